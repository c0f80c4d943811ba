"""Encoding against a public tokenizer library, leaks against brute force."""

import random

import numpy as np
import pytest

from lemmaflow.llm import bpe, leaks

tiktoken = pytest.importorskip("tiktoken")
regex = pytest.importorskip("regex")
LETTERS = "abcdefghijklmnoprstuy еаинтсроl  \x00é😀中0123'!<|>\n\t"


@pytest.fixture(scope="module")
def encoder():
    return bpe.TrieEncoder(bpe.default_vocabulary())


@pytest.fixture(scope="module")
def other(encoder):
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=encoder.rank, special_tokens={})


def test_ids_equal_the_library(encoder, other):
    rng = random.Random(3)
    texts = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(1, 40))) for _ in range(4000)]
    texts += ["a" * k for k in range(1, 80)] + ["<|endoftext|> ordinary", "the " * 500, "Привет, мир! " * 50, "語" * 3000]
    got = bpe.encode_texts(texts, encoder, regex.compile(bpe.PATTERN))
    for t, ids in zip(texts, got):
        assert np.frombuffer(ids, np.int32).tolist() == other.encode_ordinary(t), t[:80]


def test_every_vocabulary_entry_is_its_own_encoding(encoder, other):
    for text, i in list(encoder.rank.items())[::97]:
        try:
            word = text.decode()
        except UnicodeDecodeError:
            continue
        pieces = regex.compile(bpe.PATTERN).findall(word)
        if len(pieces) == 1:
            assert np.frombuffer(bpe.encode_texts([word], encoder, regex.compile(bpe.PATTERN))[0], np.int32).tolist() == other.encode_ordinary(word)


def test_forgetting_changes_nothing(encoder, monkeypatch):
    pattern = regex.compile(bpe.PATTERN)
    first = bpe.encode_texts(["one two", "two three"], encoder, pattern)
    monkeypatch.setattr(bpe, "REMEMBER", 0)
    assert bpe.encode_texts(["one two", "two three"], encoder, pattern) == first


def test_empty_null_and_clashing(spark):
    df = spark.createDataFrame([(1, "Hi there", "x"), (2, "", "x"), (3, None, "x"), (1, "Hi there", "y"), (None, "a", "z")], "doc_id bigint, text string, ids string")
    rows = [(r["doc_id"], r["ids"]) for r in bpe.encode(df).collect()]
    assert sorted(rows, key=str) == sorted([(1, [17250, 612]), (2, []), (3, []), (1, [17250, 612]), (None, [64])], key=str)
    assert bpe.encode(df.limit(0)).collect() == []


def brute(docs, items, least):
    out = set()
    for d, text in docs:
        w = leaks.words(text)
        for i, item in items:
            x = leaks.words(item)
            n = min(least, len(x))
            if n and any(w[a : a + n] == x[b : b + n] for a in range(len(w) - n + 1) for b in range(len(x) - n + 1)):
                out.add((d, i))
    return out


def test_leaks_against_brute_force(spark):
    rng = random.Random(11)
    make = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    items = [(i, make(rng.choice([1, 2, 3, 5, 9, 14]))) for i in range(25)] + [(90, None), (91, ""), (92, "!?"), (93, "a b c a b"), (94, "a b c a b")]
    docs = [(d, make(rng.randint(0, 40))) for d in range(60)] + [(70, None), (71, "")]
    ddf = spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id bigint, text string, item_id int")
    idf = spark.createDataFrame(items, "item_id bigint, item_text string")
    for least in (4, 6):
        got = {(r["doc_id"], r["item_id"]) for r in leaks.find_leaks(ddf, idf, least=least).collect()}
        assert got == brute(docs, items, least)
    assert leaks.find_leaks(ddf, idf.limit(0)).count() == 0 and leaks.find_leaks(ddf.limit(0), idf).count() == 0


def test_blocks_of_items_find_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "x a b c d y"), (2, "e f g")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "a b c d"), (2, "e f g")], "item_id bigint, item_text string")
    monkeypatch.setattr(leaks, "BLOCK_WORDS", 3)
    assert sorted((r[0], r[1]) for r in leaks.find_leaks(docs, items, least=4).collect()) == [(1, 1), (2, 2)]


def test_looks_make_no_difference():
    a = "Straße MOСKBA été со­бака ﬁn"
    b = "STRASSE москва ÉTÉ собака ＦＩＮ"
    assert leaks.words(a) == leaks.words(b)
    assert leaks.words("a_b, c​d 12.5") == ["a", "b", "cd", "12", "5"]


def test_spans_lie_on_the_words():
    rng = random.Random(4)
    for _ in range(500):
        text = "".join(rng.choice("aBß é́­_1.ﬁ​\nЯ") for _ in range(rng.randint(0, 25)))
        spans = leaks.word_spans(text)
        assert ["".join(leaks.words(text[a:b])) for a, b in spans] == leaks.words(text)


def test_leaked_runs_are_cut_out(spark):
    docs = spark.createDataFrame([(1, "Keep this. A b, c D! And this here too."), (2, "a b c d"), (3, "nothing")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "a b c d")], "item_id bigint, item_text string")
    got = {r["doc_id"]: (r["clean_text"], r["removed_words"]) for r in leaks.remove_leaks(docs, items, least=4).collect()}
    assert got == {1: ("Keep this. ! And this here too.", 4), 2: (None, 4)}


def test_runs_of_all_blocks_are_cut_at_once(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "Keep a b c d this e f g h too, and much more of it."), (2, "a b c d x y e f g h"), (3, "a b c d e f g h i am here still, so it goes on and on."), (1, "Keep a b c d this e f g h too, and much more of it."), (4, "no")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "a b c d"), (2, "e f g h"), (3, "c d e f g")], "item_id bigint, item_text string")
    want = None
    for size in (500_000, 3):
        monkeypatch.setattr(leaks, "BLOCK_WORDS", size)
        got = sorted((r["doc_id"], r["clean_text"], r["removed_words"]) for r in leaks.remove_leaks(docs, items, least=4).collect())
        assert got == (want := want or got)
    one = (1, "Keep  this  too, and much more of it.", 8)
    assert want == [one, one, (2, None, 8), (3, " i am here still, so it goes on and on.", 8)]
