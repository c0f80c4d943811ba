"""Native text functions, parsing, alignment and tokens."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lemmaflow.errors import InvalidOptions, ParseError, TokenizationError
from lemmaflow.functions import charclass
from lemmaflow.functions import text as T
from lemmaflow.operators import lemmas
from lemmaflow.operators.analyze import analyze_text, postings_of, preparation_issues, prefix, reader_chunks, units
from lemmaflow.operators.parse import align, parse_tokens
from lemmaflow.operators.tokens import Tokenizer, select_lemmas, to_utf16
from lemmaflow.options import AnalysisOptions, AnalyzerOptions, ExecutionMode, LemmaPolicy, OversizedPolicy, PoolOptions, PositionPolicy, TokenizerOptions, UnmatchedPolicy

PLAIN, SEARCH, ENTITIES = TokenizerOptions.conservative(), TokenizerOptions.search(), TokenizerOptions.entity_aware()


def shown(tokens):
    return [(t, k) for t, _, _, k, _ in tokens if t.strip()]


def test_prepare_and_issues(spark):
    cases = {
        "a\U0001F600b": ("a\U0001F600b", []),
        "a\u0000b\nc": ("a b\nc", [("CONTROL_CHARACTER", 1, 1)]),
        "a\U0010FFFFb\uFDD0c": ("a b c", [("NONCHARACTER", 1, 2), ("NONCHARACTER", 4, 1)]),
        "": ("", []),
        "\x85\x07": ("  ", [("CONTROL_CHARACTER", 0, 1), ("CONTROL_CHARACTER", 1, 1)]),
        None: (None, None),
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    for t, p, i in df.select("t", T.prepare(F.col("t")), T.preparation_issues(F.col("t"))).collect():
        want, issues = cases[t]
        assert p == want
        assert (i is None) if issues is None else [(x["type"], x["offset"], x["length"]) for x in i] == issues
    line = spark.createDataFrame([("a\r\nb\nc",)], "t string").select(T.prepare(F.col("t"), True), T.preparation_issues(F.col("t"), True)).first()
    assert line[0] == "a  b c" and [x["offset"] for x in line[1]] == [1, 2, 4]
    assert T.prepare_utf16("a\ud83db".encode("utf-16-be", "surrogatepass")) == ("a\ufffdb", [("UNPAIRED_SURROGATE", "Unpaired high surrogate", 1, 1)])


def test_python_and_native_preparation_agree(spark):
    rng = random.Random(3)
    texts = ["".join(chr(rng.choice([rng.randrange(0xD800), rng.randrange(0xE000, 0x110000), rng.randrange(0x100)])) for _ in range(12)) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.prepare(F.col("t"), True).alias("p"), T.preparation_issues(F.col("t"), True).alias("i"))
    for r in df.collect():
        safe, issues = preparation_issues(r["t"])
        at = to_utf16(r["t"])
        assert safe == r["p"] and [(k, m, at(o)) for k, m, o in issues] == [(x["type"], x["message"], x["offset"]) for x in r["i"]]


def test_grammar(spark):
    cases = {
        "S,жен,од=им,ед": ("S", ["жен", "од"], [["ед", "им"]]),
        "A=вин,ед,полн,муж,неод|им,ед,полн,муж": ("A", [], [["вин", "ед", "муж", "неод", "полн"], ["ед", "им", "муж", "полн"]]),
        "S,жен=(пр,ед|пр,мн)": ("S", ["жен"], [["ед", "пр"], ["мн", "пр"]]),
        "S=(a)|(b)": ("S", [], [["a"], ["b"]]),
        "PR=": ("PR", [], [[]]), "": (None, [], [[]]), "S=|": ("S", [], []), None: (None, [], [[]]), "(|=,,)": ("(|", [], [[]]), "S=a=b|": ("S", [], [["a=b"]]),
    }
    df = spark.createDataFrame([(g,) for g in cases], "g string").select("g", T.parse_grammar(F.col("g")).alias("x")).select("g", "x", T.all_grammemes(F.col("x")).alias("all"))
    for r in df.collect():
        x = r["x"]
        assert (x["pos"], x["common"], x["variants"]) == cases[r["g"]], r["g"]
        assert r["all"] == sorted({*x["common"], *(y for v in x["variants"] for y in v)})


def test_lemmas(spark):
    rows = [
        (1, [("a", 0.2), ("b", 0.8), ("c", 0.1)]), (2, [("x", None), ("y", None)]), (3, [("x", 0.5), ("y", 0.5)]), (4, [("", 0.9), ("x", 0.1), ("x", None)]), (5, []), (6, None), (7, [(None, 1.0)]),
    ]
    df = spark.createDataFrame(rows, "k int, a array<struct<lemma:string,weight:double>>")
    got = {r["k"]: (r["all"], r["best"]) for r in df.select("k", lemmas.all_lemmas(F.col("a")).alias("all"), lemmas.best_lemma(F.col("a")).alias("best")).collect()}
    assert got == {1: (["a", "b", "c"], "b"), 2: (["x", "y"], "x"), 3: (["x", "y"], "x"), 4: (["x"], "x"), 5: ([], None), 6: ([], None), 7: ([], None)}


def test_parse():
    assert parse_tokens('[{"text":"a","analysis":[{"lex":"b","gr":"S","wt":1}]}]\n[{"text":1}]') == [("a", [{"lemma": "b", "gr": "S", "weight": 1.0}]), ("", [])]
    assert parse_tokens("[]") == []
    assert parse_tokens('[{"text":123,"analysis":[{"lex":false,"gr":[],"wt":"bad"}]}]') == [("", [{"lemma": "", "gr": "", "weight": None}])]
    assert parse_tokens('[{"text":"\\ud83d"}]')[0][0] == "\ufffd"
    for bad in ("", "{}", '[{"text":"x"}', "[[]]", '[{"analysis":[[]]}]', "[NaN]", "[] x", '{"text":"text"}'):
        with pytest.raises(ParseError, match="line 1, column"):
            parse_tokens(bad)


def test_random_noise_only_raises_the_parser_error():
    rng = random.Random(1)
    for _ in range(2000):
        noise = "".join(rng.choice('[]{}",:\\ntfe0123 "text"') for _ in range(rng.randrange(60)))
        try:
            parse_tokens(noise)
        except ParseError:
            pass


def spans(text, tokens):
    return [(s, e) for _, s, e, _ in align(text, [(t, []) for t in tokens])[0]]


def test_alignment():
    assert spans("Мама, мама.", ["Мама", "мама"]) == [(0, 4), (6, 10)]
    assert spans("О\u00adд\u00adи\u00adн", ["Один"]) == [(0, 7)]
    assert spans("a \u00adодин", ["один"]) == [(3, 7)]
    assert spans("x о\u00adдин один", ["один"]) == [(8, 12)]
    assert spans("\u00adо\u00adн", ["он"]) == [(0, 4)]
    tokens, issues = align("мама", [("папа", []), ("", []), ("мама", [])])
    assert [(s, e) for _, s, e, _ in tokens] == [(-1, -1), (0, 0), (0, 4)] and issues[0][0] == "UNMATCHED_TOKEN" and issues[0][2:] == (0, 4)


def test_suffixes_and_composites():
    text = "Раз++ два# C++ 10#"
    got = Tokenizer(ENTITIES).tokenize(text, [("Раз", 0, 3, [("раз++", None)]), (" ", 5, 6, []), ("два", 6, 9, [("два#", None)]), ("C", 11, 12, []), ("10#", 15, 18, [])])
    assert [(t, f) for t, _, _, _, f in got if t != " "] == [
        ("Раз++", [("раз++", True), ("раз", True)]), ("два#", [("два#", True), ("два", True)]), ("C++", [("c++", False), ("c", False)]), ("10#", [("10#", True), ("10", True)]),
    ]
    got = Tokenizer(ENTITIES).tokenize("A https://example.com, me@example.com!")
    assert shown(got) == [("A", "WORD"), ("https://example.com", "URL"), (",", "OTHER"), ("me@example.com", "EMAIL"), ("!", "OTHER")]
    assert shown(Tokenizer(ENTITIES).tokenize("http://me@example.com"))[0] == ("http", "WORD")
    assert shown(Tokenizer(PLAIN).tokenize("10# $ https://example.com"))[:3] == [("10#", "WORD"), ("$", "OTHER"), ("https", "WORD")]
    assert [f for f, _ in Tokenizer(ENTITIES).tokenize("€")[0][4]] == ["€", "евро", "euro", "欧元", "eur"]
    assert Tokenizer(ENTITIES).tokenize("cafe\u0301")[0][4] == [("cafe", False)]
    assert shown(Tokenizer(PLAIN).tokenize("123Привет abc123")) == [("123", "WORD"), ("Привет", "WORD"), ("abc123", "WORD")]
    whole = [(w, 0, len(w), []) for w in ("123Привет", "2,20", "50%")]
    assert [Tokenizer(ENTITIES).tokenize(w, [t])[0][3] for (w, *_), t in zip(whole, whole)] == ["WORD", "OTHER", "OTHER"]


def test_overlaps_policies_and_errors():
    got = Tokenizer(SEARCH).tokenize("мама мама", [("мама", 0, 4, []), ("мама", 0, 4, [])])
    assert [(s, e) for _, s, e, k, _ in got if k == "WORD"] == [(0, 4), (5, 9)]
    assert shown(Tokenizer(SEARCH).tokenize("text", [("x", -1, -1, [])])) == [("text", "WORD")]
    with pytest.raises(TokenizationError):
        Tokenizer(TokenizerOptions(unmatched=UnmatchedPolicy.FAIL)).tokenize("text", [("x", -1, -1, [])])
    with pytest.raises(TokenizationError):
        Tokenizer(SEARCH).tokenize("x", [("x", 0, 2, [])])
    best = TokenizerOptions(lemmas=LemmaPolicy.BEST_WEIGHT)
    assert Tokenizer(best).tokenize("замок", [("замок", 0, 5, [("a", 0.2), ("замокнуть", 0.8), ("c", 0.1)])])[0][4] == [("замокнуть", True)]
    assert Tokenizer(best).tokenize("тест", [("тест", 0, 4, [("первый", None), ("b", None)])])[0][4] == [("первый", True)]


def test_tokens_cover_any_text():
    rng = random.Random(7)
    letters = "ab Я1#+.@:/$€元\"'\u00ad\u0301\n\u00a0\U0001F600中"
    for options in (PLAIN, SEARCH, ENTITIES):
        t = Tokenizer(options)
        for _ in range(1500):
            text = "".join(rng.choice([rng.choice(letters), "://"]) for _ in range(rng.randrange(20)))
            got = t.tokenize(text)
            assert "".join(x[0] for x in got) == text
            assert all(text[s:e] == x and f for x, s, e, _, f in got)


def test_classes():
    assert 0xA0 not in charclass.members("S") and 0xAD in charclass.members("S") & charclass.members("W")
    assert ord("元") in charclass.members("C") and ord("元") in charclass.members("W")


def test_chunks_and_limits():
    assert [(a, b) for a, b in reader_chunks("Alpha Beta Gamma", 8)] == [(0, 6), (6, 11), (11, 16)]
    assert reader_chunks("\U0001F600 A", 1) == [(0, 1), (1, 2), (2, 3)]
    assert reader_chunks("", 5) == []
    assert prefix("A\U0001F600B", 2) == "A" and units("A\U0001F600") == 3
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice("ab \n\U0001F600") for _ in range(rng.randrange(40)))
        limit = rng.randrange(2, 9)
        cut = reader_chunks(text, limit)
        assert "".join(text[a:b] for a, b in cut) == text and all(units(text[a:b]) <= limit for a, b in cut)
    fail, short = AnalysisOptions(max_input_chars=4, max_chunk_chars=4), AnalysisOptions(max_input_chars=4, max_chunk_chars=4, oversized=OversizedPolicy.TRUNCATE)
    with pytest.raises(InvalidOptions):
        analyze_text("12345", None, Tokenizer(PLAIN), fail)
    cut = analyze_text("Alpha", None, Tokenizer(PLAIN), short)
    assert [t[0] for t in cut.tokens] == ["Alph"] and cut.final == 5


def test_positions():
    found = analyze_text("A B, ", None, Tokenizer(PLAIN), AnalysisOptions())
    rows, left = postings_of(found.tokens, PositionPolicy.COMPACT)
    assert [(r[0], r[5], r[6]) for r in rows] == [("a", 1, 0), ("b", 1, 1)] and left == 0
    rows, left = postings_of(found.tokens, PositionPolicy.PRESERVE)
    assert [(r[0], r[5], r[6]) for r in rows] == [("a", 1, 0), ("b", 2, 2)] and left == 2


def test_options():
    for bad in (
        lambda: TokenizerOptions(expand_currency_forms=True), lambda: AnalysisOptions(max_input_chars=0), lambda: AnalysisOptions(max_input_chars=5, max_chunk_chars=6),
        lambda: AnalyzerOptions(merge_word_forms=True), lambda: AnalyzerOptions(sentence_markers=True), lambda: AnalyzerOptions(filter_grammar=" "),
        lambda: AnalyzerOptions(new_line_each_word=True).check_for(ExecutionMode.SESSION), lambda: PoolOptions(max_size=0), lambda: PoolOptions(max_size=1, warmup=2),
    ):
        with pytest.raises(InvalidOptions):
            bad()
    full = AnalyzerOptions(True, True, True, True, True, True, True, disambiguate=True, english_grammemes=True, filter_grammar="S", fixlist="f", generate_all=True, weight=True)
    assert " ".join(full.arguments()) == "-n -c -w -l -i -g -s -e utf-8 -d --eng-gr --filter-gram S --fixlist f --format json --generate-all --weight"


def test_jvm_class_has_the_same_members(spark):
    for name in "WNC":
        members = charclass.members(name)
        points = [cp for cp in range(0x3100) if not 0xD800 <= cp < 0xE000] + [0x1F600, 0x1D165, 0x10FFFF]
        df = spark.createDataFrame([(cp, chr(cp)) for cp in points], "cp int, c string")
        got = {r["cp"] for r in df.where(F.col("c").rlike(f"^[{charclass.java_class(name)}]$")).collect()}
        assigned = {cp for cp in points if __import__("unicodedata").category(chr(cp)) != "Cn"}
        odd = (got ^ {cp for cp in points if cp in members}) & assigned
        assert len(odd) < 60, sorted(map(hex, odd))[:20]  # characters that one side's Unicode tables lack


@given(st.lists(st.tuples(st.sampled_from(["", "a", "b", "c"]), st.sampled_from([None, 0.1, 0.5, 0.9])), max_size=6))
@settings(max_examples=300, deadline=None)
def test_lemma_policies_by_definition(analyses):
    filled = [x for x in analyses if x[0]]
    assert select_lemmas(analyses, LemmaPolicy.ALL) == [x for n, x in enumerate(f[0] for f in filled) if x not in [f[0] for f in filled[:n]]]
    top = max((w for _, w in filled if w is not None), default=None)
    assert select_lemmas(analyses, LemmaPolicy.BEST_WEIGHT) == ([] if not filled else [next(t for t, w in filled if w == top)])


def test_native_and_tokenizer_lemmas_agree(spark):
    import itertools

    cases = [list(c) for n in range(4) for c in itertools.product([("", 0.9), ("a", None), ("b", 0.5), ("a", 0.5), ("c", 0.1)], repeat=n)]
    df = spark.createDataFrame([(n, c) for n, c in enumerate(cases)], "k int, a array<struct<lemma:string,weight:double>>")
    for r in df.select("k", lemmas.all_lemmas(F.col("a")).alias("all"), lemmas.best_lemma(F.col("a")).alias("best")).collect():
        assert list(r["all"]) == select_lemmas(cases[r["k"]], LemmaPolicy.ALL)
        assert ([r["best"]] if r["best"] is not None else []) == select_lemmas(cases[r["k"]], LemmaPolicy.BEST_WEIGHT)
