"""Canonical forms, encoding repair and sentences."""

import random

import pytest

from lemmaflow.llm import canon, mojibake, sentences


def pairs(spark, rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], "k bigint, t string, look string")
    return {tuple(r) for r in canon.alike_pairs(canon.canonical(df, "k", "t"), "k").collect()}


def test_alike_and_not_alike(spark):
    base = "Тёмный вечер сора, Anna ate é."
    rows = [
        (1, base), (2, base.replace("е", "e")), (3, base.replace(" ", " ")), (4, base.replace("ё", "ё")), (5, "Тём​ный вечер сора, Anna ate é."), (6, base.replace(",", "，")), (7, base),
        (8, base.lower()), (9, base.replace("é", "e")), (10, base + "²"), (11, base + "2"), (12, base.replace(",", ";")), (13, None), (14, ""), (15, " ​ "), (16, " "), (None, base), (1, base),
        (20, "соха"), (21, "coxa"), (22, "cоха"), (23, "coха"),
    ]
    same = [1, 2, 3, 4, 5, 6, 7]
    want = {(a, b) for a in same for b in same if a < b and (a, b) != (1, 7)}
    got = pairs(spark, rows)
    assert {p for p in got if p[1] <= 12} == want
    assert not any(k in (13, 14, 15, 16) for p in got for k in p)
    assert pairs(spark, []) == set()


def test_many_copies_make_no_pairs_among_themselves(spark):
    rows = [(n, "одно и то же") for n in range(300)] + [(1000, "одно и тo же")]
    assert pairs(spark, rows) == {(n, 1000) for n in range(300)}


def test_repair_needs_a_word_of_the_corpus(spark):
    df = spark.createDataFrame([(1, "мoлоко пьют"), (2, "молоко"), (3, "кoтофей ждёт")], "k bigint, t string")
    got = {r["k"]: r["canonical_text"] for r in canon.canonical(df, "k", "t").collect()}
    assert got == {1: "молоко пьют", 2: "молоко", 3: "кoтофей ждёт"}


def test_script_of_tokens():
    assert canon.repairs(canon.plain("clеaflur with Ｓｐａｃе")) == {"clеaflur": "cleaflur", "Spacе": "Space"}
    assert canon.repairs("В тексте a word PC стоит") == {} == canon.repairs("We saw СОН and со here")
    assert canon.repairs("жRo") == {"жRo": "жRo"}
    assert canon.repairs("слово cлово") == {"cлово": "слово"}
    assert canon.repairs("plain text") == {} and canon.repairs("просто текст") == {}
    assert canon.repair("Saicе́r", "LATIN") == "Saicér"


def test_words_of_one_script_stay_and_still_look_alike(spark):
    rows = [(1, "В тексте a word PC стоит"), (2, "We saw СОН and со here"), (3, "СОН со a РС"), (4, "В тексте а word РС стоит"), (5, "We saw COH and co here"), (6, "жRo"), (7, "жRо")]
    df = spark.createDataFrame(rows, "k bigint, t string")
    forms = canon.canonical(df, "k", "t")
    assert {r["k"]: r["canonical_text"] for r in forms.collect()} == dict(rows)
    assert {tuple(r) for r in canon.alike_pairs(forms, "k").collect()} == {(1, 4), (2, 5), (6, 7)}
    classes = {r["k"]: r for r in canon.alike_classes(forms, "k").collect()}
    assert set(classes) == {1, 2, 4, 5, 6, 7} and classes[1]["class_id"] == classes[4]["class_id"] != classes[2]["class_id"]
    assert all(r["n_looks"] == 2 and r["n_alike"] == 1 for r in classes.values())


def test_a_class_of_copies_counts_them(spark):
    rows = [(n, "одно и то же") for n in range(300)] + [(1000, "одно и тo же")]
    found = {r["k"]: r["n_alike"] for r in canon.alike_classes(canon.canonical(spark.createDataFrame(rows, "k bigint, t string"), "k", "t"), "k").collect()}
    assert found == {n: 1 for n in range(300)} | {1000: 300}


SOUND = [f"Мама мыла раму и пела песню номер {n}, потому что вечер был тихий. Затем все пошли домой спать." for n in range(60)] + [f"Der Müller und die schöne Fähre, größer als für Zug {n}. Über den Fluß führt eine Brücke." for n in range(40)]
ORIGINAL = "Вечер был тихий. Мама пела песню, потому что пошли домой."


def samples():
    by = {}
    for t in SOUND:
        by.setdefault(mojibake.language_of(t), []).append(t)
    return {k: "\n".join(v) for k, v in by.items()}


@pytest.fixture(scope="module")
def measure():
    return mojibake.Measure(samples())


@pytest.fixture(scope="module")
def ranking():
    return mojibake.Ranking(samples())


def garble(text, *chain):
    for right, wrong in chain:
        data = text.encode(right) if right != "web" else text.encode()
        high = mojibake._high(wrong)
        text = "".join(chr(b) if b < 128 else high[b - 128] for b in data)
    return text


CHAINS = [
    [("utf_8", "cp1251")], [("utf_8", "cp1252")], [("utf_8", "latin_1")], [("utf_8", "cp866")], [("utf_8", "koi8_r")],
    [("cp1251", "koi8_r")], [("cp1251", "cp866")], [("cp1251", "latin_1")], [("koi8_r", "cp1251")], [("koi8_r", "cp866")], [("cp866", "cp1251")], [("koi8_r", "latin_1")],
    [("utf_8", "cp1251"), ("utf_8", "cp1251")], [("cp1251", "latin_1"), ("utf_8", "cp1252")],
]


@pytest.mark.parametrize("chain", CHAINS, ids=str)
def test_chains_are_undone(measure, ranking, chain):
    bad = garble(ORIGINAL, *chain)
    assert mojibake.SUSPECT.search(bad) and mojibake.restore(bad, None, measure) == ORIGINAL
    gains = ranking.doubtful(["a", bad, "b"])
    assert list(gains) == [1] and mojibake.restore(bad, None, measure, ranking, gains[1]) == ORIGINAL


WORDS = "мама мыла раму пела песню потому что вечер был тихий затем все пошли домой спать".split()


@pytest.mark.parametrize("change", [str.capitalize, str.lower, str.upper], ids=["sentence", "small", "capitals"])
def test_the_first_look_loses_nothing(measure, ranking, change):
    """Random sentences in every case, garbled in every way: what packing alone restores, and that is most, the first look lets through."""
    rng = random.Random(12)
    texts = [change(" ".join(rng.choice(WORDS) for _ in range(rng.randint(5, 14)))) + "." for _ in range(25)]
    plain = looked = total = 0
    for t in texts:
        for chain in CHAINS:
            bad = garble(t, *chain)
            total += 1
            plain += mojibake.restore(bad, None, measure) == t
            looked += bool(ranking.doubtful([bad])) and mojibake.restore(bad, None, measure, ranking) == t
        assert not ranking.doubtful([t]) or mojibake.restore(t, None, measure, ranking) == t
    assert looked >= 0.99 * plain and looked >= 0.9 * total


def test_parts_and_sound_texts(measure):
    first, second = "Мама мыла раму и пела песню. ", "Затем все пошли домой спать."
    for chain in ([("utf_8", "cp1251")], [("cp1251", "latin_1")]):
        assert mojibake.restore(first + garble(second, *chain), None, measure) == first + second
    for sound in (*SOUND[::9], "São Paulo é ÑANDÚ!", "a\x90b тихий вечер", "оаткккооатоаткоаттаоко" * 9, "Moskva Мoсква"):
        assert mojibake.restore(sound, "CP1251", measure) == sound
    latin = "Über den Fluß führt eine Brücke."
    assert mojibake.restore(garble(latin, ("utf_8", "cp1252")), None, measure) == latin


def test_texts_of_one_case_leave_no_trace_and_are_restored(spark):
    small = [ORIGINAL.lower(), "я пела песню, потому что вечер был тихий. мама мыла раму и пошла спать."]
    bad = {(n, k): garble(t, chain) for n, t in enumerate(small) for k, chain in enumerate([("cp1251", "koi8_r"), ("koi8_r", "cp1251")])}
    assert not any(mojibake.SUSPECT.search(t) for t in bad.values())
    rows = [(n, t, "UTF_8") for n, t in enumerate(SOUND)] + [(1000 + 10 * n + k, t, None) for (n, k), t in bad.items()] + [(2000 + n, t, "KOI8_R") for n, t in enumerate(small)]
    df = spark.createDataFrame(rows, "k bigint, t string, e string")
    got = {r["k"]: r["restored"] for r in mojibake.repair_encodings(df, "k", "t", "e").collect()}
    want = {1000 + 10 * n + k: small[n] for n, k in bad}
    assert got == want


def test_a_chain_may_gain_at_its_second_step_only():
    first, second = ("cp1251", "koi8_r"), ("cp1251", "cp866")
    costs = {garble("Вечер", first, second): 20.0, garble("Вечер", first): 16.0, "Вечер": 5.0}
    assert len(costs) == 3 and mojibake.restore(garble("Вечер", first, second), None, lambda t: costs.get(t, 30.0)) == "Вечер"


def test_samples_are_whole_texts(spark):
    text = "Мама мыла раму. " * 200 + "Конец."
    df = spark.createDataFrame([(1, text), (2, text)], "k bigint, t string")
    assert mojibake.sample_texts(df, "k", "t") == {"ru": f"\n{text}\n{text}"}


def test_every_sound_text_is_learned_from(spark):
    texts = [f"Мама мыла раму и пела песню номер {n}, потому что вечер был тихий." for n in range(1000)]
    df = spark.createDataFrame([*enumerate(texts), (None, "Лишняя строка без ключа, её никто не считает."), (2000, "Домик")], "k bigint, t string").repartition(5)
    samples, counts = mojibake.learn(df, "k", "t")
    assert sorted(samples["ru"].split("\n")) == sorted(["", "Домик", *texts])
    number, size = mojibake._letters()
    assert counts["ru"].sum() == sum(len(t) + 1 for t in [*texts, "Домик"])
    assert counts["ru"][number[ord("М")] * size + number[ord("а")]] == 1000


def test_a_large_language_gives_the_words_that_save_most(spark, monkeypatch):
    from collections import Counter

    monkeypatch.setattr(mojibake, "DICTIONARY_CHARS", 700)
    rng = random.Random(4)
    texts = [" ".join(f"слово{rng.choice('абвгд')}{int(rng.expovariate(0.05))}" for _ in range(12)) + "." for _ in range(3000)]
    texts = [t.capitalize() for t in texts]
    samples, _ = mojibake.learn(spark.createDataFrame([*enumerate(texts)], "k bigint, t string").repartition(7), "k", "t")
    found = Counter(w for t in texts for w in t.split(" "))
    best = sorted(found, key=lambda w: (-(found[w] - 1) * (len(w.encode()) - 3) / (len(w) + 1), w.encode()))
    room, want = 700, []
    for w in best:
        room -= len(w) + 1
        if room < 0:
            break
        want.append(w)
    assert samples == {"ru": " ".join(want[::-1])}


def test_soundness_of_a_batch_equals_that_of_each_text():
    rng = random.Random(8)
    texts = ["".join(rng.choice("aбВÀñЂ¤─\x85 .\nўіАZзё÷😀?�") for _ in range(rng.randint(1, 9))) for _ in range(5000)] + SOUND
    want = [None if mojibake.SUSPECT.search(t) or mojibake._one_case(t) or mojibake.is_lost(t) else mojibake.language_of(t) for t in texts]
    assert mojibake.Tally().sound(texts)[0] == want and len(set(want)) > 5


def test_lost():
    assert mojibake.is_lost("Ве�ер") and mojibake.is_lost("??? ????? ??") and mojibake.is_lost("sch?n")
    assert not mojibake.is_lost("Что?! Да??? Нет? http://a.b/?q=1 ok") and not mojibake.is_lost("")


def test_repair_of_a_table(spark):
    rows = [(n, t, "UTF_8", "x") for n, t in enumerate(SOUND)]
    rows += [(900, garble(ORIGINAL, ("utf_8", "cp1251")), "UTF_8", "x"), (901, "????? ??? ????", None, "x"), (902, None, None, "x"), (903, "", None, "x"), (900, garble(ORIGINAL, ("utf_8", "cp1251")), "UTF_8", "y"), (None, "�", None, "x")]
    df = spark.createDataFrame(rows, "k bigint, t string, e string, restored string")
    got = {(r["k"], r["restored"], r["lost"]) for r in mojibake.repair_encodings(df, "k", "t", "e").collect()}
    assert got == {(900, ORIGINAL, False), (901, None, True)}
    assert mojibake.repair_encodings(df.limit(0), "k", "t", "e").count() == 0


def corpus():
    rng = random.Random(1)
    nouns = "стол дом лес река город школа книга окно дверь улица".split()
    out = []
    for n in range(700):
        parts = []
        for _ in range(rng.randint(2, 6)):
            w = [rng.choice(nouns) for _ in range(5)]
            parts.append(
                rng.choice([
                    f"{w[0].title()} {w[1]} и {w[2]} в 19{rng.randint(10, 99)} г. {w[3]} {w[4]}.", f"{w[0].title()} на ул. {w[1].title()} около {w[2]}.", f"{w[0].title()}, {w[1]} и др.",
                    f"{w[0].title()} и проф. {w[1].title()} читает {w[2]}.", f"{w[0].title()} {w[1]}?", f"«{w[0].title()} {w[1]}!» — сказал {w[2]}.", f"{w[0].title()} на рис. {rng.randint(1, 99)} и {w[3]}…",
                ])
            )
        out.append((n, " ".join(parts), "ru", parts))
    return out


def test_learned_abbreviations(spark):
    rows = corpus()
    df = spark.createDataFrame([(k, t, l, 0) for k, t, l, _ in rows] + [(9000, None, "ru", 0), (9001, " \n ", None, 0), (9002, "", "ru", 0)], "doc_id bigint, text string, lang string, sent_start int")
    got = {}
    for r in sentences.split_sentences(df).collect():
        got.setdefault(r["doc_id"], []).append((r["sent_start"], r["sent_end"]))
    assert set(got) == {k for k, *_ in rows}
    right = total = 0
    for k, text, _, parts in rows:
        total += len(parts)
        right += len({text[a:b] for a, b in got[k]} & set(parts))
    assert right / total > 0.98
    assert sentences.split_sentences(df.limit(0)).count() == 0


def cut(text, model=None):
    return [text[a:b] for a, b in sentences.spans(text, model or sentences.Model())]


def test_words_are_counted_in_whole_texts():
    from collections import Counter

    out = Counter()
    sentences.period_counts("Он шёл домой. " * 100 + "Потом она снова поёт.", out)
    assert out["шёл"] == 100 and out["она"] == out["снова"] == 1


def test_starters_of_low_rank_are_kept(spark):
    letters = "абвгдежзик"
    name = lambda n: "".join(letters[int(d)] for d in f"{n:04d}")
    rows = [(f"Что? {name(n).title()} дом, " + f"он {name(n)} дом, " * 60, "ru") for n in range(2200) for _ in range(8)]
    rows += [("Что? Щука дом.", "ru")] * 7
    got = sentences.learn(spark.createDataFrame(rows, "t string, l string").repartition(4), "t", "l")["ru"]
    assert got.starters == {"щука"}


def test_languages_are_guessed_from_whole_texts():
    german, russian = sentences.Model(), sentences.Model()
    german.profile, russian.profile = {"und", "der"}, {"и", "дом"}
    text = "1 2 3 4 5\n" * 190 + "und der " * 12 + "\n\n" + "дом и дом " * 300
    assert sentences.guess(text, {"de": german, "ru": russian}) == "ru"


def test_pairs_and_words_of_any_length(spark):
    rng = random.Random(9)
    nouns = "стол дом лес река город школа книга окно дверь улица".split()
    w = lambda: rng.choice(nouns)
    rows = []
    for n in range(900):
        parts = [f"{w().title()} {w()} и {w()}.", f"{w().title()} и Dipl.-Ing. {w().title()} {w()}.", f"{w().title()} и деньгами. {w()}.", f"{w().title()} {w()} деньгами."]
        parts += [f"{w().title()} у деньгами. Врыгола {w()}."] * (n % 3 == 0)
        rng.shuffle(parts)
        rows.append((" ".join(parts), "ru"))
    model = sentences.learn(spark.createDataFrame(rows, "t string, l string"), "t", "l")["ru"]
    assert "деньгами врыгола" in model.pairs and model.ends["dipl.-ing"] < sentences.SURELY_NOT
    assert cut("Дом и Dipl.-Ing. Лес стол. Стол у деньгами. Врыгола дом. Стол и лес. Река.", model) == ["Дом и Dipl.-Ing. Лес стол.", "Стол у деньгами. Врыгола дом.", "Стол и лес.", "Река."]


def test_ratios_of_columns_equal_the_others(spark):
    rng = random.Random(5)
    rows = [(min(a, b), max(a, b), min(c, d), max(c, d)) for a, b, c, d in ([rng.choice([0, 1, 2, 7, 50, 900]) for _ in range(4)] for _ in range(300))]
    df = spark.createDataFrame(rows, "a bigint, b bigint, c bigint, d bigint")
    for r in df.withColumn("x", sentences.ratio_column(df.a, df.b, df.c, df.d)).collect():
        assert r.x == pytest.approx(sentences.ratio(r.a, r.b, r.c, r.d), abs=1e-6)


def test_marks_of_many_scripts():
    assert cut("今天很好。明天呢？“好！”他说") == ["今天很好。", "明天呢？", "“好！”", "他说"]
    assert cut("「行く？」と聞いた。はい……そう。") == ["「行く？」と聞いた。", "はい……", "そう。"]
    assert cut("हम आए। रु. 5 है? हाँ!") == ["हम आए।", "रु. 5 है?", "हाँ!"]
    assert cut("ԱԲ գ՞ դ։ Եզ։") == ["ԱԲ գ՞ դ։", "Եզ։"]
    assert cut("ሰላም። ዓ.ም. ነው፧ አዎ") == ["ሰላም።", "ዓ.ም. ነው፧", "አዎ"]
    assert cut("สวัสดีv1.5ครับ ไปไหน\nมา") == ["สวัสดีv1.5ครับ", "ไปไหน", "มา"]
    assert cut("Πού; Εδώ. Ναι!") == ["Πού;", "Εδώ.", "Ναι!"]
    assert cut("هل؟ نعم. لا!") == ["هل؟", "نعم.", "لا!"]


def test_quotes_breaks_and_lists():
    assert cut("«Кто там?» — спросил он. «Я!» Дом.") == ["«Кто там?» — спросил он.", "«Я!»", "Дом."]
    assert cut("“Who?” asked Al. He (why?) left (now!).") == ["“Who?” asked Al.", "He (why?) left (now!)."]
    assert cut("Heading\n\nOne line\nmore of it. Next… and on... End") == ["Heading", "One line\nmore of it.", "Next… and on...", "End"]
    assert cut("1. First item.\n2. Second item.") == ["1. First item.", "2. Second item."]
    assert cut("It costs 3.50 at a.b.org today.Then more.\r\n\r\nX") == ["It costs 3.50 at a.b.org today.", "Then more.", "X"]
    assert cut("  ") == [] and cut("") == [] and cut("!!! Yes") == ["!!!", "Yes"]


def test_spans_are_in_order_and_lose_nothing():
    rng = random.Random(3)
    for _ in range(2000):
        text = "".join(rng.choice("aБ1 .!?…\n«»\"(),—;。と」ก ") for _ in range(rng.randint(0, 40)))
        found = sentences.spans(text, sentences.Model())
        covered, at = "", 0
        for a, b in found:
            assert at <= a < b and not text[a].isspace() and not text[b - 1].isspace()
            covered += text[a:b]
            at = b
        assert "".join(covered.split()) == "".join(text.split())


def test_degenerate_texts_take_linear_time(measure):
    import time
    from collections import Counter

    began = time.monotonic()
    for text in (" " * 200_000, "\n" * 200_000, "?" * 100_000, "." * 100_000, "б" * 300_000, "aб" * 50_000):
        sentences.spans(text, sentences.Model())
        sentences.period_counts(text, Counter())
        mojibake.is_lost(text)
        mojibake.restore(text, None, measure)
        canon.repairs(canon.plain(text))
    assert time.monotonic() - began < 60
