"""Packed values and nested records, against plain versions and edge cases."""

import json
import random

from lemmaflow.operators.nested import Index, flatten, flatten_batch
from lemmaflow.operators.packed import best_path, expected, segments, split_packed, weight


def values(spark, rows, **more):
    df = spark.createDataFrame(rows, "gr_id bigint, raw string, value_pos string, k int").drop()
    out = split_packed(df, **more).orderBy("gr_id", "value_pos").collect()
    return [(r["gr_id"], r["value_pos"], r["value"]) for r in out]


def test_delimiters_quotes_and_repeats(spark):
    rows = [
        (1, 'S, муж, "гео, топоним"=(им,ед|вин,ед)', "clash", 1),
        (2, 'S муж "так ""наз""" неод=«дат» ед', None, 2),
        (3, "V|несов|нп|3-л,", "", 3),
        (3, "V|несов|нп|3-л,", "", 4),
        (4, None, None, None), (5, "  ", None, None), (6, "(|=,,)", None, None), (7, "", None, None),
        (None, "A", None, None), (8, 'S,"муж', None, None), (9, "S/сред 'имя/отчество'", None, None),
    ]
    got = {}
    for k, n, v in values(spark, rows):
        got.setdefault(k, []).append((n, v))
    assert got[1] == list(enumerate(["S", "муж", "гео, топоним", "им", "ед", "вин", "ед"]))
    assert got[2] == list(enumerate(["S", "муж", 'так "наз"', "неод", "дат", "ед"]))
    assert got[3] == list(enumerate(["V", "несов", "нп", "3-л"]))
    assert got[8] == list(enumerate(["S", "муж"]))
    assert got[9] == list(enumerate(["S", "сред", "имя/отчество"]))
    assert set(got) == {1, 2, 3, 8, 9}


def test_empty_table(spark):
    assert values(spark, []) == []


def column(*groups):
    """Rows of a column: each of the texts as often as is said."""
    return [(n, raw, "", 0) for n, raw in enumerate(raw for raw, times in groups for _ in range(times))]


def test_the_column_tells_which_words_stay_together(spark):
    rows = column(("S;часть речи;муж", 40), ("S;ед муж", 40), ("S;ед;муж", 40), ("S;вид глагола", 9), ("S;один раз", 1), ("V;собств имя нарицат сущ", 20))
    got = {v for _, _, v in values(spark, rows)}
    assert got == {"S", "V", "часть речи", "муж", "ед", "вид глагола", "один", "раз", "собств имя нарицат сущ"}


def test_rounds_of_learning_change_the_split(spark):
    rows = column(("S;ед что", 100), ("S;ед", 60))
    assert "ед что" in {v for _, _, v in values(spark, rows, rounds=0)}
    assert {v for _, _, v in values(spark, rows)} == {"S", "ед", "что"}


def test_words_with_many_partners_part_without_any_certain_value(spark):
    rows = column(*((f"{a} {b}", 3) for a in ("S", "V", "A", "ADV", "NUM") for b in ("ед", "мн", "муж", "жен", "сред")))
    assert {v for _, _, v in values(spark, rows)} == {"S", "V", "A", "ADV", "NUM", "ед", "мн", "муж", "жен", "сред"}


def test_a_very_long_field(spark):
    rows = column((" ".join(f"w{n % 100}" for n in range(600)), 1), ("S;часть речи;муж", 40), ("S;собств имя сущ;муж", 40), ("S;вид глагола муж", 30))
    got = values(spark, rows)
    assert {v for k, _, v in got if k > 0} == {"S", "часть речи", "муж", "собств имя сущ", "вид глагола"}
    assert " ".join(v for k, _, v in got if k == 0) == " ".join(f"w{n % 100}" for n in range(600))


def test_lattice():
    edges = [dict(i=0, j=1, value="a", w=-0.7), dict(i=1, j=2, value="b", w=-0.7), dict(i=0, j=2, value="a b", w=-1.6)]
    assert best_path(edges) == ["a", "b"]
    counts = {v: c for v, _, c in expected(edges)}
    assert abs(counts["a"] + counts["a b"] - 1) < 1e-9 and counts["a"] == counts["b"]
    long = [dict(i=n, j=m, value=f"v{n} {m}", w=-14.0 * (m - n)) for n in range(3000) for m in (n + 1, n + 2) if m <= 3000]
    assert len(best_path(long)) == 3000 and abs(sum(c * k for _, k, c in expected(long)) - 3000) < 1e-6
    assert segments("«a, b» c") == [("a, b", True), ("c", True)]
    assert weight(2, 9.5, 10, 0.0) > weight(2, 9.5, 10, 3.0) > weight(2, 9.5, 2, 3.0)


def as_list(x):
    return x if isinstance(x, list) else [x] if isinstance(x, dict) else []


def plain_paths(i, body):
    try:
        x = json.loads(body, parse_constant=lambda _: 1 / 0)
    except (ValueError, ZeroDivisionError):
        return
    tokens = as_list(x.get("tokens")) if isinstance(x, dict) else []
    if not tokens:
        yield i, -1, -1, -1
    for t, token in enumerate(tokens):
        analyses = as_list(token.get("analyses")) if isinstance(token, dict) else []
        if not analyses:
            yield i, t, -1, -1
        for a, analysis in enumerate(analyses):
            grammar = analysis.get("grammar") if isinstance(analysis, dict) else None
            variants = as_list(grammar.get("variants")) if isinstance(grammar, dict) else []
            if not variants:
                yield i, t, a, -1
            yield from ((i, t, a, v) for v in range(len(variants)))


BODIES = [
    "{}", "[]", "1", '"a"', "null", '{"tokens":[1,null,{"analyses":{"grammar":{"variants":{}}}}]}', '{"tokens":{"text":"a\\\\\\"]"}}',
    '{"tokens": [ {"text" : "x", "analyses" : [ {"grammar": {"variants": [{"grammemes": ["a","b"]}, {}]}} , {} ] } , {} ] , "z": 1e-3}',
    '{"tokens":[{"analyses":[]}],"tokens":[{"analyses":null},{}]}', '{"extra":{"tokens":[1]},"tokens":[]}', '{"\\u0074okens":[{}]}',
    '{"tokens":[{"text":"кот","start":0,"end":3,"analyses":[{"lemma":"кот","weight":"0.5","grammar":{"raw":"S=им","pos":"S","common":["муж"],"variants":[{"grammemes":["им"]}]}}]}]}',
]


def test_paths_and_validity_against_a_plain_parser():
    rng = random.Random(5)
    cases = list(BODIES)
    for _ in range(3000):
        s = list(rng.choice(BODIES))
        for _ in range(rng.randint(1, 2)):
            at = rng.randrange(len(s) + 1)
            if rng.random() < 0.5 and at < len(s):
                del s[at]
            else:
                s.insert(at, rng.choice('{}[]:,"\\ 1ntru\n\x01é'))
        cases.append("".join(s) or " ")
    raw = [c.encode() for c in cases]
    want = [list(plain_paths(i, c)) for i, c in enumerate(cases)]
    assert Index(raw).good.tolist() == [bool(w) for w in want]
    rows = flatten_batch(list(range(len(raw))), raw, "paths")
    got = sorted(zip(*(map(int, rows[c]) for c in ("rec_id", "token_pos", "analysis_pos", "variant_pos"))))
    assert got == sorted(x for w in want for x in w)


def test_flat_tables_link_up(spark):
    rows = [(n, b, "clash") for n, b in enumerate(BODIES)] + [(11, BODIES[11], "again"), (50, None, None), (None, "{}", None), (51, "", None), (52, '{"tokens": [', None)]
    df = spark.createDataFrame(rows, "rec_id bigint, body string, token_pos string")
    tables = {level: flatten(df, level) for level in ("records", "tokens", "analyses", "variants", "paths")}
    assert sorted(r["rec_id"] for r in tables["records"].collect()) == list(range(12))
    token = tables["tokens"].where("rec_id = 11").collect()
    assert [tuple(r) for r in token] == [(11, 0, "кот", 0, 3)]
    analysis = tables["analyses"].where("rec_id = 11").first()
    assert (analysis["lemma"], analysis["weight"], analysis["common"], analysis["part_of_speech"]) == ("кот", 0.5, ["муж"], "S")
    orphans = tables["variants"].join(tables["analyses"], ["rec_id", "token_pos", "analysis_pos"], "left_anti").count()
    orphans += tables["analyses"].join(tables["tokens"], ["rec_id", "token_pos"], "left_anti").count()
    assert orphans == 0
    assert flatten(df.limit(0), "paths").count() == 0
