"""Pieces of long texts and term frequencies, against plain versions."""

import random

import pytest
import regex

from lemmaflow.llm import chunks, frequencies


def utf16(t):
    return len(t.encode("utf-16-le")) // 2


def check_pieces(text, limit, overlap, pieces):
    units = text.encode("utf-16-le")
    total = utf16(text)
    limit, overlap = max(1, limit), min(max(0, overlap), max(1, limit) - 1)
    assert pieces[0][0] == 0 and pieces[-1][1] == total
    for n, (a, b) in enumerate(pieces):
        units[2 * a : 2 * b].decode("utf-16-le")
        assert b - a <= max(limit, 2 if limit == 1 else 0)
        if n:
            before = pieces[n - 1]
            assert 0 <= before[1] - a <= overlap + 1 and a > before[0]
            # a character of two units may cost one unit of the overlap, or all of it if nothing else goes on
            wide = any(c > "\uffff" for c in text)
            assert before[1] - a >= overlap - wide * (1 if limit - overlap > 1 else overlap)


def table(rows):
    return rows, "k bigint, t string, lim int, ov int, piece_no string"


def run(spark, rows, monkeypatch, size=16, halo=8):
    monkeypatch.setattr(chunks, "RANGE", size)
    monkeypatch.setattr(chunks, "HALO", halo)
    df = spark.createDataFrame(*table(rows))
    out = {}
    for r in chunks.split_texts(df, "k", "t", "lim", "ov").orderBy("k", "piece_no").collect():
        out.setdefault(r["k"], []).append((r["start"], r["end"], r["piece"]))
    return out, {r["k"]: (r["oversized"], r["unbroken"]) for r in chunks.oversized_cases(df, "k", "t", "lim", "ov").collect()}


def test_random_texts(spark, monkeypatch):
    rng = random.Random(8)
    rows = []
    for k in range(150):
        text = "".join(rng.choice("abc  .,\n😀é。") for _ in range(rng.randint(0, 120)))
        rows.append((k, text, rng.choice([1, 2, 5, 12, 30]), rng.choice([0, 1, 3, 11, None]), "clash"))
    rows += [(200, None, 5, 0, ""), (201, "", 5, 0, ""), (202, " " * 20, 5, 1, ""), (203, "short", None, None, ""), (5, rows[5][1], rows[5][2], rows[5][3], "again"), (None, "a" * 40, 5, 0, "")]
    got, cases = run(spark, rows, monkeypatch)
    for k, text, limit, overlap, _ in rows:
        if k is None or text is None or utf16(text) <= (limit or 32768):
            assert k not in got and k not in cases
            continue
        check_pieces(text, limit, overlap or 0, [(a, b) for a, b, _ in got[k]])
        assert all(text.encode("utf-16-le")[2 * a : 2 * b].decode("utf-16-le") == p for a, b, p in got[k])
        runs = regex.findall(r"[^\p{Z}\p{P}\t\n\x0b\f\r]+", text)
        assert cases[k] == (True, max(map(utf16, runs), default=0) > limit)


def test_the_size_of_ranges_changes_nothing(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(k, "".join(rng.choice("ab . \n") for _ in range(200)), 20, 4, "") for k in range(10)]
    assert run(spark, rows, monkeypatch, 16, 64) == run(spark, rows, monkeypatch, 1000, 64)


def test_natural_places(spark, monkeypatch):
    rows = [(1, "One two three. Four five six seven", 20, 0, ""), (2, "One two three four\n\nfive six seven", 24, 0, ""), (3, "x" * 30, 12, 2, "")]
    got, cases = run(spark, rows, monkeypatch, 1000, 64)
    assert [p for _, _, p in got[1]] == ["One two three. ", "Four five six seven"]
    assert [p for _, _, p in got[2]] == ["One two three four\n\n", "five six seven"]
    assert [len(p) for _, _, p in got[3]] == [12, 12, 10] and cases[3] == (True, True)


def test_files_by_ranges(spark, tmp_path):
    rng = random.Random(6)
    text = "".join(rng.choice("аб cd. \n😀") for _ in range(5000))
    path = tmp_path / "big.txt"
    path.write_text(text, "utf-8", newline="")
    files = [(path.as_uri(), path.stat().st_size)]
    pieces = [[(r["start"], r["end"]) for r in chunks.split_files(spark, files, 300, 20, size).orderBy("piece_no").collect()] for size in (700, 1 << 20)]
    check_pieces(text, 300, 20, pieces[0])
    assert pieces[0] == pieces[1]
    assert chunks.split_files(spark, []).count() == 0


@pytest.mark.parametrize("overlap", [0, 20, 150])
def test_sections_of_one_file_are_walked_apart(spark, tmp_path, overlap):
    rng = random.Random(7)
    text = "".join(rng.choice("аб cd. \n😀") for _ in range(4000)) + "x" * 3000 + "".join(rng.choice("аб cd. 😀") for _ in range(3000))
    path = tmp_path / "big.txt"
    path.write_text(text, "utf-8", newline="")
    pieces = [(r["piece_no"], r["start"], r["end"]) for r in chunks.split_files(spark, [(path.as_uri(), path.stat().st_size)], 300, overlap, 700, 2100).orderBy("piece_no").collect()]
    assert [n for n, _, _ in pieces] == list(range(len(pieces)))
    check_pieces(text, 300, overlap, [(a, b) for _, a, b in pieces])


def plain(rows, fields, share=0.2):
    seen, out = {}, {}
    for form, doc, *values in rows:
        if form is not None and doc is not None:
            seen[form] = (doc, values)
    for n, name in enumerate(fields):
        have = {d for d, v in seen.values() if v[n]}
        for d, v in seen.values():
            if v[n]:
                o = out.setdefault((name, v[n]), [0, set()])
                o[0] += 1
                o[1].add(d)
        for (f, _), o in out.items():
            if f == name:
                o.append("rare" if len(o[1]) == 1 else "common" if len(o[1]) > share * len(have) else None)
    return {(f, t, o[0], len(o[1]), o[2]) for (f, t), o in out.items()}


@pytest.mark.parametrize("bound", [1 << 26, 600])
def test_frequencies(spark, bound):
    rng = random.Random(9)
    words = ["a", "А", "é", "é", "hot", "", None, "x y", "Z"] + [f"w{n}" for n in range(60)]
    rows = [(n, rng.randrange(30), "hot" if n % 3 == 0 else rng.choice(words), rng.choice(words)) for n in range(900)]
    rows += rows[::7] + [(None, 1, "a", "a"), (5000, None, "a", "a")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "form_id bigint, mdoc_id bigint, lemma string, form_text string, documents int")
    got = frequencies.frequencies(df, ["lemma", "form_text"], partition_bytes=bound)
    assert {tuple(r) for r in got.collect()} == plain(rows, ["lemma", "form_text"])
    assert frequencies.frequencies(df.limit(0), ["lemma", "form_text"]).count() == 0


def test_one_term_of_everything_spills_and_ends(spark):
    df = spark.range(3000).selectExpr("id AS form_id", "id % 500 AS mdoc_id", "'same' AS lemma").withColumn("x", __import__("pyspark").sql.functions.lit(1))
    assert [tuple(r) for r in frequencies.frequencies(df, ["lemma"], partition_bytes=2000).collect()] == [("lemma", "same", 3000, 500, "common")]
