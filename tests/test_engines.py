"""Engines, processes, files, search, streams and SQL functions."""

import os
import stat
import sys
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from lemmaflow import errors
from lemmaflow.functions.sql import register
from lemmaflow.operators import search
from lemmaflow.operators.analyze import analyze, corrected, document_ends, search_tokens, term_stream
from lemmaflow.options import AnalysisOptions, AnalyzerOptions, ClientPolicy, Encoding, ExecutionProfile, Limits, OutputFormat, OversizedPolicy, PoolOptions, PositionPolicy, TokenizerOptions
from lemmaflow.sources import archive, files, process
from lemmaflow.sources.engines import DictionaryEngine, NoEngine, PrecomputedEngine, ProcessEngine, check_policy, request_stats
from lemmaflow.streaming.postings import stream_postings, term_counts, write_stream

FAKE = [sys.executable, os.path.join(os.path.dirname(__file__), "fake_analyzer.py")]
OPTIONS = AnalysisOptions()


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def test_one_shot():
    out, stats = process.OneShot([*FAKE, "whole"]).ask("мама")
    assert out == '[{"text":"мама"}]' and stats.in_chars == 4 and stats.in_bytes == 8 and stats.mode == "ONE_SHOT_TEXT"
    with pytest.raises(errors.EngineProcess) as e:
        process.OneShot([*FAKE, "fail"]).ask("x")
    assert e.value.exit_code == 3 and "bad" in e.value.stderr and "x" != str(e.value)
    with pytest.raises(errors.EngineTimeout):
        process.OneShot([*FAKE, "sleep"], limits=Limits(timeout_s=0.3)).ask("x")
    with pytest.raises(errors.EngineStartup):
        process.OneShot(["/nowhere/analyzer"]).ask("x")
    with pytest.raises(errors.InvalidOptions):
        process.OneShot(FAKE, limits=Limits(input_chars=2)).ask("xxx")
    with pytest.raises(errors.InvalidOptions):
        process.OneShot(FAKE, AnalyzerOptions(encoding=Encoding.CP1251)).ask("中")
    with pytest.raises(errors.EngineOutputLimit):
        process.OneShot([*FAKE, "whole"], limits=Limits(output_bytes=5)).ask("xxxxxxx")


def test_file_requests(tmp_path):
    source, target = tmp_path / "in.txt", tmp_path / "out.json"
    source.write_text("мама", "utf-8")
    one = process.OneShot([*FAKE, "whole"])
    assert one.ask_file(str(source))[0] == '[{"text":"мама"}]'
    assert one.ask_file(str(source), str(target))[0] is None and "мама" in target.read_text("utf-8")
    for a, b in ((tmp_path / "none", None), (source, source), (source, tmp_path), (source, tmp_path / "no" / "x")):
        with pytest.raises(errors.InvalidOptions):
            one.ask_file(str(a), str(b) if b else None)


def test_sessions():
    s = process.Session(FAKE)
    assert s.ask("Мама мыла")[0].count("lex") == 2 and s.ask("x")[1].mode == "SESSION"
    with pytest.raises(errors.InvalidOptions):
        s.ask("a\nb")
    assert s.ask("y")[0]  # a refused request doesn't end the session
    with pytest.raises(errors.EngineProcess) as e:
        s.ask("die")
    assert e.value.exit_code == 7
    with pytest.raises(errors.EngineClosed):
        s.ask("x")
    for mode, error in (("text", errors.EngineProtocol), ("slow", errors.EngineTimeout), ("large", errors.EngineOutputLimit), ("exit", errors.EngineProcess)):
        with pytest.raises(error):
            process.Session([*FAKE, mode], limits=Limits(timeout_s=0.5 if mode == "slow" else 10, output_bytes=5000)).ask("x")
    assert process.Session([*FAKE, "noisy"]).ask("x")[0]


def pool(mode="pid", limits=Limits(), **options):
    return process.Pool([*FAKE, mode], AnalyzerOptions(), limits, PoolOptions(**options))


def test_pools():
    p = pool(max_requests_per_worker=2)
    assert len({p.ask("x")[0] for _ in range(6)}) == 3 == p.started and p.ask("x")[1].mode == "POOL"
    p.close()
    with pytest.raises(errors.EngineClosed):
        p.ask("x")
    warm = pool(max_size=3, warmup=2, min_idle=1)
    assert warm.started == 2
    lent = [warm._acquire() for _ in range(3)]
    assert warm.started == 3
    waiting = pool(max_size=1, acquire_timeout_s=0.1)
    waiting._acquire()
    with pytest.raises(errors.EnginePoolExhausted):
        waiting.ask("x")
    lent[0].close()  # a broken session isn't lent again, and is replaced
    for s in lent:
        warm._give_back(s)
    assert warm.ask("x")[0] and warm.started >= 3
    for q in (warm, waiting):
        q.close()
    for background in (False, True):
        filled = pool(max_size=3, min_idle=2, background_replenishment=background)
        one = filled._acquire()
        filled._give_back(one)
        filled._acquire().close()
        filled.ask("x")
        until = time.monotonic() + 5
        while len(filled._free) < 2 and time.monotonic() < until:
            time.sleep(0.02)
        assert len(filled._free) == 2
        filled.close()
    old = pool(max_worker_age_s=0.01)
    old.ask("x"), time.sleep(0.05), old.ask("x")
    assert old.started == 2
    old.close()
    from concurrent.futures import ThreadPoolExecutor

    wide = pool("slow", max_size=4, acquire_timeout_s=10.0, limits=Limits(timeout_s=10.0))
    with ThreadPoolExecutor(4) as threads:
        assert all(threads.map(lambda n: wide.ask(str(n))[0] == f'[{{"text": "{n}", "analysis": [{{"lex": "{n}"}}]}}]', range(4)))
    assert wide.started == 4
    wide.close()


def test_resolution_and_probe(tmp_path, monkeypatch):
    tool = tmp_path / "tool"
    tool.write_text(f"#!{sys.executable}\nimport sys; sys.argv=['x','whole']; exec(open({FAKE[1]!r}).read())\n")
    with pytest.raises(errors.EngineNotFound):
        process.resolve_executable(str(tool))
    tool.chmod(tool.stat().st_mode | stat.S_IXUSR)
    assert process.resolve_executable(str(tool)) == str(tool)
    monkeypatch.delenv(process.VARIABLE, raising=False)
    with pytest.raises(errors.EngineNotFound):
        process.resolve_executable()
    monkeypatch.setenv(process.VARIABLE, str(tool))
    assert process.resolve_executable() == str(tool)
    assert "мама" in process.probe(str(tool))[0]


def test_archive(tmp_path):
    packed = tmp_path / "a.zip"
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("bin/tool", "#!/bin/sh\n")
    url = packed.as_uri()
    got = archive.fetch(url, str(tmp_path / "b.zip"), archive.digest(str(packed)), license_accepted=True)
    assert os.access(archive.unpack(got, str(tmp_path / "out"), "tool"), os.X_OK)
    packed.write_bytes(b"other")  # what was fetched is whole by its note, and isn't fetched again
    assert archive.fetch(url, got, license_accepted=True) == got and archive.digest(got) != archive.digest(str(packed))
    (tmp_path / "b.zip").write_bytes(b"cut off")
    assert archive.digest(archive.fetch(url, got, license_accepted=True)) == archive.digest(str(packed))
    for bad in (dict(license_accepted=False), dict(license_accepted=True, sha256="0" * 64), dict(license_accepted=True, max_bytes=3)):
        with pytest.raises(errors.InvalidOptions):
            archive.fetch(url, str(tmp_path / "c.zip"), **bad)
    with pytest.raises(errors.InvalidOptions):
        archive.fetch("https://nowhere.invalid/x", str(tmp_path / "c.zip"), license_accepted=True)


def terms(df):
    return [tuple(r) for r in df.orderBy("doc_id", "position", "pos_inc").collect()]


def test_process_engine(spark):
    df = docs(spark, [(1, "Мама Папа"), (2, "a\u0001B"), (3, None), (4, "")])
    engine = ProcessEngine(FAKE)
    check_policy(engine, AnalysisOptions(client=ClientPolicy.REQUIRE_POOLED))
    got = term_stream(engine.attach(df, "doc_id", "text", OPTIONS), "doc_id", "text", "answers").select("doc_id", "term", "start", "end", "keyword", "position", "pos_inc")
    assert terms(got) == [(1, "мама", 0, 4, True, 0, 1), (1, "папа", 5, 9, True, 1, 1), (2, "a", 0, 1, True, 0, 1), (2, "b", 2, 3, True, 1, 1)]
    lenient = ProcessEngine([*FAKE, "text"], mode="PERMISSIVE").attach(df, "doc_id", "text", OPTIONS)
    failed = term_stream(lenient, "doc_id", "text", "answers", mode="PERMISSIVE").collect()
    assert {r["doc_id"] for r in failed} == {1, 2} and all(r["term"] is None and "EngineProtocol" in r["error"] for r in failed)
    figures = request_stats(engine.attach(df, "doc_id", "text", OPTIONS), "doc_id").orderBy("doc_id").collect()
    assert [(r["doc_id"], r["at"], r["in_chars"], r["in_bytes"], r["mode"], r["error"]) for r in figures] == [(1, 0, 9, 17, "POOL", None), (2, 0, 3, 3, "POOL", None)]
    assert all(r["elapsed_ms"] > 0 and r["out_chars"] > 0 for r in figures)
    wide = ProcessEngine(FAKE, pool=PoolOptions(max_size=3))
    many = docs(spark, [(n, f"A{n} B") for n in range(50)])
    assert term_stream(many, "doc_id", "text", engine=wide).where("keyword").count() == 100
    slow = NoEngine()
    slow.profile = ExecutionProfile.PROCESS_PER_REQUEST
    with pytest.raises(errors.InvalidOptions):
        check_policy(slow, AnalysisOptions(client=ClientPolicy.REQUIRE_POOLED))
    with pytest.warns(UserWarning):
        check_policy(slow, AnalysisOptions(client=ClientPolicy.WARN))
    with pytest.raises(errors.InvalidOptions):
        term_stream(df, "doc_id", "text", engine=slow, options=AnalysisOptions(client=ClientPolicy.REQUIRE_POOLED))
    slow.format = OutputFormat.XML
    with pytest.raises(errors.InvalidOptions):
        check_policy(slow, OPTIONS)


def test_a_truncated_text_is_analyzed_up_to_its_limit(spark):
    df = docs(spark, [(1, "Alpha Beta Gamma"), (2, "Alpha Beta"), (3, "A\U0001f600B")])
    short = AnalysisOptions(max_input_chars=11, max_chunk_chars=11, oversized=OversizedPolicy.TRUNCATE)
    got = term_stream(df, "doc_id", "text", engine=ProcessEngine(FAKE), options=short)
    assert [(r["doc_id"], r["term"], r["keyword"]) for r in got.where("doc_id < 3").orderBy("doc_id", "position").collect()] == [(1, "alpha", True), (1, "beta", True), (2, "alpha", True), (2, "beta", True)]
    two = AnalysisOptions(max_input_chars=2, max_chunk_chars=2, oversized=OversizedPolicy.TRUNCATE)
    assert [r["term"] for r in term_stream(df.where("doc_id = 3"), "doc_id", "text", engine=ProcessEngine(FAKE), options=two).collect()] == ["a"]
    with pytest.raises(Exception, match="InvalidOptions"):
        term_stream(df, "doc_id", "text", engine=ProcessEngine([*FAKE, "exit"]), options=AnalysisOptions(max_input_chars=2, max_chunk_chars=2)).collect()


def test_a_filter_in_front_keeps_its_offsets(spark):
    df = spark.createDataFrame([(1, "Мама & папа", [(6, 4)])], "doc_id bigint, text string, moved array<struct<at:int,add:int>>")
    got = term_stream(df, "doc_id", "text", deltas="moved").orderBy("position").collect()
    assert [(r["term"], r["start"], r["end"]) for r in got] == [("мама", 0, 4), ("папа", 11, 15)]
    assert analyze(df, "doc_id", "text", deltas="moved").first()["final_offset"] == 15


def test_dictionary_and_search(spark):
    df = docs(spark, [(1, "Мамы мыли раму"), (2, "Мама и папа, мама"), (3, "Папа"), (4, None)])
    words = spark.createDataFrame([("Мамы", "мама"), ("мама", "мама"), ("мыли", "мыть"), ("мыли", "мыло"), ("", "x"), (None, None)], "word string, lemma string")
    p = term_stream(DictionaryEngine(words).attach(df, "doc_id", "text", OPTIONS), "doc_id", "text", "answers")
    ids = lambda q: sorted(r[0] for r in q.collect())
    assert ids(search.term_query(p, "мама")) == [1, 2] and ids(search.term_query(p, "мамы")) == []
    assert ids(search.phrase_query(p, ["мама", "мыло"])) == [1] == ids(search.phrase_query(p, ["мама", "мыть", "раму"]))
    assert ids(search.phrase_query(p, ["мыть", "мама"])) == [] and ids(search.phrase_query(p, [])) == []
    assert ids(search.phrase_query(p, ["мама", "мама"], [0, 3])) == [2]
    assert ids(search.pattern_query(p, "ПАП?")) == [2, 3] and ids(search.pattern_query(p, "м*")) == [1, 2] and ids(search.pattern_query(p, "%")) == []
    assert [tuple(r) for r in search.boolean_query(p, should=["мама", "папа"], k=2).collect()] == [(2, 3), (1, 1)]
    assert ids(search.boolean_query(p, must=["мама", "папа"])) == [2] and ids(search.boolean_query(p, ["папа"], must_not=["мама"])) == [3]
    stats = {r["term"]: (r["tf"], r["df"]) for r in search.term_stats(p).collect()}
    assert stats["мама"] == (3, 2) and stats["раму"] == (1, 1)
    assert {r["doc_id"]: r["n_positions"] for r in search.doc_stats(p).collect()} == {1: 3, 2: 4, 3: 1}
    ways = [term_stream(df, "doc_id", "text", engine=DictionaryEngine(words, local_words=n)) for n in (3, 2)]
    assert DictionaryEngine(words, local_words=2).look_up() is None and DictionaryEngine(words, local_words=4).look_up() is not None
    assert all(sorted(map(tuple, w.collect())) == sorted(map(tuple, p.collect())) for w in ways)
    asked = term_stream(DictionaryEngine(words).attach(spark.createDataFrame([(7, "МАМА, раму")], "query_id bigint, text string"), "query_id", "text", OPTIONS), "query_id", "text", "answers")
    assert sorted(tuple(r) for r in search.analyzed_query(p, asked).collect()) == [(7, 1, 2), (7, 2, 1)]


def test_written_postings(spark, tmp_path):
    p = term_stream(docs(spark, [(n, f"a b{n}") for n in range(20)]), "doc_id", "text")
    search.write_postings(p, str(tmp_path / "p"), buckets=4)
    assert search.read_term(spark, str(tmp_path / "p"), "a", buckets=4).count() == 20
    assert search.read_term(spark, str(tmp_path / "p"), "b7", buckets=4).count() == 1
    plan = search.read_term(spark, str(tmp_path / "p"), "a", buckets=4)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(term_bucket" in plan and "EqualTo(term,a)" in plan


def test_positions_phrases_and_errors(spark):
    df = docs(spark, [(1, "Мама Папа"), (2, "12345")])
    keep = AnalysisOptions(positions=PositionPolicy.PRESERVE)
    p = term_stream(df, "doc_id", "text", options=keep)
    assert search.phrase_query(p, ["мама", "папа"]).count() == 0 and search.phrase_query(p, ["мама", "папа"], [0, 2]).count() == 1
    small = AnalysisOptions(max_input_chars=5, max_chunk_chars=5)
    rows = {r["doc_id"]: r for r in analyze(df, "doc_id", "text", options=small, mode="PERMISSIVE").collect()}
    assert "InvalidOptions" in rows[1]["error"] and "Мама" not in rows[1]["error"] and rows[1]["tokens"] == [] and rows[2]["error"] is None
    with pytest.raises(Exception, match="InvalidOptions"):
        analyze(df, "doc_id", "text", options=small).collect()
    broken = df.where("doc_id = 1").withColumn("json", F.lit("{}"))
    got = analyze(PrecomputedEngine("json").attach(broken, "doc_id", "text", OPTIONS), "doc_id", "text", "answers", mode="PERMISSIVE").first()
    assert "ParseError" in got["error"]


def test_issues_offsets_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "x\U0001f600\u0001мама", '[{"text":"мама"},{"text":"нет"}]', "kept", 5)], "doc_id bigint, text string, json string, term string, start int")
    got = analyze(PrecomputedEngine("json").attach(df, "doc_id", "text", OPTIONS), "doc_id", "text", "answers", keep=("term",)).first()
    assert [(i["type"], i["offset"], i["length"]) for i in got["issues"]] == [("CONTROL_CHARACTER", 3, 1), ("UNMATCHED_TOKEN", 8, 3)]
    assert got["final_offset"] == 8 and [t["start"] for t in got["tokens"] if t["text"] == "мама"] == [4] and got["term"] == "kept"
    assert term_stream(df, "doc_id", "text").where("term = 'мама'").first()["start"] == 4
    assert term_stream(df.limit(0), "doc_id", "text").count() == 0
    moved = spark.createDataFrame([(3, [(2, 5), (4, 9)])], "o int, d array<struct<at:int,add:int>>").select(corrected(F.col("o"), F.col("d"))).first()[0]
    assert moved == 8


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_bytes("мама".encode("cp866"))
    assert files.read_files(spark, str(tmp_path / "in"), Encoding.CP866).first()["text"] == "мама"
    df = docs(spark, [(1, "a")])
    files.write_files(df, str(tmp_path / "out"), source=str(tmp_path / "in"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
    with pytest.raises(errors.InvalidOptions):
        files.write_files(df, str(tmp_path / "in"), source=str(tmp_path / "in"))


def test_streams(spark, tmp_path):
    schema = "doc_id bigint, text string, at timestamp"
    rows = spark.createDataFrame([(1, "a b a"), (2, "b")], "doc_id bigint, text string").withColumn("at", F.lit("2031-01-01 10:00:00").cast("timestamp"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    rows.where("doc_id = 2").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = stream_postings(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "doc_id", "text", "at", tokenizer=TokenizerOptions.search())
    write_stream(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert sorted(r["term"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "a", "b", "b"]
    counts = term_counts(spark.read.parquet(str(tmp_path / "out")), "at")
    assert {r["term"]: r["n"] for r in counts.collect()} == {"a": 2, "b": 2}


def test_sql_functions(spark):
    register(spark)
    got = spark.sql("SELECT prepare_text('a\\u0001b') AS p, prepare_json_line('a\\nb') AS j, utf16_length('\U0001f600') AS n, normalize_term('Мам*') AS t").first()
    assert tuple(got) == ("a b", "a b", 2, "мам*")
    assert [r["token"] for r in spark.sql("SELECT token FROM search_tokens('Мама 5') ORDER BY ord").collect()] == ["Мама", " ", "5"]


def test_the_newest_usable_record_counts(spark, tmp_path):
    from lemmaflow.plans.text import precomputed_terms

    body = lambda *w: '{"mdoc_id": 1, "tokens": [' + ", ".join(f'{{"text": "{x}", "start": 0, "end": 1, "analyses": [{{"lemma": "{x.lower()}{n}", "weight": 0.5}}]}}' for x, n in w) + "]}"
    records = [(1, 1, body(("Дом", "a"))), (2, 1, body(("Дом", "b"))), (3, 1, None), (4, 2, body(("Лес", "a"))), (5, 2, '{"tokens": ['), (6, 3, body(("Сад", "a"))), (7, 3, '{"tokens": []}'), (8, 4, body(("Пол", "a"))), (9, 4, body(("Пол", "b"))), (10, 5, None)]
    spark.createDataFrame(records, "rec_id bigint, mdoc_id bigint, body string").write.parquet(f"{tmp_path}/model_records.parquet")
    spark.createDataFrame([(1, "Дом"), (2, "Лес"), (3, "Сад"), (4, "Пол"), (5, "Дом")], "mdoc_id bigint, original_text string").write.parquet(f"{tmp_path}/mystem_documents.parquet")
    got = {(r["mdoc_id"], r["term"]) for r in precomputed_terms(spark, str(tmp_path)).where("keyword").collect()}
    assert got == {(1, "домb"), (2, "лесa"), (3, "садa"), (4, "полb")}


def test_first_deliveries_keep_the_rows_where_they_lie(spark, tmp_path):
    from lemmaflow.runtime import first_deliveries

    rows = [(1, "a"), (2, "b"), (1, "c"), (None, "d"), (None, "e"), (3, None), (3, "f")]
    spark.createDataFrame(rows, "k bigint, t string").coalesce(1).write.parquet(f"{tmp_path}/t")
    for most in (10, 0):
        got = first_deliveries(spark.read.parquet(f"{tmp_path}/t"), "k", "k", "t", most=most)
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [(1, "a"), (2, "b"), (None, "d"), (None, "e"), (3, None)]))
    assert first_deliveries(spark.read.parquet(f"{tmp_path}/t").where("k > 5"), "k", "k", "t").count() == 0


class Parts:
    """Stands for a DataFrame: gives the batches that one task makes of one batch."""

    def __init__(self, texts):
        self.texts, self.dtypes = texts, [("doc_id", "bigint"), ("text", "string")]

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):  # noqa: N802
        import pyarrow as pa

        nulls = pa.nulls(len(self.texts))
        return list(run(iter([pa.record_batch([pa.array(range(len(self.texts))), pa.array(self.texts), nulls, nulls], ["doc_id", "_x0", "_x1", "_x2"])])))


def test_a_task_holds_few_tokens_at_once(spark):
    """A batch has ten thousand documents; what is made of them goes on in parts."""
    texts = [f"слово {n} и ещё " * 200 for n in range(100)] + [None, ""]
    whole = analyze(Parts(texts), "doc_id", "text")
    assert [n for b in whole for n in b.column(0).to_pylist()] == list(range(102))
    sizes = [sum(map(len, b.column(1).to_pylist())) for b in whole]
    assert sum(sizes) == 160_000 and max(sizes) < 52_000
    rows = search_tokens(Parts(texts), "doc_id", "text")
    assert sum(b.num_rows for b in rows) == 160_000 and max(b.num_rows for b in rows) <= 50_000


@pytest.mark.parametrize("positions", list(PositionPolicy))
def test_ends_of_documents_are_those_of_their_tokens(spark, positions):
    df = spark.createDataFrame([(1, "Раз, два! "), (2, " ... "), (3, ""), (4, None), (5, "😀 слово")], "doc_id bigint, text string")
    options = AnalysisOptions(positions=positions)
    whole = analyze(df, "doc_id", "text", options=options).select("doc_id", "final_offset", "end_increment", F.size("tokens").cast("bigint"))
    got = {tuple(r) for r in document_ends(df, "doc_id", "text", options=options).collect()}
    assert got == {tuple(r) for r in whole.collect()}
    left = {r[0]: r[2] for r in got}
    assert left == ({1: 2, 2: 3, 3: 0, 4: 0, 5: 0} if positions == PositionPolicy.PRESERVE else dict.fromkeys(range(1, 6), 0))
