"""Queries over small inline texts: rules that no table exercises, each with the rows that must come out."""

from __future__ import annotations

import json
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lemmaflow.functions import text as T
from lemmaflow.operators import search
from lemmaflow.operators.analyze import MODEL, analyze, reader_chunks, term_stream
from lemmaflow.operators.parse import model_documents
from lemmaflow.operators.tokens import to_utf16
from lemmaflow.options import AnalysisOptions, LemmaPolicy, OversizedPolicy, PositionPolicy, TokenizerOptions, UnmatchedPolicy
from lemmaflow.runtime import map_rows
from lemmaflow.sources.engines import DictionaryEngine, ModelEngine

PRESETS = {
    "conservative": TokenizerOptions.conservative(), "search": TokenizerOptions.search(), "entities": TokenizerOptions.entity_aware(),
    "best": TokenizerOptions(lemmas=LemmaPolicy.BEST_WEIGHT), "strict": TokenizerOptions(unmatched=UnmatchedPolicy.FAIL),
}
ADDRESSES = "10# $ https://example.com me@example.com"

#: (case, preset, text, tokens): tokens are (text, start, end, [(lemma, weight)]), or None for what the text gives.
TOKENS = [
    (1, "entities", "Раз++ два# C++ 10#", [("Раз", 0, 3, [("раз++", None)]), ("два", 6, 9, [("два#", None)]), ("C", 11, 12, []), ("10#", 15, 18, [])]),
    (2, "entities", "A https://example.com, me@example.com!", None),
    (3, "entities", "пиши,me@example.com", [("пиши", 0, 4, [("писать", None)])]),
    (4, "search", "мама мама", [("мама", 0, 4, [("мама", None)]), ("мама", 0, 4, [("мама", None)])]),
    (5, "conservative", ADDRESSES, None),
    (6, "search", ADDRESSES, None),
    (7, "entities", "$ €", None),
    (8, "entities", "cafe\u0301 123\u0341", None),
    (9, "entities", "123Привет 2,20 50%", None),
    (10, "best", "замок", [("замок", 0, 5, [("замок", 0.2), ("замокнуть", 0.8), ("замкнуть", 0.1)])]),
    (11, "best", "тест", [("тест", 0, 4, [("первый", None), ("второй", None)])]),
    (12, "search", "text", [("text", -1, -1, [("x", None)])]),
    (13, "search", "x", [("", 0, 0, [])]),
    (14, "conservative", "О\u00adд\u00adи\u00adн да", [("Один", 0, 7, [("один", None)])]),
    (15, "conservative", "\U0001f600 да", [("да", 3, 5, [("да", None), ("", None), ("да", 0.5)])]),
    (16, "conservative", "два слова", [("два слова", 0, 9, []), ("слова", 4, 9, [("слово", None)])]),
    (20, "strict", "text", [("text", -1, -1, [])]),
    (21, "conservative", "x", [("x", 0, 2, [])]),
]
_TOKEN_ROWS = [
    (1, "Раз++", 0, 5, "WORD", "раз++ раз", "true true"), (1, " ", 5, 6, "SEPARATOR", " ", "true"), (1, "два#", 6, 10, "WORD", "два# два", "true true"), (1, " ", 10, 11, "SEPARATOR", " ", "true"),
    (1, "C++", 11, 14, "WORD", "c++ c", "false false"), (1, " ", 14, 15, "SEPARATOR", " ", "true"), (1, "10#", 15, 18, "NUMBER", "10# 10", "true true"),
    (2, "A", 0, 1, "WORD", "a", "false"), (2, " ", 1, 2, "SEPARATOR", " ", "true"), (2, "https://example.com", 2, 21, "URL", "https://example.com example.com", "true true"), (2, ",", 21, 22, "OTHER", ",", "true"),
    (2, " ", 22, 23, "SEPARATOR", " ", "true"), (2, "me@example.com", 23, 37, "EMAIL", "me@example.com example.com", "true true"), (2, "!", 37, 38, "OTHER", "!", "true"),
    (3, "пиши", 0, 4, "WORD", "писать", "true"), (3, ",", 4, 5, "OTHER", ",", "true"), (3, "me@example.com", 5, 19, "EMAIL", "me@example.com example.com", "true true"),
    (4, "мама", 0, 4, "WORD", "мама", "true"), (4, " ", 4, 5, "SEPARATOR", " ", "true"), (4, "мама", 5, 9, "WORD", "мама", "true"),
    *[
        (case, *row)
        for case, number, currency in ((5, "WORD", "OTHER"), (6, "NUMBER", "CURRENCY"))
        for row in (
            ("10#", 0, 3, number, "10# 10", "true true"), (" ", 3, 4, "SEPARATOR", " ", "true"), ("$", 4, 5, currency, "$", "true"), (" ", 5, 6, "SEPARATOR", " ", "true"), ("https", 6, 11, "WORD", "https", "false"),
            ("://", 11, 14, "OTHER", "://", "true"), ("example", 14, 21, "WORD", "example", "false"), (".", 21, 22, "OTHER", ".", "true"), ("com", 22, 25, "WORD", "com", "false"), (" ", 25, 26, "SEPARATOR", " ", "true"),
            ("me", 26, 28, "WORD", "me", "false"), ("@", 28, 29, "OTHER", "@", "true"), ("example", 29, 36, "WORD", "example", "false"), (".", 36, 37, "OTHER", ".", "true"), ("com", 37, 40, "WORD", "com", "false"),
        )
    ],
    (7, "$", 0, 1, "CURRENCY", "$ доллар dollar dólar 美元 usd", "true true true true true true"), (7, " ", 1, 2, "SEPARATOR", " ", "true"), (7, "€", 2, 3, "CURRENCY", "€ евро euro 欧元 eur", "true true true true true"),
    (8, "cafe\u0301", 0, 5, "WORD", "cafe", "false"), (8, " ", 5, 6, "SEPARATOR", " ", "true"), (8, "123\u0341", 6, 10, "NUMBER", "123", "true"),
    (9, "123", 0, 3, "NUMBER", "123", "true"), (9, "Привет", 3, 9, "WORD", "привет", "false"), (9, " ", 9, 10, "SEPARATOR", " ", "true"), (9, "2", 10, 11, "NUMBER", "2", "true"), (9, ",", 11, 12, "OTHER", ",", "true"), (9, "20", 12, 14, "NUMBER", "20", "true"),
    (9, " ", 14, 15, "SEPARATOR", " ", "true"), (9, "50", 15, 17, "NUMBER", "50", "true"), (9, "%", 17, 18, "OTHER", "%", "true"),
    (10, "замок", 0, 5, "WORD", "замокнуть", "true"), (11, "тест", 0, 4, "WORD", "первый", "true"), (12, "text", 0, 4, "WORD", "text", "false"), (13, "x", 0, 1, "WORD", "x", "false"),
    (14, "О\u00adд\u00adи\u00adн", 0, 7, "WORD", "один", "true"), (14, " ", 7, 8, "SEPARATOR", " ", "true"), (14, "да", 8, 10, "WORD", "да", "false"),
    (15, "\U0001f600", 0, 2, "OTHER", "\U0001f600", "true"), (15, " ", 2, 3, "SEPARATOR", " ", "true"), (15, "да", 3, 5, "WORD", "да", "true"),
    (16, "два слова", 0, 9, "SEPARATOR", "два слова", "true"),
    (20, None, None, None, "TokenizationError", None, None), (21, None, None, None, "TokenizationError", None, None),
]


def fixture_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Search tokens of analyzed texts: offsets, types, forms, endings, places that collide, lemma policies and refusals."""
    out = None
    for name, options in PRESETS.items():
        rows = [(n, t, None if tokens is None else [(w, a, b, x) for w, a, b, x in tokens]) for n, preset, t, tokens in TOKENS if preset == name]
        df = spark.createDataFrame(rows, f"case_id bigint, text string, tokens {MODEL}")
        got = analyze(df, "case_id", "text", tokenizer=options, engine=ModelEngine("tokens"), mode="PERMISSIVE")
        t = F.explode(F.when(F.col("error").isNotNull(), F.array(F.lit(None).cast("struct<text:string,start:int,end:int,type:string,forms:array<struct<text:string,keyword:boolean>>>"))).otherwise(F.col("tokens"))).alias("t")
        flat = got.select("case_id", "error", t).select(
            "case_id", F.col("t.text").alias("token"), F.col("t.start").cast("bigint").alias("start_offset"), F.col("t.end").cast("bigint").alias("end_offset"),
            F.coalesce("t.type", F.substring_index("error", ":", 1)).alias("type"),
            F.when(F.col("t").isNotNull(), F.array_join(F.transform("t.forms", lambda f: f["text"]), " ")).alias("forms"),
            F.when(F.col("t").isNotNull(), F.array_join(F.transform("t.forms", lambda f: f["keyword"].cast("string")), " ")).alias("keywords"),
        )
        out = flat if out is None else out.unionByName(flat)
    return out


_ANALYSIS = lambda text, *lexes: {"text": text, "analysis": [dict(zip(("lex", "gr", "wt"), x)) for x in lexes]}
#: (case, text, analyzer output)
OUTPUTS = [
    (1, "Мама, мама.", json.dumps([_ANALYSIS("Мама", ("мама", "S,жен,од=им,ед", 0.98)), _ANALYSIS("мама", ("мама", "S"))])),
    (2, "мама", json.dumps([_ANALYSIS("папа")])),
    (3, "ма\u0000ма", json.dumps([_ANALYSIS("ма"), _ANALYSIS("ма")])),
    (4, "xдо\U0001f600послеy", json.dumps([_ANALYSIS("до\U0001f600после")])),
    (5, "мама\nпапа", '[{"text":"мама"}]\n[{"text":"папа","analysis":[]}]'),
    (6, "О\u00adд\u00adи\u00adн", '[{"text":"Один"}]'),
    (7, "text", '{"text":"text"}'),
    (8, "text", '[{"text":"text"}'),
    (9, "x", '[{"text":123,"analysis":[{"lex":false,"gr":[],"wt":"bad"}],"more":{}}]'),
    (10, "x", '[{"analysis":[[]]}]'),
    (11, "x", "[]"),
    (12, "a b", "[1]"),
    (13, None, "[]"),
    (14, "a", None),
]
_MODEL_ROWS = [
    (1, "Мама", 0, 4, "мама", "S,жен,од=им,ед", 0.98), (1, "мама", 6, 10, "мама", "S", None), (2, "папа", -1, -1, None, None, None), (3, "ма", 0, 2, None, None, None), (3, "ма", 3, 5, None, None, None),
    (4, "до\U0001f600после", 1, 10, None, None, None), (5, "мама", 0, 4, None, None, None), (5, "папа", 5, 9, None, None, None), (6, "Один", 0, 7, None, None, None),
    (7, "ParseError: The root must be an array at line 1, column 1.", None, None, None, None, None), (8, "ParseError: Failed to parse the analyzer's output at line 1, column 17.", None, None, None, None, None),
    (9, "", 0, 0, "", "", None), (10, "ParseError: An analysis must be an object at line 1, column 1.", None, None, None, None, None), (12, "ParseError: An item must be an object at line 1, column 1.", None, None, None, None, None),
]
_ISSUE_ROWS = [(2, "UNMATCHED_TOKEN", "Could not align token to original text: папа", 0, 4), (3, "CONTROL_CHARACTER", "Control character replaced with space", 2, 1), (5, "CONTROL_CHARACTER", "Line separator replaced with space for JSON-line protocol", 4, 1)]


def _parsed(spark: SparkSession) -> DataFrame:
    return model_documents(spark.createDataFrame(OUTPUTS, "case_id bigint, text string, output string"), "case_id", "text", "output")


def fixture_model(spark: SparkSession, d: str) -> DataFrame:
    """Analyzer output parsed and aligned: places, lemmas, grammar strings, weights and refusals."""
    tokens = _parsed(spark).select("case_id", "error", F.explode_outer("tokens").alias("t")).where("t is not null or error is not null")
    each = tokens.select("case_id", F.coalesce("error", "t.text").alias("token"), F.col("t.start").cast("bigint").alias("start_offset"), F.col("t.end").cast("bigint").alias("end_offset"), F.explode_outer("t.analyses").alias("a"))
    return each.select("case_id", "token", "start_offset", "end_offset", "a.lemma", "a.gr", "a.weight")


def fixture_issues(spark: SparkSession, d: str) -> DataFrame:
    """Issues of the same texts: what was replaced, and tokens that were not found."""
    each = _parsed(spark).select("case_id", F.explode("issues").alias("i"))
    return each.select("case_id", "i.type", "i.message", F.col("i.offset").cast("bigint").alias("issue_offset"), F.col("i.length").cast("bigint").alias("issue_length"))


#: (case, text, tokenizer, analysis options)
STREAMS = [
    (1, "Раз++ C++", PRESETS["conservative"], AnalysisOptions()),
    (2, "10# $ https://example.com", PRESETS["conservative"], AnalysisOptions()),
    (3, "A\u0001B", PRESETS["conservative"], AnalysisOptions()),
    (4, "Alpha Beta Gamma", PRESETS["conservative"], AnalysisOptions(max_chunk_chars=8)),
    (5, "\U0001f600 A", PRESETS["conservative"], AnalysisOptions(max_chunk_chars=1)),
    (6, "A B", PRESETS["conservative"], AnalysisOptions(positions=PositionPolicy.PRESERVE)),
    (7, "12345", PRESETS["conservative"], AnalysisOptions(max_input_chars=4, max_chunk_chars=4)),
    (8, "Alpha", PRESETS["conservative"], AnalysisOptions(max_input_chars=4, max_chunk_chars=4, oversized=OversizedPolicy.TRUNCATE)),
    (9, "A\U0001f600B", PRESETS["conservative"], AnalysisOptions(max_input_chars=2, max_chunk_chars=2, oversized=OversizedPolicy.TRUNCATE)),
    (10, "Alpha", replace(PRESETS["conservative"], classify_numbers=True), AnalysisOptions()),
]
_STREAM_ROWS = [
    (1, "раз++", 0, 5, 1, None), (1, "раз", 0, 5, 0, None), (1, "c++", 6, 9, 1, None), (1, "c", 6, 9, 0, None),
    (2, "10#", 0, 3, 1, None), (2, "10", 0, 3, 0, None), (2, "https", 6, 11, 1, None), (2, "example", 14, 21, 1, None), (2, "com", 22, 25, 1, None),
    (3, "a", 0, 1, 1, None), (3, "b", 2, 3, 1, None), (4, "alpha", 0, 5, 1, None), (4, "beta", 6, 10, 1, None), (4, "gamma", 11, 16, 1, None), (5, "a", 3, 4, 1, None),
    (6, "a", 0, 1, 1, None), (6, "b", 2, 3, 2, None), (7, None, None, None, None, "InvalidOptions"), (8, "alph", 0, 4, 1, None), (9, "a", 0, 1, 1, None), (10, "alpha", 0, 5, 1, None),
]
WORDS = [("Раз", "раз++"), ("C", "c++")]


def fixture_terms(spark: SparkSession, d: str) -> DataFrame:
    """Term streams: increments, chunks, limits that refuse or truncate, and skipped positions."""
    out = None
    known = spark.createDataFrame(WORDS, "word string, lemma string")
    for n, text, tokenizer, options in STREAMS:
        engine = DictionaryEngine(known) if n == 1 else None
        got = term_stream(spark.createDataFrame([(n, text)], "case_id bigint, text string"), "case_id", "text", tokenizer=tokenizer, options=options, engine=engine, mode="PERMISSIVE")
        row = got.select("case_id", "term", F.col("start").cast("bigint").alias("start_offset"), F.col("end").cast("bigint").alias("end_offset"), F.col("pos_inc").cast("bigint").alias("pos_inc"), F.substring_index("error", ":", 1).alias("refused"))
        out = row if out is None else out.unionByName(row)
    return out


#: (case, text, limit)
CHUNKED = [(1, "Alpha Beta Gamma", 8), (2, "\U0001f600 A", 1), (3, "abcdefghij", 4), (4, "a\nb c", 3), (5, "", 5)]
_CHUNK_ROWS = [(1, 0, 0, 6), (1, 1, 6, 11), (1, 2, 11, 16), (2, 0, 0, 2), (2, 1, 2, 3), (2, 2, 3, 4), (3, 0, 0, 4), (3, 1, 4, 8), (3, 2, 8, 10), (4, 0, 0, 2), (4, 1, 2, 5)]


def fixture_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Where chunks end: behind the last blank, at the limit, and never inside a character."""

    def rows(x):
        at = to_utf16(x["text"])
        return [(x["case_id"], n, at(a), at(b)) for n, (a, b) in enumerate(reader_chunks(x["text"], x["size"]))]

    return map_rows(spark.createDataFrame(CHUNKED, "case_id bigint, text string, size int"), "case_id bigint, chunk_no bigint, start_offset bigint, end_offset bigint", rows)


#: (case, UTF-16-BE bytes)
RAW = [(1, "a\ud83db".encode("utf-16-be", "surrogatepass")), (2, "a\U0001f600b".encode("utf-16-be")), (3, "\udc00".encode("utf-16-be", "surrogatepass")), (4, b""), (5, None)]
_RAW_ROWS = [(1, "a\ufffdb", "UNPAIRED_SURROGATE", 1, 1), (2, "a\U0001f600b", None, None, None), (3, "\ufffd", "UNPAIRED_SURROGATE", 0, 1), (4, "", None, None, None), (5, None, None, None, None)]


def fixture_surrogates(spark: SparkSession, d: str) -> DataFrame:
    """Raw bytes with halves of characters, which no string can hold."""
    got = T.prepared_utf16(spark.createDataFrame(RAW, "case_id bigint, raw binary"), "case_id", "raw")
    return got.select("case_id", "text", F.explode_outer("issues").alias("i")).select("case_id", "text", "i.type", F.col("i.offset").cast("bigint").alias("issue_offset"), F.col("i.length").cast("bigint").alias("issue_length"))


_SEARCH_ROWS = [("мама", 1), ("мамы", 0), ("мамами", 1), ("папами", 0), ("раз++ c++", 1), ("раз c", 1), ("раз++ c", 1), ("compact", 1), ("preserve", 0), ("preserve at 2", 1), ("мам*", 1)]


def fixture_search(spark: SparkSession, d: str) -> DataFrame:
    """An index and its queries: lemmas, analyzed query words, phrases over forms, and positions."""
    known = DictionaryEngine(spark.createDataFrame([("Мамы", "мама"), ("Мамами", "мама"), ("Раз", "раз++"), ("C", "c++")], "word string, lemma string"))
    text = lambda t, **more: term_stream(spark.createDataFrame([(1, t)], "doc_id bigint, text string"), "doc_id", "text", engine=known, **more)
    keep = AnalysisOptions(positions=PositionPolicy.PRESERVE)
    one, two, three = text("Мамы"), text("Раз++ C++"), text("Мама Папа")
    asked = lambda t: search.analyzed_query(one, text(t).withColumnRenamed("doc_id", "query_id"))
    found = {
        "мама": search.term_query(one, "мама"), "мамы": search.term_query(one, "мамы"), "мамами": asked("Мамами"), "папами": asked("Папами"),
        "раз++ c++": search.phrase_query(two, ["раз++", "c++"]), "раз c": search.phrase_query(two, ["раз", "c"]), "раз++ c": search.phrase_query(two, ["раз++", "c"]),
        "compact": search.phrase_query(three, ["мама", "папа"]), "preserve": search.phrase_query(text("Мама Папа", options=keep), ["мама", "папа"]),
        "preserve at 2": search.phrase_query(text("Мама Папа", options=keep), ["мама", "папа"], [0, 2]), "мам*": search.pattern_query(one, "Мам*"),
    }
    out = None
    for name, hits in found.items():
        row = hits.agg(F.count("*").alias("hits")).select(F.lit(name).alias("query"), "hits")
        out = row if out is None else out.unionByName(row)
    return out


def _values(rows: list[tuple], columns: str) -> str:
    """SQL of literal rows; ``columns``: names with types."""

    def literal(x) -> str:
        return "NULL" if x is None else str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"

    names = [c.split() for c in columns.split(", ")]
    casts = ", ".join(f"CAST({n} AS {t}) AS {n}" for n, t in names)
    return f"SELECT {casts} FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) v({', '.join(n for n, _ in names)})"


QUERIES = {
    "fixture_tokens": fixture_tokens,
    "fixture_model": fixture_model,
    "fixture_issues": fixture_issues,
    "fixture_terms": fixture_terms,
    "fixture_chunks": fixture_chunks,
    "fixture_surrogates": fixture_surrogates,
    "fixture_search": fixture_search,
}
ORACLE = {
    "fixture_tokens": _values(_TOKEN_ROWS, "case_id BIGINT, token VARCHAR, start_offset BIGINT, end_offset BIGINT, type VARCHAR, forms VARCHAR, keywords VARCHAR"),
    "fixture_model": _values(_MODEL_ROWS, "case_id BIGINT, token VARCHAR, start_offset BIGINT, end_offset BIGINT, lemma VARCHAR, gr VARCHAR, weight DOUBLE"),
    "fixture_issues": _values(_ISSUE_ROWS, "case_id BIGINT, type VARCHAR, message VARCHAR, issue_offset BIGINT, issue_length BIGINT"),
    "fixture_terms": _values(_STREAM_ROWS, "case_id BIGINT, term VARCHAR, start_offset BIGINT, end_offset BIGINT, pos_inc BIGINT, refused VARCHAR"),
    "fixture_chunks": _values(_CHUNK_ROWS, "case_id BIGINT, chunk_no BIGINT, start_offset BIGINT, end_offset BIGINT"),
    "fixture_surrogates": _values(_RAW_ROWS, "case_id BIGINT, text VARCHAR, type VARCHAR, issue_offset BIGINT, issue_length BIGINT"),
    "fixture_search": _values(_SEARCH_ROWS, "query VARCHAR, hits BIGINT"),
}
