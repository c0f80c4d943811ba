"""Where analyses come from: nowhere, a JSON column, a dictionary, or an external process in each task.

An engine adds a column of answers (see lemmaflow.operators.analyze.ANSWERS) to documents of (key, text).
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lemmaflow.errors import InvalidOptions, LemmaflowError
from lemmaflow.functions.charclass import java_class, python_class
from lemmaflow.operators.analyze import ANSWERS, MODEL, STATS, prefix, preparation_issues, reader_chunks, units
from lemmaflow.options import AnalysisOptions, AnalyzerOptions, ClientPolicy, ExecutionProfile, Limits, OutputFormat, OversizedPolicy, PoolOptions
from lemmaflow.runtime import arrow_batch, staged_with


class Engine(Protocol):
    """Anything that can answer for documents."""

    profile: ExecutionProfile
    format: OutputFormat

    def attach(self, df: DataFrame, key: str, text: str, options: AnalysisOptions) -> DataFrame:
        """``df`` with a column ``answers``."""


def check_policy(engine: Engine, options: AnalysisOptions) -> None:
    """Whether an engine may serve a term stream."""
    if engine.format != OutputFormat.JSON:
        raise InvalidOptions("analysis needs JSON")
    slow = engine.profile in (ExecutionProfile.PROCESS_PER_REQUEST, ExecutionProfile.REUSABLE_SESSION)
    if slow and options.client == ClientPolicy.REQUIRE_POOLED:
        raise InvalidOptions(f"{engine.profile} isn't pooled")
    if engine.profile == ExecutionProfile.PROCESS_PER_REQUEST and options.client == ClientPolicy.WARN:
        warnings.warn("a process for each document is slow", stacklevel=3)


class NoEngine:
    """No analyses: every token comes from the text."""

    profile, format = ExecutionProfile.UNKNOWN, OutputFormat.JSON

    def attach(self, df: DataFrame, key: str, text: str, options: AnalysisOptions) -> DataFrame:
        return df.withColumn("answers", F.lit(None).cast(ANSWERS))


def _answer(n: Column, json: Column | None = None, tokens: Column | None = None) -> Column:
    """One answer for a whole text of ``n`` code points."""
    none = F.lit(None)
    parts = {"at": F.lit(0), "n": n, "json": none if json is None else json, "error": none, "stats": none.cast(STATS), "tokens": none.cast(MODEL) if tokens is None else tokens.cast(MODEL)}
    return F.array(F.struct(*[c.alias(name) for name, c in parts.items()])).cast(ANSWERS)


class PrecomputedEngine:
    """Analyzer output that is already a column, one answer for the whole text."""

    profile, format = ExecutionProfile.UNKNOWN, OutputFormat.JSON

    def __init__(self, column: str):
        self.column = column

    def attach(self, df: DataFrame, key: str, text: str, options: AnalysisOptions) -> DataFrame:
        known = F.col(self.column).isNotNull() & F.col(text).isNotNull()
        return df.withColumn("answers", F.when(known, _answer(F.length(text), F.col(self.column))))


class ModelEngine:
    """Tokens that are a column already, with their places in the text (see lemmaflow.operators.analyze.MODEL)."""

    profile, format = ExecutionProfile.UNKNOWN, OutputFormat.JSON

    def __init__(self, column: str):
        self.column = column

    def attach(self, df: DataFrame, key: str, text: str, options: AnalysisOptions) -> DataFrame:
        known = F.col(self.column).isNotNull() & F.col(text).isNotNull()
        return df.withColumn("answers", F.when(known, _answer(F.length(text), tokens=F.col(self.column))))


class DictionaryEngine:
    """Lemmas of a table of (word, lemma): words are looked up in small letters.

    A dictionary of at most ``local_words`` entries and ``local_chars`` characters, which is checked, is
    sent to the tasks, and texts are analyzed where they lie. A larger one meets the words of the documents in
    a join; each distinct word of a document is joined once, and the words are spread over 16 keys
    each. Homonyms give several analyses, in the order of their lemmas. Words that the dictionary lacks
    are answered without an analysis, so that every answer aligns with its own place.
    """

    profile, format = ExecutionProfile.UNKNOWN, OutputFormat.JSON

    def __init__(self, dictionary: DataFrame, word: str = "word", lemma: str = "lemma", local_words: int = 1_000_000, local_chars: int = 32_000_000):
        self.dictionary = dictionary.select(F.lower(word).alias("w"), F.col(lemma).alias("lemma")).where("w <> '' and lemma <> ''").distinct()
        self.local_words, self.local_chars = local_words, local_chars

    def look_up(self):
        """A function from a piece of text to its analyzed tokens, or None if the dictionary is too large to be sent."""
        spark = self.dictionary.sparkSession
        held, size = staged_with(self.dictionary, "dictionary", n=F.count(F.lit(1)), chars=F.sum(F.length("w") + F.length("lemma")))
        if size["n"] > self.local_words or size["chars"] > self.local_chars:
            return None
        lemmas: dict[str, list[str]] = {}
        found = held.toArrow()
        for w, lemma in zip(found["w"].to_pylist(), found["lemma"].to_pylist()):
            lemmas.setdefault(w, []).append(lemma)
        sent = spark.sparkContext.broadcast({w: [(x, None) for x in sorted(found)] for w, found in lemmas.items()})
        return _LookUp(sent, f"[{python_class('W')}]+")

    def attach(self, df: DataFrame, key: str, text: str, options: AnalysisOptions) -> DataFrame:
        """``df`` with answers by a join, for dictionaries of any size."""
        run = f"[{java_class('W')}]+"
        words = df.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(run), F.lit(0)))).alias("word"))
        entries = self.dictionary.groupBy("w").agg(F.array_sort(F.collect_list("lemma")).alias("lemmas"))
        salted = words.withColumns({"w": F.lower("word"), "salt": F.pmod(F.xxhash64("k"), F.lit(16)).cast("int")})
        entries = entries.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
        known = salted.join(entries, ["w", "salt"]).groupBy("k").agg(F.collect_list(F.struct("word", "lemmas")).alias("_known"))
        joined = df.join(known.withColumnRenamed("k", "_k"), F.col(key) == F.col("_k"), "left").drop("_k")
        names = [c for c in df.columns if c != "answers"]
        out_schema = _with_answers(df.select(*names))
        arrow, at = _to_arrow(out_schema), names.index(text)
        pattern = f"[{python_class('W')}]+"

        def run_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import json
            import re

            word = re.compile(pattern)
            for batch in batches:
                answers = []
                for t, found in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist()):
                    if t is None or not found:
                        answers.append(None)
                        continue
                    held = {x["word"]: [{"lex": y} for y in x["lemmas"]] for x in found}
                    items = [{"text": w, "analysis": held.get(w, [])} for w in word.findall(t)]
                    answers.append([{"at": 0, "n": len(t), "json": json.dumps(items, ensure_ascii=False)}])
                yield arrow_batch(arrow, [*batch.columns[: len(names)], answers])

        return joined.select(*names, "_known").mapInArrow(run_batches, out_schema)


class _LookUp:
    """Words of a piece of text with the lemmas of a dictionary that was sent to the task."""

    def __init__(self, sent, pattern: str):
        self.sent, self.pattern = sent, pattern

    def __call__(self, piece: str) -> list[tuple[str, int, int, list[tuple[str, None]]]]:
        import re

        held = self.sent.value
        return [(w := m.group(), *m.span(), held.get(w.lower(), [])) for m in re.finditer(self.pattern, piece)]


def _with_answers(df: DataFrame):
    from pyspark.sql.types import StructType

    return StructType(df.schema.fields).add("answers", StructType.fromDDL(f"x {ANSWERS}")["x"].dataType)


def _to_arrow(schema):
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


class ProcessEngine:
    """An external analyzer: a pool of processes per running task, which answer chunk by chunk.

    A task asks for as many documents at once as its pool has sessions, and keeps their order. Each
    answer carries the figures of its request. A document whose request fails stops the query, or with mode
    PERMISSIVE its answer is the error, which the analysis reports. Of a text over the limit the policy
    of ``options`` tells what is sent: the prefix that is analyzed, or nothing, as the analysis refuses it.
    """

    format = OutputFormat.JSON

    def __init__(self, command: list[str], options: AnalyzerOptions = AnalyzerOptions(), limits: Limits = Limits(), pool: PoolOptions = PoolOptions(), mode: str = "FAILFAST"):
        self.command, self.options, self.limits, self.pool, self.mode = command, options, limits, pool, mode
        self.format, self.profile = options.format, ExecutionProfile.POOLED_SESSIONS

    def attach(self, df: DataFrame, key: str, text: str, options: AnalysisOptions) -> DataFrame:
        names = [c for c in df.columns if c != "answers"]
        out_schema = _with_answers(df.select(*names))
        arrow = _to_arrow(out_schema)
        command, request, limits, pool, mode = self.command, self.options, self.limits, self.pool, self.mode
        at = names.index(text)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from concurrent.futures import ThreadPoolExecutor
            from dataclasses import asdict

            from lemmaflow.sources.process import Pool

            sessions = Pool(command, request, limits, pool)

            def asked(t: str, a: int, b: int) -> dict:
                out, stats = sessions.ask(preparation_issues(t[a:b])[0])
                return {"at": a, "n": b - a, "json": out, "stats": asdict(stats)}

            def answers(t: str | None) -> list[dict] | None:
                if t is None:
                    return None
                if units(t) > options.max_input_chars:
                    if options.oversized == OversizedPolicy.FAIL:
                        return None
                    t = prefix(t, options.max_input_chars)
                try:
                    return [asked(t, a, b) for a, b in reader_chunks(t, options.max_chunk_chars)]
                except LemmaflowError as e:
                    if mode != "PERMISSIVE":
                        raise
                    return [{"at": 0, "n": len(t), "error": f"{type(e).__name__}: {e}"}]

            try:
                with ThreadPoolExecutor(pool.max_size) as threads:
                    for batch in batches:
                        yield arrow_batch(arrow, [*batch.columns, list(threads.map(answers, batch.column(at).to_pylist()))])
            finally:
                sessions.close()

        return df.select(*names).mapInArrow(run, out_schema)


def request_stats(answered: DataFrame, key: str) -> DataFrame:
    """One row per request of a column ``answers``: at, elapsed_ms, mode, in_chars, in_bytes, out_chars, out_bytes and error."""
    each = answered.select(key, F.explode("answers").alias("a"))
    return each.select(key, "a.at", "a.stats.*", "a.error")
