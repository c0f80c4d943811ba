"""The batch operators on streams: stateless, so a stream of documents is a stream of postings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lemmaflow.operators import search
from lemmaflow.operators.analyze import document_terms, term_stream
from lemmaflow.options import AnalysisOptions, TokenizerOptions


def stream_postings(documents: DataFrame, key: str, text: str, event_time: str | None = None, delay: str = "1 hour", tokenizer: TokenizerOptions = TokenizerOptions(), options: AnalysisOptions = AnalysisOptions(), keep: tuple[str, ...] = (), partitions: int | None = None) -> DataFrame:
    """Postings of a stream; with an event time, redelivered documents within ``delay`` are dropped.

    ``partitions`` spreads each batch, for sources of few files that can't be split.
    """
    if event_time:
        documents = documents.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])
        keep = tuple(dict.fromkeys([*keep, event_time]))
    if partitions:
        documents = documents.repartition(partitions)
    return term_stream(documents, key, text, tokenizer=tokenizer, options=options, keep=keep)


def term_counts(postings: DataFrame, event_time: str, window: str = "1 hour") -> DataFrame:
    """(window, term, n) of a stream of postings that carries its event time and watermark."""
    return postings.groupBy(F.window(event_time, window), "term").agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), "term", "n")


def write_stream(postings: DataFrame, path: str, checkpoint: str):
    """Appends postings to Parquet, exactly once; runs until the available input is used."""
    return postings.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def write_batches(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Each batch as a part of a Parquet table: a repeated batch replaces its part, and a complete one the whole table."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path if mode == "complete" else f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()


def stream_term_stats(documents: DataFrame, key: str, text: str, path: str, checkpoint: str, tokenizer: TokenizerOptions = TokenizerOptions(), options: AnalysisOptions = AnalysisOptions(), partitions: int | None = None):
    """Writes (term, tf, df) of each batch of a stream of distinct documents; no posting is ever written."""

    def write(batch: DataFrame, number: int) -> None:
        spread = batch.repartition(partitions) if partitions else batch
        search.term_stats(document_terms(spread, key, text, tokenizer=tokenizer, options=options)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_term_stats(spark: SparkSession, path: str) -> DataFrame:
    """(term, tf, df) of all batches that stream_term_stats() has written."""
    return spark.read.schema("term string, tf bigint, df bigint").parquet(path).groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))
