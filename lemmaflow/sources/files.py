"""Text files in, analyzed files out."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lemmaflow.errors import InvalidOptions
from lemmaflow.options import Encoding
from lemmaflow.runtime import map_rows


def read_files(spark: SparkSession, path: str, encoding: Encoding = Encoding.UTF_8) -> DataFrame:
    """(path, text): one row per file, decoded on the executors."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    if encoding == Encoding.UTF_8:
        return files.select("path", F.decode("content", "UTF-8").alias("text"))
    codec = str(encoding)
    return map_rows(files, "path string, text string", lambda x: [(x["path"], bytes(x["content"]).decode(codec, "replace"))])


def write_files(df: DataFrame, path: str, source: str | None = None, format: str = "parquet") -> None:
    """Writes a result in place of what is there; never over its own source."""
    strip = lambda p: os.path.realpath(p.removeprefix("file://").removeprefix("file:"))
    if source is not None and (strip(path) == strip(source) or strip(source).startswith(strip(path) + os.sep)):
        raise InvalidOptions("input and output are one place")
    df.write.mode("overwrite").format(format).save(path)
