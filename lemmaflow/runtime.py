"""Session helpers that every operator shares."""

from __future__ import annotations

import os
import tempfile
import uuid
from itertools import islice

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lemmaflow.errors import InvalidOptions


#: Rows of a batch that a task hands on at once.
MOST_ROWS = 50_000


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """One Parquet table of the directory ``base``."""
    return spark.read.parquet(f"{base}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Where a session on one machine names none, as in tests, a temporary folder becomes its checkpoint
    folder; on a cluster that would be no shared folder, so there it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise InvalidOptions("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), f"lemmaflow-{os.getpid()}")
        os.makedirs(found[7:], exist_ok=True)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, which is removed when the session's JVM ends."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}")
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.deleteOnExit(path)
    whole = path.makeQualified(system.getUri(), system.getWorkingDirectory()).toString()
    return whole.replace("file:/", "file:///", 1) if whole.startswith("file:/") and not whole.startswith("file://") else whole


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts lineage and survives executor loss."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged_with(df: DataFrame, label: str, **sums) -> tuple[DataFrame, dict]:
    """staged(), and aggregates of the rows, which the writing itself takes."""
    seen = Observation()
    out = staged(df.observe(seen, *[c.alias(name) for name, c in sums.items()]), label)
    return out, {name: seen.get.get(name) or 0 for name in sums}


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` over all cores, if its scan gives fewer partitions than there are cores.

    A large input arrives in many splits and isn't moved; only a few unsplittable files are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys) if keys else df.repartition(cores)


def first_deliveries(df: DataFrame, key: str, *columns: str, most: int = 1_000_000) -> DataFrame:
    """``columns`` of a table read from files, of each key only its first row by file and place; spread over all cores.

    Keys and places alone are shuffled. The places of the later rows are broadcast if they are no more
    than ``most``, so that the rows themselves stay where they are; else Spark joins by size. Rows with a
    null key are all kept.
    """
    at = ["_file", "_row"]
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")]
    places = df.select(F.col(key).alias("_key"), F.struct(*place).alias("at"))
    several = places.groupBy("_key").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1")
    later, size = staged_with(places.join(several, "_key").where("at <> first").select("at.*"), "later-rows", n=F.count(F.lit(1)))
    rows = spread(df.select(*columns, *place))
    return rows.join(F.broadcast(later) if size["n"] <= most else later, at, "left_anti").drop(*at)


def arrow_schema(ddl: str):
    """The Arrow schema of a DDL string; to be called on the driver."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def arrow_batch(schema, columns):
    """A record batch of ``schema`` from one list (or Arrow array) per column."""
    import pyarrow as pa

    arrays = [c.cast(f.type) if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for c, f in zip(columns, schema)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def map_rows(df: DataFrame, ddl: str, rows) -> DataFrame:
    """``rows`` makes any number of output tuples of each input row, a dict; runs in Arrow batches."""
    arrow = arrow_schema(ddl)

    def run(batches):
        for batch in batches:
            made = (r for x in batch.to_pylist() for r in rows(x))
            # one row may make very many: they go on in parts
            while out := list(islice(made, MOST_ROWS)):
                yield arrow_batch(arrow, zip(*out))

    return df.mapInArrow(run, ddl)
