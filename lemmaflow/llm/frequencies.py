"""Occurrences and document counts of every distinct term, by recursive radix spilling with DuckDB.

Rows are spread over tasks by the hash of term and document, so that no term, however frequent, gathers
in one task. A task partitions its rows by hash bits of the term; while they exceed its memory bound,
its largest partitions go to files in the shared folder, and a file that is still too large is split by
further bits (of term and document once the term's own are used up). DuckDB aggregates each partition
alone; the small partial counts are then added up.

Rules: null and empty terms don't count; terms compare character for character; a redelivered row (same
row key) counts once; rows without a document or row key don't count; a term of one document is rare, one
of more than ``common_share`` of the documents that have any term in the field is common, and a term that
is both is rare; an empty table has no rows; extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lemmaflow.runtime import arrow_batch, arrow_schema, scratch

#: Bytes of rows that a task aggregates at once.
PARTITION_BYTES = 96 << 20
#: Hash bits of one level of partitioning.
BITS = 3
_LEVELS = 2 * (64 // BITS)


def _counting(fields: int) -> str:
    """Partial counts of one partition: a row per term, two columns per field."""
    per_doc = ", ".join(f"count(*) FILTER (flags & {1 << i} <> 0) AS n{i}" for i in range(fields))
    total = ", ".join(f"sum(n{i})::BIGINT, count(*) FILTER (n{i} > 0)" for i in range(fields))
    return f"""WITH once AS (SELECT term, doc, row_key, bit_or(flags) AS flags FROM rows GROUP BY ALL),
      docs AS (SELECT term, doc, {per_doc} FROM once GROUP BY ALL) SELECT term, {total} FROM docs GROUP BY term"""


def _bucket(table: pa.Table | pa.RecordBatch, level: int):
    import numpy as np

    name, shift = ("by_term", level * BITS) if level < _LEVELS // 2 else ("by_both", (level - _LEVELS // 2) * BITS)
    return (table.column(name).to_numpy() >> np.int64(shift)) & ((1 << BITS) - 1)


class _Spill:
    """The files of one level, in the shared folder."""

    def __init__(self, uri: str, schema: pa.Schema, level: int):
        from pyarrow import fs

        self.fs, path = fs.FileSystem.from_uri(uri)
        self.dir = f"{path}/spill-{uuid.uuid4().hex}"
        self.fs.create_dir(self.dir, recursive=True)
        self.level, self.schema = level, schema
        self.writers: dict[int, pa.RecordBatchStreamWriter] = {}
        self.outs: dict[int, pa.NativeFile] = {}

    def add(self, b: int, part: pa.RecordBatch) -> None:
        if b not in self.writers:
            self.outs[b] = self.fs.open_output_stream(f"{self.dir}/{b}")
            self.writers[b] = pa.ipc.new_stream(self.outs[b], self.schema)
        self.writers[b].write_batch(part)

    def read(self, b: int) -> Iterator[pa.RecordBatch]:
        with self.fs.open_input_stream(f"{self.dir}/{b}") as f, pa.ipc.open_stream(f) as reader:
            yield from reader

    def close(self) -> None:
        for b, w in self.writers.items():
            w.close()
            self.outs[b].close()

    def remove(self) -> None:
        self.fs.delete_dir(self.dir)


def _connection(uri: str):
    """A database for one partition after another; what it must spill itself goes to the shared folder, or is refused."""
    import duckdb

    con = duckdb.connect(config={"threads": 1, "memory_limit": "700MB"})
    own = f"{uri[7:]}/duckdb-{uuid.uuid4().hex}" if uri.startswith("file://") else ""
    con.execute(f"SET temp_directory = '{own.replace(chr(39), chr(39) * 2)}'")
    return con


def partial_counts(batches: Iterator[pa.RecordBatch], fields: int, uri: str, bound: int, level: int = 0, con=None) -> Iterator[pa.Table]:
    """Partial counts of a stream of rows, which holds at most ``bound`` bytes: the largest partitions are spilled beyond."""
    con = con or _connection(uri)
    held: dict[int, list[pa.RecordBatch]] = {}
    sizes: dict[int, int] = {}
    spill = None
    for batch in batches:
        bucket = _bucket(batch, level) if level < _LEVELS else None
        for b in [0] if bucket is None else sorted(set(bucket.tolist())):
            part = batch if bucket is None else batch.filter(pa.array(bucket == b))
            if spill is not None and b in spill.writers:
                spill.add(b, part)
                continue
            held.setdefault(b, []).append(part)
            sizes[b] = sizes.get(b, 0) + part.nbytes
        while sum(sizes.values()) > bound and level < _LEVELS:
            spill = spill or _Spill(uri, batch.schema, level)
            largest = max(sizes, key=sizes.get)
            for part in held.pop(largest):
                spill.add(largest, part)
            del sizes[largest]
    for b in sorted(held):
        con.register("rows", pa.Table.from_batches(held[b]))
        yield con.sql(_counting(fields)).to_arrow_table()
        con.unregister("rows")
        held[b] = []
    if spill is not None:
        spill.close()
        try:
            for b in sorted(spill.writers):
                yield from partial_counts(spill.read(b), fields, uri, bound, level + 1, con)
        finally:
            spill.remove()


def frequencies(df: DataFrame, fields: list[str], doc: str = "mdoc_id", row_key: str = "form_id", common_share: float = 0.2, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """(field_name, term, occurrences, documents, mark); mark: rare, common or null."""
    uri = scratch(df.sparkSession, "radix")
    n = len(fields)
    base = df.select(F.col(doc).cast("bigint").alias("doc"), F.col(row_key).cast("bigint").alias("row_key"), *[F.col(f).cast("string").alias(f"f{i}") for i, f in enumerate(fields)]).where("doc is not null and row_key is not null")
    # one row per distinct term of a source row, with a bit for each field that holds it
    pairs = []
    for i in range(n):
        flags = sum((F.when(F.col(f"f{j}").eqNullSafe(F.col(f"f{i}")), F.lit(1 << j)).otherwise(F.lit(0)) for j in range(n)), F.lit(0))
        first = F.lit(True)
        for j in range(i):
            first = first & ~F.col(f"f{j}").eqNullSafe(F.col(f"f{i}"))
        pairs.append(F.when(first & (F.col(f"f{i}") != ""), F.struct(F.col(f"f{i}").alias("term"), flags.cast("int").alias("flags"))))
    rows = base.select("doc", "row_key", F.explode(F.filter(F.array(*pairs), lambda x: x.isNotNull())).alias("t")).select("t.term", "doc", "row_key", "t.flags")
    rows = rows.repartition("term", "doc").withColumns({"by_term": F.xxhash64("term"), "by_both": F.xxhash64("doc", "term")})
    ddl = "term string, " + ", ".join(f"n{i} bigint, d{i} bigint" for i in range(n))
    arrow = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in partial_counts(batches, n, uri, partition_bytes):
            for b in t.to_batches(max_chunksize=50_000):
                yield arrow_batch(arrow, b.columns)

    counts = rows.mapInArrow(run, ddl).groupBy("term").agg(*[F.sum(c).alias(c) for i in range(n) for c in (f"n{i}", f"d{i}")])
    any_term = [F.max((F.col(f"f{i}").isNotNull() & (F.col(f"f{i}") != "")).cast("int")).alias(f"h{i}") for i in range(n)]
    totals = base.groupBy("doc").agg(*any_term).agg(*[F.coalesce(F.sum(f"h{i}"), F.lit(0)).alias(f"h{i}") for i in range(n)])
    # one row per field on either side; the totals are as many rows as there are fields
    stacked = totals.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"h{i}").alias("with_terms")) for i, f in enumerate(fields)])).alias("x")).select("x.*")
    out = counts.select("term", F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"n{i}").alias("occurrences"), F.col(f"d{i}").alias("documents")) for i, f in enumerate(fields)])).alias("x"))
    out = out.select("x.field_name", "term", "x.occurrences", "x.documents").where("documents > 0").join(F.broadcast(stacked), "field_name")
    mark = F.when(F.col("documents") == 1, "rare").when(F.col("documents") > F.lit(common_share) * F.col("with_terms"), "common")
    return out.select("field_name", "term", "occurrences", "documents", mark.alias("mark"))
