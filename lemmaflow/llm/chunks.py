"""Oversized texts cut into pieces at natural boundaries, range by range.

A text is read in byte ranges with a halo on either side. Each range gives a boundary table: its length in
UTF-16 units, its natural cuts with their rank, the places of two-unit characters, and how long it stays
unbroken at its edges. Prefix sums of the lengths turn these into places in the whole text, and a walk
over the stitched tables, which holds one window of them at a time, emits the pieces by offset.

Texts of a table are walked where they lie, range after range, without a shuffle. Files are read by as
many tasks as they have ranges; their tables are stitched section by section (split_files).

Rules: lengths and offsets are UTF-16 units. A piece is at most the limit long, unless the limit is 1 and
the character takes 2. Cuts prefer the highest rank in the later half of a piece (blank line, sentence
end, line end, white space, punctuation), else the last natural cut that makes progress, else the limit;
never inside a character. Consecutive pieces share exactly the overlap (one more, or one less if only
that goes on, where it would cut a character; at most the limit less one). A null, empty or blank text is never oversized for being blank;
texts within the limit have no pieces. A limit of null is the default with its own overlap kept; a limit
under 1 counts as 1, a null or negative overlap as 0. A key that comes again with the same text counts
once; with another text, both are cut.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lemmaflow.errors import InvalidOptions
from lemmaflow.runtime import arrow_batch, arrow_schema, staged

#: Fixed value: the limit where none is given.
DEFAULT_LIMIT = 32_768
#: Bytes of a range of a text, and code points of the halo that is read with it on either side.
RANGE, HALO = 65_536, 256
#: Tasks that ranges or sections are spread over at most; their number is set, as their rows are small and their work isn't.
MOST_TASKS = 20_000
#: Bytes of a section of a file. Longer files are first cut at the best natural place in the first range of each further section.
SECTION = 512 << 20
_TERMINAL = frozenset(".!?…。！？｡．։።፧؟۔।॥")
_WIDE_TERMINAL = frozenset("。！？｡．։።፧।॥")
_BLANKS = r"\p{Z}\t\n\x0b\x0c\r"
#: A file's boundary table: a cut and its rank share a number, cut * 8 + rank.
_TABLE = "units int, cuts array<int>, wide array<int>"


def boundary_table(before: str, core: str, after: str):
    """The boundary table of ``core``; ``before`` and ``after`` are its halo."""
    import regex

    text = before + core + after
    lo, hi = len(before), len(before) + len(core)
    codes = np.frombuffer(core.encode("utf-32-le"), np.uint32)
    big = codes > 0xFFFF
    at = np.concatenate([[0], np.cumsum(1 + big)])
    cuts, ranks, edges = [], [], []
    for m in regex.finditer(rf"[{_BLANKS}\p{{P}}]+", text):
        a, b = m.span()
        if b <= lo or a >= hi:
            continue
        run = m.group()
        edges.append((max(a, lo) - lo, min(b, hi) - lo))
        blank = max((i for i, c in enumerate(run, 1) if c.isspace()), default=0)
        if blank:
            head = run[:blank]
            lines = head.count("\n")
            rank = 4 if lines > 1 else 3 if not _TERMINAL.isdisjoint(head) else 2 if lines else 1
            cut = a + blank
        else:
            rank, cut = (3 if not _WIDE_TERMINAL.isdisjoint(run) else 0), b
        if lo < cut <= hi:  # a cut at the very start belongs to the range before
            cuts.append(int(at[cut - lo]))
            ranks.append(rank)
    units = int(at[-1])
    if not edges:
        lead = inner = trail = units
    else:
        lead, trail = int(at[edges[0][0]]), units - int(at[edges[-1][1]])
        inner = max((int(at[y[0]] - at[x[1]]) for x, y in zip(edges, edges[1:])), default=0)
    return units, cuts, ranks, at[:-1][big].tolist(), lead, inner, trail


class _Walk:
    """Cuts one text into pieces while its boundary tables arrive in order."""

    def __init__(self, key, limit: int | None, overlap: int | None):
        self.key, self.limit = key, max(1, DEFAULT_LIMIT if limit is None else limit)
        self.overlap = min(max(0, overlap or 0), self.limit - 1)
        self.total = self.start = self.number = 0
        self.cuts: list[int] = []
        self.ranks: list[int] = []
        self.wide: list[int] = []
        self.run = self.longest = 0

    def _inside(self, p: int) -> bool:
        k = bisect_left(self.wide, p - 1)
        return k < len(self.wide) and self.wide[k] == p - 1

    def _pieces(self, final: bool) -> Iterator[tuple]:
        while self.total - self.start > self.limit:
            s, end = self.start, self.start + self.limit
            a, b = bisect_right(self.cuts, s + max(self.overlap, self.limit // 2)), bisect_right(self.cuts, end)
            if a < b:
                top = max(self.ranks[a:b])
                cut = next(self.cuts[k] for k in range(b - 1, a - 1, -1) if self.ranks[k] == top)
            else:
                k = b - 1
                if k >= 0 and self.cuts[k] > s + self.overlap:
                    cut = self.cuts[k]
                else:
                    cut = end - 1 if self._inside(end) else end
                    if cut <= s:
                        cut = s + 2
            yield self._emit(s, cut)
            nxt = cut - self.overlap
            if self._inside(nxt):
                nxt += -1 if nxt - 1 > s else 1
            self.start = nxt if nxt > s else cut
            drop = bisect_left(self.cuts, self.start)
            del self.cuts[:drop], self.ranks[:drop]
            del self.wide[: bisect_left(self.wide, self.start - 1)]
        if final and self.number and self.total > self.start:
            yield self._emit(self.start, self.total)

    def _emit(self, a: int, b: int) -> tuple:
        self.number += 1
        return self.key, self.number - 1, a, b

    def add(self, units, cuts, ranks, wide, lead, inner, trail) -> Iterator[tuple]:
        base = self.total
        self.cuts += [base + c for c in cuts]
        self.ranks += ranks
        self.wide += [base + w for w in wide]
        self.total += units
        self.run += lead
        self.longest = max(self.longest, self.run, inner)
        if lead < units or not units:
            self.run = trail
        yield from self._pieces(False)

    def end(self) -> Iterator[tuple]:
        yield from self._pieces(True)


def _utf8_start(data, at: int) -> int:
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1
    return at


def _ranges(data: memoryview) -> Iterator[tuple[int, str, str, str]]:
    """(first byte, text before, text, text behind) of the ranges of UTF-8 bytes."""
    edges = [*range(0, len(data), RANGE), len(data)]
    edges = list(dict.fromkeys(_utf8_start(data, e) for e in edges))
    for a, b in zip(edges, edges[1:]):
        left = bytes(data[_utf8_start(data, max(0, a - 4 * HALO)) : a]).decode()
        right = bytes(data[b : _utf8_start(data, min(len(data), b + 4 * HALO))]).decode()
        yield a, left[-HALO:], bytes(data[a:b]).decode(), right[:HALO]


class _Bytes:
    """Byte places of UTF-16 places, for the part of a text that a walk still holds."""

    def __init__(self):
        self.held: deque[tuple[int, int, np.ndarray, np.ndarray]] = deque()

    def add(self, unit: int, byte: int, core: str) -> None:
        codes = np.frombuffer(core.encode("utf-32-le"), np.uint32)
        units = np.concatenate([[0], np.cumsum(1 + (codes > 0xFFFF))])
        sizes = np.concatenate([[0], np.cumsum(1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF))])
        self.held.append((unit, byte, units, sizes))

    def at(self, unit: int) -> int:
        """The byte of a place at or behind those asked before, less one window."""
        first, byte, units, sizes = next(x for x in self.held if unit <= x[0] + x[2][-1])
        return int(byte + sizes[np.searchsorted(units, unit - first)])

    def drop(self, unit: int) -> None:
        while len(self.held) > 1 and self.held[0][0] + self.held[0][2][-1] < unit:
            self.held.popleft()


def _walk_text(key, data: memoryview, limit: int | None, overlap: int | None, pieces: bool) -> tuple[_Walk, list[tuple]]:
    """The walk over one text, and with ``pieces`` its pieces: (key, number, start, end, text)."""
    walk, places, out = _Walk(key, limit, overlap), _Bytes(), []

    def keep(got: Iterator[tuple]) -> None:
        for k, number, a, b in got:
            if pieces:
                out.append((k, number, a, b, bytes(data[places.at(a) : places.at(b)]).decode()))
                places.drop(max(0, a))

    for byte, before, core, after in _ranges(data):
        if pieces:
            places.add(walk.total, byte, core)
        keep(walk.add(*boundary_table(before, core, after)))
    keep(walk.end())
    return walk, out


def _walked(df: DataFrame, key: str, text: str, limit: str, overlap: str, ddl: str, pieces: bool, rows) -> DataFrame:
    """``rows(walk, pieces, digest)`` of every text that is longer than its limit, in one narrow pass."""
    arrow = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            out, size = [], 0
            texts = batch.column(1)
            for n, (k, lim, over) in enumerate(zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)))):
                data = memoryview(texts[n].as_buffer())
                if len(data) <= max(1, DEFAULT_LIMIT if lim is None else lim):
                    continue  # no text has more units than bytes
                walk, found = _walk_text(k, data, lim, over, pieces)
                if walk.total > walk.limit:
                    out += rows(walk, found, xxhash.xxh64_intdigest(data) - (1 << 63))
                    size += len(data)
                if size > 32 << 20:
                    yield arrow_batch(arrow, zip(*out))
                    out, size = [], 0
            yield arrow_batch(arrow, zip(*out) if out else [[] for _ in arrow])

    docs = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"), F.col(limit).cast("int").alias("limit"), F.col(overlap).cast("int").alias("overlap"))
    return docs.where("k is not null and t <> ''").mapInArrow(run, ddl)


def oversized_cases(df: DataFrame, key: str, text: str, limit: str, overlap: str) -> DataFrame:
    """(key, units, pieces, oversized, unbroken) of the texts that are cut, for each key and text once."""

    def rows(walk: _Walk, found: list, digest: int) -> list[tuple]:
        return [(walk.key, walk.total, walk.number, walk.number > 1, max(walk.longest, walk.run) > walk.limit, digest)]

    ddl = f"k {dict(df.dtypes)[key]}, units bigint, pieces bigint, oversized boolean, unbroken boolean, h bigint"
    return _walked(df, key, text, limit, overlap, ddl, False, rows).dropDuplicates(["k", "h"]).drop("h").withColumnRenamed("k", key)


def split_texts(df: DataFrame, key: str, text: str, limit: str, overlap: str, unique: bool = False) -> DataFrame:
    """(key, piece_no, start, end, piece): the pieces with their text.

    ``unique`` says that no key comes again (see runtime.first_deliveries); otherwise pieces are shuffled
    to drop repeated ones.
    """

    def rows(walk: _Walk, found: list, digest: int) -> list[tuple]:
        return [(*r, digest) for r in found]

    ddl = f"k {dict(df.dtypes)[key]}, piece_no bigint, start bigint, end bigint, piece string, h bigint"
    out = _walked(df, key, text, limit, overlap, ddl, True, rows)
    return (out if unique else out.dropDuplicates(["k", "h", "piece_no"])).drop("h").withColumnRenamed("k", key)


def _sections(tables: DataFrame, per_section: int, limit: int, overlap: int, around: int, tasks: int) -> DataFrame:
    """(k, piece_no, start, end) of files from the boundary tables of their ranges.

    A section is walked by one task from its certain cut to that of the next one; both lie in first
    ranges, so a section has the first range of the next besides its own, and ``around`` ranges of the one before
    for the overlap. Only the lengths of sections and the numbers of their pieces are summed up file by file.
    """
    in_order = Window.partitionBy("k").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    tables = tables.withColumn("s", F.floor(F.col("r") / per_section).cast("bigint"))
    lengths = tables.groupBy("k", "s").agg(F.sum("units").alias("units"))
    bases = lengths.select("k", "s", F.coalesce(F.sum("units").over(in_order), F.lit(0)).alias("base"), F.max("s").over(Window.partitionBy("k")).alias("last"))
    place = F.col("r") - F.col("s") * per_section
    uses = F.array_compact(F.array("s", F.when((place == 0) & (F.col("s") > 0), F.col("s") - 1), F.when(place >= per_section - around, F.col("s") + 1)))
    given = tables.withColumn("own", F.col("s")).withColumn("s", F.explode(uses)).join(bases, ["k", "s"])
    ddl = "k string, s bigint, n bigint, start bigint, end bigint"
    arrow = arrow_schema(ddl)

    def certain(x: dict) -> int:
        """The best cut in the first range of a section, from its start; the start itself if there is none."""
        top = max((c % 8 for c in x["cuts"]), default=0)
        return next((c // 8 for c in x["cuts"] if c % 8 == top), 0)

    def walked(rows: list[dict]) -> list[tuple]:
        k, s, base, last = (rows[0][c] for c in ("k", "s", "base", "last"))
        before = [x for x in rows if x["own"] < s]
        walk = _Walk(k, limit, overlap)
        walk.total = base - sum(x["units"] for x in before)
        first = next(x for x in rows if x["own"] == s)
        if s:
            walk.start = max(0, base + certain(first) - walk.overlap)
        out = []
        for x in rows:
            end = certain(x) if x["own"] > s else x["units"]
            at = walk.total
            walk.cuts += [at + c // 8 for c in x["cuts"] if c // 8 <= end]
            walk.ranks += [c % 8 for c in x["cuts"] if c // 8 <= end]
            walk.wide += [at + w for w in x["wide"] if w < end]
            walk.total += end
            if x is first and s and walk._inside(walk.start):
                walk.start -= 1
            if x["own"] >= s:
                out += walk._pieces(False)
        if walk.total > walk.start and (walk.number or last):
            out.append(walk._emit(walk.start, walk.total))
        return [(k, s, n, a, b) for _, n, a, b in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            out: list[tuple] = []
            for x in batch.to_pylist():
                if held and (held[0]["k"], held[0]["s"]) != (x["k"], x["s"]):
                    out += walked(held)
                    held = []
                held.append(x)
            yield arrow_batch(arrow, zip(*out) if out else [[] for _ in arrow])
        out = walked(held) if held else []
        yield arrow_batch(arrow, zip(*out) if out else [[] for _ in arrow])

    pieces = staged(given.repartition(tasks, "k", "s").sortWithinPartitions("k", "s", "r").mapInArrow(run, ddl), "pieces")
    counts = pieces.groupBy("k", "s").agg(F.count("*").alias("c"))
    firsts = counts.select("k", "s", F.coalesce(F.sum("c").over(in_order), F.lit(0)).alias("first"))
    return pieces.join(firsts, ["k", "s"]).select("k", (F.col("first") + F.col("n")).alias("piece_no"), "start", "end")


def split_files(spark, files: list[tuple[str, int]], limit: int = DEFAULT_LIMIT, overlap: int = 0, range_bytes: int = 8 << 20, section_bytes: int | None = None) -> DataFrame:
    """(path, piece_no, start, end) in UTF-16 units of UTF-8 files given as (URI, size in bytes).

    Tasks read only their byte range and its halo through the file's own file system; a range begins at
    the first whole character at or behind its offset, so that neighbours meet without gap or overlap.
    A file of more than ``section_bytes`` is walked by several tasks, one for each section. A range has
    at most 256 MB.
    """
    if not 0 < range_bytes <= 256 << 20:
        raise InvalidOptions("a range has between one byte and 256 MB")
    ddl = f"k string, r bigint, {_TABLE}"
    arrow = arrow_schema(ddl)
    halo = 4 * HALO
    per_section = max(1, (section_bytes or SECTION) // range_bytes)
    around = 1 + 4 * max(0, overlap) // range_bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            out = []
            for x in batch.to_pylist():
                system, path = fs.FileSystem.from_uri(x["k"])
                with system.open_input_file(path) as f:
                    lo = max(0, x["at"] - halo)
                    data = f.read_at(x["n"] + halo + x["at"] - lo, lo)
                a = _utf8_start(data, x["at"] - lo)
                b = _utf8_start(data, min(len(data), x["at"] - lo + x["n"]))
                left = data[_utf8_start(data, 0) : a].decode("utf-8", "replace")
                right = data[b:].decode("utf-8", "ignore")
                units, cuts, ranks, wide, *_ = boundary_table(left[-HALO:], data[a:b].decode("utf-8", "replace"), right[:HALO])
                out.append((x["k"], x["r"], units, (np.array(cuts, np.int32) * 8 + np.array(ranks, np.int32)), wide))
            yield arrow_batch(arrow, zip(*out) if out else [[] for _ in arrow])

    listed = spark.createDataFrame(files or [("", 0)], "k string, size bigint").where("size > 0")
    ranges = listed.select("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("size") / range_bytes) - 1)).alias("r"), "size")
    ranges = ranges.select("k", "r", (F.col("r") * range_bytes).alias("at"), F.least(F.lit(range_bytes), F.col("size") - F.col("r") * range_bytes).alias("n"))
    # the tables are written once: lengths are summed before the tables are walked
    tasks = lambda size: min(MOST_TASKS, max(1, sum(-(-n // size) for _, n in files)))
    tables = staged(ranges.repartition(tasks(range_bytes), "k", "r").mapInArrow(run, ddl), "boundaries")
    return _sections(tables, per_section, limit, overlap, min(around, per_section), tasks(per_section * range_bytes)).withColumnRenamed("k", "path")
