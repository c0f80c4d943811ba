"""Several values packed into one field: one row per value, with its place kept.

A field is cut at hard delimiters; quoted spans stay whole. What is left between hard delimiters may
hold soft ones (blanks, slashes), which either part values or belong to one. Expectation-maximisation
over the distinct segments of the whole column learns how often each value occurs, from what is certain
(values between hard delimiters or in quotes) and from the expected splits of the open segments; the
best path through each segment's lattice gives its split.

A value counts once for each of its words, so that readings of different lengths can be compared: words
are kept together if they occur together more often than apart, by the geometric mean. Besides, a value
of several words pays for being one: the price, learned in each round, is the logarithm of how many
recurring groups of words are parted for each that is kept, and the occurrences of a value share it.

Of groups that always occur within the same longer group, by words that are never certain alone, only
the longer one counts. A group of words that occurs once, or that even all its occurrences could not lift above what its words
are certain to be alone, is never kept in any round; such candidates are dropped before the first, and
segments without any other are parted at once. A value kept together has at most ``longest`` words.

Rules: null, blank and valueless fields have no row; empty values don't count; values are trimmed; a
doubled quote inside quotes stands for one; a quote opens only where a value may begin, and one that
never closes is dropped; hyphens belong to their value; repeated values are repeated rows; a redelivered
key counts once; extra columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lemmaflow.runtime import map_rows, staged

# The delimiters that always part values, and the pairs of quotes.
HARD = ",;|=、，；｜＝\t\r\n()[]{}（）"
SOFT = "/"
QUOTES = {'"': '"', "'": "'", "«": "»", "“": "”", "„": "“"}

#: Occurrences that every value is given beyond those counted.
PRIOR = 0.5

_h, _open = re.escape(HARD), "".join(QUOTES)
_SEGMENT = re.compile(
    "|".join(f"{q}((?:[^{c}]|{c}{c})*){c}(?=[\\s{_h}{re.escape(SOFT)}]|\\Z)" for q, c in QUOTES.items())
    + f"|([^{_h}]+?)(?=[{_h}]|\\Z|[\\s{re.escape(SOFT)}]+[{_open}])"
)
_ATOM = re.compile(rf"[^\s{re.escape(SOFT)}]+")
_EDGE = "".join(set(QUOTES) | set(QUOTES.values())) + " \t "


def segments(raw: str) -> list[tuple[str, bool]]:
    """(text, quoted) of the segments of a field: a quoted value, or what lies between hard delimiters."""
    out, at = [], 0
    while at < len(raw):
        if raw[at].isspace() or raw[at] in HARD or raw[at] in SOFT:
            at += 1
            continue
        m = _SEGMENT.match(raw, at)
        if not m:
            at += 1
            continue
        plain = m.group(m.re.groups)
        if plain is None:
            q = QUOTES[raw[at]]
            text = next(g for g in m.groups() if g is not None).replace(q + q, q).strip()
            if text:
                out.append((text, True))
        else:
            atoms = [a for a in (x.strip(_EDGE) for x in _ATOM.findall(plain)) if a]
            text = plain.strip().strip(_EDGE + SOFT)
            if len(atoms) == 1:
                out.append((atoms[0], True))  # nothing to decide
            elif atoms:
                out.append((text, False))
        at = m.end()
    return out


def candidates(text: str, longest: int) -> list[tuple[int, int, str]]:
    """(from atom, to atom, value) of a segment's lattice."""
    spans = [m.span() for m in _ATOM.finditer(text)]
    n = len(spans)
    return [(i, j, text[spans[i][0] : spans[j - 1][1]].strip(_EDGE)) for i in range(n) for j in range(i + 1, min(n, i + longest) + 1)]


def _shortened(value: str) -> list[tuple[str, str]]:
    """A group of three or more words without its first and without its last word, and the word left out."""
    spans = [m.span() for m in _ATOM.finditer(value)]
    if len(spans) < 3:
        return []
    return [(value[spans[1][0] :].strip(_EDGE), value[: spans[0][1]].strip(_EDGE)), (value[: spans[-2][1]].strip(_EDGE), value[spans[-1][0] :].strip(_EDGE))]


def weight(words: int, count: float, seen: int, price: float) -> float:
    """What a value adds to a path: its frequency, once for each word, less its share of the price."""
    return words * math.log(count + PRIOR) - (words - 1) * price / seen


def _lattice(edges: list[dict]):
    n = max(e["j"] for e in edges)
    rows = [[] for _ in range(n + 1)]
    for e in edges:
        rows[e["i"]].append((e["j"], e["value"], e["w"]))
    return n, rows


def best_path(edges: list[dict]) -> list[str]:
    """Values of the best split of a segment, edges having weights ``w``; of ties the one with more values."""
    n, rows = _lattice(edges)
    best: list[tuple[float, int]] = [(-math.inf, 0)] * (n + 1)
    back: list[tuple[int, str]] = [(0, "")] * (n + 1)
    best[0] = (0.0, 0)
    for i in range(n):
        s, k = best[i]
        for j, v, w in rows[i]:
            if (s + w, k + 1) > best[j]:
                best[j], back[j] = (s + w, k + 1), (i, v)
    out, at = [], n
    while at:
        at, value = back[at]
        out.append(value)
    return [v for v in reversed(out) if v]


def _log_sum(xs: list[float]) -> float:
    top = max(xs, default=-math.inf)
    return top if top == -math.inf else top + math.log(sum(math.exp(x - top) for x in xs))


def expected(edges: list[dict]) -> list[tuple[str, int, float]]:
    """(value, words, expected occurrences) of each candidate over all splits of a segment (forward-backward, in logarithms)."""
    n, rows = _lattice(edges)
    into: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
    for i in range(n):
        for j, _, w in rows[i]:
            into[j].append((i, w))
    a, b = [0.0] + [-math.inf] * n, [-math.inf] * n + [0.0]
    for j in range(1, n + 1):
        a[j] = _log_sum([a[i] + w for i, w in into[j]])
    for i in range(n - 1, -1, -1):
        b[i] = _log_sum([w + b[j] for j, _, w in rows[i]])
    return [(v, j - i, math.exp(a[i] + w + b[j] - a[n])) for i in range(n) for j, v, w in rows[i]]


def learn_splits(open_segments: DataFrame, fixed: DataFrame, rounds: int, longest: int) -> DataFrame | None:
    """(segment, values) of the distinct open segments (segment, n) that may keep words together; None if none may.

    ``fixed``: (value, n) of the values already certain.
    """
    every = map_rows(open_segments, "segment string, n bigint, i int, j int, value string", lambda x: ((x["segment"], x["n"], i, j, v) for i, j, v in candidates(x["segment"], longest)))
    every = staged(every, "packed-edges")
    certain = fixed.groupBy("value").agg(F.sum("n").cast("double").alias("c"))
    groups = every.where("j - i > 1").groupBy("value").agg(F.sum("n").alias("seen")).where("seen > 1")
    groups = staged(groups, "packed-recurring")
    within = map_rows(groups, "value string, seen bigint, word string", lambda x: ((v, x["seen"], w) for v, w in _shortened(x["value"])))
    within = within.join(certain.withColumnRenamed("value", "word"), "word", "left_anti").select("value", "seen").distinct()
    groups = groups.join(within, ["value", "seen"], "left_anti")
    words = map_rows(groups, "value string, seen bigint, words int, word string", lambda x: ((x["value"], x["seen"], len(w), y) for w in [_ATOM.findall(x["value"])] for y in w))
    alone = words.join(certain.withColumnRenamed("value", "word"), "word", "left").groupBy("value", "seen", "words").agg(F.sum(F.log(F.coalesce("c", F.lit(0.0)) + PRIOR)).alias("apart"))
    judged = staged(alone.select("value", "seen", "words", (F.col("words") * F.log(F.col("seen") + PRIOR) > F.col("apart")).alias("may")), "packed-groups")
    kept = judged.where("may").select("value", "seen")
    totals = judged.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("may").cast("int")), F.lit(0)).alias("kept")).first()
    if not totals["kept"]:
        return None
    edges = every.join(kept, "value", "left").where("j - i = 1 or seen is not null")
    live = edges.where("seen is not null").select("segment").distinct()
    # what has no candidate is parted for certain
    certain = certain.unionByName(edges.join(live, "segment", "left_anti").groupBy("value").agg(F.sum("n").cast("double").alias("c")))
    certain = staged(certain.groupBy("value").agg(F.sum("c").alias("c")), "packed-certain")
    edges = staged(edges.join(live, "segment", "left_semi"), "packed-live")

    def lattices(lexicon: DataFrame | None, price: float) -> DataFrame:
        each = edges.withColumn("c", F.lit(None).cast("double")) if lexicon is None else edges.join(lexicon, "value")
        return each.groupBy("segment", "n").agg(F.collect_list(F.struct("i", "j", "value", "seen", "c")).alias("edges"))

    def weighed(x: dict, price: float) -> list[dict]:
        # before anything is counted, a soft delimiter is twice as likely to keep words together as to part them
        for e in x["edges"]:
            k = e["j"] - e["i"]
            e["w"] = (k - 1) * math.log(2) if e["c"] is None else weight(k, e["c"], e["seen"] or 1, price)
        return x["edges"]

    def counted(lexicon: DataFrame | None, price: float) -> DataFrame:
        rows = map_rows(lattices(lexicon, price), "value string, words int, c double", lambda x: ((v, k, c * x["n"]) for v, k, c in expected(weighed(x, price))))
        sums = rows.groupBy("value").agg(F.sum("c").alias("c"))
        return staged(certain.unionByName(sums).groupBy("value").agg(F.sum("c").alias("c")), "packed-lexicon")

    def learned(lexicon: DataFrame) -> float:
        share = kept.join(lexicon, "value").agg(F.sum(F.least(F.col("c") / F.col("seen"), F.lit(1.0)))).first()[0] or 0.0
        return max(0.0, math.log((totals["n"] + 1 - share) / (share + 1)))

    lexicon = counted(None, 0.0)
    price = learned(lexicon)
    for _ in range(rounds):
        lexicon = counted(lexicon, price)
        price = learned(lexicon)
    return map_rows(lattices(lexicon, price), "segment string, values array<string>", lambda x: [(x["segment"], best_path(weighed(x, price)))])


def split_packed(df: DataFrame, key: str = "gr_id", raw: str = "raw", rounds: int = 5, longest: int = 64) -> DataFrame:
    """(key, value_pos, value): one row per packed value, positions from 0 across the whole field."""
    rows = df.select(F.col(key).alias("k"), F.col(raw).cast("string").alias("raw")).where("k is not null and trim(raw) <> ''").dropDuplicates(["k"])
    kind = dict(rows.dtypes)["k"]

    def cut(x: dict):
        for n, (text, closed) in enumerate(segments(x["raw"])):
            yield x["k"], n, text, closed, [text] if closed else [a for a in (y.strip(_EDGE) for y in _ATOM.findall(text)) if a]

    parts = staged(map_rows(rows, f"k {kind}, seg_no int, segment string, closed boolean, parted array<string>", cut), "packed-parts")
    counts = parts.groupBy("segment", "closed").agg(F.count("*").alias("n"))
    splits = learn_splits(counts.where("not closed").select("segment", "n"), counts.where("closed").select(F.col("segment").alias("value"), "n"), rounds, longest)
    values = parts.withColumnRenamed("parted", "v")
    if splits is not None:
        # only splits that keep words together are looked up; frequent segments are spread over 16 keys
        other = splits.where(F.size("values") < F.size(F.split("segment", rf"[\s{re.escape(SOFT)}]+"))).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
        salted = parts.withColumn("salt", F.when(F.col("closed"), None).otherwise(F.pmod(F.xxhash64("k"), F.lit(16)).cast("int")))
        values = salted.join(other, ["segment", "salt"], "left").select("k", "seg_no", F.coalesce("values", "parted").alias("v"))
    whole = values.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("seg_no", "v"))).alias("s"))
    flat = whole.select("k", F.posexplode(F.flatten(F.transform("s", lambda x: x["v"]))).alias("value_pos", "value"))
    return flat.select(F.col("k").alias(key), F.col("value_pos").cast("bigint").alias("value_pos"), "value")
