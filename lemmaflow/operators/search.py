"""Search and statistics over postings (key, term, position, ...), all native.

Terms are compared as the index has them; run query text through the same analysis first. Filters on
terms come before every shuffle, and groups are pre-aggregated, so frequent terms are counted where
they lie.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lemmaflow.functions.text import normalize_term


def term_query(postings: DataFrame, term: str, key: str = "doc_id") -> DataFrame:
    """Documents that hold a term."""
    return postings.where(F.col("term") == term).select(key).distinct()


def pattern_query(postings: DataFrame, pattern: str, key: str = "doc_id") -> DataFrame:
    """Documents with a term that fits a pattern of ``*`` and ``?``; the pattern is only made small."""
    like = pattern.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%").replace("?", "_")
    return postings.where(F.like(F.col("term"), normalize_term(F.lit(like)))).select(key).distinct()


def analyzed_query(postings: DataFrame, queries: DataFrame, query_key: str = "query_id", key: str = "doc_id") -> DataFrame:
    """(query, document, matched_terms) for analyzed queries: postings of their own with ``query_key``."""
    asked = queries.select(query_key, "term").distinct()
    # postings are reduced to the asked terms' documents before they are counted
    found = postings.select(key, "term").join(asked, "term").distinct()
    return found.groupBy(query_key, key).agg(F.count("*").alias("matched_terms"))


def phrase_query(postings: DataFrame, terms: list[str], distances: list[int] | None = None, key: str = "doc_id") -> DataFrame:
    """Documents where the terms stand at the given distances from the first (by default 0, 1, 2, ...).

    No self-join: every hit names the place where its phrase would begin, and a document has the phrase
    where all parts name one place.
    """
    steps = list(range(len(terms))) if distances is None else distances
    if len(steps) != len(terms):
        raise ValueError("one distance for each term")
    if not terms:
        return postings.select(key).limit(0)
    parts = F.filter(F.array(*[F.when(F.col("term") == t, F.struct(F.lit(1 << n).cast("long").alias("part"), (F.col("position") - d).alias("begin"))) for n, (t, d) in enumerate(zip(terms, steps))]), lambda x: x.isNotNull())
    hits = postings.where(F.col("term").isin(*terms)).select(key, F.explode(parts).alias("x")).select(key, "x.part", "x.begin")
    whole = hits.groupBy(key, "begin").agg(F.bit_or("part").alias("seen"))
    return whole.where(F.col("seen") == (1 << len(terms)) - 1).select(key).distinct()


def boolean_query(postings: DataFrame, should: list[str] = (), must: list[str] = (), must_not: list[str] = (), k: int | None = None, key: str = "doc_id") -> DataFrame:
    """(document, score): all of ``must``, none of ``must_not``, and, without any must, some of ``should``.

    The score counts the occurrences of the wanted terms; ties are ordered by key. ``k`` keeps the best.
    """
    wanted = [*dict.fromkeys([*should, *must])]
    hits = postings.where(F.col("term").isin(*wanted, *must_not)).select(key, "term")
    count = lambda terms: F.sum(F.when(F.col("term").isin(*terms), 1).otherwise(0)) if terms else F.lit(0)
    checks = [F.max((F.col("term") == t).cast("int")).alias(f"_m{n}") for n, t in enumerate(must)]
    scored = hits.groupBy(key).agg(count(wanted).cast("bigint").alias("score"), count(list(must_not)).alias("_not"), *checks)
    scored = scored.where("_not = 0 and score > 0")
    for n in range(len(must)):
        scored = scored.where(f"_m{n} = 1")
    scored = scored.select(key, "score")
    return scored.orderBy(F.desc("score"), key).limit(k) if k else scored


def term_stats(postings: DataFrame, key: str = "doc_id") -> DataFrame:
    """(term, tf, df): occurrences and documents of every term.

    From postings in two steps, so that no term's documents gather; from the terms of distinct documents
    (analyze.document_terms) in one, with partial sums before the only shuffle.
    """
    per_doc = postings if "n" in postings.columns else postings.groupBy("term", key).agg(F.count("*").alias("n"))
    return per_doc.groupBy("term").agg(F.sum("n").alias("tf"), F.count("*").alias("df"))


def doc_stats(postings: DataFrame, key: str = "doc_id") -> DataFrame:
    """(document, n_terms, n_positions, n_distinct)."""
    per_term = postings.groupBy(key, "term").agg(F.count("*").alias("n"), F.max("position").alias("last"))
    return per_term.groupBy(key).agg(F.sum("n").alias("n_terms"), (F.max("last") + 1).cast("bigint").alias("n_positions"), F.count("*").alias("n_distinct"))


def write_postings(postings: DataFrame, path: str, buckets: int = 64) -> None:
    """Postings as Parquet, partitioned by the term's hash and sorted by term, so that a term reads one part.

    The rows of a frequent term are spread over 8 salted tasks; they stay in one directory.
    """
    slot = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")
    salted = postings.withColumn("term_bucket", slot).repartition(F.col("term_bucket"), F.pmod(F.xxhash64("position"), F.lit(8)))
    salted.sortWithinPartitions("term_bucket", "term").write.mode("overwrite").partitionBy("term_bucket").parquet(path)


def read_term(spark, path: str, term: str, buckets: int = 64) -> DataFrame:
    """The postings of one term from write_postings(): one directory, skipped row groups."""
    slot = spark.range(1).select(F.pmod(F.xxhash64(F.lit(term)), F.lit(buckets)).cast("int").alias("b")).first()["b"]
    return spark.read.parquet(path).where((F.col("term_bucket") == slot) & (F.col("term") == term))
