"""Which lemmas of a token count, as native expressions over ARRAY<STRUCT<lemma, weight, ...>>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def all_lemmas(analyses: Column) -> Column:
    """The distinct non-empty lemmas as first seen; an empty array for none and for null."""
    found = F.filter(F.transform(analyses, lambda a: a["lemma"]), lambda x: x != "")
    return F.coalesce(F.array_distinct(found), F.array().cast("array<string>"))


def best_lemma(analyses: Column) -> Column:
    """The non-empty lemma of the greatest weight, the first of ties; without weights the first; else null."""
    filled = F.filter(analyses, lambda a: a["lemma"] != "")
    weighted = F.filter(filled, lambda a: a["weight"].isNotNull())
    top = F.array_max(F.transform(weighted, lambda a: a["weight"]))
    best = F.get(F.filter(weighted, lambda a: a["weight"] == top), F.lit(0))
    return F.when(F.size(weighted) > 0, best["lemma"]).otherwise(F.get(filled, F.lit(0))["lemma"])
