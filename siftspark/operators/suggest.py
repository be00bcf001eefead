"""Completions of the last word of a query, from the dictionary alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftspark.functions.fuzzy import near_terms
from siftspark.functions.text import tokenize
from siftspark.operators.index import Index
from siftspark.plans.errors import QueryError
from siftspark.plans.request import SUGGEST_LIMIT, SUGGEST_MOST, fields_of

PREFIXES = 1000


def suggest(index: Index, q: str, query_by: str | None = None, limit: int = SUGGEST_LIMIT, typo_tolerance: bool | None = None) -> DataFrame:
    """(text, edits, count): words that begin with the last word of ``q`` or are near it.

    Fewest edits first, then the words of most documents (a document counts once for each field).
    """
    by = index.schema.searchable if query_by is None else fields_of(query_by, index.schema, "query_by", lambda f: f.searchable)
    if not 1 <= limit <= SUGGEST_MOST:
        raise QueryError(f"limit goes from 1 to {SUGGEST_MOST}")
    known = index.terms.where(F.col("field").isin([f.name for f in by])).groupBy("term").agg(F.sum("df").alias("count"))
    words = tokenize(q)
    if not words:
        return known.limit(0).select(F.col("term").alias("text"), F.lit(0).alias("edits"), "count")
    word = words[-1]
    found = known.where(F.col("term").startswith(word)).orderBy("term").limit(PREFIXES).withColumn("edits", F.lit(0))
    most = index.schema.typo.budget(len(word))
    if most and (index.schema.typo.enabled if typo_tolerance is None else typo_tolerance):
        found = found.unionByName(near_terms(known, word, most).where("edits > 0"))
    best = found.groupBy("term").agg(F.min("edits").alias("edits"), F.max("count").alias("count")).where("count > 0")
    return best.select(F.col("term").alias("text"), "edits", "count").orderBy("edits", F.desc("count"), "text").limit(limit)
