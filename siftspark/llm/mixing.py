"""Mixing sources to target weights by hash-random order and exact token budgets.

A document's key is the MD5 of the seed and its id. Within a source, documents are sorted by key in
ranges of the key (uniform, so the ranges are balanced whatever the source's size), token counts are
summed by range, ranges are offset by the sums before them, and only within a range does a running
sum go row by row. A source whose budget exceeds its tokens repeats whole epochs, and the last epoch
is cut where the budget is met.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftspark.functions.durable import durable
from siftspark.llm.frames import fresh

SEED = "mix-1"
ALPHA = 0.5
_RANGE = 3


def token_count(text: Column) -> Column:
    """Runs of other than blanks, tabs and line ends; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\r]+")), F.lit(0)).cast("long")


def random_key(doc_id: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def budgets(totals: DataFrame, weights: dict[str, float] | None, alpha: float, total: int | None) -> DataFrame:
    """(source, tokens, budget): the total, or all tokens there are, shared out by weight and rounded down.

    Weights are the given ones (a source without one gets nothing), or tokens**alpha.
    """
    if weights is not None:
        entries = [x for kv in weights.items() for x in (F.lit(kv[0]), F.lit(float(kv[1])))]
        weight = F.coalesce(F.element_at(F.create_map(*entries), F.col("source")), F.lit(0.0)) if entries else F.lit(0.0)
    else:
        weight = F.sqrt(F.col("tokens").cast("double")) if alpha == 0.5 else F.pow(F.col("tokens").cast("double"), F.lit(alpha))
    unit = F.when(F.col("tokens") > 0, F.floor(weight * 1_000_000).cast("long")).otherwise(F.lit(0))
    weighted = totals.withColumn("unit", unit)
    wanted = F.lit(total).cast("decimal(20,0)") if total is not None else F.sum("tokens").cast("decimal(20,0)")
    sums = weighted.agg(F.sum("unit").cast("decimal(18,0)").alias("units"), wanted.alias("wanted"))
    share = F.expr("CASE WHEN units > 0 THEN wanted * CAST(unit AS DECIMAL(18,0)) div units ELSE 0 END").cast("long")
    return weighted.crossJoin(sums).select("source", "tokens", share.alias("budget"))


def _slim(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str) -> DataFrame:
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
        token_count(F.col(text_col)).alias("tokens"),
        random_key(F.col(id_col), seed).alias("key"),
    )


def _placed(docs: DataFrame, weights: dict[str, float] | None, alpha: float, total: int | None, seed: str, cols: tuple[str, str, str]) -> DataFrame:
    """Each row with the tokens of its source's order before it, and its source's totals."""
    slim = durable(_slim(docs, *cols, seed)).withColumn("range", F.substring("key", 1, _RANGE))
    ranges = slim.groupBy("source", "range").agg(F.sum("tokens").alias("own"))
    before = F.coalesce(F.sum("own").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = ranges.select(F.col("source").alias("_s"), F.col("range").alias("_r"), before.alias("offset"))
    plan = budgets(slim.groupBy("source").agg(F.sum("tokens").alias("tokens")), weights, alpha, total)
    plan = plan.select(F.col("source").alias("_p"), F.col("tokens").alias("source_tokens"), "budget")
    within = Window.partitionBy("source", "range").orderBy("key", F.col("doc_id").asc_nulls_first(), "tokens")
    running = F.sum("tokens").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens")
    summed = slim.withColumn("inside", running)
    return (
        summed.join(offsets, (F.col("source") == F.col("_s")) & (F.col("range") == F.col("_r")))
        .join(plan, F.col("source") == F.col("_p"))
        .select("doc_id", "source", "key", "tokens", (F.col("offset") + F.col("inside")).alias("before"), "source_tokens", "budget")
    )


def _epochs() -> Column:
    """How often a row is drawn: whole epochs, and once more if the cut comes after it begins."""
    whole = F.floor(F.col("budget") / F.col("source_tokens"))
    more = (F.col("before") < F.col("budget") - whole * F.col("source_tokens")) & (F.col("tokens") > 0)
    return F.when(F.col("source_tokens") > 0, whole + more.cast("long")).otherwise(F.lit(0)).cast("long")


def mix(
    docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = ALPHA, total: int | None = None, seed: str = SEED,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """(doc_id, source, epoch, tokens, taken): each draw of each document; ``taken`` sums to each budget exactly.

    ``taken`` is less than ``tokens`` only for the document at the cut of its source. A null source
    counts as the source ''. A null id is hashed as "null"; rows of equal key are ordered by id and
    token count, and repeated rows are so many documents. Texts without tokens are drawn in whole
    epochs only. A source without tokens gets nothing. An empty table gives an empty result. Only
    the named columns are read.
    """
    placed = _placed(docs, weights, alpha, total, seed, (id_col, text_col, source_col)).withColumn("n", _epochs()).where("n > 0")
    drawn = placed.withColumn("epoch", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    taken = F.least(F.col("tokens"), F.col("budget") - (F.col("epoch") - 1) * F.col("source_tokens") - F.col("before"))
    return drawn.select("doc_id", "source", F.col("epoch"), "tokens", taken.alias("taken"))


def mixed_documents(
    docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = ALPHA, total: int | None = None, seed: str = SEED,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """The rows of ``docs``, each as often as ``mix`` draws it, in full and with all its columns.

    The document at a source's cut is kept whole, so a source exceeds its budget by less than one
    document. Only each source's cut (its epochs and the first key beyond it) is joined to the texts,
    which are not shuffled while that table is small enough to broadcast. Rows of the cut's key stay
    or go together.
    """
    placed = _placed(docs, weights, alpha, total, seed, (id_col, text_col, source_col))
    whole = F.floor(F.col("budget") / F.col("source_tokens"))
    inside = (F.col("source_tokens") > 0) & (F.col("before") < F.col("budget") - whole * F.col("source_tokens")) & (F.col("tokens") > 0)
    cuts = durable(
        placed.groupBy("source").agg(
            F.max(F.when(F.col("source_tokens") > 0, whole).otherwise(F.lit(0))).alias("whole"), F.max(F.when(inside, F.col("key"))).alias("last")
        )
    )
    names = {c: fresh(docs, c) for c in ("source", "whole", "last", "n")}
    cuts = cuts.select(*(F.col(c).alias(names[c]) for c in ("source", "whole", "last")))
    more = (random_key(F.col(id_col), seed) <= F.col(names["last"])) & (token_count(F.col(text_col)) > 0)
    n = F.col(names["whole"]) + F.coalesce(more, F.lit(False)).cast("long")
    joined = docs.join(cuts, F.coalesce(docs[source_col].cast("string"), F.lit("")) == cuts[names["source"]])
    repeated = joined.withColumn(names["n"], F.explode(F.sequence(F.lit(1).cast("long"), F.when(n > 0, n))))
    return repeated.select(*(docs[c] for c in docs.columns))


SQL = r"""
WITH slim AS (
  SELECT doc_id, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\r]+'))::BIGINT AS tokens,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')) AS key
  FROM documents),
totals AS (
  SELECT source, sum(tokens)::BIGINT AS source_tokens FROM slim GROUP BY source),
units AS (
  SELECT *, CASE WHEN source_tokens > 0 THEN floor(sqrt(source_tokens::DOUBLE) * 1000000)::BIGINT ELSE 0 END AS unit FROM totals),
plan AS (
  SELECT source, source_tokens,
         ((SELECT sum(source_tokens) FROM totals)::HUGEINT * unit // (SELECT sum(unit) FROM units)::HUGEINT)::BIGINT AS budget
  FROM units),
placed AS (
  SELECT s.doc_id, s.source, s.tokens, p.source_tokens, p.budget, p.budget // p.source_tokens AS whole,
         (sum(s.tokens) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id NULLS FIRST, s.tokens ROWS UNBOUNDED PRECEDING) - s.tokens)::BIGINT AS before
  FROM slim s JOIN plan p USING (source) WHERE p.source_tokens > 0),
drawn AS (
  SELECT *, unnest(range(1, 1 + whole + CASE WHEN before < budget - whole * source_tokens AND tokens > 0 THEN 1 ELSE 0 END)) AS epoch FROM placed)
SELECT doc_id, source, epoch, tokens, least(tokens, budget - (epoch - 1) * source_tokens - before) AS taken FROM drawn
"""
