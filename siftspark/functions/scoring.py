"""The parts of a document's relevance as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
BM25_HALF, POPULARITY_HALF = 10.0, 100.0
WEIGHTS = {"bm25": 0.45, "boost": 0.25, "proximity": 0.15, "typo": 0.10, "popularity": 0.05}
SCALE = 1000.0


def idf(docs: Column, df: Column) -> Column:
    return F.log(1 + (docs - F.least(df, docs) + 0.5) / (df + 0.5))


def bm25(idf_: Column, tf: Column, length: Column, mean_length: Column) -> Column:
    norm = F.when(mean_length > 0, 1 - B + B * length / mean_length).otherwise(F.lit(1.0))
    return idf_ * tf * (K1 + 1) / (tf + K1 * norm)


def saturated(x: Column, half: float) -> Column:
    return F.when((x > 0) & (x < float("inf")), x / (x + half)).otherwise(F.lit(0.0))


def smallest_span(lists: Column, n: Column) -> Column:
    """The least distance that holds a position from each of ``n`` ascending lists (array<array<int>>).

    One sweep over all positions in order, with the last one seen of each list.
    """
    tagged = F.array_sort(F.flatten(F.transform(lists, lambda own, i: F.transform(own, lambda p: F.struct(p.alias("p"), i.alias("i"))))))
    start = F.struct(F.transform(lists, lambda _: F.lit(None).cast("int")).alias("last"), F.lit(2147483647).alias("best"))

    def step(acc: Column, x: Column) -> Column:
        last = F.transform(acc["last"], lambda p, i: F.when(i == x["i"], x["p"]).otherwise(p))
        whole = ~F.exists(last, lambda p: p.isNull())
        return F.struct(last.alias("last"), F.when(whole, F.least(acc["best"], x["p"] - F.array_min(last))).otherwise(acc["best"]).alias("best"))

    return F.aggregate(tagged, start, step, lambda acc: acc["best"])


def proximity(lists: Column, asked: int) -> Column:
    """1 where the matched words stand side by side, less the further apart; in proportion if words are missing."""
    n = F.size(lists)
    span = smallest_span(lists, n)
    tight = F.when(n <= 1, F.lit(1.0)).when(span > 0, F.least(F.lit(1.0), (n - 1) / span)).otherwise(F.lit(1.0))
    return F.when(n < asked, tight * n / F.lit(float(asked))).otherwise(tight)


def typo(used: Column, allowed: int) -> Column:
    return F.lit(1.0) if allowed == 0 else 1.0 - F.least(used / F.lit(float(allowed)), F.lit(1.0))


def combined(bm25_: Column, boost: Column, proximity_: Column, typo_: Column, popularity: Column) -> Column:
    w = WEIGHTS
    return SCALE * (w["bm25"] * saturated(bm25_, BM25_HALF) + w["boost"] * boost + w["proximity"] * proximity_ + w["typo"] * typo_ + w["popularity"] * popularity)
