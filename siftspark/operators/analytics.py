"""What a query log tells: frequent queries, queries without results, latency, throughput.

The log has the columns collection, query, found, latency_us and ts (epoch milliseconds).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LIMIT, MOST = 20, 500
BUCKETS = 32


def query_stats(log: DataFrame) -> DataFrame:
    """One row for each collection and query that isn't blank."""
    last = F.max_by("found", F.struct("ts", "found"))
    return log.where(F.trim("query") != "").groupBy("collection", "query").agg(
        F.count("*").alias("count"), F.sum(F.when(F.col("found") == 0, 1).otherwise(0)).cast("long").alias("zero_result_count"),
        last.alias("last_result_count"), (F.sum("latency_us") / F.count("*") / 1000).alias("avg_latency_ms"), F.max("ts").alias("last_seen"),
    )


def top_queries(log: DataFrame, limit: int = LIMIT) -> DataFrame:
    return query_stats(log).orderBy(F.desc("count"), F.desc("last_seen"), "query", "collection").limit(min(limit, MOST))


def zero_result_queries(log: DataFrame, limit: int = LIMIT) -> DataFrame:
    return query_stats(log).where("zero_result_count > 0").orderBy(F.desc("zero_result_count"), F.desc("last_seen"), "query", "collection").limit(min(limit, MOST))


def bucket(latency_us: Column) -> Column:
    """The place of the highest bit: powers of two, the last bucket open."""
    return F.least(F.greatest(F.length(F.bin(latency_us)) - 1, F.lit(0)), F.lit(BUCKETS - 1)).cast("int")


def latency_histogram(log: DataFrame) -> DataFrame:
    return log.groupBy(bucket(F.col("latency_us")).alias("bucket")).agg(F.count("*").alias("count"))


def latency(log: DataFrame, shares: tuple[int, ...] = (50, 95, 99)) -> DataFrame:
    """(percentile, latency_us): the upper edge of the bucket that holds it, the greatest latency at most."""
    counts = log.groupBy(bucket(F.col("latency_us")).alias("bucket")).agg(F.count("*").alias("n"), F.max("latency_us").alias("most"))
    # There are at most BUCKETS rows from here on.
    up_to = counts.withColumn("upto", F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("bucket"))).withColumns({k: F.expr(v).over(Window.partitionBy(F.lit(0))) for k, v in (("total", "sum(n)"), ("greatest", "max(most)"))})
    wanted = up_to.select("*", F.explode(F.array(*map(F.lit, shares))).alias("percentile"))
    reached = wanted.where(F.col("upto") * 100 >= F.col("total") * F.col("percentile"))
    first = reached.groupBy("percentile").agg(F.min("bucket").alias("bucket"), F.max("greatest").alias("greatest"))
    edge = F.expr("shiftleft(CAST(1 AS BIGINT), bucket + 1)")
    return first.select("percentile", F.least(edge, F.greatest(F.col("greatest"), F.lit(1).cast("long"))).alias("latency_us"))


def throughput(log: DataFrame) -> DataFrame:
    """(total, seconds, per_second) over the time that the log spans."""
    spanned = log.agg(F.count("*").alias("total"), ((F.max("ts") - F.min("ts")) / 1000).alias("seconds"))
    return spanned.withColumn("per_second", F.when(F.col("seconds") > 0, F.col("total") / F.col("seconds")).otherwise(F.lit(0.0)))
