"""Writes as a stream: upserts and deletes appended to a log, whose latest rows are the collection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siftspark.plans.schema import CollectionSchema
from siftspark.sources.ingest import parse_documents


def write_log(writes: DataFrame, schema: CollectionSchema, path: str, checkpoint: str) -> StreamingQuery:
    """Starts a query over (value, op, seq), op being upsert or delete, whose good rows go to ``path``/log.

    A batch is one folder and is written whole or again, so that a restart adds nothing twice. Bad
    documents go to ``path``/rejected with their error.
    """

    def batch(rows: DataFrame, number: int) -> None:
        parsed = parse_documents(rows, schema).withColumn("deleted", F.col("op") == "delete")
        # A delete needs an id only.
        parsed = parsed.withColumn("error", F.when(F.col("deleted") & F.col("id").isNotNull(), None).otherwise(F.col("error")))
        parsed.persist()
        parsed.where("error IS NULL").drop("error").write.mode("overwrite").parquet(f"{path}/log/batch={number}")
        parsed.where("error IS NOT NULL").select("source", "id", "seq", "error").write.mode("overwrite").parquet(f"{path}/rejected/batch={number}")
        parsed.unpersist()

    return writes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def streamed_query_stats(log: DataFrame, delay: str = "1 hour", span: str = "10 minutes") -> DataFrame:
    """Counts of each query in windows of event time, of a stream with ``at`` (timestamp), query and found."""
    return log.withWatermark("at", delay).groupBy(F.window("at", span), "collection", "query").agg(F.count("*").alias("count"), F.sum(F.when(F.col("found") == 0, 1).otherwise(0)).alias("zero_result_count"))
