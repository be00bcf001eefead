"""The given tables as collections."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftspark.functions.durable import checkpoint_root
from siftspark.operators.index import Index, build
from siftspark.plans.request import SearchRequest
from siftspark.plans.schema import CollectionSchema, FieldSchema

DOCS = CollectionSchema(
    "docs",
    (FieldSchema("text", "text"), FieldSchema("lang", "keyword", facet=True), FieldSchema("source", "keyword", facet=True), FieldSchema("n_chars", "int", filter=True, sort=True)),
)
PARTS = CollectionSchema(
    "parts",
    (
        FieldSchema("title", "text"), FieldSchema("kind", "text", boost=3.0), FieldSchema("brand", "keyword", facet=True), FieldSchema("size", "int", facet=True, sort=True),
        FieldSchema("price", "float", filter=True, sort=True), FieldSchema("popularity", "int", sort=True), FieldSchema("big", "bool", facet=True),
        FieldSchema("tags", "keyword", facet=True, multi=True), FieldSchema("steps", "int", facet=True, sort=True, multi=True), FieldSchema("spare", "int", filter=True, sort=True, optional=True),
    ),
)
CHAT = CollectionSchema("chat", (FieldSchema("text", "text"), FieldSchema("role", "keyword", facet=True), FieldSchema("turn", "int", facet=True, sort=True)))
PAGES = CollectionSchema("pages", (FieldSchema("html", "text"),))

#: The parts again, in a script without spaces, with a text of several values and with dates.
ODD = CollectionSchema("odd", (FieldSchema("title", "text"), FieldSchema("names", "text", multi=True), FieldSchema("made", "date", filter=True, sort=True)))


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(
        F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("title"), F.col("p_type").alias("kind"), F.col("p_brand").alias("brand"), F.col("p_size").cast("long").alias("size"),
        F.col("p_retailprice").alias("price"), F.col("p_size").cast("long").alias("popularity"), (F.col("p_size") > 25).alias("big"),
        F.split("p_name", " ").alias("tags"), F.array(F.col("p_size").cast("long"), F.col("p_size").cast("long") % 5).alias("steps"), F.when(F.col("p_size") % 3 == 0, F.col("p_size").cast("long")).alias("spare"),
    )


def _chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text", "role", "turn")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("doc_id"), "html")


def _odd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(
        F.col("p_partkey").alias("doc_id"), F.translate("p_name", "aeiou", "日月水火木").alias("title"), F.array("p_name", "p_type", "p_brand").alias("names"), (F.col("p_partkey") * 86_400_000_000 % 1_700_000_000_000).alias("made"),
    )


TABLES = {"docs": (DOCS, _docs), "parts": (PARTS, _parts), "chat": (CHAT, _chat), "pages": (PAGES, _pages), "odd": (ODD, _odd)}


def documents(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return TABLES[name][1](spark, sf_dir)


def index(spark: SparkSession, sf_dir: str, name: str) -> Index:
    """The collection's index, built once a session into the shared folder."""
    return _index(spark, spark.sparkContext.applicationId, sf_dir, name)


def spread(docs: DataFrame) -> DataFrame:
    """The documents dealt out evenly where the scan leaves most of them to few tasks, as one file does of few row groups.

    Counting them reads the files' ends only."""
    counts = [r["count"] for r in docs.groupBy(F.spark_partition_id()).count().collect()]
    cores, rows = docs.sparkSession.sparkContext.defaultParallelism, sum(counts)
    if not rows or max(counts) * cores <= 2 * rows:
        return docs
    return docs.repartition(min(rows // 500 + 1, max(4 * cores, rows // 100_000)), "doc_id")


def opened(spark: SparkSession, sf_dir: str, name: str, request: SearchRequest) -> Index:
    """What a request reads: the index, or where it has no words the documents alone, for which nothing is built."""
    if request.query.tokens:
        return index(spark, sf_dir, name)
    return Index(TABLES[name][0], documents(spark, sf_dir, name), None, None, None)


@functools.cache
def _index(spark: SparkSession, application: str, sf_dir: str, name: str) -> Index:
    schema, read = TABLES[name]
    path = f"{checkpoint_root(spark)}/index-{name}-{uuid.uuid4().hex}"
    build(spread(read(spark, sf_dir)), schema).write(path)
    return Index.read(spark, schema, path)


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as if they were searches."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.concat(F.lit("c"), (F.col("user_id") % 3).cast("string")).alias("collection"), F.concat_ws(" ", "event_type", (F.col("user_id") % 17).cast("string")).alias("query"),
        F.when(F.col("value") < 10, 0).otherwise(F.floor("value")).cast("long").alias("found"), F.round(F.abs("value") * 1000).cast("long").alias("latency_us"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"),
    )
