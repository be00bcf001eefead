"""The corpus pipeline: what is left of documents after each stage, and how it is packed.

Toxic documents go; repeated lines go; one document of each near-duplicate group stays; sources are
mixed to their token budgets; and what is left is packed into bins of fixed capacity.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siftspark.functions.durable import checkpoint_root
from siftspark.llm import linedups, minhash, mixing, packing, toxicity
from siftspark.llm.frames import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean_documents(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linedups.without_repeats(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("minhash_dedup", dedup_documents),
    ("mixing", mix_sources),
    ("packing", pack_bins),
]

#: Fitted scores and SimHash groups have no SQL; each stage is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bins of the last stage. Every stage is written to the shared folder and read again by the next."""
    import uuid

    folder = f"{checkpoint_root(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{folder}/{name}.parquet"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
