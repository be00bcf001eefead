"""A seeded product catalogue and queries over it, for benchmarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftspark.plans.schema import CollectionSchema, FieldSchema

NOUNS = "mouse keyboard monitor lamp desk chair cable charger speaker headset camera tripod backpack bottle notebook printer".split()
ADJECTIVES = "wireless ergonomic compact portable silent rugged slim foldable bright modular classic vintage smart heavy soft magnetic".split()
BRANDS = [f"brand{i}" for i in range(24)]
CATEGORIES = "office audio photo travel home gaming".split()

PRODUCTS = CollectionSchema(
    "products",
    (
        FieldSchema("title", "text"), FieldSchema("description", "text", optional=True), FieldSchema("brand", "keyword", facet=True), FieldSchema("category", "keyword", facet=True),
        FieldSchema("price", "int", filter=True, sort=True), FieldSchema("rating", "float", filter=True, sort=True), FieldSchema("popularity", "int", sort=True),
    ),
)


def _pick(values: list[str], salt: int, seed: int) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.xxhash64("doc_id", F.lit(salt), F.lit(seed)), F.lit(len(values))) + 1).cast("int"))


def _number(most: int, salt: int, seed: int) -> Column:
    return F.pmod(F.xxhash64("doc_id", F.lit(salt), F.lit(seed)), F.lit(most))


def products(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    pick = lambda values, salt: _pick(values, salt, seed)
    return spark.range(n).withColumnRenamed("id", "doc_id").select(
        "doc_id", F.col("doc_id").cast("string").alias("id"), F.concat_ws(" ", pick(ADJECTIVES, 1), pick(ADJECTIVES, 2), pick(NOUNS, 3)).alias("title"),
        F.concat_ws(" ", F.lit("a"), pick(ADJECTIVES, 4), pick(NOUNS, 5), F.lit("for the"), pick(CATEGORIES, 6)).alias("description"),
        pick(BRANDS, 7).alias("brand"), pick(CATEGORIES, 8).alias("category"), (_number(99_000, 9, seed) + 1000).alias("price"),
        (_number(41, 10, seed) / 10 + 1).alias("rating"), _number(1000, 11, seed).alias("popularity"),
    )


def query_mix(n: int) -> list[str]:
    """One word, two, a phrase, a swapped pair of letters, and the first four letters, in turn."""
    out = []
    for i in range(n):
        noun, adjective = NOUNS[i * 7 % len(NOUNS)], ADJECTIVES[i * 5 % len(ADJECTIVES)]
        swapped = noun[:1] + noun[2:3] + noun[1:2] + noun[3:]
        out.append([noun, f"{adjective} {noun}", f'"{adjective} {noun}"', swapped, noun[:4]][i % 5])
    return out
