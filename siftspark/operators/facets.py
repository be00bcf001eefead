"""Counts of values over all matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftspark.plans.schema import FieldSchema

VALUES = 100


def _entries(field: FieldSchema) -> Column:
    """array<struct<field,value>> of a document's values."""
    own = F.col(f"`{field.name}`") if field.multi else F.array(F.col(f"`{field.name}`"))
    own = F.array_distinct(own) if field.type == "keyword" else own
    text = F.transform(own, lambda x: (x.cast("int") if field.type == "bool" else x).cast("string"))
    return F.transform(F.coalesce(text, F.array().cast("array<string>")), lambda v: F.struct(F.lit(field.name).alias("field"), v.alias("value")))


def facet_counts(matched: DataFrame, fields: list[FieldSchema], values: int = VALUES) -> DataFrame:
    """(field, value, count) of the ``values`` most frequent values of each field, equals in the order of the value.

    All fields are counted in one pass. A document counts once for a keyword that it holds twice,
    and twice for a number. Booleans read 1 and 0.
    """
    entries = [_entries(f) for f in fields]
    each = matched.select(F.explode(F.concat(*entries)).alias("e")).select("e.field", "e.value").where("value IS NOT NULL")
    counted = each.groupBy("field", "value").agg(F.count("*").alias("count"))
    rank = F.row_number().over(Window.partitionBy("field").orderBy(F.desc("count"), F.asc("value")))
    return counted.withColumn("_rank", rank).where(F.col("_rank") <= values).drop("_rank")
