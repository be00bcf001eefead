"""JSON documents: validation, and the live snapshot of a log of writes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftspark.functions.dates import millis
from siftspark.plans.schema import CollectionSchema, FieldSchema

MAX_ID_BYTES = 256
_INTEGER = r"^-?(0|[1-9][0-9]*)$"
_NUMBER = r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$"


def _kind(value: Column) -> Column:
    """The JSON kind of a variant: OBJECT, ARRAY, STRING, BOOLEAN, NULL, or a number's type."""
    return F.regexp_extract(F.schema_of_variant(value), r"^\w+", 0)


def _scalar(value: Column, field: FieldSchema) -> tuple[Column, Column]:
    """(converted, fits) of a variant that is neither null nor an array."""
    kind = _kind(value)
    text = F.try_variant_get(value, "$", "string")
    whole = (kind == "BIGINT") | ((kind == "DECIMAL") & text.rlike(_INTEGER))
    number = kind.isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")
    as_long = text.try_cast("long")
    if field.type in ("text", "keyword"):
        return F.when(kind == "STRING", text), kind == "STRING"
    if field.type == "bool":
        return F.try_variant_get(value, "$", "boolean"), kind == "BOOLEAN"
    if field.type == "float":
        return F.try_variant_get(value, "$", "double"), number
    if field.type == "int":
        return as_long, whole & as_long.isNotNull()
    stamp = F.when(kind == "STRING", millis(text)).when(whole, as_long)
    return stamp, stamp.isNotNull()


def _field(document: Column, field: FieldSchema) -> tuple[Column, Column]:
    """(converted, error) of one declared field; absent and null are the same."""
    value = F.try_variant_get(document, f"$.{field.name}" if "-" not in field.name else f"$['{field.name}']", "variant")
    kind = F.when(value.isNull() | F.is_variant_null(value), F.lit("NULL")).otherwise(_kind(value))
    absent = kind == "NULL"
    missing = F.lit(f"{field.name} is required") if not field.optional else F.lit(None).cast("string")
    wrong = F.lit(f"{field.name} is not of type {field.type}")
    items = F.try_variant_get(value, "$", "array<variant>")
    one, fits = _scalar(value, field)
    null = lambda x: x.isNull() | F.is_variant_null(x)
    if field.multi:
        many = F.transform(items, lambda x: F.when(~null(x), _scalar(x, field)[0]))
        good = F.forall(items, lambda x: null(x) | F.coalesce(_scalar(x, field)[1], F.lit(False)))
        converted = F.when(absent, None).when(kind == "ARRAY", many).otherwise(F.array(one))
        ok = F.when(kind == "ARRAY", good).otherwise(fits)
    else:
        converted, ok = F.when(absent, None).otherwise(one), fits & (kind != "ARRAY")
    return converted.cast(field.spark_type), F.when(absent, missing).when(~F.coalesce(ok, F.lit(False)), wrong)


def parse_documents(raw: DataFrame, schema: CollectionSchema, column: str = "value") -> DataFrame:
    """(source, id, the fields, error): each document of a column of JSON texts, an array of them counting one each.

    ``error`` is null for a good document; a bad one leaves its neighbours as they are. Undeclared
    keys stay in ``source`` only. Other columns pass through ahead of these.
    """
    variant = F.try_parse_json(F.col(column))
    listed = F.when(F.col("_v").isNotNull() & (_kind(F.col("_v")) == "ARRAY"), F.try_variant_get("_v", "$", "array<variant>")).otherwise(F.array("_v"))
    others = [c for c in raw.columns if c != column]
    each = raw.withColumn("_v", variant).select(*others, F.col(column).alias("_text"), F.posexplode(listed).alias("nth", "_d"))
    identity = F.try_variant_get("_d", "$.id", "variant")
    id_kind = F.when(identity.isNotNull(), _kind(identity))
    id_ = F.when(id_kind.isin("STRING", "BIGINT", "DECIMAL", "DOUBLE"), F.try_variant_get(identity, "$", "string"))
    made = {f.name: _field(F.col("_d"), f) for f in schema.fields}
    shape = (
        F.when(F.col("_d").isNull(), F.lit("not JSON")).when(_kind(F.col("_d")) != "OBJECT", F.lit("not an object"))
        .when(identity.isNull() | F.is_variant_null(identity), F.lit("id is required")).when(id_.isNull(), F.lit("id is not a string"))
        .when((id_ == "") | (F.octet_length(id_) > MAX_ID_BYTES), F.lit(f"id has not 1 to {MAX_ID_BYTES} bytes"))
    )
    error = F.coalesce(shape, *(e for _, e in made.values()))
    return each.select(*others, "nth", F.to_json("_d").alias("source"), id_.alias("id"), *(c.alias(n) for n, (c, _) in made.items()), error.alias("error"))


def live_snapshot(log: DataFrame, key: str = "id", order: str = "seq", deleted: str = "deleted") -> DataFrame:
    """The rows of a log of upserts and deletes that are live: of each key the latest, unless it is a delete.

    One shuffle on the key, with the rank cut off before it, so that a key written often sends few
    rows.
    """
    latest = Window.partitionBy(key).orderBy(F.desc(order))
    return log.withColumn("_n", F.row_number().over(latest)).where((F.col("_n") == 1) & ~F.coalesce(F.col(deleted), F.lit(False))).drop("_n")


def without_deleted(docs: DataFrame, tombstones: DataFrame, key: str = "id") -> DataFrame:
    return docs.join(tombstones.select(key).distinct(), key, "left_anti")


def compact(parts: list[DataFrame], tombstones: DataFrame, order: str = "doc_id", key: str = "id") -> DataFrame:
    """The union of snapshots without retired versions and deleted keys; every row keeps its ``order``."""
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    latest = Window.partitionBy(key).orderBy(F.desc(order))
    return without_deleted(every.withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n"), tombstones, key)
