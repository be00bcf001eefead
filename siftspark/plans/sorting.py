"""Sort clauses, parsed into ordering columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftspark.plans.errors import QueryError
from siftspark.plans.schema import CollectionSchema

SCORE = "_text_match"


def parse_sort(text: str, schema: CollectionSchema) -> list[tuple[str, bool]]:
    """(field, descending) of each clause."""
    clauses: list[tuple[str, bool]] = []
    for part in filter(None, map(str.strip, text.split(","))):
        name, colon, way = (x.strip() for x in part.rpartition(":"))
        if not colon or way.lower() not in ("asc", "desc"):
            raise QueryError(f"sort: {part} must end in :asc or :desc")
        field = schema.field(name)
        if name != SCORE and not (field and field.sort):
            raise QueryError(f"sort: {name} is not declared for sorting")
        if name in (n for n, _ in clauses):
            raise QueryError(f"sort: {name} comes twice")
        clauses.append((name, way.lower() == "desc"))
    if not clauses:
        raise QueryError("sort: no clause")
    return clauses


def ordering(clauses: list[tuple[str, bool]] | None, schema: CollectionSchema) -> list[Column]:
    """Clause by clause, absent values last either way, then the older document; relevance by default."""
    out = []
    for name, descending in clauses or [(SCORE, True)]:
        if name == SCORE:
            key = F.col("text_match")
        else:
            key = F.col(f"`{name}`")
            key = F.array_min(key) if schema.field(name).multi else key
        out.append(key.desc_nulls_last() if descending else key.asc_nulls_last())
    return [*out, F.col("doc_id").asc()]
