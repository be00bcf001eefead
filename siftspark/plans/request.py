"""What a search or a completion asks for, checked against the schema."""

from __future__ import annotations

from dataclasses import dataclass, field

import regex
from pyspark.sql import Column

from siftspark.functions.text import tokenize
from siftspark.plans.errors import QueryError
from siftspark.plans.filters import parse_filter
from siftspark.plans.schema import CollectionSchema, FieldSchema
from siftspark.plans.sorting import parse_sort

LIMIT, MOST, WINDOW = 10, 250, 10_000
SUGGEST_LIMIT, SUGGEST_MOST = 5, 50


@dataclass(frozen=True)
class Query:
    """Tokens in order, and each phrase as the places of its first and last token."""

    tokens: list[str]
    phrases: list[tuple[int, int]] = field(default_factory=list)

    def in_phrase(self, i: int) -> bool:
        return any(a <= i <= b for a, b in self.phrases)


def parse_query(text: str) -> Query:
    """Words between double quotes are a phrase if there are two at least; a quote without an end is none."""
    tokens, phrases, at = [], [], 0
    for m in regex.finditer(r'"([^"]*)"', text):
        tokens += tokenize(text[at : m.start()])
        inside = tokenize(m[1])
        if len(inside) > 1:
            phrases.append((len(tokens), len(tokens) + len(inside) - 1))
        tokens += inside
        at = m.end()
    return Query(tokens + tokenize(text[at:]), phrases)


@dataclass(frozen=True)
class SearchRequest:
    query: Query
    query_by: list[FieldSchema]
    filter: Column | None
    sort: list[tuple[str, bool]] | None
    facets: list[FieldSchema]
    limit: int
    offset: int
    prefix: bool
    typos: bool
    match_all: bool


def fields_of(names: str | None, schema: CollectionSchema, what: str, allowed) -> list[FieldSchema]:
    out = []
    for name in filter(None, map(str.strip, (names or "").split(","))):
        own = schema.field(name)
        if own is None or not allowed(own):
            raise QueryError(f"{what}: {name} is not a field for that")
        out.append(own)
    return out


def _whole(value: int, what: str) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value < 0:
        raise QueryError(f"{what} is a whole number from 0 on")
    return value


def resolve_search(
    schema: CollectionSchema, q: str = "", query_by: str | None = None, filter: str | None = None, sort: str | None = None, facet: str | None = None,
    limit: int = LIMIT, offset: int = 0, prefix: bool = True, typo_tolerance: bool | None = None, match_mode: str = "all",
) -> SearchRequest:
    by = schema.searchable if query_by is None else fields_of(query_by, schema, "query_by", lambda f: f.searchable)
    if not by:
        raise QueryError("query_by: no field")
    if _whole(limit, "limit") > MOST:
        raise QueryError(f"limit goes up to {MOST}")
    if _whole(offset, "offset") + limit > WINDOW:
        raise QueryError(f"offset and limit go up to {WINDOW} together")
    if match_mode not in ("all", "any"):
        raise QueryError("match_mode is all or any")
    return SearchRequest(
        parse_query(q or ""), by, parse_filter(filter, schema) if filter and filter.strip() else None, parse_sort(sort, schema) if sort and sort.strip() else None,
        fields_of(facet, schema, "facet", lambda f: f.facet), limit, offset, prefix, schema.typo.enabled if typo_tolerance is None else typo_tolerance, match_mode == "all",
    )
