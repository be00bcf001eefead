"""The filter language, parsed into a Column.

    any   := all ("||" all)*
    all   := one ("&&" one)*
    one   := "(" any ")" | field ":" [= | != | < | <= | > | >=] operand
    operand := value | "[" value ("," value)* "]" | "[" value ".." value "]"
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftspark.functions.dates import epoch_millis
from siftspark.plans.errors import QueryError
from siftspark.plans.schema import CollectionSchema, FieldSchema

_SPACE = re.compile(r"\s*")
_FIELD = re.compile(r"[A-Za-z0-9_-]+")
_COMPARE = re.compile(r"<=|>=|!=|=|<|>")
_BARE = re.compile(r"(?:(?!&&|\|\||\.\.)[^ \t\n\r)\],])+")
_INT = re.compile(r"[+-]?\d+\Z", re.ASCII)
_FLOAT = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\Z", re.ASCII)


def literal(raw: str, field: FieldSchema) -> object:
    """A value of the field's type from its text."""
    if field.type in ("text", "keyword"):
        return raw
    if field.type == "bool" and raw in ("true", "false"):
        return raw == "true"
    if field.type in ("int", "date") and _INT.match(raw) and -(1 << 63) <= int(raw) < 1 << 63:
        return int(raw)
    if field.type == "date" and (at := epoch_millis(raw)) is not None:
        return at
    if field.type == "float" and _FLOAT.match(raw) and math.isfinite(float(raw)):
        return float(raw)
    raise QueryError(f"{field.name} is of type {field.type}; {raw!r} is not")


class _Parser:
    def __init__(self, text: str, schema: CollectionSchema):
        self.text, self.schema, self.at = text, schema, 0

    def take(self, pattern: re.Pattern) -> str | None:
        self.at = _SPACE.match(self.text, self.at).end()
        if m := pattern.match(self.text, self.at):
            self.at = m.end()
            return m[0]
        return None

    def sign(self, mark: str) -> bool:
        return self.take(re.compile(re.escape(mark))) is not None

    def need(self, mark: str) -> None:
        if not self.sign(mark):
            raise QueryError(f"filter: {mark!r} is missing at {self.at}")

    def whole(self) -> Column:
        found = self.any()
        if self.text[self.at :].strip():
            raise QueryError(f"filter: nothing was expected at {self.at}")
        return found

    def any(self) -> Column:
        parts = [self.all()]
        while self.sign("||"):
            parts.append(self.all())
        return reduce(lambda a, b: a | b, parts)

    def all(self) -> Column:
        parts = [self.one()]
        while self.sign("&&"):
            parts.append(self.one())
        return reduce(lambda a, b: a & b, parts)

    def one(self) -> Column:
        if self.sign("("):
            inner = self.any()
            self.need(")")
            return inner
        name = self.take(_FIELD)
        if name is None:
            raise QueryError(f"filter: a field is missing at {self.at}")
        field = self.schema.field(name)
        if field is None:
            raise QueryError(f"filter: there is no field {name}")
        if not field.filterable:
            raise QueryError(f"filter: {name} is not declared for filters")
        self.need(":")
        compare = self.take(_COMPARE) or "="
        if self.sign("["):
            return self.listed(field, compare)
        value = self.value(field)
        if compare in ("=", "!="):
            return equals(field, [value], compare == "!=")
        if field.type in ("text", "keyword"):
            raise QueryError(f"filter: {name} has no order")
        return compared(field, compare, value)

    def listed(self, field: FieldSchema, compare: str) -> Column:
        values = [self.value(field)]
        if self.sign(".."):
            if field.type in ("text", "keyword") or compare != "=":
                raise QueryError(f"filter: no range of {field.name} with {compare}")
            values.append(self.value(field))
            self.need("]")
            if values[0] > values[1]:
                raise QueryError(f"filter: the range of {field.name} ends before it begins")
            return between(field, *values)
        if compare not in ("=", "!="):
            raise QueryError(f"filter: {compare} takes no list")
        while self.sign(","):
            values.append(self.value(field))
        self.need("]")
        return equals(field, values, compare == "!=")

    def value(self, field: FieldSchema) -> object:
        self.at = _SPACE.match(self.text, self.at).end()
        quote = self.text[self.at : self.at + 1]
        if quote and quote in "\"'":
            end = self.text.find(quote, self.at + 1)
            if end < 0:
                raise QueryError(f"filter: the quote of {field.name} does not end")
            raw, self.at = self.text[self.at + 1 : end], end + 1
        elif (raw := self.take(_BARE)) is None:
            raise QueryError(f"filter: a value of {field.name} is missing")
        return literal(raw, field)


def _lit(field: FieldSchema, value: object) -> Column:
    return F.lit(value).cast(field.spark_type[6:-1] if field.multi else field.spark_type)


def _tested(field: FieldSchema, test) -> Column:
    """Whether the field, or any element of it, passes; absent never does."""
    column = F.col(f"`{field.name}`")
    found = F.exists(column, test) if field.multi else test(column)
    return F.coalesce(found, F.lit(False)) if field.multi else column.isNotNull() & found


def equals(field: FieldSchema, values: list, negated: bool = False) -> Column:
    """Some element is one of ``values``; negated: there are elements and none is."""
    column = F.col(f"`{field.name}`")
    if not negated:
        return _tested(field, lambda x: x.isin(values) if len(values) > 1 else x == _lit(field, values[0]))
    if field.multi:
        clean = F.filter(column, lambda x: x.isNotNull())
        return F.coalesce((F.size(clean) > 0) & ~F.exists(clean, lambda x: x.isin(values)), F.lit(False))
    return column.isNotNull() & ~(column.isin(values) if len(values) > 1 else column == _lit(field, values[0]))


def compared(field: FieldSchema, compare: str, value: object) -> Column:
    tests = {"<": lambda x: x < _lit(field, value), "<=": lambda x: x <= _lit(field, value), ">": lambda x: x > _lit(field, value), ">=": lambda x: x >= _lit(field, value)}
    return _tested(field, tests[compare])


def between(field: FieldSchema, low: object, high: object) -> Column:
    return _tested(field, lambda x: (x >= _lit(field, low)) & (x <= _lit(field, high)))


def parse_filter(text: str, schema: CollectionSchema) -> Column:
    """The predicate on the collection's columns; never null."""
    return _Parser(text, schema).whole()
