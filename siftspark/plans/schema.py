"""Collections: declared fields, their flags, and what may be asked of them."""

from __future__ import annotations

import json
import math
import re
from dataclasses import asdict, dataclass, field

from siftspark.functions.fuzzy import typo_budget
from siftspark.plans.errors import SchemaError

TYPES = {"text": "string", "keyword": "string", "int": "long", "float": "double", "bool": "boolean", "date": "long"}
_FACET = {"keyword", "int", "bool", "date"}
_SORT = {"int", "float", "bool", "date"}
_BOOSTS = {"title": 10.0, "brand": 6.0, "description": 2.0}
_NAME = re.compile(r"[A-Za-z][A-Za-z0-9_-]{0,63}\Z")


@dataclass(frozen=True)
class FieldSchema:
    """``multi`` declares that the column holds arrays of the type."""

    name: str
    type: str
    facet: bool = False
    filter: bool = False
    sort: bool = False
    index: bool = True
    optional: bool = False
    boost: float | None = None
    multi: bool = False

    @property
    def searchable(self) -> bool:
        return self.index and self.type == "text"

    @property
    def filterable(self) -> bool:
        return self.filter or self.facet or self.sort

    @property
    def weight(self) -> float:
        return _BOOSTS.get(self.name, 1.0) if self.boost is None else self.boost

    @property
    def spark_type(self) -> str:
        return f"array<{TYPES[self.type]}>" if self.multi else TYPES[self.type]


@dataclass(frozen=True)
class TypoConfig:
    enabled: bool = True
    one_typo_min_len: int = 4
    two_typo_min_len: int = 8
    max_typos: int = 2

    def budget(self, length: int) -> int:
        return typo_budget(length, self.one_typo_min_len, self.two_typo_min_len, self.max_typos)


@dataclass(frozen=True)
class CollectionSchema:
    name: str
    fields: tuple[FieldSchema, ...]
    default_sorting_field: str | None = None
    typo: TypoConfig = field(default_factory=TypoConfig)

    def field(self, name: str) -> FieldSchema | None:
        return next((f for f in self.fields if f.name == name), None)

    @property
    def searchable(self) -> list[FieldSchema]:
        return [f for f in self.fields if f.searchable]

    @property
    def max_boost(self) -> float:
        return max([1.0, *(f.weight for f in self.searchable)])

    def validate(self) -> CollectionSchema:
        _check_name(self.name)
        t = self.typo
        if not 0 <= t.max_typos <= 2 or t.one_typo_min_len < 1 or t.two_typo_min_len < t.one_typo_min_len:
            raise SchemaError("typo lengths must ascend from 1, and at most 2 typos can be allowed")
        if not self.fields:
            raise SchemaError("no fields are declared")
        seen = set()
        for f in self.fields:
            _check_name(f.name)
            if f.name == "id" or f.name in seen:
                raise SchemaError(f"{f.name}: reserved or declared twice")
            seen.add(f.name)
            if f.type not in TYPES:
                raise SchemaError(f"{f.name}: no type {f.type}")
            if f.facet and f.type not in _FACET or f.sort and f.type not in _SORT:
                raise SchemaError(f"{f.name}: {f.type} can't be used for that")
            if f.boost is not None and not (math.isfinite(f.boost) and f.boost >= 0):
                raise SchemaError(f"{f.name}: a boost is a finite number from 0 on")
        if not self.searchable:
            raise SchemaError("one text field at least must be indexed")
        if (by := self.default_sorting_field) is not None and not ((f := self.field(by)) and f.sort):
            raise SchemaError(f"{by} is no field with sort")
        return self

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> CollectionSchema:
        raw = json.loads(text)
        return CollectionSchema(raw["name"], tuple(FieldSchema(**f) for f in raw["fields"]), raw["default_sorting_field"], TypoConfig(**raw["typo"]))


def _check_name(name: str) -> None:
    if not _NAME.match(name):
        raise SchemaError(f"{name!r}: a name is 1 to 64 of letters, digits, _ and -, a letter first")
