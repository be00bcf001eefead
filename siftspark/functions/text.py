"""Tokenising and folding text, as column expressions and as the same thing in plain Python."""

from __future__ import annotations

import functools
import sys
import unicodedata

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

TERM_CHARS = 64
VALUE_GAP = 100

_HAN = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2A6DF}"
TOKEN = rf"[{_HAN}]|[\p{{IsAlphabetic}}\p{{N}}&&[^{_HAN}]]+"
_HAN_PY = "㐀-䶿一-鿿豈-﫿\U00020000-\U0002a6df"
_TOKEN_PY = regex.compile(rf"(?V1)[{_HAN_PY}]|[[\p{{Alphabetic}}\p{{N}}]--[{_HAN_PY}]]+")


def fold_char(c: str) -> str:
    """The base letters of a character in lower case, without its combining marks."""
    bare = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x)[0] != "M")
    return "".join(x.lower() if len(x.lower()) == 1 else fold_char(x.lower()) if x.lower() != x else x for x in bare)


@functools.cache
def _tables() -> tuple[str, str]:
    """Characters that fold to one other character, and those."""
    source, target = [], []
    for code in range(sys.maxunicode + 1):
        c = chr(code)
        if c.isalnum() and not 0xAC00 <= code <= 0xD7A3:
            folded = fold_char(c)
            if folded != c and len(folded) == 1:
                source.append(c)
                target.append(folded)
    return "".join(source), "".join(target)


@functools.cache
def _hangul() -> tuple[str, str, str, str]:
    """All syllables, those with a final consonant first, and what each splits into."""
    codes = sorted(range(0xAC00, 0xD7A4), key=lambda c: (c - 0xAC00) % 28 == 0)
    parts = [unicodedata.normalize("NFD", chr(c)) for c in codes]
    return "".join(map(chr, codes)), "".join(p[0] for p in parts), "".join(p[1] for p in parts), "".join(p[2] for p in parts if len(p) == 3)


def fold_token(token: str) -> str:
    return "".join(map(fold_char, token))[:TERM_CHARS]


def tokenize(text: str) -> list[str]:
    """Folded tokens; a token of combining marks only would be empty and takes no position."""
    return [t for t in (fold_token(x) for x in _TOKEN_PY.findall(text)) if t]


def folded(text: Column) -> Column:
    """``text`` with every alphanumeric character folded; syllables that split do so where any occur."""
    one = F.translate(text, *_tables())
    syllables, lead, vowel, tail = _hangul()
    split = F.transform(F.split(one, ""), lambda c: F.when(c.between("가", "힣"), F.concat(*(F.translate(c, syllables, to) for to in (lead, vowel, tail)))).otherwise(c))
    ascii_only = F.char_length(text) == F.octet_length(text)
    return F.when(ascii_only, F.lower(text)).when(one.rlike("[가-힣]"), F.array_join(split, "")).otherwise(one)


def terms(text: Column) -> Column:
    """The tokens of a string, in order."""
    found = F.regexp_extract_all(folded(text), F.lit(TOKEN), F.lit(0))
    return F.transform(found, lambda t: F.substring(t, 1, TERM_CHARS))


def positioned(values: Column) -> Column:
    """array<struct<term,pos>> over an array of strings; each value starts a gap behind the one before it."""
    token = "array<struct<term:string,pos:int>>"
    start = F.struct(F.array().cast(token).alias("out"), F.lit(0).alias("next"))

    def step(acc: Column, value: Column) -> Column:
        own = terms(value)
        shifted = F.transform(own, lambda t, i: F.struct(t.alias("term"), (i + acc["next"]).cast("int").alias("pos")))
        none = value.isNull() | (F.size(own) <= 0)
        return F.struct(
            F.when(none, acc["out"]).otherwise(F.concat(acc["out"], shifted)).alias("out"),
            F.when(none, acc["next"]).otherwise(acc["next"] + F.size(own) + VALUE_GAP).cast("int").alias("next"),
        )

    return F.aggregate(values, start, step, lambda acc: acc["out"])
