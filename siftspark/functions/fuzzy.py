"""Unrestricted Damerau-Levenshtein distance with a budget."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LONGEST = 64


def distance(a: str, b: str, most: int) -> int | None:
    """Insertions, deletions, substitutions and swaps of neighbours (edits may fall between them); None beyond ``most``.

    A query longer than ``LONGEST`` is cut; a longer candidate is never near.
    """
    a = a[:LONGEST]
    if len(b) > LONGEST or abs(len(a) - len(b)) > most:
        return None
    if most == 0:
        return 0 if a == b else None
    far = len(a) + len(b)
    seen: dict[str, int] = {}
    table = [[far] * (len(b) + 2), [far, *range(len(b) + 1)]]
    for i, x in enumerate(a, 1):
        row, match = [far, i], 0
        for j, y in enumerate(b, 1):
            k, at = seen.get(y, 0), match
            cost = 1
            if x == y:
                cost, match = 0, j
            row.append(min(table[i][j] + cost, row[j] + 1, table[i][j + 1] + 1, table[k][at] + (i - k - 1) + 1 + (j - at - 1)))
        table.append(row)
        seen[x] = i
    found = table[-1][-1]
    return found if found <= most else None


def near_terms(terms: DataFrame, token: str, most: int, column: str = "term") -> DataFrame:
    """Rows of ``terms`` whose ``column`` is within ``most`` edits of ``token``, with the distance as ``edits``.

    A swap is two plain edits, so the built-in distance with twice the budget lets every near term
    through, in the JVM; only what passes is measured exactly.
    """
    token = token[:LONGEST]
    length = F.char_length(column)
    close = terms.where(length.between(len(token) - most, min(len(token) + most, LONGEST)))
    close = close.where(F.levenshtein(F.col(column), F.lit(token), 2 * most) >= 0)

    @F.pandas_udf("int")
    def edits(found: pd.Series) -> pd.Series:
        return found.map(lambda x: distance(token, x, most)).astype("Int32")

    return close.withColumn("edits", edits(F.col(column))).where(F.col("edits").isNotNull())


def typo_budget(length: int, one: int = 4, two: int = 8, most: int = 2) -> int:
    """Edits allowed for a word of ``length`` characters."""
    return min(most, 2 if length >= two else 1 if length >= one else 0)


def within(a: Column, b: Column, most: int) -> Column:
    """Whether two columns are within ``most`` edits of each other."""

    @F.pandas_udf("boolean")
    def near(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([p is not None and q is not None and distance(p, q, most) is not None for p, q in zip(x, y, strict=True)])

    return near(a, b)
