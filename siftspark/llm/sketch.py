"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch is the ascending list of the ``k`` least distinct 64-bit shingle hashes of a document, read
as unsigned numbers and stored as longs shifted by 2**63, so that the order of the longs is the
order of the hashes. A sketch of fewer than ``k`` values holds every shingle and is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftspark.llm import vectext as V

SIZE = 64
SHINGLE = 3
_SHIFT = np.uint64(1 << 63)


def _sketches(size: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for low, raw, offsets in V.slices(V.strings(batch.column(1))):
                hashes, first = V.shingles(V.words(raw, offsets), k)
                kept = [np.unique(hashes[first[r] : first[r + 1]])[:size] for r in range(len(first) - 1)]
                sizes = np.array([len(x) for x in kept])
                flat = np.concatenate(kept) if kept else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(low, len(kept)), pa.array(np.diff(first)), V.lists(V.signed(flat ^ _SHIFT), np.concatenate([[0], np.cumsum(sizes)]))],
                    ["doc_id", "shingles", "sketch"],
                )

    return run


def part_sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, k: int = SHINGLE) -> DataFrame:
    """(doc_id, shingles, sketch) of every row: its shingle occurrences and its bottom-``size`` sketch."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(_sketches(size, k), f"doc_id {kind}, shingles long, sketch array<long>")


def merged(a: Column, b: Column, size: int = SIZE) -> Column:
    """The sketch of the union of what two sketches were made of."""
    return F.slice(F.array_sort(F.array_union(a, b)), 1, size)


def merge_parts(parts: DataFrame, key: str, size: int = SIZE) -> DataFrame:
    """One (key, shingles, sketch) for each key from the sketches of its parts.

    A part's values that are not among the key's least ``size`` cannot matter, so each key's values
    are ranked after a partial distinct, and no list grows beyond ``size``. A key whose parts all
    have empty sketches has an empty sketch.
    """
    totals = parts.groupBy(key).agg(F.sum("shingles").alias("shingles"))
    values = parts.select(F.col(key).alias("_k"), F.explode("sketch").alias("_v")).distinct()
    from pyspark.sql import Window

    least = values.withColumn("_n", F.row_number().over(Window.partitionBy("_k").orderBy("_v"))).where(F.col("_n") <= size)
    lists = least.groupBy("_k").agg(F.array_sort(F.collect_list("_v")).alias("sketch"))
    empty = F.expr("cast(array() as array<bigint>)")
    return totals.join(lists, F.col(key).eqNullSafe(F.col("_k")), "left").select(key, "shingles", F.coalesce("sketch", empty).alias("sketch"))


def distinct_estimate(sketch: Column, size: int = SIZE) -> Column:
    """Distinct shingles: exact below ``size`` values, else (size - 1) over the greatest value's quantile."""
    greatest = (F.element_at(sketch, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(sketch) < size, F.size(sketch).cast("double")).otherwise(F.lit(float(size - 1)) / greatest)


def resemblance(a: Column, b: Column, size: int = SIZE) -> Column:
    """Estimated Jaccard similarity; two empty sketches give null."""
    union = merged(a, b, size)
    both = F.size(F.array_intersect(F.array_intersect(union, a), b))
    return F.when(F.size(union) > 0, both / F.size(union))


def containment(a: Column, b: Column, size: int = SIZE) -> Column:
    """Estimated share of the first one's distinct shingles that the second has; null when it is empty."""
    shared = resemblance(a, b, size) * distinct_estimate(merged(a, b, size), size)
    return F.when(F.size(a) > 0, F.least(F.lit(1.0), shared / distinct_estimate(a, size)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, k: int = SHINGLE) -> DataFrame:
    """(doc_id, shingles, distinct_shingles, sketch), a row for each row of ``docs``.

    Null and empty texts, and texts without a word, have 0 shingles and an empty sketch; a text of
    fewer than ``k`` words is one shingle. A null id stays null; repeated rows give equal rows.
    Columns other than the two named are not read. An empty table gives an empty result. No row
    depends on another, so nothing is shuffled.
    """
    made = part_sketches(docs, id_col, text_col, size, k)
    return made.select("doc_id", "shingles", distinct_estimate(F.col("sketch"), size).alias("distinct_shingles"), "sketch")
