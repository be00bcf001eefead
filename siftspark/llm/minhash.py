"""Near-duplicate documents by b-bit MinHash.

Every document becomes the set of its word shingles. 128 permutations give 128 minima, of which the
low ``B`` bits are packed; band keys made from the full minima propose candidates, and a pair counts
as near-duplicate when its similarity, estimated by bit counts over the packed lanes and corrected
for chance collisions (1 in 2**B), reaches the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftspark.functions.durable import durable
from siftspark.llm import vectext as V
from siftspark.llm.frames import fresh
from siftspark.llm.graph import bucket_edges, components

K = 128
B = 2
ROWS = 4
SHINGLE = 3
THRESHOLD = 0.5

_rng = np.random.default_rng(1009)
_A = _rng.integers(0, 1 << 31, K, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_C = _rng.integers(0, 1 << 32, K, dtype=np.uint32)
_ROW_MIX = _rng.integers(0, 1 << 63, (K // ROWS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LANES = np.uint64(0x5555555555555555)
WORDS = K * B // 64
SIGNATURE = ", ".join(f"s{i} long" for i in range(WORDS))


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least value of each of the ``K`` permutations over one document's shingle hashes."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.full(K, 0xFFFFFFFF, dtype=np.uint32)
    for low in range(0, len(x), 1024):
        np.minimum(out, (x[None, low : low + 1024] * _A[:, None] + _C[:, None]).min(axis=1), out=out)
    return out


def pack(minima_: np.ndarray) -> np.ndarray:
    """The low ``B`` bits of rows of minima in ``WORDS`` 64-bit words."""
    lanes = (minima_ & np.uint32((1 << B) - 1)).astype(np.uint64).reshape(len(minima_), WORDS, 64 // B)
    return np.bitwise_or.reduce(lanes << (np.arange(64 // B, dtype=np.uint64) * np.uint64(B)), axis=2)


def similarity(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Collision-corrected resemblance of packed signatures, from bit counts."""
    apart = x ^ y
    lanes = (apart | (apart >> np.uint64(1))) & _LANES
    same = 1 - np.bitwise_count(lanes).sum(axis=1, dtype=np.int64) / K
    chance = 1 / (1 << B)
    return (same - chance) / (1 - chance)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_numpy()
        for low, raw, offsets in V.slices(V.strings(batch.column(1))):
            hashes, first = V.shingles(V.words(raw, offsets), SHINGLE)
            rows = np.flatnonzero(np.diff(first))
            if not len(rows):
                continue
            mins = np.stack([minima(hashes[first[r] : first[r + 1]]) for r in rows])
            packed = V.signed(pack(mins))
            wide = mins.astype(np.uint64).reshape(len(rows), K // ROWS, ROWS)
            bands = V.mix((wide * _ROW_MIX).sum(axis=2, dtype=np.uint64) + np.arange(K // ROWS, dtype=np.uint64))
            whole = V.mix((bands * np.arange(1, 2 * (K // ROWS), 2, dtype=np.uint64)).sum(axis=1, dtype=np.uint64))
            each = np.arange(0, bands.size + 1, K // ROWS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[low + rows]), pa.array(V.signed(whole)), *(pa.array(np.ascontiguousarray(packed[:, i])) for i in range(WORDS)), V.lists(V.signed(bands).reshape(-1), each)],
                ["id", "whole", *(f"s{i}" for i in range(WORDS)), "bands"],
            )


def _edges(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return bucket_edges(batches, "key", "id", [f"s{i}" for i in range(WORDS)], lambda x, y: similarity(x, y) >= threshold)

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, duplicate_of, group_size) for every document that repeats an earlier one.

    ``duplicate_of`` is the least id of the connected group, whose document stays; ``group_size``
    counts the group's ids. Documents whose id is null, and texts that are null or without a word,
    belong to no group. Rows that share an id are one document whose shingles are taken from each
    row. Ties go to the lesser id. Other columns are not read, whatever their names. An empty table
    gives an empty result. Texts are used whole, however long.
    """
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")
    signed = durable(own.mapInArrow(_signatures, f"id long, whole long, {SIGNATURE}, bands array<long>"))
    sig = [f"s{i}" for i in range(WORDS)]
    # Copies meet by a partial aggregation; only ids and signatures are joined back.
    least = signed.groupBy("whole", *sig).agg(F.min("id").alias("rep"))
    copies = signed.select("id", "whole", *sig).join(least, ["whole", *sig]).where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    banded = signed.join(least.withColumnRenamed("rep", "id"), ["id", "whole", *sig], "left_semi").select("id", *sig, F.explode("bands").alias("key"))
    close = banded.select("key", "id", *sig).repartition("key").sortWithinPartitions("key").mapInArrow(_edges(threshold), "a long, b long")
    return groups(copies.union(close))


def groups(edges: DataFrame) -> DataFrame:
    """(doc_id, duplicate_of, group_size) of the components of pairs (a, b)."""
    found = components(edges)
    sizes = found.groupBy("root").agg(F.count("*").alias("group_size"))
    return found.where("node <> root").join(sizes, "root").select(F.col("node").alias("doc_id"), F.col("root").alias("duplicate_of"), "group_size")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one document of each near-duplicate group, the one with the least id.

    Rows without an id stay. All columns pass through, whatever their names. Rows that share an id
    stay or go together.
    """
    name = fresh(docs, "gone")
    gone = near_duplicates(docs, id_col, text_col, threshold).select(F.col("doc_id").alias(name))
    return docs.join(gone, docs[id_col].cast("long") == gone[name], "left_anti")
