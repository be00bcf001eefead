"""Best-fit packing by hierarchical residuals.

Each partition packs its own items best-fit, largest first, and emits the bins that are nearly full.
The underfull bins become items themselves: groups of partitions are merged along a tree, and each
merged group packs the bins it was handed best-fit again, until one group is left, which emits all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftspark.functions.durable import durable
from siftspark.llm.mixing import token_count

CAPACITY = 2048
NEARLY_FULL = 0.99
FAN_IN = 8
LEAF_ITEMS = 20_000

_PIECE = "struct<doc_id:bigint,begin:bigint,tokens:bigint>"
_ITEM = f"`group` long, fill long, pieces array<{_PIECE}>"


class _Bins:
    """Open bins by the room they have left; the best fit is the least room that suffices."""

    def __init__(self, capacity: int):
        self.capacity, self.room, self.mask, self.bins = capacity, {}, 0, []

    def add(self, item: int, size: int) -> None:
        fitting = self.mask >> size
        if fitting:
            left = size + (fitting & -fitting).bit_length() - 1
            stack = self.room[left]
            at = stack.pop()
            if not stack:
                self.mask ^= 1 << left
            self.bins[at].append(item)
        else:
            left, at = self.capacity, len(self.bins)
            self.bins.append([item])
        rest = left - size
        if rest:
            self.room.setdefault(rest, []).append(at)
            self.mask |= 1 << rest


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of indices into ``sizes``, each of 1 to ``capacity``; largest first, ties in the given order."""
    bins = _Bins(capacity)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        bins.add(i, sizes[i])
    return bins.bins


def _round(capacity: int, full: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got)
        groups = table.column("group").to_numpy()
        # The order in which a partition receives rows must not decide the packing.
        pieces = table.column("pieces").combine_chunks()
        heads = pieces.flatten().field("doc_id").fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
        begins = pieces.flatten().field("begin").to_numpy(zero_copy_only=False)
        offsets = pieces.offsets.to_numpy()
        fill = table.column("fill").to_numpy()
        order = np.lexsort((begins[offsets[:-1] - offsets[0]], heads[offsets[:-1] - offsets[0]], fill, groups))
        keys = groups[order]
        flat = pieces.flatten()
        for low, high in zip(*_runs(keys), strict=True):
            rows = order[low:high]
            bins = best_fit(fill[rows].tolist(), capacity)
            fills = np.array([int(fill[rows[b]].sum()) for b in bins])
            members = [np.concatenate([np.arange(offsets[r], offsets[r + 1]) for r in rows[b]]) - offsets[0] for b in bins]
            ends = np.concatenate([[0], np.cumsum([len(m) for m in members])]).astype(np.int32)
            made = pa.ListArray.from_arrays(pa.array(ends), flat.take(pa.array(np.concatenate(members))))
            group = np.where(fills >= full, -1, keys[low])
            batch = pa.RecordBatch.from_arrays([pa.array(group), pa.array(fills), made], ["group", "fill", "pieces"])
            for at in range(0, batch.num_rows, 10_000):
                yield batch.slice(at, 10_000)

    return run


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return begin, np.append(begin[1:], len(keys))


def pack(
    docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", nearly_full: float = NEARLY_FULL,
    leaf_items: int = LEAF_ITEMS, fan_in: int = FAN_IN,
) -> DataFrame:
    """(bin_id, tokens, doc_ids, begins, lengths): a row for each bin of at most ``capacity`` tokens.

    Every token of every document is in exactly one bin: a document longer than the capacity fills
    whole bins and leaves one remainder. Documents without tokens (null, empty) are in no bin; a null
    id is carried as null; repeated rows are so many documents. Documents are dealt to the leaves by
    the hash of their id, so ties and the order of rows do not change the bins. ``bin_id`` is the
    hash of the bin's first piece and of its number among the bins of that first piece, which repeated rows
    and null ids have. There is a leaf for every ``leaf_items`` pieces. An empty table gives an empty result. Only the named columns are
    read.
    """
    full = max(1, int(np.ceil(capacity * nearly_full)))
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), token_count(F.col(text_col)).alias("n")).where("n > 0")
    starts = F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(capacity).cast("long"))
    pieces = slim.select("doc_id", "n", F.explode(starts).alias("begin")).withColumn("fill", F.least(F.col("n") - F.col("begin"), F.lit(capacity).cast("long")))
    piece = F.struct("doc_id", "begin", F.col("fill").alias("tokens"))
    hashed = F.shiftrightunsigned(F.xxhash64("doc_id", "begin"), 1)
    level = durable(pieces.select(F.when(F.col("fill") >= full, F.lit(-1)).otherwise(hashed).cast("long").alias("group"), "fill", F.array(piece).cast(f"array<{_PIECE}>").alias("pieces")))
    leaves = max(1, -(-level.where("`group` >= 0").count() // leaf_items))
    level = level.withColumn("group", F.when(F.col("group") < 0, F.col("group")).otherwise(F.col("group") % leaves))
    emitted = []
    while True:
        emitted.append(level.where("`group` < 0"))
        packed = level.where("`group` >= 0").repartition(leaves, "group").mapInArrow(_round(capacity, full), _ITEM)
        if leaves == 1:
            emitted.append(packed)
            break
        leaves = -(-leaves // fan_in)
        level = durable(packed.withColumn("group", F.when(F.col("group") < 0, F.col("group")).otherwise(F.floor(F.col("group") / fan_in)).cast("long")))
    bins = emitted[0]
    for more in emitted[1:]:
        bins = bins.unionByName(more)
    first = F.col("pieces")[0]
    # Bins that are equal in all of this order are interchangeable.
    nth = F.row_number().over(Window.partitionBy(first["doc_id"], first["begin"]).orderBy("fill", "pieces"))
    return bins.select("fill", "pieces", nth.alias("nth")).select(
        F.xxhash64(first["doc_id"], first["begin"], "nth").alias("bin_id"), F.col("fill").alias("tokens"),
        F.col("pieces.doc_id").alias("doc_ids"), F.col("pieces.begin").alias("begins"), F.col("pieces.tokens").alias("lengths"),
    )
