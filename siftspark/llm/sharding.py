"""Sharding by minimax contiguous partition.

Ordered atomic groups are cut into at most ``shards`` runs so that the largest run is as small as
can be. The least feasible capacity is searched between two bounds that are one group apart at most;
each pass over the sizes tests many capacities at once by the greedy fill, which is ten halvings of
the interval for each pass, and the greedy fill at the capacity found gives the cuts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftspark.functions.durable import durable

SHARDS = 64
PROBES = 1024
_CHUNK = 1 << 16
NULL_GROUP = -(1 << 63)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, sizes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for low in range(0, len(keys), _CHUNK):
            own = slice(low, low + _CHUNK)
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(keys[low])]), pa.array([keys[own].tobytes()]), pa.array([sizes[own].tobytes()])], ["head", "keys", "sizes"]
            )


class Greedy:
    """The greedy fill for many capacities at once, fed with chunks of sizes in order."""

    def __init__(self, capacities: np.ndarray):
        self.capacities = capacities.astype(np.int64)
        self.begin = np.zeros(len(capacities), dtype=np.int64)
        self.cuts = np.zeros(len(capacities), dtype=np.int64)
        self.seen = 0

    def feed(self, sizes: np.ndarray) -> list[int]:
        """Takes a chunk; returns the places in it where the first capacity's fill begins a new shard."""
        sums = self.seen + np.concatenate([[0], np.cumsum(sizes)])
        at = []
        while True:
            full = np.flatnonzero(self.begin + self.capacities < sums[-1])
            if not len(full):
                break
            place = np.searchsorted(sums, self.begin[full] + self.capacities[full], "right") - 1
            self.begin[full] = sums[place]
            self.cuts[full] += 1
            if full[0] == 0:
                at.append(int(place[0]))
        self.seen = int(sums[-1])
        return at


def _probe(capacities: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        greedy = Greedy(capacities)
        for batch in batches:
            for sizes in batch.column("sizes"):
                greedy.feed(np.frombuffer(sizes.as_buffer(), dtype=np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(greedy.capacities), pa.array(greedy.cuts + 1)], ["capacity", "shards"])

    return run


def _cuts(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        greedy, heads = Greedy(np.array([capacity])), []
        for batch in batches:
            for keys, sizes in zip(batch.column("keys"), batch.column("sizes"), strict=True):
                own = np.frombuffer(keys.as_buffer(), dtype=np.int64)
                heads += [int(own[i]) for i in greedy.feed(np.frombuffer(sizes.as_buffer(), dtype=np.int64))]
        yield pa.RecordBatch.from_arrays([pa.array(heads, pa.int64())], ["head"])

    return run


def shard(docs: DataFrame, group_col: str = "doc_id", size: Column | None = None, shards: int = SHARDS, text_col: str = "text", probes: int = PROBES) -> DataFrame:
    """(group_key, size, shard): the shard, from 0, of every atomic group, in ascending order of its key.

    A group is all rows of one key, which is a long; rows with a null key are one group, ordered
    first and returned with a null key. The size is the sum of ``size`` over the group, by default
    the bytes of its text; a null size counts 0. Groups of size 0 join the shard that is open. The
    largest shard is as small as any contiguous partition into at most ``shards`` allows; a single
    group larger than the average is never split. An empty table gives an empty result. Only the
    named columns are read.

    Sizes are packed into chunks that one task reads in order, 16 bytes a group; only the shards'
    first keys (``shards`` of them) reach the driver.
    """
    measure = F.coalesce((F.octet_length(F.col(text_col)) if size is None else size).cast("long"), F.lit(0))
    key = F.coalesce(F.col(group_col).cast("long"), F.lit(NULL_GROUP))
    groups = durable(docs.select(key.alias("key"), measure.alias("size")).groupBy("key").agg(F.sum("size").alias("size")))
    spark = docs.sparkSession
    bounds = groups.agg(F.sum("size").alias("total"), F.max("size").alias("most")).first()
    if bounds["total"] is None:
        return spark.createDataFrame([], "group_key long, size long, shard int")
    ranged = groups.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(_packed, "head long, keys binary, sizes binary")
    packed = durable(ranged.repartition(1).sortWithinPartitions("head"))
    low = max(int(bounds["most"]), -(-int(bounds["total"]) // shards))
    high = -(-int(bounds["total"]) // shards) + int(bounds["most"])
    while low < high:
        tried = np.unique(np.linspace(low, high, min(probes, high - low + 1), dtype=np.int64))[:-1]
        found = packed.mapInArrow(_probe(tried), "capacity long, shards long").toPandas().sort_values("capacity")
        fits = found[found.shards <= shards].capacity
        fails = found[found.shards > shards].capacity
        high = int(fits.min()) if len(fits) else high
        low = int(fails.max()) + 1 if len(fails) else low
        if len(fits) and not len(fails):
            low = high
    heads = np.array(sorted(r.head for r in packed.mapInArrow(_cuts(high), "head long").collect()), dtype=np.int64)

    @F.pandas_udf("int")
    def place(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(heads, keys.to_numpy(), "right").astype(np.int32))

    return groups.select(F.when(F.col("key") != NULL_GROUP, F.col("key")).alias("group_key"), "size", place("key").alias("shard"))
