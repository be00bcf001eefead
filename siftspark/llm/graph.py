"""Connected groups: within a bucket of candidates, and across all edges."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftspark.functions.durable import durable

#: Up to this many edges (16 bytes each) one task labels them; beyond, star contraction does.
ONE_TASK_EDGES = 4_000_000
_NEAR = 8


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by ``key``; no group is split between two."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(keys, keys[-1], "left"))
        if held and held[-1].column(key)[-1].as_py() == keys[-1]:
            held.append(batch)
            continue
        if held or cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def spanning_edges(bits: np.ndarray, alike: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Iterator[tuple[int, int]]:
    """A spanning forest of the graph of alike rows of one bucket.

    Every row that is reached is compared with all rows that are not reached yet, so the forest has
    the very components of the full graph, while a bucket of copies costs one comparison a row.
    """
    left = np.arange(len(bits))
    while len(left) > 1:
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            at = frontier.pop()
            hit = alike(bits[at][None, :], bits[left])
            for other in left[hit]:
                yield int(at), int(other)
            frontier.extend(left[hit])
            left = left[~hit]


def bucket_edges(
    batches: Iterator[pa.RecordBatch], key: str, node: str, parts: list[str], alike: Callable[[np.ndarray, np.ndarray], np.ndarray], near: int = _NEAR
) -> Iterator[pa.RecordBatch]:
    """Edges (a, b), a > b, that join all alike rows of equal ``key``; input sorted by ``key``.

    In buckets of up to ``near`` rows all pairs are compared, many buckets at a time.
    """
    for table in grouped(batches, key):
        if table.num_rows < 2:
            continue
        keys = table.column(key).to_numpy()
        nodes = table.column(node).to_numpy()
        bits = np.stack([table.column(p).to_numpy() for p in parts], axis=1).view(np.uint64)
        begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.append(begin, len(keys)))
        size_of = np.repeat(sizes, sizes)
        a, b = [], []
        for step in range(1, near):
            i = np.flatnonzero((keys[step:] == keys[:-step]) & (size_of[step:] <= near))
            if not len(i):
                break
            hit = i[alike(bits[i], bits[i + step])]
            a.append(nodes[hit])
            b.append(nodes[hit + step])
        for g in np.flatnonzero(sizes > near):
            low = begin[g]
            pairs = np.array(list(spanning_edges(bits[low : low + sizes[g]], alike)), dtype=np.int64).reshape(-1, 2) + low
            a.append(nodes[pairs[:, 0]])
            b.append(nodes[pairs[:, 1]])
        if not a:
            continue
        x, y = np.concatenate(a), np.concatenate(b)
        edges = np.unique(np.stack([np.maximum(x, y), np.minimum(x, y)], axis=1)[x != y], axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], ["a", "b"])


def label(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) by hooking and pointer jumping."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inverse[: len(a)], inverse[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        while True:
            jumped = root[root]
            if np.array_equal(jumped, root):
                break
            root = jumped
        if np.array_equal(before, root):
            return nodes, nodes[root]


def _one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = [x for x in batches if x.num_rows]
    if got:
        table = pa.Table.from_batches(got)
        nodes, roots = label(table.column("a").to_numpy(), table.column("b").to_numpy())
        for low in range(0, len(nodes), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(nodes[low : low + (1 << 16)]), pa.array(roots[low : low + (1 << 16)])], ["node", "root"])


def components(edges: DataFrame, one_task_edges: int = ONE_TASK_EDGES) -> DataFrame:
    """(node, root) for every node of the edges (a, b) of longs; root is its component's least node.

    Up to ``one_task_edges`` edges are labelled by one task. Beyond that, large-star and small-star
    contraction alternate until nothing changes, each round written to the shared folder.
    """
    edges = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if edges.count() <= one_task_edges:
        return durable(edges.coalesce(1).mapInArrow(_one_task, "node long, root long"))
    seen = None
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = F.least(F.min("b").over(Window.partitionBy("a")), F.col("a"))
        large = both.withColumn("m", least).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.withColumn("m", F.min("b").over(Window.partitionBy("a")))
        small = down.select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = durable(small.select("e.a", "e.b").where("a <> b").distinct())
        state = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if state == seen:
            break
        seen = state
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return durable(roots.union(edges.select("b", "b").distinct().toDF("node", "root")))


def hamming(most: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    return lambda x, y: np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) <= most
