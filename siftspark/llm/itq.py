"""Near-duplicate embeddings by iterative quantisation.

Unit vectors are centred, projected on their principal axes and rotated so that the signs of the
coordinates lose as little as can be; the rotation is learned over all vectors, a pass for each
step. Codes are looked up in tables, each of some of their bits, as many as make a bucket's share 1 in n. How
many tables, how far codes of one bucket may differ there and in all bits is taken from the data: vectors are
moved to the least cosine that counts, and ``RECALL`` of them must still meet. What hangs together is
compared by the original vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftspark.functions.durable import durable
from siftspark.llm import vectext as V
from siftspark.llm.graph import bucket_edges, components, grouped, hamming
from siftspark.llm.minhash import groups

SIMILARITY = 0.95
BITS = 64
RECALL = 0.95
#: The share of moved vectors that the check of whole codes lets pass.
PASSED = 0.998
PROBES = 20_000
MOST_TABLES = 4096
RADII = (0, 1, 2)
STEPS = 30
TOLERANCE = 1e-4
_BLOCK = 4096


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.float32)


def vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): the unit vectors that can be compared, of the dimension that most have (of equals the least)."""
    own = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x * x))
    usable = own.where(F.col("id").isNotNull() & F.col("v").isNotNull()).where((F.size("v") > 0) & finite).withColumn("norm", norm).where((F.col("norm") > 0) & (F.col("norm") < float("inf")))
    most = usable.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    d = most["d"] if most else 0
    return durable(usable.where(F.size("v") == d).select("id", F.transform("v", lambda x: x / F.col("norm")).cast("array<float>").alias("v")))


def _summed(rows: DataFrame, part, shape: tuple[int, int]) -> np.ndarray:
    """The sum over all rows of the matrix that ``part`` makes of a batch of vectors, added up by the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                total += part(_matrix(batch.column(0)).astype(np.float64))
        cells = np.flatnonzero(total.reshape(-1))
        yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int64)), pa.array(total.reshape(-1)[cells])], ["cell", "value"])

    got = rows.select("v").mapInArrow(run, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).toPandas()
    out = np.zeros(shape[0] * shape[1])
    out[got["cell"].to_numpy(dtype=np.int64)] = got["value"].to_numpy(dtype=float)
    return out.reshape(shape)


def learn(rows: DataFrame, d: int, n: int, bits: int = BITS, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection): the code of x is the signs of (x - mean) @ projection."""
    c = min(bits, d)
    mean = _summed(rows, lambda x: x.sum(axis=0, keepdims=True), (1, d))[0] / n
    spread = _summed(rows, lambda x: (x - mean).T @ (x - mean), (d, d))
    axes = np.linalg.eigh(spread)[1][:, ::-1][:, :c]
    rotation = np.linalg.qr(np.random.default_rng(77).normal(size=(c, c)))[0]
    before = -np.inf
    for _ in range(steps):
        turned = axes @ rotation

        def part(x: np.ndarray, turned: np.ndarray = turned) -> np.ndarray:
            centred = x - mean
            return (centred @ axes).T @ np.where(centred @ turned > 0, 1.0, -1.0)

        cross = _summed(rows, part, (c, c))
        u, s, vt = np.linalg.svd(cross)
        rotation = u @ vt
        if s.sum() <= before * (1 + TOLERANCE):
            break
        before = s.sum()
    return mean, axes @ rotation


def codes(x: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """64-bit codes of rows of vectors."""
    signs = (x - mean) @ projection > 0
    wide = np.zeros((len(x), 64), dtype=bool)
    wide[:, : signs.shape[1]] = signs
    return np.packbits(wide, axis=1).view(np.uint64).reshape(-1)


def supersets(values: np.ndarray, width: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, value with up to ``most`` of its zero bits set); values within ``most`` bits of each other meet in one."""
    for k in range(most + 1):
        for places in combinations(range(width), k):
            mask = np.uint64(sum(1 << p for p in places))
            rows = np.flatnonzero((values & mask) == 0)
            yield rows, values[rows] | mask


def table_bits(c: int, width: int, tables: int = MOST_TABLES) -> np.ndarray:
    """The signs that each table reads: the code cut into whole substrings, then shuffled and cut again."""
    rng = np.random.default_rng(91)
    per = c // width
    rounds = -(-tables // per)
    orders = [np.arange(c), *(rng.permutation(c) for _ in range(rounds - 1))]
    return np.concatenate([o[: per * width].reshape(per, width) for o in orders])[:tables]


def moved(x: np.ndarray, similarity: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Each unit vector moved to a cosine of ``similarity`` with itself: in a random direction, and towards another of the rows."""
    rng = np.random.default_rng(seed)
    out = []
    for towards in (rng.normal(size=x.shape), np.roll(x, 1, axis=0) + 1e-9 * rng.normal(size=x.shape)):
        across = towards - (towards * x).sum(axis=1, keepdims=True) * x
        across /= np.maximum(np.linalg.norm(across, axis=1, keepdims=True), 1e-300)
        out.append(similarity * x + math.sqrt(max(0.0, 1 - similarity * similarity)) * across)
    return out[0], out[1]


def chosen(apart: np.ndarray, bits: np.ndarray, recall: float = RECALL) -> tuple[int, int, int]:
    """(tables, radius, check bits) of the least keys a vector at which ``recall`` of each column of moved vectors is met.

    ``apart`` has the bits in which the moved vectors' codes differ. Where no number of tables is enough, all are used.
    """
    masks = [np.uint64(sum(1 << (63 - int(i)) for i in row)) for row in bits]
    check = int(np.ceil(np.quantile(np.bitwise_count(apart), PASSED, axis=0).max())) if len(apart) else 64
    within = np.bitwise_count(apart) <= check
    best = (math.inf, len(masks), max(RADII))
    for radius in RADII:
        keys = sum(math.comb(bits.shape[1], k) / 2**k for k in range(radius + 1))
        met = np.zeros(apart.shape, dtype=bool)
        for t, mask in enumerate(masks, 1):
            if t * keys >= best[0]:
                break
            met |= np.bitwise_count(apart & mask) <= radius
            if (met & within).mean(axis=0).min() >= recall:
                best = (t * keys, t, radius)
                break
    return best[1], best[2], check


def measured(rows: DataFrame, n: int, mean: np.ndarray, projection: np.ndarray, similarity: float) -> np.ndarray:
    """The differing bits of the codes of about ``PROBES`` vectors and their moved ones, a column for each way to move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0)).astype(np.float64)
                code = codes(x, mean, projection)
                a, b = (V.signed(code ^ codes(y, mean, projection)) for y in moved(x, similarity, batch.num_rows))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    probes = rows.where(F.pmod(F.xxhash64("id"), F.lit(max(1, n // PROBES))) == 0).select("v")
    got = probes.mapInArrow(run, "a long, b long").toPandas()
    return got.to_numpy(dtype=np.int64).reshape(-1, 2).view(np.uint64)


def _tables(mean: np.ndarray, projection: np.ndarray, bits: np.ndarray, radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy()
            code = codes(_matrix(batch.column(1)).astype(np.float64), mean, projection)
            high = code.byteswap()  # the first sign is the highest bit
            for t, places in enumerate(bits):
                part = np.zeros(len(high), dtype=np.uint64)
                for i in places.tolist():
                    part = (part << np.uint64(1)) | ((high >> np.uint64(63 - i)) & np.uint64(1))
                for rows, key in supersets(part, len(places), radius):
                    keys = V.mix(key ^ np.uint64(V.mix_int(t + 1)))
                    yield pa.RecordBatch.from_arrays([pa.array(V.signed(keys)), pa.array(ids[rows]), pa.array(V.signed(code[rows]))], ["key", "id", "code"])

    return run


def _compared(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, "root"):
            roots, ids = table.column("root").to_numpy(), table.column("id").to_numpy()
            x = _matrix(table.column("v").combine_chunks())
            begin = np.flatnonzero(np.concatenate([[True], roots[1:] != roots[:-1]]))
            a, b = [], []
            for low, high in zip(begin, np.append(begin[1:], len(roots)), strict=True):
                left = np.arange(low, high)
                while len(left) > 1:
                    frontier, left = left[:1], left[1:]
                    while len(frontier) and len(left):
                        some, frontier = frontier[:_BLOCK], frontier[_BLOCK:]
                        reached = np.zeros(len(left), dtype=bool)
                        for at in range(0, len(left), _BLOCK):
                            hit = x[some] @ x[left[at : at + _BLOCK]].T >= similarity
                            any_ = hit.any(axis=0)
                            a.append(ids[some[hit.argmax(axis=0)[any_]]])
                            b.append(ids[left[at : at + _BLOCK][any_]])
                            reached[at : at + _BLOCK] = any_
                        frontier, left = np.concatenate([frontier, left[reached]]), left[~reached]
            flat = lambda parts: pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([flat(a), flat(b)], ["a", "b"])

    return run


def near_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", similarity: float = SIMILARITY, bits: int = BITS, recall: float = RECALL) -> DataFrame:
    """(vec_id, duplicate_of, group_size) of every vector whose cosine with a group's member reaches ``similarity``.

    Groups are connected; the least id stays. Left out are null ids, vectors that are null, empty or
    zero, that hold a null, NaN or infinity, or that have another dimension than most. Rows that
    share an id are one vector of a group if any of them is. Other columns are not read. An empty
    table gives an empty result. Tables read as many bits as the logarithm of the number of vectors, so that buckets do not
    grow with it; there are as many tables as ``recall`` needs on these vectors (``chosen``).
    """
    rows = vectors(table, id_col, vector_col)
    n = rows.count()
    spark = table.sparkSession
    if n < 2:
        return spark.createDataFrame([], "vec_id long, duplicate_of long, group_size long")
    d = len(rows.select("v").first()["v"])
    mean, projection = learn(rows, d, n, bits)
    c = projection.shape[1]
    places = table_bits(c, max(1, min(c, math.ceil(math.log2(n)))))
    apart = measured(rows, n, mean, projection, similarity)
    apart = apart.byteswap()  # the first sign is the highest bit
    tables, radius, check = chosen(apart, places, recall)
    keyed = rows.mapInArrow(_tables(mean, projection, places[:tables], radius), "key long, id long, code long")
    close = components(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(lambda b: bucket_edges(b, "key", "id", ["code"], hamming(check)), "a long, b long"))
    ranked = rows.join(close, rows["id"] == close["node"]).select("root", "id", "v")
    edges = ranked.repartition("root").sortWithinPartitions("root").mapInArrow(_compared(similarity), "a long, b long")
    return groups(edges).withColumnRenamed("doc_id", "vec_id")
