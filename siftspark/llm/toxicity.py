"""Toxic passages by maximum-scoring segment search.

A token's score is its log-odds of toxic against clean labelled documents. The share of toxic documents
among those that have a word has a Dirichlet prior (of two classes) centred at the share of its longest
prefix, and so on from prefix to prefix down to the share of all documents; a prefix speaks for the other
words that it begins only. Odds are shrunk towards 0 by the error of their posterior and set back by a
constant drift; a word that no labelled document has takes the score of its longest known prefix. Near
copies among the labelled documents count once.
One scan finds every maximal scoring segment of a text in linear time. Scores of segments are
calibrated as extreme values of clean text: a segment of score S in a text of n tokens is expected
K n exp(-lambda S) times by chance, where lambda solves the mean of exp(lambda s) = 1 over clean
tokens, and K is fitted to the clean documents' best segments. The r best segments of a text are judged
together by the sum of their normalised scores, for each r, so that weak segments that lie apart add up.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftspark.functions.durable import durable
from siftspark.llm import vectext as V

#: The classifier is fitted to at most so many labelled documents, the first in the order of hashed ids.
MAX_LABELLED = 25_000
#: The prior counts as many documents as so many times the square root of the labelled ones.
PRIOR = 0.12
SHRINK = 2.0
DRIFT = 0.25
SIGNIFICANCE = 1e-3
PREFIXES = (4, 5, 6, 7, 8, 9)
#: So many best segments of a text are judged together at most.
MOST_SEGMENTS = 32
_TAIL_END = 200
_GRAIN = 1 / 16
_SALTS = [np.uint64(V.mix_int(0xA5A5 + c)) for c in (*PREFIXES, 0)]


def features(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """For each level (prefixes from the shortest, then the word) the hash of each word's feature."""
    lead = (raw & 0xC0) != 0x80
    leads = np.append(np.flatnonzero(lead), np.full(max(PREFIXES) + 1, len(raw)))
    at = np.cumsum(lead)[starts] - 1 if len(starts) else np.zeros(0, np.int64)
    out = [V.span_hashes(raw, starts, np.minimum(leads[at + c], ends)) ^ salt for salt, c in zip(_SALTS, PREFIXES, strict=False)]
    return [*out, V.span_hashes(raw, starts, ends) ^ _SALTS[-1]]


COUNTS = "root long, level int, feature long, parent long, toxic long, docs long"


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The features of each level with the one that they extend, the toxic documents and all that have them, by batch."""
    for batch in batches:
        toxic = batch.column(1).to_numpy().astype(bool)
        for low, raw, offsets in V.slices(V.strings(batch.column(0))):
            found = V.words(raw, offsets)
            row = np.repeat(np.arange(found.rows), found.counts)
            levels = features(raw, found.starts, found.ends)
            for level, hashes in enumerate(levels):
                order = np.lexsort((row, hashes))
                h, r = hashes[order], row[order]
                new = np.ones(len(h), dtype=bool)
                new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
                order, h, r = order[new], h[new], r[new]
                kinds, first = np.unique(h, return_index=True)
                if not len(kinds):
                    continue
                at = order[first]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(V.signed(levels[0][at])), pa.array(np.full(len(kinds), level, np.int32)), pa.array(V.signed(kinds)), pa.array(V.signed(levels[max(0, level - 1)][at])),
                        pa.array(np.add.reduceat(toxic[low + r].astype(np.int64), first)), pa.array(np.diff(np.append(first, len(h)))),
                    ],
                    ["root", "level", "feature", "parent", "toxic", "docs"],
                )


def odds(toxic: np.ndarray, docs: np.ndarray, prior: np.ndarray | float, weight: float, base: float) -> np.ndarray:
    """The log-odds of the posterior share against the base share, shrunk by its error and rounded."""
    share = (toxic + weight * prior) / (docs + weight)
    value = np.log(share / (1 - share)) - math.log(base / (1 - base))
    error = np.sqrt(1 / (share * (docs + weight)) + 1 / ((1 - share) * (docs + weight)))
    return np.round(np.sign(value) * np.maximum(0.0, np.abs(value) - SHRINK * error) / _GRAIN) * _GRAIN


def _scores(weight: float, base: float):
    """Scores of whole families of features that begin alike; those that score as what they extend are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [x for x in batches if x.num_rows]
        if not held:
            return
        level, feature, parent, toxic, docs = (pa.Table.from_batches(held).column(c).to_numpy() for c in ("level", "feature", "parent", "t", "n"))
        before: tuple[np.ndarray, ...] = ()
        for k in range(len(PREFIXES) + 1):
            own = np.flatnonzero(level == k)
            own = own[np.argsort(feature[own])]
            t, n = toxic[own].astype(float), docs[own].astype(float)
            if k:
                # What a feature adds to the one it extends must not count again in its own prior.
                at = np.searchsorted(before[0], parent[own])
                prior = (np.maximum(before[1][at] - t, 0) + weight * before[3][at]) / (np.maximum(before[2][at] - n, 0) + weight)
                known = before[4][at]
            else:
                prior, known = np.full(len(own), base), np.zeros(len(own))
            score = odds(t, n, prior, weight, base)
            new = score != known
            yield pa.RecordBatch.from_arrays([pa.array(feature[own][new]), pa.array(score[new])], ["feature", "score"])
            before = (feature[own], t, n, prior, score)

    return run


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The least hash of three words in a row of each text, which near copies mostly share."""
    for batch in batches:
        least = np.zeros(batch.num_rows, dtype=np.uint64)
        for low, raw, offsets in V.slices(V.strings(batch.column(1))):
            hashes, first = V.shingles(V.words(raw, offsets), 3)
            full = np.flatnonzero(np.diff(first))
            if len(full):
                least[low + full] = np.minimum.reduceat(hashes, first[full])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(V.signed(least))], [*batch.schema.names, "least"])


@dataclass(frozen=True)
class Model:
    """Scores of the known features (sorted by hash), and the extreme-value parameters."""

    hashes: np.ndarray
    scores: np.ndarray
    lam: float = 1.0
    k: float = 1.0

    def tokens(self, raw: np.ndarray, found: V.Words) -> np.ndarray:
        """The score of each word: that of its most specific known feature."""
        _, at, inverse = np.unique(found.hashes, return_index=True, return_inverse=True)
        out = np.zeros(len(at))
        if len(self.hashes):
            for hashes in features(raw, found.starts[at], found.ends[at]):
                place = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
                known = self.hashes[place] == hashes
                out[known] = self.scores[place[known]]
        return out[inverse] - DRIFT

    def expected(self, score: np.ndarray | float, n: int) -> np.ndarray | float:
        return self.k * n * np.exp(-self.lam * score)

    def combined(self, scores: list[float], n: int) -> tuple[float, int]:
        """The p-value of a text of n tokens by its segments' scores, and how many of the best give it.

        The r best have the share 1 / (r (r + 1)) of the significance; the shares add up to 1.
        """
        if not scores or self.lam <= 0:
            return 1.0, 0
        sums = np.cumsum(self.lam * np.sort(scores)[::-1][:MOST_SEGMENTS] - math.log(self.k * n))
        return min((min(1.0, r * (r + 1) * sum_tail(r, float(t))), r) for r, t in enumerate(sums, 1))


def sum_tail(r: int, t: float) -> float:
    """The chance that the normalised scores of the r best segments add up to t or more (Karlin and Altschul's sum statistic)."""
    if r == 1:
        return float(-np.expm1(-math.exp(min(-t, 700.0))))
    if t <= 0:
        return 1.0
    logs = _tail_logs(r)
    at = min(int(t), _TAIL_END - 1)
    return min(1.0, math.exp(logs[at] + (t - at) * (logs[at + 1] - logs[at])))


@functools.cache
def _tail_logs(r: int) -> np.ndarray:
    """The logarithm of ``sum_tail`` at 0, 1, 2 and so on.

    The expected numbers exp(-s) of the best segments are the first arrivals of a Poisson process: the
    r-th is g, of a gamma distribution, and the others are uniform below it, so that the sum is
    -r log g and r - 1 exponential variables.
    """
    u = np.linspace(-(_TAIL_END + 60) / r, math.log(r + 12 * math.sqrt(r) + 12), 1501)
    density = r * u - np.exp(u) - math.lgamma(r) + math.log(u[1] - u[0])
    rest = np.maximum(np.arange(_TAIL_END + 1)[:, None] + r * u, 0.0)
    term, total = np.zeros_like(rest), np.zeros_like(rest)
    with np.errstate(divide="ignore"):
        logs = np.log(rest)
        for j in range(1, r - 1):
            term = term + logs - math.log(j)
            total = np.logaddexp(total, term)
    return np.logaddexp.reduce(density + total - rest, axis=1)


def segments(scores: np.ndarray) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, begin, end) of a text, none overlapping, in linear time.

    Only tokens above 0 open segments, so tokens at or below 0 cost no step of the scan.
    """
    ups = np.flatnonzero(scores > 0)
    if not len(ups):
        return []
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    stack: list[tuple[float, float, int, int]] = []
    for i in ups.tolist():
        left, right, begin = sums[i], sums[i + 1], i
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][0] >= left:
                j -= 1
            if j < 0 or stack[j][1] >= right:
                stack.append((left, right, begin, i + 1))
                break
            left, begin = stack[j][0], stack[j][2]
            del stack[j:]
    return [(float(r - l), b, e) for l, r, b, e in stack]


def _scan(model: Model, column: pa.Array) -> Iterator[tuple[int, int, list[tuple[float, int, int]]]]:
    """(row, words, segments) of every row."""
    for low, raw, offsets in V.slices(V.strings(column)):
        found = V.words(raw, offsets)
        scores = model.tokens(raw, found)
        up = np.concatenate([[0], np.cumsum(scores > 0)])[found.first]
        for r in range(found.rows):
            n = int(found.first[r + 1] - found.first[r])
            yield low + r, n, segments(scores[found.first[r] : found.first[r + 1]]) if up[r + 1] > up[r] else []


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED) -> Model:
    """The model of the labelled documents, of which ``max_labelled`` are used at most.

    Labels that are null are left out; an id labelled twice is toxic if any label says so. Of labelled texts
    of one label whose least hash of three words in a row agrees, the one of the least id is used. Without
    both toxic and clean documents nothing is known and no segment is ever found.
    """
    spark = docs.sparkSession
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("_labelled"))
    chosen = known.agg(F.max("toxic").cast("int").alias("_toxic")).orderBy(F.xxhash64("_labelled"), "_labelled").limit(max_labelled)
    own = docs.select(F.col(id_col).cast("long").alias("_labelled"), F.col(text_col).cast("string").alias("text"))
    # The labelled side has max_labelled rows of 12 bytes at most.
    read = own.join(F.broadcast(chosen), "_labelled").select("_labelled", "text", F.col("_toxic").alias("toxic")).mapInArrow(_grouped, "_labelled long, text string, toxic int, least long")
    alike = Window.partitionBy("least", "toxic").orderBy("_labelled", F.xxhash64("text"))
    sample = durable(read.withColumn("nth", F.row_number().over(alike)).where((F.col("nth") == 1) | (F.col("least") == 0)).select("text", "toxic"))
    toxic, docs_ = sample.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    if not 0 < toxic < docs_:
        return Model(np.zeros(0, np.uint64), np.zeros(0), 0.0, 1.0)
    counted = sample.mapInArrow(_counts, COUNTS).repartition("root").groupBy("root", "level", "feature", "parent").agg(F.sum("toxic").alias("t"), F.sum("docs").alias("n"))
    rows = counted.mapInArrow(_scores(PRIOR * math.sqrt(docs_), toxic / docs_), "feature long, score double").toPandas()
    hashes = rows["feature"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(hashes)
    model = Model(hashes[order], rows["score"].to_numpy(dtype=float)[order])
    return calibrated(model, sample.where("toxic = 0"), spark)


def calibrated(model: Model, clean: DataFrame, spark) -> Model:
    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[float, int] = {}
            for low, raw, offsets in V.slices(V.strings(batch.column(0))):
                found = V.words(raw, offsets)
                for value, n in zip(*np.unique(model.tokens(raw, found), return_counts=True), strict=True):
                    counts[float(value)] = counts.get(float(value), 0) + int(n)
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.float64()), pa.array(list(counts.values()), pa.int64())], ["score", "n"])

    histogram = clean.select("text").mapInArrow(tally, "score double, n long").groupBy("score").agg(F.sum("n").alias("n")).orderBy("score").toPandas()
    lam = root_of(histogram["score"].to_numpy(dtype=float), histogram["n"].to_numpy(dtype=float))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, mass = 0, 0.0
            for _, n, found in _scan(model, batch.column(0)):
                if n:
                    docs += 1
                    mass += n * float(np.exp(-lam * max((s for s, _, _ in found), default=0.0)))
            yield pa.RecordBatch.from_arrays([pa.array([docs]), pa.array([mass])], ["docs", "mass"])

    got = clean.select("text").mapInArrow(best, "docs long, mass double").agg(F.sum("docs"), F.sum("mass")).first()
    k = got[0] / got[1] if got[0] and got[1] else 1.0
    return Model(model.hashes, model.scores, lam, float(k))


def root_of(scores: np.ndarray, counts: np.ndarray) -> float:
    """The positive lambda at which the mean of exp(lambda * score) is 1.

    Where clean text has no score above 0, the toxic tokens' share is at most 1 in its tokens plus
    one, which stands in at a score of 1. A mean that is not negative has no such root; 0 is given.
    """
    if not len(scores):
        return 0.0
    if scores.max() <= 0:
        scores, counts = np.append(scores, 1.0), np.append(counts, 1.0)
    p = counts / counts.sum()
    if (p * scores).sum() >= 0:
        return 0.0
    low, high = 0.0, 1.0
    f = lambda x: np.log((p * np.exp(x * scores)).sum())
    while f(high) < 0 and high < 64:
        low, high = high, high * 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return high


_PASSAGE = "struct<begin:int,end:int,score:double,expected:double>"


def toxic_documents(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", significance: float = SIGNIFICANCE, max_labelled: int = MAX_LABELLED,
) -> DataFrame:
    """(doc_id, p_value, score, passages) of every row whose segments are significant together.

    ``p_value`` is that of the r best segments at the r where it is least (``Model.combined``), ``score``
    is the best segment's. ``passages`` lists these segments, and any that is significant alone, as word
    positions [begin, end), score and expected number by chance. Null and empty texts
    have no segments and are clean. A null id is returned as null. Repeated rows give equal rows.
    An empty table gives an empty result, and empty labels find nothing. Columns other than id, text
    and the labels' doc_id and toxic are not read. Texts are scanned whole.
    """
    model = fit(docs, labels, id_col, text_col, max_labelled)
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, p, best, passages = [], [], [], []
            for row, n, found in _scan(model, batch.column(1)):
                p_value, r = model.combined([s for s, _, _ in found], n)
                if p_value < significance:
                    least = sorted((s for s, _, _ in found), reverse=True)[r - 1]
                    real = [(s, b, e, float(model.expected(s, n))) for s, b, e in found]
                    real = [x for x in real if x[0] >= least or -np.expm1(-x[3]) < significance]
                    rows.append(row)
                    p.append(p_value)
                    best.append(max(x[0] for x in real))
                    passages.append([{"begin": b, "end": e, "score": s, "expected": x} for s, b, e, x in real])
            kinds = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(p, pa.float64()), pa.array(best, pa.float64()), pa.array(passages, kinds)],
                ["doc_id", "p_value", "score", "passages"],
            )

    return own.mapInArrow(run, f"doc_id {kind}, p_value double, score double, passages array<{_PASSAGE}>")


def is_toxic(model: Model, text: Column, significance: float = SIGNIFICANCE) -> Column:
    """Whether a text's passages are significant together; false for null."""

    @F.arrow_udf("boolean")
    def flag(texts: pa.Array) -> pa.Array:
        out = np.zeros(len(texts), dtype=bool)
        for row, n, found in _scan(model, texts):
            out[row] = model.combined([s for s, _, _ in found], n)[0] < significance
        return pa.array(out)

    return flag(text)


def clean_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", significance: float = SIGNIFICANCE, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """The rows of ``docs`` without significant toxic passages, with all their columns, unshuffled.

    Rows with a null or empty text, or a null id, stay unless the text is toxic; repeated rows stay or go together;
    an empty table stays empty, and without labels of both kinds all rows stay. Columns pass through whatever
    their names. At most ``max_labelled`` labelled documents fit the scores.
    """
    model = fit(docs, labels, id_col, text_col, max_labelled)
    return docs.where(~is_toxic(model, docs[text_col].cast("string"), significance))
