"""Passages that repeat across documents, by suffix arrays.

Any ``LENGTH`` words hold the same minimisers wherever they stand, so two documents that share them
share two consecutive chunks between minimisers. Chunk pairs that occur in one text only are left
out; what is left, with a margin for the passage's ends, makes regions. A window of ``LENGTH`` words
goes where the least of its hashed word pairs sends it, together with its neighbours of the same least
pair; equal windows meet there, and the suffixes of these segments are sorted, so that equal windows
are neighbours. Segments that are copies are sorted once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftspark.functions.durable import durable
from siftspark.llm import vectext as V
from siftspark.llm.graph import grouped
from siftspark.llm.linedups import line_hashes
from siftspark.llm.suffixes import suffix_array

LENGTH = 50
SPREAD = 16
#: Segments of whole keys are sorted together up to so many words; a key with more is sorted by itself.
BATCH_WORDS = 200_000


def minimisers(order: np.ndarray, spread: int) -> np.ndarray:
    """Places of the least value (the leftmost of equals) of every ``spread`` consecutive ones."""
    if not len(order):
        return np.zeros(0, dtype=np.int64)
    if len(order) <= spread:
        return np.array([int(np.argmin(order))])
    windows = np.lib.stride_tricks.sliding_window_view(order, spread)
    return np.unique(np.argmin(windows, axis=1) + np.arange(len(windows)))


def _runs(hashes: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of each run of words."""
    up, down = V._power_table(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    return V.mix((sums[ends] - sums[begins]) * down[begins] + (ends - begins).astype(np.uint64))


def _chunked(length: int, spread: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for low, raw, offsets in V.slices(V.strings(batch.column(1))):
                found = V.words(raw, offsets)
                whole = line_hashes(found)
                rows = np.flatnonzero(found.counts >= length)
                keys, begins, ends, sizes = [], [], [], []
                for r in rows:
                    own = found.hashes[found.first[r] : found.first[r + 1]]
                    at = minimisers(_pairs(own), spread)
                    b, e = at[:-2], at[2:]
                    keys.append(_runs(own, b, e))
                    begins.append(b)
                    ends.append(e)
                    sizes.append(len(b))
                if not len(rows):
                    continue
                each = np.concatenate([[0], np.cumsum(sizes)])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(V.signed(whole[rows])), pa.array(ids[low + rows]), pa.array(found.counts[rows].astype(np.int32)),
                        V.lists(V.signed(np.concatenate(keys)), each), V.lists(np.concatenate(begins).astype(np.int32), each), V.lists(np.concatenate(ends).astype(np.int32), each),
                    ],
                    ["x", "doc_id", "words", "keys", "begins", "ends"],
                )

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows whose key occurs in two texts at least; input sorted by (key, x)."""
    for table in grouped(batches, "key"):
        keys, x = table.column("key").to_numpy(), table.column("x").to_numpy()
        begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.append(begin, len(keys)))
        last = begin + sizes - 1
        many = np.repeat(x[begin] != x[last], sizes)
        for batch in table.filter(pa.array(many)).to_batches():
            if batch.num_rows:
                yield batch


def _regions(length: int, spread: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, "x"):
            x, begins, ends = (table.column(c).to_numpy() for c in ("x", "begin", "end"))
            # A passage begins and ends less than a spread and a word off its outer minimisers.
            low, high = np.maximum(begins - spread - 1, 0), np.minimum(ends + spread + 2, table.column("words").to_numpy())
            reach = np.zeros(len(x), dtype=np.int64)
            starts = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
            for a, b in zip(starts, np.append(starts[1:], len(x)), strict=True):
                reach[a:b] = np.maximum.accumulate(high[a:b])
            new = np.ones(len(x), dtype=bool)
            new[1:] = (x[1:] != x[:-1]) | (low[1:] > reach[:-1])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(x)) - 1
            made = pa.RecordBatch.from_arrays([pa.array(x[first]), pa.array(low[first].astype(np.int32)), pa.array(reach[last].astype(np.int32))], ["x", "begin", "end"])
            yield made.filter(pa.array(reach[last] - low[first] >= length))

    return run


def _pairs(words: np.ndarray) -> np.ndarray:
    """A hash of each two words in a row."""
    return V.mix(words[:-1] * V._PLACES[0] + words[1:] * V._PLACES[1])


def segments(words: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, begin, end) of the runs of windows that have the same least pair (the leftmost of equals)."""
    pairs = _pairs(words)
    windows = np.lib.stride_tricks.sliding_window_view(pairs, length - 1)
    least = np.argmin(windows, axis=1) + np.arange(len(windows))
    begin = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    return pairs[least[begin]], begin, np.append(begin[1:], len(windows)) + length - 1


def _cut(length: int):
    """The segments of each wanted region; rows that share an id may differ, so hashes of texts are compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column("wanted").to_pylist()
            ids = batch.column("doc_id").to_numpy()
            for low, raw, offsets in V.slices(V.strings(batch.column("text"))):
                found = V.words(raw, offsets)
                whole = V.signed(line_hashes(found))
                rows: list[tuple] = []
                for r in range(found.rows):
                    for w in wanted[low + r]:
                        if w["x"] == whole[r]:
                            own = found.hashes[found.first[r] + w["begin"] : found.first[r] + w["end"]]
                            for k, b, e in zip(*segments(own, length), strict=True):
                                rows.append((k, w["x"], ids[low + r], w["begin"] + b, own[b:e]))
                for at in range(0, len(rows), 5000):
                    key, x, doc, begin, words = zip(*rows[at : at + 5000], strict=True)
                    each = np.concatenate([[0], np.cumsum([len(w) for w in words])])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(V.signed(np.array(key, dtype=np.uint64))), pa.array(x, pa.int64()), pa.array(doc, pa.int64()), pa.array(begin, pa.int32()), V.lists(V.signed(np.concatenate(words)), each)],
                        ["key", "x", "doc_id", "begin", "words"],
                    )

    return run


def repeated_windows(words: np.ndarray, first: np.ndarray, lowest: np.ndarray, highest: np.ndarray, length: int) -> np.ndarray:
    """The least document of the window that begins at each word, or the least long where one document alone has it.

    ``first`` is where each segment's words begin; ``lowest`` and ``highest`` are the least and the
    greatest document that have the segment.
    """
    n, count = len(words), len(lowest)
    segment = np.repeat(np.arange(count), np.diff(first))
    # Each segment is followed by a symbol of its own, less than any word; the very last one is least.
    symbols = np.unique(words, return_inverse=True)[1] + count + 1
    place = np.arange(n) + segment
    text = np.zeros(n + count, dtype=np.int64)
    text[place] = symbols
    text[first[1:] + np.arange(count)] = np.arange(count, 0, -1) - 1
    word = np.full(n + count, -1, dtype=np.int64)
    word[place] = np.arange(n)
    starts = word[suffix_array(text)]
    starts = starts[starts >= 0]
    starts = starts[starts + length <= first[1:][segment[starts]]]
    same = np.ones(len(starts) - 1, dtype=bool)
    for k in range(length):
        at = np.flatnonzero(same)
        same[at] = words[starts[at] + k] == words[starts[at + 1] + k]
    cluster = np.flatnonzero(np.concatenate([[True], ~same]))
    low = np.minimum.reduceat(lowest[segment[starts]], cluster)
    high = np.maximum.reduceat(highest[segment[starts]], cluster)
    least = np.full(n, _ALONE, dtype=np.int64)
    least[starts] = np.repeat(np.where(low == high, _ALONE, low), np.diff(np.append(cluster, len(starts))))
    return least


_ALONE = np.iinfo(np.int64).min


def spans(marked: np.ndarray, first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(region, begin, end) of the unions of the windows that begin at marked words, within each region."""
    at = np.flatnonzero(marked)
    region = np.searchsorted(first, at, "right") - 1
    new = np.ones(len(at), dtype=bool)
    new[1:] = (region[1:] != region[:-1]) | (at[1:] > at[:-1] + length)
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(at)) - 1
    return region[begin], at[begin] - first[region[begin]], at[end] + length - first[region[begin]] if len(begin) else at


def _sorted(length: int, batch_words: int):
    def solve(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        """Runs of windows (x, doc_id, begin, end, kept); end is behind the last window's beginning."""
        unique: dict[bytes, int] = {}
        which = np.array([unique.setdefault(r[3], len(unique)) for r in rows])
        docs = np.array([r[1] for r in rows], dtype=np.int64)
        lowest, highest = np.full(len(unique), np.iinfo(np.int64).max), np.full(len(unique), _ALONE)
        np.minimum.at(lowest, which, docs)
        np.maximum.at(highest, which, docs)
        words = [np.frombuffer(w, dtype=np.int64) for w in unique]
        first = np.concatenate([[0], np.cumsum([len(w) for w in words])])
        if len(unique) == 1:
            least = np.full(first[-1], lowest[0] if lowest[0] != highest[0] else _ALONE)
            least[first[-1] - length + 1 :] = _ALONE
        else:
            least = repeated_windows(np.concatenate(words), first, lowest, highest, length)
        out = []
        for (x, doc, begin, _), u in zip(rows, which, strict=True):
            own = least[first[u] : first[u + 1]]
            edges = np.flatnonzero(np.diff(np.concatenate([[0], np.where(own == _ALONE, 0, np.where(own == doc, 1, 2)), [0]])))
            for b, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if own[b] != _ALONE:
                    out.append((x, doc, begin + b, begin + e, bool(own[b] == doc)))
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_())
        for at in range(0, len(out), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out[at : at + 20_000], strict=True), kinds, strict=True)], ["x", "doc_id", "begin", "end", "kept"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, key = 0, None
        for batch in batches:
            lists = batch.column("words")
            flat, offsets = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            columns = [batch.column(c).to_pylist() for c in ("key", "x", "doc_id", "begin")]
            for i, (own, x, doc, begin) in enumerate(zip(*columns, strict=True)):
                if own != key and size >= batch_words:
                    yield from solve(held)
                    held, size = [], 0
                key = own
                held.append((x, doc, begin, flat[offsets[i] : offsets[i + 1]].tobytes()))
                size += int(offsets[i + 1] - offsets[i])
        if held:
            yield from solve(held)

    return run


def _spans(length: int):
    """The spans of each text from its runs of windows; of a text that has copies every window repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for owner, words, copied, runs in zip(*(batch.column(c).to_pylist() for c in ("owner", "words", "copied", "runs")), strict=True):
                kept, gone = np.zeros(words, dtype=bool), np.zeros(words, dtype=bool)
                for r in runs or []:
                    (kept if r["kept"] else gone)[r["begin"] : r["end"]] = True
                if copied:
                    kept = ~gone
                    kept[words - length + 1 :] = False
                for mark, stays in ((gone, False), (kept, True)):
                    _, begin, end = spans(mark, np.array([0, words]), length)
                    out += [(owner, b, e, stays) for b, e in zip(begin.tolist(), end.tolist(), strict=True)]
            columns = list(zip(*out, strict=True)) if out else [[], [], [], []]
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "begin", "end", "kept"])

    return run


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, spread: int = SPREAD) -> DataFrame:
    """(doc_id, begin, end, kept): word spans [begin, end) made of windows of ``length`` words found in another document too.

    Windows of a document that is the least of those that have them make the spans to be ``kept``;
    the same windows elsewhere make the spans that may go. Words are runs of letters, digits and
    non-ASCII characters in lower case. Rows with a null id are left out; null, empty and shorter
    texts have no window. Repeats within one id do not count; repeated rows give one result. Columns
    other than the two named are not read. An empty table gives an empty result. Texts are used
    whole.
    """
    if length < 3 * spread + 1:
        raise ValueError("a passage must hold three minimisers: length > 3 * spread")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    chunked = durable(own.mapInArrow(_chunked(length, spread), "x long, doc_id long, words int, keys array<long>, begins array<int>, ends array<int>"))
    texts = durable(chunked.select("x", "doc_id", "words").distinct())
    owners = texts.groupBy("x").agg(F.min("doc_id").alias("owner"), F.count("*").alias("copies"), F.max("words").alias("words"))
    # One row of each text; rows that repeat id and text are cut down by the rank.
    order = Window.partitionBy("x").orderBy("doc_id")
    one = chunked.withColumn("nth", F.row_number().over(order)).where("nth = 1")
    pairs = one.select("x", "words", F.explode(F.arrays_zip("keys", "begins", "ends")).alias("c")).select("x", "words", F.col("c.keys").alias("key"), F.col("c.begins").alias("begin"), F.col("c.ends").alias("end"))
    kinds = "x long, words int, key long, begin int, end int"
    shared = pairs.repartition("key").sortWithinPartitions("key", "x").mapInArrow(_shared, kinds)
    regions = shared.repartition("x").sortWithinPartitions("x", "begin").mapInArrow(_regions(length, spread), "x long, begin int, end int")
    wanted = regions.join(owners.select("x", "owner"), "x").groupBy(F.col("owner").alias("_o")).agg(F.collect_list(F.struct("x", "begin", "end")).alias("wanted"))
    cut = own.join(wanted, own["doc_id"] == wanted["_o"]).select("doc_id", "text", "wanted").mapInArrow(_cut(length), "key long, x long, doc_id long, begin int, words array<long>")
    found = cut.repartition("key").sortWithinPartitions("key").mapInArrow(_sorted(length, BATCH_WORDS), "x long, doc_id long, begin int, end int, kept boolean")
    runs = found.groupBy("x").agg(F.collect_list(F.struct("begin", "end", "kept")).alias("runs"))
    repeated = owners.join(runs, "x", "left").where("copies > 1 OR runs IS NOT NULL").select("owner", "words", (F.col("copies") > 1).alias("copied"), "runs")
    spanned = repeated.mapInArrow(_spans(length), "doc_id long, begin int, end int, kept boolean")
    # Copies of a text repeat it whole.
    copied = owners.where("copies > 1").select("x", "owner")
    extra = texts.join(copied, "x").where("doc_id > owner").select("doc_id", F.lit(0).alias("begin"), F.col("words").alias("end"), F.lit(False).alias("kept"))
    return spanned.union(extra).distinct()


SQL = (
    r"""
WITH words AS (
  SELECT DISTINCT doc_id, regexp_extract_all(lower(text), 'WORD') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
texts AS (
  SELECT doc_id, row_number() OVER () AS r, w FROM words WHERE len(w) >= 50),
windows AS (
  SELECT doc_id, r, i, array_to_string(w[i + 1 : i + 50], ' ') AS s FROM (SELECT doc_id, r, w, unnest(range(len(w) - 49)) AS i FROM texts)),
owners AS (
  SELECT s, min(doc_id) AS least FROM windows GROUP BY s HAVING min(doc_id) <> max(doc_id)),
marked AS (
  SELECT doc_id, r, i, doc_id = least AS kept FROM windows JOIN owners USING (s)),
broken AS (
  SELECT *, CASE WHEN i <= 50 + lag(i) OVER (PARTITION BY doc_id, r, kept ORDER BY i) THEN 0 ELSE 1 END AS new FROM marked),
runs AS (
  SELECT *, sum(new) OVER (PARTITION BY doc_id, r, kept ORDER BY i) AS run FROM broken)
SELECT DISTINCT doc_id, min(i)::INT AS begin, (max(i) + 50)::INT AS "end", kept FROM runs GROUP BY doc_id, r, kept, run
""".replace("WORD", V.word_pattern())
)
