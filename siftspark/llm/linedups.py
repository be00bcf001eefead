"""Fuzzy line dedup: SimHash of normalised lines, pigeonhole blocks, edit similarity, one line a group.

A line's normal form is its words in lower case, digits as 0, joined by single blanks. Lines of one
normal form are copies. Distinct forms get a SimHash whose features are the letters together with
the low waves of their places in the line: a letter that is changed, added or taken out turns a
SimHash by little wherever it stands, however short the line is, and the waves have no mean that
all lines of a language would share. Forms of like length that agree in a whole block and in one of the
bytes of their check words that go with it, and whose check words are near, are candidates; of each pair of
them the edit similarity is computed once. Only blocks are shuffled by, bytes are met within a task. Whether
two forms are candidates depends on the two alone, however many others there are.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftspark.functions.durable import durable
from siftspark.llm import vectext as V
from siftspark.llm.frames import fresh, release
from siftspark.llm.graph import components, grouped, spanning_edges

SIMILARITY = 0.95
#: Letters fall into so many classes, places into so many parts, waves are the cosines up to so many halves.
CLASSES, PLACES, WAVES = 32, 16, 4
#: 64-bit words of SimHash that blocks are cut from, and further bits that candidates are checked by.
WORDS = 3
BITS = 64 * WORDS
CHECKED = 96
#: Check bits in which candidates may differ; pairs of similarity 0.95 differ in 10 of 96 on average.
CHECK_BITS = 17
#: The width of the blocks and their number, whatever the input's size.
WIDTH, BLOCKS = 10, 12
#: Each key of a block goes with one of so many runs of the check bits' bytes.
TURNS = 3
TURN_BYTES = CHECKED // 8 // TURNS
BAND = 0.3
#: Forms with more near ones than so many in a group of which that holds on average are compared as families, in chunks; other near pairs are listed.
FAMILY = 32
CHUNK = 1024
#: Bits of the bitmap of documents whose texts are wanted: 8 MB, whatever the input's size.
MARKS = 1 << 26
_SIGS = [*(f"s{i}" for i in range(WORDS)), "c", "d"]
_SIG_TYPE = ", ".join(f"{s} {'int' if s == 'd' else 'long'}" for s in _SIGS)
_ENTRIES = 1 << 20
_BUCKET_BYTES = 1 << 24
#: Groups of so many forms are compared together with others; larger ones so many rows at a time.
_SMALL, _ROWS = 12, 256
_PAIRS = 1 << 22
_CELLS = 1 << 20
#: Pairs with room for so many edits are first compared by their runs of characters.
_LONG, _RUN = 40, 6
#: All pairs are first compared by whether runs of so many characters, hashed to so many kinds, are odd in number.
_GRAM, _GRAMS = 4, 2048
#: So many forms of a family at most are compared at once with those that are not reached yet.
_FRONTIER = 64
_ODD = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], dtype=np.uint32)

_CLASS = np.zeros(256, dtype=np.int64)
_CLASS[97:123] = np.arange(26)
_CLASS[65:91] = np.arange(26)
_CLASS[48:58] = 26
_CLASS[128:192] = np.arange(128, 192) * 7 % CLASSES
_CLASS[192:] = 27 + np.arange(192, 256) % 4
_WAVE = np.cos(np.pi * np.arange(1, WAVES + 1)[None, :] * ((np.arange(PLACES) + 0.5) / PLACES)[:, None]).astype(np.float32)
_PLANES = np.random.default_rng(20240301).standard_normal((CLASSES * WAVES, BITS + CHECKED)).astype(np.float32)


def simhashes(classes: np.ndarray, first: np.ndarray, rows: np.ndarray, step: int = 400) -> np.ndarray:
    """The SimHash of the chosen rows in 32-bit words: those of the blocks, then the check bits.

    ``classes`` has the letters' classes, ``first`` where each row's begin. A bit is set where the sum of
    its plane's weights over all (letter, wave) features is above 0.
    """
    out = np.empty((len(rows), (BITS + CHECKED) // 32), dtype=np.uint32)
    for low in range(0, len(rows), step):
        own = rows[low : low + step]
        begin, sizes = first[own], first[own + 1] - first[own]
        row = np.repeat(np.arange(len(own)), sizes)
        at = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        cells = (row * CLASSES + classes[np.repeat(begin, sizes) + at]) * PLACES + at * PLACES // sizes[row]
        counts = np.bincount(cells, minlength=len(own) * CLASSES * PLACES).astype(np.float32)
        waves = (counts.reshape(-1, PLACES) @ _WAVE).reshape(len(own), -1)
        out[low : low + step] = np.packbits(waves @ _PLANES > 0, axis=1).view(np.uint32)
    return out


def line_words(raw: np.ndarray, offsets: np.ndarray) -> tuple[V.Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words of runs of rows with ``first`` by line, and for each line where it begins, its row and its number there."""
    breaks = np.flatnonzero(raw == 10)
    begins = np.concatenate([offsets[:-1], breaks + 1])
    row = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, breaks, "right") - 1])
    order = np.lexsort((begins, row))
    begins, row = begins[order], row[order]
    nth = np.arange(len(row)) - np.searchsorted(row, row)
    digits = (raw >= 48) & (raw <= 57)
    found = V.words(np.where(digits, np.uint8(48), raw), offsets)
    found.first = np.append(np.searchsorted(found.starts, begins), len(found.starts))
    return found, begins, row, nth


def line_hashes(found: V.Words) -> np.ndarray:
    """A hash of each line's words in their order, whose lines begin at ``found.first``."""
    up, down = V._power_table(len(found.hashes) + 1)
    sums = np.zeros(len(found.hashes) + 1, dtype=np.uint64)
    np.cumsum(found.hashes * up[: len(found.hashes)], out=sums[1:])
    return V.mix((sums[found.first[1:]] - sums[found.first[:-1]]) * down[found.first[:-1]] + found.counts.astype(np.uint64))


def most_edits(longest: np.ndarray | int, similarity: float) -> np.ndarray | int:
    """The greatest distance at which 1 - distance / longest reaches ``similarity``."""
    return np.floor(longest * (1 - similarity) + 1e-9).astype(np.int64) if isinstance(longest, np.ndarray) else int(longest * (1 - similarity) + 1e-9)


def columns(sig: np.ndarray) -> list[np.ndarray]:
    """SimHashes as signed columns: of 64 bits each, the last of 32."""
    wide = np.ascontiguousarray(sig[:, :-1]).view(np.int64)
    return [*(np.ascontiguousarray(wide[:, i]) for i in range(wide.shape[1])), np.ascontiguousarray(sig[:, -1]).view(np.int32)]


def fewest_letters(similarity: float) -> int:
    """The least size of a form that may be alike to another one."""
    longest = math.ceil(1 / (1 - similarity) - 1e-9) if similarity < 1 else 1 << 30
    return longest - most_edits(longest, similarity)


def _lines(similarity: float):
    """(h, doc_id, line, size, SimHash) of each line with a word; shorter lines than can be alike have no SimHash."""
    least = fewest_letters(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for low, raw, offsets in V.slices(V.strings(batch.column(1))):
                found, begins, row, nth = line_words(raw, offsets)
                keep = np.flatnonzero(found.counts)
                if not len(keep):
                    continue
                letters = np.flatnonzero(found.inside)
                first = np.searchsorted(letters, np.append(begins, len(raw)))
                leads = np.concatenate([[0], np.cumsum((raw[letters] & 0xC0) != 0x80)])
                size = (leads[first[1:]] - leads[first[:-1]] + found.counts - 1)[keep]
                h = line_hashes(found)[keep]
                _, one, inverse = np.unique(h, return_index=True, return_inverse=True)
                long = size[one] >= least
                sig = np.zeros((len(one), (BITS + CHECKED) // 32), dtype=np.uint32)
                sig[long] = simhashes(_CLASS[raw[letters]], first, keep[one[long]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(V.signed(h)), pa.array(ids[low + row[keep]]), pa.array(nth[keep].astype(np.int32)), pa.array(size.astype(np.int32)), *(pa.array(x) for x in columns(sig[inverse]))],
                    ["h", "doc_id", "line", "size", *_SIGS],
                )

    return run


def bands(sizes: np.ndarray, similarity: float) -> np.ndarray:
    """Two bands of the logarithm of each length, mostly the same; alike lines share one at least."""
    x = np.log(np.maximum(sizes, 1))
    return np.stack([np.floor(x / BAND), np.floor((x - np.log(similarity) + 1e-9) / BAND)], axis=1).astype(np.int64)


def block_plan(forms: float = 0) -> tuple[int, int]:
    """The width of blocks and their number: the same for any number of forms, so that no pair is lost as a table grows."""
    return WIDTH, BLOCKS


def block_keys(sig: np.ndarray, band: int, width: int, blocks: int) -> np.ndarray:
    """The keys of each SimHash's blocks within its band, a column for each; blocks lie evenly and wrap around."""
    out = np.empty((len(sig), blocks), dtype=np.uint64)
    for b in range(blocks):
        word, bit = divmod(b * BITS // blocks, 64)
        value = sig[:, word] >> np.uint64(bit)
        if bit + width > 64:
            value = value | (sig[:, (word + 1) % WORDS] << np.uint64(64 - bit))
        out[:, b] = V.mix((value & np.uint64((1 << width) - 1)) + np.uint64((band * 4096 + b) << 33))
    return out


def _entries(batch: pa.RecordBatch, similarity: float) -> np.ndarray:
    """(part hash, block key, h, check bits) of a batch of forms in 32-bit words: 1, 1, 2 and 3 of them."""
    sig = np.stack([batch.column(s).to_numpy() for s in _SIGS[:-1]], axis=1).view(np.uint64)
    last = batch.column("d").to_numpy().view(np.uint32)
    h, band = batch.column("h").to_numpy().view(np.uint64), bands(batch.column("size").to_numpy(), similarity)
    out = [np.zeros((0, 7), np.uint32)]
    for own, rows in ((band[:, 0], np.arange(len(h))), (band[:, 1], np.flatnonzero(band[:, 0] != band[:, 1]))):
        for b in np.unique(own[rows]).tolist():
            some = rows[own[rows] == b]
            keys = block_keys(sig[some], b, *block_plan())
            each = np.repeat(some, keys.shape[1])
            out.append(np.column_stack([np.column_stack([keys.reshape(-1), h[each], sig[each, WORDS]]).view(np.uint32), last[each]]))
    return np.concatenate(out)


def pack(entries: np.ndarray) -> bytes:
    """Entries (key, h, check bits), sorted by key, with each key once and the number of its entries."""
    keys, begin = np.unique(entries[:, 0], return_index=True)
    counts = np.diff(np.append(begin, len(entries))).astype(np.uint32)
    return b"".join([np.uint32(len(keys)).tobytes(), keys.tobytes(), counts.tobytes(), entries[:, 1:].tobytes()])


def unpack(blob: bytes) -> np.ndarray:
    """The entries of ``pack``."""
    words = np.frombuffer(blob, dtype=np.uint32)
    n = int(words[0])
    return np.column_stack([np.repeat(words[1 : 1 + n], words[1 + n : 1 + 2 * n]), words[1 + 2 * n :].reshape(-1, 5)])


def _blocked(similarity: float, parts: int):
    """Entries packed by the part that their key falls to, so that the shuffle moves few large rows."""

    def packed(held: list[np.ndarray]) -> pa.RecordBatch:
        entries = np.concatenate(held)
        part = entries[:, 0] % np.uint32(parts)
        order = np.argsort(part.astype(np.uint64) << np.uint64(32) | entries[:, 1])
        kinds, begin = np.unique(part[order], return_index=True)
        blobs = [pack(entries[own, 1:]) for own in np.split(order, begin[1:])]
        return pa.RecordBatch.from_arrays([pa.array(kinds.astype(np.int32)), pa.array(blobs, pa.binary())], ["part", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(_entries(batch, similarity))
            n += len(held[-1])
            if n >= _ENTRIES:
                yield packed(held)
                held, n = [], 0
        if n:
            yield packed(held)

    return run


def _near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether check bits, in two columns, are near."""
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64) <= CHECK_BITS


def _dense(check: np.ndarray, rest: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray] | None:
    """The near pairs of one group, or None where there are more than ``most``."""
    a, b, n = [], [], 0
    for low in range(0, len(check), _ROWS):
        i, j = np.divmod(np.flatnonzero(np.bitwise_count(check[low : low + _ROWS, None] ^ check[None, low:]) <= CHECK_BITS), len(check) - low)
        up = j > i
        i, j = i[up] + low, j[up] + low
        near = np.bitwise_count(check[i] ^ check[j]) + np.bitwise_count(rest[i] ^ rest[j]) <= CHECK_BITS
        a.append(i[near])
        b.append(j[near])
        n += len(a[-1])
        if n > most:
            return None
    return np.concatenate(a), np.concatenate(b)


def _crowded(check: np.ndarray, rest: np.ndarray, family: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one group, the near pairs of forms that have up to ``family`` near ones, and the places of the forms that have more."""
    a, b, many = [], [], []
    for low in range(0, len(check), _ROWS):
        near = np.bitwise_count(check[low : low + _ROWS, None] ^ check) + np.bitwise_count(rest[low : low + _ROWS, None] ^ rest) <= CHECK_BITS
        few = near.sum(axis=1) <= family + 1
        i, j = np.nonzero(near[few])
        a.append(low + np.flatnonzero(few)[i])
        b.append(j)
        many.append(low + np.flatnonzero(~few))
    i, j = np.concatenate(a), np.concatenate(b)
    return i[i != j], j[i != j], np.concatenate(many)


def _near_pairs(group: np.ndarray, check: np.ndarray, rest: np.ndarray, family: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """The near pairs of places of each group, in which ``group`` is equal and sorted.

    In groups with more than ``family`` near forms a form on average, forms that have more get a spanning forest, marked as such,
    so that a group gives in proportion to its forms.
    """
    begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    sizes = np.diff(np.append(begin, len(group)))
    small = min(_SMALL, family)
    each = np.repeat(sizes, sizes)
    own = np.flatnonzero((each > 1) & (each <= small))
    g, c, r = group[own], check[own], rest[own]
    for step in range(1, min(small, len(own))):
        hit = np.flatnonzero((g[step:] == g[:-step]) & (np.bitwise_count(c[step:] ^ c[:-step]) <= CHECK_BITS))
        hit = hit[np.bitwise_count(c[hit] ^ c[hit + step]) + np.bitwise_count(r[hit] ^ r[hit + step]) <= CHECK_BITS]
        yield own[hit], own[hit + step], False
    large = np.flatnonzero(sizes > small)
    for low, size in zip(begin[large].tolist(), sizes[large].tolist(), strict=True):
        c, r = check[low : low + size], rest[low : low + size]
        pairs = _dense(c, r, size * family // 2)
        if pairs is not None:
            yield low + pairs[0], low + pairs[1], False
        else:
            a, b, many = _crowded(c, r, family)
            yield low + a, low + b, False
            forest = np.array(list(spanning_edges(np.stack([c[many], r[many].astype(np.uint64)], axis=1), _near)), dtype=np.int64).reshape(-1, 2)
            yield low + many[forest[:, 0]], low + many[forest[:, 1]], True


def turns(key: np.ndarray) -> np.ndarray:
    """Which run of the check bits' bytes goes with each block's key."""
    return (key >> np.uint64(32)) % np.uint64(TURNS)


def _candidates(family: int):
    """The near pairs (a, b) of each block and byte; of families a spanning forest of near pairs, marked as such."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = [b for batch in batches for b in batch.column("blob").to_pylist()]
        if not blobs:
            return
        entries = np.concatenate([unpack(b) for b in blobs])
        del blobs
        kinds, form = np.unique(np.ascontiguousarray(entries[:, 1:3]).view(np.uint64)[:, 0], return_inverse=True)
        _, bucket = np.unique(entries[:, 0], return_inverse=True)
        check, rest = np.ascontiguousarray(entries[:, 3:5]).view(np.uint64)[:, 0], np.ascontiguousarray(entries[:, 5])
        octets = np.ascontiguousarray(entries[:, 3:]).view(np.uint8)
        first = np.arange(len(entries)) * octets.shape[1] + entries[:, 0] % np.uint32(TURNS) * np.int64(TURN_BYTES)
        found: dict[bool, list[np.ndarray]] = {False: [], True: []}
        held = {False: 0, True: 0}
        for byte in range(TURN_BYTES):
            group = bucket << 8 | octets.reshape(-1)[first + byte]
            order = np.argsort(group)
            for a, b, marked in _near_pairs(group[order], check[order], rest[order], family):
                a, b = form[order[a]], form[order[b]]
                found[marked].append((np.maximum(a, b) * len(kinds) + np.minimum(a, b))[a != b])
                held[marked] += len(a)
                if held[marked] > _PAIRS:
                    found[marked] = [np.unique(np.concatenate(found[marked]))]
                    held[marked] = len(found[marked][0]) // 2
        for marked, pairs in found.items():
            a, b = np.divmod(np.unique(np.concatenate([np.zeros(0, np.int64), *pairs])), len(kinds))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(V.signed(kinds[a])), pa.array(V.signed(kinds[b])), pa.array(np.full(len(a), marked))], ["a", "b", "family"])

    return run


class Sketches:
    """SimHashes of forms, to tell of any two of them whether they are candidates."""

    def __init__(self, sig: np.ndarray, last: np.ndarray, sizes: np.ndarray, similarity: float):
        band = bands(sizes, similarity)
        self.keys = np.zeros((len(sig), 2, BLOCKS), dtype=np.uint64)
        for b in np.unique(band).tolist():
            for nth in range(2):
                own = band[:, nth] == b
                self.keys[own, nth] = block_keys(sig[own], b, *block_plan())
        self.turns = turns(self.keys).astype(np.int64)
        self.check = np.column_stack([np.ascontiguousarray(sig[:, WORDS : WORDS + 1]).view(np.uint32), last])
        self.octets = self.check.view(np.uint8)

    def candidates(self, at: int | np.ndarray, others: np.ndarray) -> np.ndarray:
        """Which of the other forms are candidates with the one at ``at``, or each with its own, as ``_candidates`` would find them."""
        out = _near(self.check[at], self.check[others])
        some = np.flatnonzero(out)
        x, y = np.broadcast_to(at, len(others))[some], others[some]
        octet = (self.octets[x] == self.octets[y]).reshape(-1, TURNS, TURN_BYTES).any(axis=2)
        met = np.zeros(len(some), dtype=bool)
        for own in range(2):
            turn = np.take_along_axis(octet, self.turns[x, own], axis=1)
            for other in range(2):
                met |= (turn & (self.keys[x, own] == self.keys[y, other])).any(axis=1)
        out[some] = met
        return out


_WORD = re.compile(V.word_pattern("\\U{:08x}"))
_DIGITS = re.compile(r"[0-9]")


def normal(line: str) -> str:
    """The normal form of a line that is already in lower case."""
    return _DIGITS.sub("0", " ".join(_WORD.findall(line)))


_MIXED = V.mix(np.arange(1, 1 + (1 << 13), dtype=np.uint64))


def _mixed(chars: np.ndarray) -> np.ndarray:
    """A hash of each character; those of most scripts are looked up."""
    if not len(chars) or int(chars.max()) < len(_MIXED):
        return _MIXED[chars]
    return V.mix(chars.astype(np.uint64) + np.uint64(1))


class Texts:
    """Characters of many texts in one array, with sums that tell in one step whether two runs are equal."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_string())
        self.sizes = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.chars = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self.powers = V._power_table(len(self.chars) + 1)[0]
        self.sums = np.zeros(len(self.chars) + 1, dtype=np.uint64)
        np.cumsum(_mixed(self.chars) * self.powers[: len(self.chars)], out=self.sums[1:])
        #: How many characters of each of 64 kinds each text has.
        self.letters = np.bincount(np.repeat(np.arange(len(texts)), self.sizes) * 64 + (self.chars & 63), minlength=len(texts) * 64).reshape(-1, 64).astype(np.int32)
        self.odd = self._odd()

    def common(self, p: np.ndarray, q: np.ndarray, most: np.ndarray) -> np.ndarray:
        """The length of the common run from the places p and q, ``most`` at most."""
        out = np.zeros(len(p), dtype=np.int64)
        at = np.flatnonzero(most > 0)
        at = at[self.chars[p[at]] == self.chars[q[at]]]
        if not len(at):
            return out
        p, q, most = p[at], q[at], most[at]
        got = np.ones(len(at), dtype=np.int64)

        def grow(some: np.ndarray, bit: int) -> np.ndarray:
            """Lengthens some runs by 2 ** bit where they stay equal, and says which."""
            some = some[got[some] + (1 << bit) <= most[some]]
            x, y, more = p[some] + got[some], q[some] + got[some], 1 << bit
            same = some[(self.sums[x + more] - self.sums[x]) * self.powers[y] == (self.sums[y + more] - self.sums[y]) * self.powers[x]]
            got[same] += more
            return same

        # Most runs are short, and only those of 9 or more need the steps above 4.
        long = grow(np.arange(len(at)), 3)
        for bit in range(int(most.max()).bit_length() - 1, 2, -1):
            grow(long, bit)
        for bit in (2, 1, 0):
            grow(np.arange(len(at)), bit)
        out[at] = got
        return out

    def _odd(self) -> np.ndarray:
        """For each text a bit for each of ``_GRAMS`` kinds of runs of ``_GRAM`` characters: whether it has an odd number of them."""
        value = self.chars[: max(0, len(self.chars) - _GRAM + 1)] * _ODD[0]
        for i in range(1, _GRAM):
            value += self.chars[i : i + len(value)] * _ODD[i]
        kinds = ((value ^ (value >> np.uint32(15))) * _ODD[0] >> np.uint32(20)) % np.uint32(_GRAMS)
        sizes = np.maximum(0, self.sizes - _GRAM + 1)
        out, step = np.empty((len(sizes), _GRAMS // 8), dtype=np.uint8), _CELLS // _GRAMS
        for low in range(0, len(sizes), step):
            own = sizes[low : low + step]
            row = np.repeat(np.arange(len(own)), own)
            at = np.repeat(self.first[low : low + step] - np.cumsum(own) + own, own) + np.arange(len(row))
            counts = np.bincount(row * _GRAMS + kinds[at], minlength=len(own) * _GRAMS)
            out[low : low + step] = np.packbits((counts & 1).astype(np.uint8).reshape(-1, _GRAMS), axis=1)
        return out.view(np.uint64)

    def able(self, at: int, others: np.ndarray, odd: np.ndarray, similarity: float) -> np.ndarray:
        """Which of the other rows, whose bits of ``_odd`` are given, may be alike to the one at ``at`` by their sizes and runs."""
        most = most_edits(np.maximum(self.sizes[at], self.sizes[others]), similarity)
        return (np.abs(self.sizes[at] - self.sizes[others]) <= most) & (np.bitwise_count(self.odd[at] ^ odd).sum(axis=1, dtype=np.int32) <= 2 * _GRAM * most)

    def alike(self, a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
        """Which of the pairs of rows reach the edit similarity.

        An edit changes lengths by one at most, the letters' counts by two and the bits of ``_odd``
        by twice as many as ``_GRAM``; pairs that are left are decided by the furthest places that so many edits reach on each diagonal, edit after edit, all pairs at once.
        """
        most = most_edits(np.maximum(self.sizes[a], self.sizes[b]), similarity)
        out = np.zeros(len(a), dtype=bool)
        able = np.flatnonzero(np.abs(self.sizes[a] - self.sizes[b]) <= most)
        for low in range(0, len(able), 1024):
            own = able[low : low + 1024]
            own = own[np.abs(self.letters[a[own]] - self.letters[b[own]]).sum(axis=1) <= 2 * most[own]]
            own = own[np.bitwise_count(self.odd[a[own]] ^ self.odd[b[own]]).sum(axis=1, dtype=np.int64) <= 2 * _GRAM * most[own]]
            own = own[np.argsort(most[own], kind="stable")]
            long = int(np.searchsorted(most[own], _LONG))
            own = np.concatenate([own[:long], [i for i in own[long:].tolist() if self._runs_agree(a[i], b[i], most[i])]]).astype(np.int64)
            while len(own):
                n = max(1, int(np.searchsorted(np.arange(1, len(own) + 1) * (2 * most[own] + 3), _CELLS, "right")))
                out[own[:n]] = self._reached(a[own[:n]], b[own[:n]], most[own[:n]])
                own = own[n:]
        return out

    def _runs(self, row: int) -> np.ndarray:
        at = self.first[row] + np.arange(max(0, self.sizes[row] - _RUN + 1))
        return V.mix((self.sums[at + _RUN] - self.sums[at]) * self.powers[len(self.chars) - at])

    def _runs_agree(self, a: int, b: int, most: int) -> bool:
        """Whether two texts share as many runs of ``_RUN`` characters as texts within ``most`` edits do; an edit breaks ``_RUN`` of them."""
        x, y = self._runs(a), self._runs(b)
        room = 1 << int(len(x) + len(y)).bit_length()
        counts = np.bincount((x & np.uint64(room - 1)).astype(np.int64), minlength=room) - np.bincount((y & np.uint64(room - 1)).astype(np.int64), minlength=room)
        return int(np.abs(counts).sum()) <= 2 * _RUN * most

    def _reached(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), dtype=bool)
        left, widest = np.arange(len(a)), int(most.max())
        far = np.full((len(a), 2 * widest + 3), -2, dtype=np.int64)
        mid = widest + 1
        for d in range(widest + 1):
            diagonal = np.arange(-d, d + 1)
            if d:
                old = far[:, mid - d - 1 : mid + d + 2]
                reach = np.maximum(np.maximum(old[:, 1:-1] + 1, old[:, 2:] + 1), old[:, :-2])
            else:
                reach = np.zeros((len(left), 1), dtype=np.int64)
            m, n = self.sizes[a[left]][:, None], self.sizes[b[left]][:, None]
            reach = np.minimum(reach, np.minimum(m, n - diagonal))
            # A diagonal counts only if the edits that are left lead from it to the end.
            fine = (reach >= 0) & (reach + diagonal >= 0) & (np.abs(diagonal - (n - m)) <= most[left][:, None] - d)
            row, column = np.nonzero(fine)
            i = reach[row, column]
            j = i + diagonal[column]
            x, y = a[left[row]], b[left[row]]
            run = self.common(self.first[x] + i, self.first[y] + j, np.minimum(self.sizes[x] - i, self.sizes[y] - j))
            reach[~fine] = -2
            reach[row, column] = i + run
            far[:, mid - d : mid + d + 1] = reach
            end = (n - m)[:, 0]
            done = (np.abs(end) <= d) & (far[np.arange(len(left)), mid + np.clip(end, -d, d)] >= m[:, 0])
            out[left[done]] = True
            stay = ~done & (most[left] > d)
            left, far = left[stay], far[stay]
            if not len(left):
                break
        return out


def line_groups(forms: pa.Array, sketches: Sketches, similarity: float) -> Iterator[tuple[int, int]]:
    """Edges that join all forms connected by alike candidates: forms that are reached are compared with all that are not.

    While those that are reached reach few others, more of them are compared at once.
    """
    texts = Texts(forms)
    left, odd = np.arange(len(forms)), texts.odd
    while len(left) > 1:
        frontier, left, odd, n = [int(left[0])], left[1:], odd[1:], 1
        while frontier and len(left):
            some, frontier = frontier[-n:], frontier[:-n]
            able = [np.flatnonzero(texts.able(at, left, odd, similarity)) for at in some]
            a, b = np.repeat(some, [len(x) for x in able]), np.concatenate(able)
            met = sketches.candidates(a, left[b])
            met[met] = texts.alike(a[met], left[b[met]], similarity)
            hit, first = np.unique(b[met], return_index=True)
            yield from zip(a[met][first].tolist(), left[hit].tolist(), strict=True)
            frontier.extend(left[hit].tolist())
            n = 1 if len(hit) > len(left) // 8 else min(2 * n, _FRONTIER)
            if len(hit):
                left, odd = np.delete(left, hit), np.delete(odd, hit, axis=0)


def _pairs(similarity: float):
    """The pairs of forms that are alike, some MB of text at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.cumsum(pc.binary_length(batch.column("x")).to_numpy().astype(np.int64) + pc.binary_length(batch.column("y")).to_numpy())
            low = 0
            while low < len(size):
                high = max(low + 1, int(np.searchsorted(size, (size[low - 1] if low else 0) + V.SLICE_BYTES, "right")))
                own = batch.slice(low, high - low)
                n, low = own.num_rows, high
                _, first, row = np.unique(np.concatenate([own.column("a").to_numpy(), own.column("b").to_numpy()]), return_index=True, return_inverse=True)
                texts = Texts(pa.concat_arrays([own.column("x"), own.column("y")]).take(pa.array(first)))
                hit = pa.array(np.flatnonzero(texts.alike(row[:n], row[n:], similarity)))
                yield pa.RecordBatch.from_arrays([own.column("a").take(hit), own.column("b").take(hit)], ["a", "b"])

    return run


def _families(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, "group"):
            group, h, forms = table.column("group").to_numpy(), table.column("h").to_numpy(), table.column("form").combine_chunks()
            sig = np.stack([table.column(s).to_numpy() for s in _SIGS[:-1]], axis=1).view(np.uint64)
            last, sizes = table.column("d").to_numpy().view(np.uint32), table.column("size").to_numpy()
            begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            for low, high in zip(begin, np.append(begin[1:], len(group)), strict=True):
                sketches = Sketches(sig[low:high], last[low:high], sizes[low:high], similarity)
                edges = np.array(list(line_groups(forms.slice(low, high - low), sketches, similarity)), dtype=np.int64).reshape(-1, 2) + low
                yield pa.RecordBatch.from_arrays([pa.array(h[edges[:, 0]]), pa.array(h[edges[:, 1]])], ["a", "b"])

    return run


def _compressed(text: bytes) -> bytes:
    return _ZSTD.compress(text, asbytes=True)


def places(ids: np.ndarray) -> np.ndarray:
    """Where ids stand in a bitmap of ``MARKS`` bits."""
    return (V.mix(ids.view(np.uint64)) % np.uint64(MARKS)).astype(np.int64)


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(places(batch.column(0).to_numpy())))], ["place"])


def marked(ids: DataFrame) -> np.ndarray:
    """A bitmap of the ids' places, of ``MARKS`` bits however many ids there are."""
    bucket, bit = F.shiftright("place", 15), F.col("place").bitwiseAND(32767)
    rows = ids.mapInArrow(_marks, "place long").groupBy(bucket.alias("n")).agg(F.bitmap_construct_agg(bit).alias("bits"))
    out = np.zeros(MARKS // 8, dtype=np.uint8)
    for r in rows.collect():
        out[4096 * r["n"] : 4096 * (r["n"] + 1)] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out


def _packed(marks):
    """Texts of marked documents, compressed for the shuffle; marks may let others through, which find no partner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = marks.value
        for batch in batches:
            at = places(batch.column("doc_id").to_numpy())
            own = batch.filter(pa.array((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1))
            raw = [t.encode() for t in own.column("text").cast(pa.large_string()).fill_null("").to_pylist()]
            blobs = [_compressed(t) for t in raw]
            yield pa.RecordBatch.from_arrays([own.column("doc_id"), pa.array([len(t) for t in raw], pa.int64()), pa.array(blobs, pa.binary())], ["doc_id", "size", "blob"])

    return run


_ZSTD = pa.Codec("zstd", compression_level=1)


def _wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The normal forms of the wanted lines of each document; rows that share an id may differ, so hashes are compared."""
    for batch in batches:
        blobs = zip(batch.column("blob").to_pylist(), batch.column("size").to_pylist(), strict=True)
        texts = V.strings(pa.array([_ZSTD.decompress(b, n, asbytes=True).decode() for b, n in blobs], pa.string())).to_pylist()
        h, form = [], []
        for text, wanted in zip(texts, batch.column("wanted").to_pylist(), strict=True):
            lines = text.split("\n")
            for x in wanted:
                if x["line"] < len(lines):
                    h.append(x["h"])
                    form.append(normal(lines[x["line"]]))
        forms, wanted = pa.array(form, pa.string()), np.array(h, dtype=np.int64)
        for low, raw, offsets in V.slices(forms.cast(pa.large_string())):
            hashes = V.signed(line_hashes(V.words(raw, offsets)))
            same = pa.array(low + np.flatnonzero(hashes == wanted[low : low + len(hashes)]))
            yield pa.RecordBatch.from_arrays([pa.array(wanted).take(same), forms.take(same)], ["h", "form"])


def _sources(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")


def forms_of(own: DataFrame, lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """(h, form) of the wanted hashes: each form is taken from the first line that has it."""
    first = durable(lines.select("h", "doc_id", "line").join(wanted, "h", "left_semi").groupBy("h").agg(F.min(F.struct("doc_id", "line")).alias("at")))
    marks = own.sparkSession.sparkContext.broadcast(marked(first.select("at.doc_id")))
    by_doc = first.groupBy(F.col("at.doc_id").alias("_d")).agg(F.collect_list(F.struct("h", F.col("at.line").alias("line"))).alias("wanted"))
    packed = own.where("text is not null").mapInArrow(_packed(marks), "doc_id long, size long, blob binary")
    texts = durable(packed.join(by_doc, packed["doc_id"] == by_doc["_d"]).select("size", "blob", "wanted").mapInArrow(_wanted, "h long, form string").dropDuplicates(["h"]))
    del packed, by_doc, first
    release(own.sparkSession)
    return texts


def family_edges(member: DataFrame, forms: DataFrame, texts: DataFrame, similarity: float, chunk: int = CHUNK) -> DataFrame:
    """Alike candidates that join the forms of families, given as (node, root), with too many near pairs to be listed.

    A family is dealt into chunks of about ``chunk`` forms by hash, and each two chunks meet in one group, so
    that no task holds more than two chunks at a time however large the family is.
    """
    sizes = member.groupBy("root").agg(F.ceil(F.count("*") / chunk).cast("long").alias("chunks"))
    own = F.pmod(F.xxhash64("node"), F.col("chunks"))
    dealt = member.join(sizes, "root").select("root", F.col("node").alias("h"), own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("other"))
    group = F.xxhash64("root", F.least("own", "other"), F.greatest("own", "other"))
    parts = int(member.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sketched = texts.join(forms.join(member.select(F.col("node").alias("h")), "h", "left_semi"), "h")
    met = dealt.select(group.alias("group"), "h").join(sketched, "h").repartition(parts, "group").sortWithinPartitions("group")
    return met.mapInArrow(_families(similarity), "a long, b long")


def alike_forms(own: DataFrame, lines: DataFrame, similarity: float, family: int = FAMILY, chunk: int = CHUNK) -> DataFrame:
    """(a, b) of pairs of alike forms, of which every connected group is connected."""
    spark = own.sparkSession
    long = lines.where(F.col("size") >= fewest_letters(similarity))
    entries = long.agg(F.approx_count_distinct("h")).first()[0] * BLOCKS * 1.25
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(entries * 24 / _BUCKET_BYTES))
    forms = long.groupBy("h").agg(F.min("size").alias("size"), *(F.min(s).alias(s) for s in _SIGS))
    blocked = forms.mapInArrow(_blocked(similarity, parts), "part int, blob binary")
    found = durable(blocked.repartitionById(parts, "part").mapInArrow(_candidates(family), "a long, b long, family boolean"))
    del blocked
    release(spark)
    texts = forms_of(own, lines, found.select(F.explode(F.array("a", "b")).alias("h")).distinct())
    pairs = found.where(~F.col("family")).select("a", "b").distinct()
    x, y = texts.select(F.col("h").alias("a"), F.col("form").alias("x")), texts.select(F.col("h").alias("b"), F.col("form").alias("y"))
    families, member = found.where("family").select("a", "b"), None
    if not families.isEmpty():
        # Pairs within a family are compared there.
        member = components(families)
        roots = [member.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")) for c in "ab"]
        pairs = pairs.join(roots[0], "a", "left").join(roots[1], "b", "left").where(~F.col("root_a").eqNullSafe(F.col("root_b")) | F.col("root_a").isNull())
    edges = pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_pairs(similarity), "a long, b long")
    return edges if member is None else edges.union(family_edges(member, forms, texts, similarity, chunk))


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, family: int = FAMILY, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, line, kept_doc_id, kept_line) of every line that is to go, and the one that stays for it.

    Lines end at '\\n' and are numbered from 0. Lines without a word (empty, blanks, punctuation) are
    in no group. Of a connected group the line of the least (doc_id, line) stays. Null texts have no
    lines; rows with a null id are left out. Rows that share an id are ordered as one document, and
    equal (doc_id, line) stay or go together. Columns other than the two named are not read. An
    empty table gives an empty result. Texts and lines are used whole, however long.

    Every pair that is joined reaches ``similarity``. Of pairs at that limit about nine in ten are
    found directly, more of those that are more alike, fewer (0.8) of lines of 20 characters; README has
    figures. A line without a word that varies from place to place (one letter repeated) has a SimHash
    that says little, and is found only by chance or as a copy.
    """
    own = _sources(docs, id_col, text_col)
    lines = durable(own.mapInArrow(_lines(similarity), f"h long, doc_id long, line int, size int, {_SIG_TYPE}"))
    groups = components(alike_forms(own, lines, similarity, family, chunk))
    rooted = lines.select("h", "doc_id", "line").join(groups, lines["h"] == groups["node"], "left").select(F.coalesce("root", "h").alias("g"), "doc_id", "line")
    kept = rooted.groupBy("g").agg(F.min(F.struct("doc_id", "line")).alias("kept"), F.count("*").alias("n")).where("n > 1").select(F.col("g").alias("_g"), "kept")
    found = rooted.join(kept, F.col("g") == F.col("_g")).where(F.struct("doc_id", "line") != F.col("kept"))
    return found.select("doc_id", "line", F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.line").alias("kept_line"))


_WORDED = "(?i)" + V.word_pattern()


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` without the lines that ``repeated_lines`` gives, with all their columns.

    ``length_col``, where ``docs`` has it, becomes the length of what is left. Documents that lose
    all their lines with a word go; those that never had one stay as they are. Null texts and rows with
    a null id stay as they are, rows that share an id lose the same line numbers, an empty table stays empty,
    and other columns pass through whatever their names.
    """
    gone = repeated_lines(docs, id_col, text_col, similarity).groupBy("doc_id").agg(F.collect_set("line").alias("lines"))
    key, drop = fresh(docs, "key"), fresh(docs, "drop")
    gone = gone.select(F.col("doc_id").alias(key), F.col("lines").alias(drop))
    joined = docs.join(gone, docs[id_col].cast("long") == gone[key], "left")
    split = F.split(docs[text_col].cast("string"), "\n", -1)
    left = F.filter(split, lambda x, i: ~F.array_contains(F.col(drop), i))
    text = F.when(F.col(drop).isNull(), docs[text_col].cast("string")).otherwise(F.array_join(left, "\n"))
    worded = F.col(drop).isNull() | F.exists(left, lambda x: x.rlike(_WORDED))
    made = {text_col: text}
    if length_col and length_col in docs.columns:
        made[length_col] = F.coalesce(F.length(text).cast(docs.schema[length_col].dataType), docs[length_col])
    return joined.where(worded).select(*(made[c].alias(c) if c in made else docs[c] for c in docs.columns))
