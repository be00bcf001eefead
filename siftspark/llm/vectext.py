"""Vectorised word and shingle hashing over the bytes of Arrow string batches.

A word is a maximal run of ASCII letters, digits and other letters of the lower-cased text, or a single
character of a script that is written without spaces (``SINGLE``); non-ASCII punctuation and spaces
(``APART``) separate words. All functions look at whole texts; a null text is an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True

#: Ranges of characters that are words by themselves: Thai and Lao, Burmese, Khmer, kana, Han, and their wide and rare forms.
SINGLE = ((0xE00, 0xEFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x20000, 0x3FFFF))
#: Ranges of non-ASCII characters that belong to no word.
APART = ((0x80, 0xA9), (0xAB, 0xB4), (0xB6, 0xB9), (0xBB, 0xBF), (0x2000, 0x206F), (0x2190, 0x2BFF), (0x3000, 0x303F), (0xFE30, 0xFE4F), (0xFF00, 0xFF0F), (0xFF1A, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF65))


def _joined() -> list[tuple[int, int]]:
    """The ranges of non-ASCII characters that make up words together."""
    out, low = [], 0x80
    for a, b in [*sorted(SINGLE + APART), (0x110000, 0x110000)]:
        if low < a:
            out.append((low, a - 1))
        low = b + 1
    return out


def word_pattern(escape: str = "\\x{{{:x}}}") -> str:
    """A regular expression of the words of lower-cased text; by default in the spelling of RE2 and Java."""
    spans = lambda ranges: "".join(f"{escape.format(a)}-{escape.format(b)}" for a, b in ranges)
    return f"[{spans(SINGLE)}]|[0-9a-z{spans(_joined())}]+"


_EDGES, _KINDS = np.array([e for a, b in sorted(SINGLE + APART) for e in (a, b + 1)]), np.array([0, *(k for r in sorted(SINGLE + APART) for k in (1 if r in SINGLE else 2, 0))])
#: Lead bytes of characters that may be in those ranges.
_RARE = np.zeros(256, dtype=bool)
_RARE[[0xC2, *range(0xE0, 0xF5)]] = True

_powers: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2**64, at least ``n`` of each."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, SLICE_BYTES + 1)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            np.multiply.accumulate(table, out=table)
            _powers[name] = table
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def mix_int(x: int) -> int:
    return int(mix(np.array([x & _MASK], dtype=np.uint64))[0])


def strings(column: pa.Array | pa.ChunkedArray, lower: bool = True) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    return pc.utf8_lower(column) if lower else column


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets) for runs of rows of about ``limit`` bytes; rows stay whole."""
    n = len(column)
    if not n:
        return
    if column.offset:
        column = pa.concat_arrays([column])
        if column.offset:
            column = column.take(pa.array(np.arange(n)))
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[: n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    low = 0
    while low < n:
        high = max(low + 1, int(np.searchsorted(at, at[low] + limit, "right")) - 1)
        high = min(high, n)
        yield low, raw[at[low] : at[high]], at[low : high + 1] - at[low]
        low = high


@dataclass
class Words:
    """Words of a run of rows: hashes, byte spans, and for each row where its words begin."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    inside: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.first) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A position-independent 64-bit polynomial hash of each byte span."""
    up, down = _power_table(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def _scripts(raw: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Takes the characters of ``APART`` out of ``inside``; the positions at which a word of ``SINGLE`` begins or ends."""
    at = np.flatnonzero(_RARE[raw])
    if not len(at):
        return at
    lead, last = raw[at], len(raw) - 1
    tail = [raw[np.minimum(at + k, last)].astype(np.int64) & 0x3F for k in (1, 2, 3)]
    size = np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4))
    two, three = tail[0] | ((lead & 0x1F).astype(np.int64) << 6), tail[1] | (tail[0] << 6) | ((lead & 0x0F).astype(np.int64) << 12)
    four = tail[2] | (tail[1] << 6) | (tail[0] << 12) | ((lead & 0x07).astype(np.int64) << 18)
    kind = _KINDS[np.searchsorted(_EDGES, np.select([size == 2, size == 3], [two, three], four), "right")]
    for k in range(4):
        inside[at[(kind == 2) & (size > k)] + k] = False
    own = kind == 1
    return np.concatenate([at[own], at[own] + size[own]])


def words(raw: np.ndarray, offsets: np.ndarray) -> Words:
    inside = _IS_WORD[raw]
    cuts = _scripts(raw, inside)
    before = np.zeros(len(raw) + 1, dtype=bool)
    before[1:] = inside
    before[offsets[:-1]] = False
    before[cuts] = False
    after = np.zeros(len(raw) + 1, dtype=bool)
    after[:-1] = inside
    after[offsets[1:]] = False
    after[cuts] = False
    starts = np.flatnonzero(inside & ~before[: len(raw)])
    ends = np.flatnonzero(inside & ~after[1 : len(raw) + 1]) + 1
    return Words(span_hashes(raw, starts, ends), starts, ends, np.searchsorted(starts, offsets), inside)


_PLACES_ARRAY = np.array([pow(0xD6E8FEB86659FD93, i + 1, 1 << 64) for i in range(512)], dtype=np.uint64)
_PLACES = list(_PLACES_ARRAY)


def shingles(found: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words of each row, and where each row's begin.

    A row of fewer than ``k`` words but at least one has a single shingle of all its words.
    """
    counts = found.counts
    per_row = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    first = np.concatenate([[0], np.cumsum(per_row)]).astype(np.int64)
    padded = np.concatenate([found.hashes, np.zeros(k, dtype=np.uint64)])
    n = len(found.hashes)
    full = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        full += padded[i : i + n] * _PLACES[i]
    row_of = np.repeat(np.arange(found.rows), per_row)
    at = np.arange(first[-1]) - first[row_of] + found.first[row_of]
    out = full[at] if n else np.zeros(0, dtype=np.uint64)
    for row in np.flatnonzero((counts < k) & (counts > 0)):
        own = found.hashes[found.first[row] : found.first[row + 1]]
        out[first[row]] = (own * _PLACES_ARRAY[: len(own)]).sum(dtype=np.uint64)
    return mix(out), first


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64)


def lists(values: np.ndarray, first: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32), pa.int32()), pa.array(values))
