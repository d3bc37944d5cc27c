"""Word and word-run hashes of whole texts, computed in Arrow batches with numpy.

Words are runs of bytes outside ``\\x20`` and ``\\x09``-``\\x0D``. A word's hash is a polynomial
over its bytes modulo 2**64 (each byte first replaced by a random number), taken from one
running sum over the batch; a run's hash is a polynomial over its words' hashes. Nothing is
looped over words, and no text is cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one numpy pass takes at most; a longer text gets a pass of its own. Numpy holds many times
#: these bytes during a pass, and the tables of powers that are kept between passes eight times each.
PASS_BYTES = 1 << 18

_rng = np.random.Generator(np.random.PCG64(20240611))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_BASES = [int(x) | 1 for x in _rng.integers(1 << 40, 1 << 63, 3, dtype=np.uint64)]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit (the splitmix64 finish)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between passes."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, PASS_BYTES + 1)
        have = np.empty(size, np.uint64)
        have[0] = 1
        have[1:] = np.uint64(base)
        have = np.multiply.accumulate(have)
        if size <= 4 * PASS_BYTES:
            _powers[base] = have
    return have[:n]


def _inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each span of bytes, from one running sum; ``lower`` takes A-Z as a-z."""
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum((_LOWER if lower else _BYTE)[data] * _power(_BASES[0], len(data)), out=total[1:])
    back = _power(_inverse(_BASES[0]), len(data) + 1)
    return mix((total[ends] - total[starts]) * back[starts])


class HashIndex:
    """64-bit keys, none of them 0, to the order in which they were added: open addressing, in bulk."""

    def __init__(self, keys: np.ndarray = np.zeros(0, np.uint64)):
        self.n = 0
        self._room(len(keys))
        self.add(keys)

    def _room(self, n: int) -> None:
        self.bits = max(10, int(3 * n + 1).bit_length())
        self.keys, self.rows = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _put(self, keys: np.ndarray, rows: np.ndarray) -> None:
        at = self._slot(keys)
        while len(keys):
            free = self.keys[at] == 0
            _, first = np.unique(np.where(free, at, -1), return_index=True)
            first = first[free[first]]
            self.keys[at[first]], self.rows[at[first]] = keys[first], rows[first]
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, rows, at = keys[rest], rows[rest], (at[rest] + 1) & (len(self.keys) - 1)

    def add(self, keys: np.ndarray) -> None:
        """Distinct keys that aren't in the index."""
        if 2 * (self.n + len(keys)) > len(self.keys):
            held = np.flatnonzero(self.keys)
            old, rows = self.keys[held], self.rows[held]
            self._room(2 * (self.n + len(keys)))
            self._put(old, rows)
        self._put(keys, np.arange(self.n, self.n + len(keys), dtype=np.int32))
        self.n += len(keys)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Rows, -1 for unknown keys."""
        at = self._slot(keys)
        have = self.keys[at]
        out = np.where(have == keys, self.rows[at], -1)
        left = np.flatnonzero((have != keys) & (have != 0))
        while len(left):
            at[left] = (at[left] + 1) & (len(self.keys) - 1)
            have = self.keys[at[left]]
            hit = have == keys[left]
            out[left[hit]] = self.rows[at[left[hit]]]
            left = left[~hit & (have != 0)]
        return out


def word_spans(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in ``data``, and the index of each text's first word."""
    inside = ~_SPACE[data]
    before = np.zeros(len(inside), bool)
    before[1:] = inside[:-1]
    # A text's first byte starts a word even if the text before it ends in one.
    before[edges[:-1][edges[:-1] < edges[1:]]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(inside), bool)
    after[:-1] = inside[1:] & before[1:]
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, edges)


class Words:
    """The words of a run of texts: ``hashes`` in order, ``starts``/``ends`` in ``data``, and
    ``first``, the index of each text's first word (one more entry than texts)."""

    def __init__(self, data: np.ndarray, edges: np.ndarray, lower: bool):
        self.starts, self.ends, self.first = word_spans(data, edges)
        self.hashes = span_hashes(data, self.starts, self.ends, lower)

    def runs(self, k: int, which: int = 1) -> np.ndarray:
        """Hashes of all runs of ``k`` words by the index of their first word, runs over the end
        of a text included; ``which`` (1 or 2) chooses one of two independent hashes."""
        n = len(self.hashes) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        base = _BASES[which]
        total = np.empty(len(self.hashes) + 1, np.uint64)
        total[0] = 0
        np.cumsum(mix(self.hashes + np.uint64(which)) * _power(base, len(self.hashes)), out=total[1:])
        return mix((total[k:] - total[:-k]) * _power(_inverse(base), n))


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and text edges of a string column without a copy; null counts as empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    return data[edges[0] : edges[-1]], edges - edges[0]


def passes(batch: pa.RecordBatch, column: str = "text", most: int = PASS_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``most`` bytes of text each, or one longer row."""
    _, edges = text_buffer(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(edges, edges[at] + most, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def words_of(batch: pa.RecordBatch, column: str = "text", lower: bool = False) -> Words:
    return Words(*text_buffer(batch.column(column)), lower)
