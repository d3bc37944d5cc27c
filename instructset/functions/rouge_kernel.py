"""ROUGE hits of all pairs of texts of an Arrow batch together.

Tokens become codes of one dictionary for the batch. N-grams are counted by one sort of (pair, gram) keys of each
side. Longest common subsequences run on bit vectors that hold 64 table columns in a word (Hyyro, 2004), one
step for all pairs at once; pairs of long token rows go one by one, on integers of any length, whose
operations are as wide as the row.

For the union of subsequences the path goes back through the table from its ends and, between two equally good
steps, drops the last token of the reference; tokens that the other side lacks are never on it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text whose tokens are held at a time, and table words of the pairs that step together.
PASS_BYTES = 4 << 20
TABLE_WORDS = 1 << 22
#: Beyond this many words a row of the table, or with fewer pairs than this, pairs go one by one.
_WIDE = 16
_FEW = 4
_TOKEN = np.zeros(256, bool)
_TOKEN[[*range(ord("a"), ord("z") + 1), *range(ord("0"), ord("9") + 1)]] = True
_ONE = np.uint64(1)

Stems = Callable[[pa.Array], pa.Array]


@dataclass
class Side:
    """The tokens of one side of all pairs: code, pair and line of each, lines counted over all pairs."""

    codes: np.ndarray
    rows: np.ndarray
    lines: np.ndarray
    n: int

    def sizes(self) -> np.ndarray:
        return np.bincount(self.rows, minlength=self.n)


def _spans(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All tokens in a row, and the pair and the line of each."""
    texts = texts.cast(pa.large_string()).fill_null("")
    edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8)[edges[0] : edges[-1]] if body else np.zeros(0, np.uint8)
    edges = edges - edges[0]
    inside = _TOKEN[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    # Texts stand without a gap; a token ends with its text.
    cuts = edges[(edges > 0) & (edges < len(data))]
    begins[cuts] = inside[cuts]
    ends[cuts - 1] = inside[cuts - 1]
    starts = np.flatnonzero(begins)
    sizes = np.flatnonzero(ends) + 1 - starts
    rows = np.searchsorted(edges, starts, side="right") - 1
    lines = np.cumsum(data == 10)[starts] + rows if len(starts) else starts
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    tokens = pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(data[inside].tobytes()))
    return tokens, rows, lines


def sides(left: pa.Array, right: pa.Array, stems: Stems | None) -> tuple[Side, Side, int]:
    """Both sides and the number of codes; ``stems`` turns distinct tokens into their stems."""
    found = [_spans(texts) for texts in (left, right)]
    coded = pa.concat_arrays([tokens for tokens, _, _ in found]).dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    count = len(coded.dictionary)
    if stems is not None and count:
        again = stems(coded.dictionary).dictionary_encode()
        codes, count = again.indices.to_numpy(zero_copy_only=False).astype(np.int64)[codes], len(again.dictionary)
    middle = len(found[0][0])
    parts = codes[:middle], codes[middle:]
    made = [Side(c, rows, lines, len(left)) for c, (_, rows, lines) in zip(parts, found, strict=True)]
    return made[0], made[1], count


def gram_hits(left: Side, right: Side, n: int, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Common n-grams of each pair, each as often as on both sides, and the n-grams of each side."""
    keys = []
    for side in (left, right):
        at = np.arange(max(len(side.codes) - n + 1, 0))
        at = at[side.rows[at] == side.rows[at + n - 1]] if len(at) else at
        keys.append((side.rows[at], [side.codes[at + k] for k in range(n)]))
    split = len(keys[0][0])
    rows = np.concatenate([r for r, _ in keys])
    gram = rows
    for k in range(n):
        # One more code; numbered anew, so that the keys never outgrow 64 bits.
        gram = gram * count + np.concatenate([c[k] for _, c in keys])
        gram = np.unique(gram, return_inverse=True)[1] if k < n - 1 or n > 1 else gram
    distinct, first, place = np.unique(gram, return_index=True, return_inverse=True)
    own = [np.bincount(place[:split], minlength=len(distinct)), np.bincount(place[split:], minlength=len(distinct))]
    hits = np.bincount(rows[first], np.minimum(*own), minlength=left.n).astype(np.int64)
    return hits, np.bincount(rows[:split], minlength=left.n), np.bincount(rows[split:], minlength=left.n)


@dataclass
class Pairs:
    """Stretches of tokens to compare: from and to on the left, from and to on the right."""

    la: np.ndarray
    lb: np.ndarray
    ra: np.ndarray
    rb: np.ndarray

    def take(self, which: np.ndarray) -> Pairs:
        return Pairs(self.la[which], self.lb[which], self.ra[which], self.rb[which])

    def __len__(self) -> int:
        return len(self.la)


def _spread(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of some stretches, and the stretch of each."""
    sizes = ends - starts
    total = int(sizes.sum())
    owner = np.repeat(np.arange(len(starts)), sizes)
    before = np.cumsum(sizes) - sizes
    return np.arange(total) - before[owner] + starts[owner], owner


def _groups(pairs: Pairs) -> Iterator[np.ndarray]:
    """Pairs that may step together: rows of about the same width and number, in a bounded table."""
    words = (pairs.rb - pairs.ra + 63) // 64
    steps = pairs.lb - pairs.la
    class_of = np.ceil(np.log2(np.maximum(words, 1))).astype(np.int64) * 64 + np.log2(np.maximum(steps, 1)).astype(np.int64)
    order = np.argsort(class_of, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(class_of[order])) + 1):
        if not len(part):
            continue
        most = max(1, TABLE_WORDS // (int(words[part].max(initial=1)) * int(steps[part].max(initial=1) + 1)))
        for a in range(0, len(part), most):
            yield part[a : a + most]


def _masks(words: Sequence[int]) -> dict[int, int]:
    masks: dict[int, int] = {}
    for i, word in enumerate(words):
        masks[word] = masks.get(word, 0) | 1 << i
    return masks


def _advance(row: int, mask: int, full: int) -> int:
    """One table row further: bit j is 0 where the common length grows at column j."""
    common = row & mask
    return ((row + common) | (row - common)) & full


def lcs_length(left: Sequence, right: Sequence) -> int:
    full = (1 << len(right)) - 1
    masks, row = _masks(right), full
    for word in left:
        row = _advance(row, masks.get(word, 0), full)
    return len(right) - row.bit_count()


def lcs_positions(left: Sequence, right: Sequence) -> list[int]:
    """Places in ``left`` of one longest common subsequence. Only every ``block``-th row is
    kept; the rows between are computed again when the path comes to them."""
    masks = _masks(right)
    common = [at for at, word in enumerate(left) if word in masks]
    steps = [masks[left[at]] for at in common]
    full = (1 << len(right)) - 1
    block = isqrt(len(steps)) + 1
    kept, row = [full], full
    for i, mask in enumerate(steps, 1):
        row = _advance(row, mask, full)
        if i % block == 0:
            kept.append(row)
    i, j, length = len(steps), len(right), len(right) - row.bit_count()
    found: list[int] = []
    base, rows = len(steps) + 1, []
    while length:
        if steps[i - 1] >> (j - 1) & 1:
            found.append(common[i - 1])
            i, j, length = i - 1, j - 1, length - 1
            continue
        if i - 1 < base:
            base = (i - 1) // block * block
            rows = [kept[base // block]]
            for mask in steps[base : i - 1]:
                rows.append(_advance(rows[-1], mask, full))
        above = j - (rows[i - 1 - base] & ((1 << j) - 1)).bit_count()
        if length > above:
            j -= 1
        else:
            i -= 1
    return found[::-1]


class Table:
    """The bit vectors of some pairs, stepped together; ``rows`` are kept where the path is wanted."""

    def __init__(self, left: np.ndarray, right: np.ndarray, pairs: Pairs, count: int, keep: bool):
        self.pairs, n = pairs, len(pairs)
        width = pairs.rb - pairs.ra
        words = max(1, int((width.max(initial=0) + 63) // 64))
        at, owner = _spread(pairs.ra, pairs.rb)
        keys, inverse = np.unique(owner * count + right[at], return_inverse=True)
        place = at - pairs.ra[owner]
        # A last mask of zeros is for pairs that have no more steps.
        self.masks = np.zeros((len(keys) + 1, words), np.uint64)
        np.bitwise_or.at(self.masks, (inverse, place >> 6), _ONE << (place & 63).astype(np.uint64))
        at, owner = _spread(pairs.la, pairs.lb)
        wanted = owner * count + left[at]
        found = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
        common = keys[found] == wanted if len(keys) else np.zeros(len(wanted), bool)
        owner, found, self.places = owner[common], found[common], at[common]
        self.steps = np.bincount(owner, minlength=n)
        self.first = np.cumsum(self.steps) - self.steps
        most = int(self.steps.max(initial=0))
        self.masks_of = np.full((most, n), len(keys))
        self.masks_of[np.arange(len(owner)) - self.first[owner], owner] = found
        row = np.zeros((words, n), np.uint64)
        for w in range(words):
            bits = np.clip(width - 64 * w, 0, 64)
            row[w] = np.where(bits == 64, ~np.uint64(0), (_ONE << np.minimum(bits, 63).astype(np.uint64)) - _ONE)
        self.full = row.copy()
        self.rows = np.zeros((most + 1, words, n), np.uint64) if keep else None
        if keep:
            self.rows[0] = row
        for step in range(most):
            masks = self.masks[self.masks_of[step]]
            carry: np.ndarray | int = 0
            for w in range(words):
                common_bits = row[w] & masks[:, w]
                total = row[w] + common_bits
                lost = total < common_bits
                if words > 1:
                    total = total + carry
                    lost = lost | (total < carry)
                    carry = lost.astype(np.uint64)
                row[w] = (total | (row[w] ^ common_bits)) & self.full[w]
            if keep:
                self.rows[step + 1] = row
        self.lengths = width - np.bitwise_count(row).sum(0).astype(np.int64)

    def _upto(self, i: np.ndarray, j: np.ndarray, which: np.ndarray) -> np.ndarray:
        """The common length of the first i steps and the first j tokens."""
        zeros = np.zeros(len(which), np.int64)
        for w in range(self.full.shape[0]):
            bits = np.clip(j - 64 * w, 0, 64)
            low = np.where(bits == 64, ~np.uint64(0), (_ONE << np.minimum(bits, 63).astype(np.uint64)) - _ONE)
            zeros += bits - np.bitwise_count(self.rows[i, w, which] & low).astype(np.int64)
        # Columns beyond a pair's width have no bits at all.
        return zeros - np.maximum(j - (self.pairs.rb - self.pairs.ra)[which], 0)

    def path(self) -> np.ndarray:
        """Places on the left that are on a longest common subsequence."""
        which = np.flatnonzero(self.lengths)
        i, j, length = self.steps[which], (self.pairs.rb - self.pairs.ra)[which], self.lengths[which]
        found = []
        while len(which):
            mask = self.masks[self.masks_of[i - 1, which], (j - 1) >> 6]
            hit = (mask >> ((j - 1) & 63).astype(np.uint64) & _ONE).astype(bool)
            found.append(self.places[(self.first[which] + i - 1)[hit]])
            above = self._upto(i - 1, j, which)
            back = ~hit & (length > above)
            i = i - (hit | ~back)
            j = j - (hit | back)
            length = length - hit
            going = length > 0
            which, i, j, length = which[going], i[going], j[going], length[going]
        return np.concatenate(found) if found else np.zeros(0, np.int64)


def _one_by_one(pairs: Pairs, group: np.ndarray) -> bool:
    return len(group) < _FEW or int((pairs.rb - pairs.ra)[group].max()) > 64 * _WIDE


def common_lengths(left: np.ndarray, right: np.ndarray, pairs: Pairs, count: int) -> np.ndarray:
    """Length of the longest common subsequence of each pair."""
    out = np.zeros(len(pairs), np.int64)
    for group in _groups(pairs):
        own = pairs.take(group)
        if _one_by_one(pairs, group):
            for k, p in enumerate(group.tolist()):
                out[p] = lcs_length(left[own.la[k] : own.lb[k]].tolist(), right[own.ra[k] : own.rb[k]].tolist())
        else:
            out[group] = Table(left, right, own, count, False).lengths
    return out


def common_places(left: np.ndarray, right: np.ndarray, pairs: Pairs, count: int) -> np.ndarray:
    """All places on the left that are on a pair's longest common subsequence, pair after pair."""
    found = [np.zeros(0, np.int64)]
    for group in _groups(pairs):
        own = pairs.take(group)
        if _one_by_one(pairs, group):
            for k in range(len(group)):
                a = int(own.la[k])
                steps = lcs_positions(left[a : own.lb[k]].tolist(), right[own.ra[k] : own.rb[k]].tolist())
                found.append(np.array(steps, np.int64) + a)
        else:
            found.append(Table(left, right, own, count, True).path())
    return np.concatenate(found)


def _stretches(of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal numbers."""
    cuts = np.flatnonzero(np.diff(of)) + 1
    return np.concatenate(([0], cuts))[: len(cuts) + bool(len(of))], np.append(cuts, len(of))[: len(cuts) + bool(len(of))]


def subsequence_hits(left: Side, right: Side, count: int) -> np.ndarray:
    """Length of the longest common subsequence of each pair of whole texts."""
    edges = np.arange(left.n + 1)
    la, ra = np.searchsorted(left.rows, edges), np.searchsorted(right.rows, edges)
    return common_lengths(left.codes, right.codes, Pairs(la[:-1], la[1:], ra[:-1], ra[1:]), count)


def union_hits(left: Side, right: Side, count: int) -> np.ndarray:
    """Per reference line the union of its common subsequences with all predicted lines; a token counts no
    more often than it occurs on either side."""
    on_path = np.zeros(len(left.codes), bool)
    (la, lb), (ra, rb) = _stretches(left.lines), _stretches(right.lines)
    if len(la) and len(ra):
        # Every line of a reference against every line of its prediction, in blocks of bounded work.
        rows = left.rows[la]
        firsts, ends = np.searchsorted(right.rows[ra], rows), np.searchsorted(right.rows[ra], rows, side="right")
        tokens = np.concatenate(([0], np.cumsum(rb - ra)))
        work = (ends - firsts) * (lb - la) + tokens[ends] - tokens[firsts]
        block = np.cumsum(work) // TABLE_WORDS
        for part in np.split(np.arange(len(la)), np.flatnonzero(np.diff(block)) + 1):
            other, line = _spread(firsts[part], ends[part])
            line = part[line]
            on_path[common_places(left.codes, right.codes, Pairs(la[line], lb[line], ra[other], rb[other]), count)] = True
    every = [(left.rows, left.codes), (right.rows, right.codes), (left.rows[on_path], left.codes[on_path])]
    keys = [rows * max(count, 1) + codes for rows, codes in every]
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    sizes = np.cumsum([0, *map(len, keys)])
    counts = [np.bincount(place[a:b], minlength=len(distinct)) for a, b in zip(sizes[:-1], sizes[1:], strict=True)]
    return np.bincount(distinct // max(count, 1), np.minimum.reduce(counts), minlength=left.n).astype(np.int64)


def hits(left: pa.Array, right: pa.Array, metrics: Sequence[str], stems: Stems | None = None) -> dict[str, np.ndarray]:
    """Per metric the hits, ``<metric>_left`` and ``<metric>_right`` the sizes, of all pairs of texts (lower case)."""
    out: dict[str, list[np.ndarray]] = {f"{m}{part}": [] for m in metrics for part in ("", "_left", "_right")}
    weight = [pc.fill_null(pc.binary_length(x), 0).to_numpy(zero_copy_only=False) for x in (left, right)]
    passes = np.cumsum(weight[0] + weight[1], dtype=np.int64) // PASS_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(passes)) + 1).tolist(), len(left)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if a == b:
            continue
        ref, pred, count = sides(left.slice(a, b - a), right.slice(a, b - a), stems)
        for metric in metrics:
            if metric in ("rougeL", "rougeLsum"):
                found = (subsequence_hits if metric == "rougeL" else union_hits)(ref, pred, count), ref.sizes(), pred.sizes()
            else:
                found = gram_hits(ref, pred, int(metric[-1]), max(count, 1))
            for part, values in zip(("", "_left", "_right"), found, strict=True):
                out[metric + part].append(values)
    return {name: np.concatenate(parts) if parts else np.zeros(0, np.int64) for name, parts in out.items()}
