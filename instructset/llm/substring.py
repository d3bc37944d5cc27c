"""Removal of passages that occur more than once: every word covered by a window of ``window`` words whose
word sequence also starts anywhere else goes, in all its places.

First pass, a count-min sketch. Of the runs of ``anchor`` words in a window, the one with the smallest hash,
leftmost on ties, is its anchor. Windows with the same words have their anchors at the same place
in them, so an anchor's count is never below the count of any of its windows, and there are some
ten times fewer anchors than windows. Each task counts its anchors in two rows of cells, counts
above two being two, and sends the cells that it has used; cells are merged by slice. The merged sketch
comes back as one bit per cell: two or more. Its width follows the size of the text up to a fixed
bound (``most_bits``); beyond it the sketch passes more windows than it needs to, never fewer.

Second pass: only windows whose anchor is estimated repeated go on. A task finds those it holds twice by
itself and sends every distinct window once, so that no window has more rows than there are
tasks' portions, however often it occurs. Windows are grouped by 96 bits of two independent hashes
of their words. What is repeated goes back to its document as spans, which are joined to the texts.

Null and empty texts have no words and stay empty; shorter texts than a window lose nothing. Rows that
repeat, id and text, count as separate places, so they lose all they share. Rows with a null id keep
their own spans. Kept words are joined by one space.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from instructset.llm.bpe import bytes_of
from instructset.llm.common import prepare
from instructset.llm.hashing import mix, passes, words_of

ROWS = 2
#: Anchors or windows that a task holds before it sends them.
HELD = 1 << 20
_SLICE = 16
_SEEDS = [np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)]


def leftmost_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest of each ``width`` values in a row, by the place of the first of them."""
    n = len(values) - width + 1
    low, at, have = values, np.arange(len(values)), 1
    while have < width:
        step = min(have, width - have)
        left, right = low[: len(low) - step], low[step:]
        first = left <= right
        low, at, have = np.where(first, left, right), np.where(first, at[: len(at) - step], at[step:]), have + step
    return at[:n]


def cells(anchors: np.ndarray, row: int, bits: int) -> np.ndarray:
    return mix(anchors ^ _SEEDS[row]) >> np.uint64(64 - bits)


class Windows:
    """The whole windows in a pass of texts: ``text`` and ``start`` (word in it), and the anchor's hash."""

    def __init__(self, part: pa.RecordBatch, window: int, anchor: int):
        self.words = words_of(part)
        first, n = self.words.first, len(self.words.hashes)
        place = np.arange(max(0, n - window + 1))
        text = np.repeat(np.arange(part.num_rows), np.diff(first))[: len(place)]
        whole = place + window <= first[text + 1]
        self.place, self.text = place[whole], text[whole]
        self.start = self.place - first[self.text]
        if len(self.place):
            runs = self.words.runs(anchor)
            self.at = leftmost_minimum(runs, window - anchor + 1)[self.place]
            self.anchor = runs[self.at]
        else:
            self.at, self.anchor = place[:0], np.zeros(0, np.uint64)

    def anchors(self) -> np.ndarray:
        """The hash of every place that is some window's anchor, once a place."""
        new = np.ones(len(self.at), bool)
        new[1:] = self.at[1:] != self.at[:-1]
        return self.anchor[new]


def _sketch(anchors: np.ndarray, bits: int) -> pa.RecordBatch:
    """The used cells of a sketch of these anchors, by slice: 16 bits of place each, those of
    cells with one and of cells with more."""
    keys, once, more = [], [], []
    own, count = np.unique(anchors, return_counts=True)
    for row in range(ROWS):
        cell = cells(own, row, bits)
        order = np.argsort(cell, kind="stable")
        cell, weight = cell[order], count[order]
        head = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1]))) if len(cell) else np.zeros(0, np.int64)
        total = np.add.reduceat(weight, head) if len(head) else weight
        cell = cell[head]
        part = cell >> np.uint64(_SLICE)
        cuts = np.concatenate(([0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(cell)])) if len(cell) else [0]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            place, two = (cell[a:b] & np.uint64(0xFFFF)).astype("<u2"), total[a:b] > 1
            keys.append((row << 40) | int(part[a]))
            once.append(place[~two].tobytes())
            more.append(place[two].tobytes())
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.int64()), pa.array(once, pa.binary()), pa.array(more, pa.binary())],
        names=["slice", "once", "more"],
    )


def sketch(docs: DataFrame, window: int, anchor: int, bits: int) -> np.ndarray:
    """One bit for each cell of each row: counted twice or more over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in passes(batch):
                held.append(Windows(part, window, anchor).anchors())
                size += len(held[-1])
                if size >= HELD:
                    yield _sketch(np.concatenate(held), bits)
                    held, size = [], 0
        if size:
            yield _sketch(np.concatenate(held), bits)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, np.zeros(1 << _SLICE, np.uint8)

        def made() -> pa.RecordBatch:
            packed = np.packbits(total > 1, bitorder="little").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([packed], pa.binary())], names=["slice", "cells"])

        for batch in batches:
            for k, once, more in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if k != key:
                    if key is not None:
                        yield made()
                    key, total = k, np.zeros(1 << _SLICE, np.uint8)
                place = np.frombuffer(once, "<u2")
                total[place] = np.minimum(total[place] + 1, 2)
                total[np.frombuffer(more, "<u2")] = 2
        if key is not None:
            yield made()

    parts = docs.select("doc_id", "text").mapInArrow(count, "slice long, once binary, more binary")
    parts = parts.repartition("slice").sortWithinPartitions("slice")
    found = parts.mapInArrow(merge, "slice long, cells binary").toArrow()
    out = np.zeros((ROWS, max(1, 1 << (bits - 3))), np.uint8)
    size = 1 << (_SLICE - 3)
    for k, packed in zip(found.column("slice").to_pylist(), found.column("cells").to_pylist(), strict=True):
        at = (k & ((1 << 40) - 1)) * size
        out[k >> 40, at : at + size] = np.frombuffer(packed, np.uint8)
    return out


def repeated(bitmap: np.ndarray, anchors: np.ndarray, bits: int) -> np.ndarray:
    found = np.ones(len(anchors), bool)
    for row in range(ROWS):
        cell = cells(anchors, row, bits)
        found &= (bitmap[row, (cell >> np.uint64(3)).astype(np.int64)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1 > 0
    return found


_SENT = "hash long, rest long, doc_id long, span long"
_NAMES = ["hash", "rest", "doc_id", "span"]
#: Span of a window that is only counted, its places being known to be repeated already; hash of a known span.
_COUNTED = -1


def _as_long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _portion(held: list[tuple]) -> Iterator[pa.RecordBatch]:
    """The rows that a task sends for the windows it holds, which it gives up: each distinct window once, and
    the spans of those it holds more than once. ``rest`` is 32 bits of the second hash, then 32
    bits of the text's hash; ``span`` is start, then length (0 for an undecided window)."""
    hashes, rests, docs, salts, starts = zip(*held, strict=True)
    held.clear()
    hashes, rests, salts, starts = (np.concatenate(x) for x in (hashes, rests, salts, starts))
    docs = pa.concat_arrays(docs)
    order = np.lexsort((rests, hashes))
    same = (hashes[order][1:] == hashes[order][:-1]) & (rests[order][1:] == rests[order][:-1])
    head = np.concatenate(([True], ~same))
    alone = head & np.concatenate((~same, [True]))
    several = np.zeros(len(order), bool)
    several[order[~alone]] = True
    one, counted = order[alone], order[head & ~alone]
    # Held rows of a text follow each other, so known windows side by side are one span.
    known = np.flatnonzero(several)
    next_to = np.zeros(len(known), bool)
    if len(known):
        ids = docs.fill_null(0).to_numpy()
        next_to[1:] = (
            (known[1:] == known[:-1] + 1) & (starts[known[1:]] == starts[known[:-1]] + 1)
            & (ids[known[1:]] == ids[known[:-1]]) & (salts[known[1:]] == salts[known[:-1]])
        )
    first = known[~next_to]
    length = np.diff(np.append(np.flatnonzero(~next_to), len(known)))
    low = np.uint64(0xFFFFFFFF)
    top = np.uint64(32)
    none = pa.nulls(len(counted), pa.int64())
    yield pa.RecordBatch.from_arrays(
        [_as_long(hashes[one]), _as_long((rests[one] << top) | (salts[one] & low)), docs.take(pa.array(one)), pa.array(starts[one] << 32)],
        names=_NAMES,
    )
    yield pa.RecordBatch.from_arrays(
        [_as_long(hashes[counted]), _as_long(rests[counted] << top), none, pa.array(np.full(len(counted), _COUNTED, np.int64))],
        names=_NAMES,
    )
    # Known spans need no company; they are dealt by the text's hash.
    yield pa.RecordBatch.from_arrays(
        [_as_long(mix(salts[first])), _as_long(salts[first] & low), docs.take(pa.array(first)), pa.array((starts[first] << 32) | length)],
        names=_NAMES,
    )


def _salt() -> Column:
    """32 bits of the text's hash, to tell rows with the same id apart."""
    return F.pmod(F.xxhash64("text"), F.lit(1 << 32))


def spans(docs: DataFrame, window: int, anchor: int, most_bits: int) -> DataFrame:
    """doc_id, salt, start, length: runs of starts of repeated windows (several may overlap)."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).collect()[0].n or 0
    # Some six bytes a word, 2 anchors per (window - anchor + 2) words, four cells an anchor.
    expected = 4 * size / 6 * 2 / (window - anchor + 2)
    bits = min(most_bits, max(_SLICE, int(expected).bit_length()))
    bitmap = spark.sparkContext.broadcast(sketch(docs, window, anchor, bits))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n = 0
        for batch in batches:
            for part in passes(batch):
                w = Windows(part, window, anchor)
                on = np.flatnonzero(repeated(bitmap.value, w.anchor, bits))
                if not len(on):
                    continue
                first, second = (w.words.runs(window, k)[w.place[on]] for k in (1, 2))
                salt = part.column("salt").to_numpy().view(np.uint64)[w.text[on]]
                docs_on = part.column("doc_id").take(pa.array(w.text[on]))
                held.append((first, second >> np.uint64(32), docs_on, salt, w.start[on]))
                n += len(on)
                if n >= HELD:
                    yield from _portion(held)
                    n = 0
        if held:
            yield from _portion(held)

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            if left is not None:
                rows = pa.concat_tables([left, rows])
            out, left = _decide(rows, False)
            yield from out.to_batches()
        if left is not None:
            yield from _decide(left, True)[0].to_batches()

    salted = docs.select("doc_id", "text", _salt().alias("salt")).where("text IS NOT NULL")
    sent = salted.mapInArrow(send, _SENT).repartition("hash").sortWithinPartitions("hash", "rest")
    return sent.mapInArrow(group, "doc_id long, salt long, start int, length int")


def _decide(rows: pa.Table, last: bool) -> tuple[pa.Table, pa.Table | None]:
    """Spans of known and repeated windows of sorted rows; unless they are the last, the rows of the last hash wait."""
    rows = rows.combine_chunks()
    hashes = rows.column("hash").to_numpy()
    rest = rows.column("rest").to_numpy().view(np.uint64)
    span = rows.column("span").to_numpy()
    known = (span != _COUNTED) & ((span & 0xFFFFFFFF) > 0)
    cut = len(hashes)
    if not last and cut:
        cut = int(np.searchsorted(hashes, hashes[-1]))
    # Rows of one hash and second hash stand together but for known spans among them.
    open_rows = np.flatnonzero(~known[:cut])
    h, r = hashes[open_rows], rest[open_rows] >> np.uint64(32)
    same = (h[1:] == h[:-1]) & (r[1:] == r[:-1]) if len(h) else np.zeros(0, bool)
    many = np.concatenate((same, [False])) | np.concatenate(([False], same)) if len(h) else same
    # A counted row stands for several places, so one other row beside it is repeated: it is in a group of two.
    chosen = np.concatenate((open_rows[many & (span[open_rows] != _COUNTED)], np.flatnonzero(known[:cut])))
    length = np.where(known[chosen], span[chosen] & 0xFFFFFFFF, 1).astype(np.int32)
    out = pa.table(
        {
            "doc_id": rows.column("doc_id").take(pa.array(chosen)),
            "salt": pa.array((rest[chosen] & np.uint64(0xFFFFFFFF)).astype(np.int64)),
            "start": pa.array((span[chosen] >> 32).astype(np.int32)),
            "length": pa.array(length),
        }
    )
    return out, None if last else rows.slice(cut)


def dedup(docs: DataFrame, window: int = 35, anchor: int | None = None, most_bits: int = 27) -> DataFrame:
    """``docs`` (doc_id, text and any other columns) with the text's kept words as ``text``, and
    ``_removal``, a struct of n_words and n_removed."""
    spark = docs.sparkSession
    prepare(spark)
    anchor = anchor or max(1, window * 2 // 5)
    found = spans(docs, window, anchor, most_bits).groupBy("doc_id", "salt")
    found = found.agg(F.collect_list(F.struct("start", "length")).alias("spans"))
    rest = [c for c in docs.columns if c != "text"]
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in rest)).alias("_row"), "doc_id", "text")
    own = own.withColumn("salt", _salt())
    on = own.doc_id.eqNullSafe(found.doc_id) & (own.salt == found.salt)
    rows = own.join(found, on, "left").select("_row", own.text, "spans")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in passes(batch):
                kept, counts, removed = [], [], []
                for text, own_spans in zip(bytes_of(part.column("text")), part.column("spans"), strict=True):
                    words = text.split()
                    gone = 0
                    if own_spans.is_valid:
                        fields = own_spans.values
                        start = np.asarray(fields.field("start"), np.int64)
                        end = start + np.asarray(fields.field("length"), np.int64) - 1 + window
                        cover = np.bincount(start, minlength=len(words) + 1) - np.bincount(end, minlength=len(words) + 1)
                        stays = np.cumsum(cover)[: len(words)] == 0
                        gone = len(words) - int(stays.sum())
                        kept.append(b" ".join(compress(words, stays.tolist())).decode())
                    else:
                        kept.append(b" ".join(words).decode())
                    counts.append(len(words))
                    removed.append(gone)
                columns = [part.column("_row"), pa.array(kept, pa.string()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["_row", "kept", "n_words", "n_removed"])

    row = own.schema["_row"].dataType.simpleString()
    out = rows.mapInArrow(keep, f"_row {row}, kept string, n_words long, n_removed long")
    columns = [F.col(f"_row.`{c}`") if c != "text" else F.col("kept").alias("text") for c in docs.columns]
    return out.select(*columns, F.struct("n_words", "n_removed").alias("_removal"))


def deduplicated(docs: DataFrame, window: int = 35) -> DataFrame:
    """The documents with their kept words as text and n_chars of these, other columns as they were."""
    out = dedup(docs, window).drop("_removal")
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out
