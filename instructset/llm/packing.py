"""Packing documents into sequences of a fixed number of tokens, by harmonic classes.

A class holds the lengths in ``(C/(k+1), C/k]`` of the capacity C and fills its sequences with
exactly k pieces, so a task packs its rows as they come, with one open sequence per class and
without asking any other task. Only lengths that divide the capacity fill their class to the
brim, so documents are cut into such lengths: first whole sequences, then the halves of the
capacity that the rest needs, largest first, and last a piece of less than ``least`` tokens that
stays whole, whose class wastes less than ``least`` tokens a sequence. At its end a task puts the
pieces of its open sequences together, longest first; a sequence that reaches a power of two
needs no padding.

Every id lies in one piece. A null or empty text is the end id alone. Equal rows give equal but
separate pieces. Sequence ids are unique, start at the task's number times 2**40, and depend only
on how the table is divided into tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from instructset.llm.bpe import encoded_passes, read_spec
from instructset.llm.common import prepare, texts

PIECES = (
    "doc_id long, start long, length long, ids array<int>, doc_tokens long, sequence_id long, offset long"
)
_ROWS = 4096


def pieces_of(n: int, capacity: int, least: int) -> list[int]:
    """Lengths of the pieces of a document of ``n`` ids, in order."""
    out = [capacity] * (n // capacity)
    rest, part = n % capacity, capacity // 2
    while rest >= least and part >= least:
        if rest >= part:
            out.append(part)
            rest -= part
        part //= 2
    return out + [rest] * (rest > 0)


class Packer:
    """The open sequences of one task."""

    def __init__(self, capacity: int, first: int):
        self.capacity, self.next = capacity, first
        self.open: dict[int, list[tuple]] = {}

    def _close(self, pieces: list[tuple]) -> Iterator[tuple]:
        at = 0
        for piece in pieces:
            yield (*piece, self.next, at)
            at += len(piece[3])
        self.next += 1

    def add(self, piece: tuple) -> Iterator[tuple]:
        """``piece``: (doc_id, start, length, ids, doc_tokens)."""
        k = self.capacity // piece[2]
        held = self.open.setdefault(k, [])
        held.append(piece)
        if len(held) == k:
            del self.open[k]
            yield from self._close(held)

    def rest(self) -> Iterator[tuple]:
        """The pieces of all open sequences, put together first-fit, longest first; at most
        one sequence's worth of pieces per class is left here."""
        left = sorted((p for held in self.open.values() for p in held), key=lambda p: -p[2])
        self.open = {}
        bins: list[list] = []
        for piece in left:
            for b in bins:
                if b[0] + piece[2] <= self.capacity:
                    b[0] += piece[2]
                    b[1].append(piece)
                    break
            else:
                bins.append([piece[2], [piece]])
        for _, pieces in bins:
            yield from self._close(pieces)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    doc, start, length, ids, tokens, sequence, offset = zip(*rows, strict=True)
    edges = np.cumsum([0, *length])
    lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(np.concatenate(ids), pa.int32()))
    numbers = [pa.array(x, pa.int64()) for x in (doc, start, length, tokens, sequence, offset)]
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    return pa.RecordBatch.from_arrays([*numbers[:3], lists, *numbers[3:]], names=names)


def pack(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = 2048,
    end_id: int = 1,
    least: int = 32,
    digests: bool = False,
) -> DataFrame:
    """One row per piece of the documents' ids, each document ended by ``end_id``.

    ``docs`` needs doc_id and text. Map only. With ``digests`` the column ids is replaced by
    ids_crc32, the CRC-32 of the ids as little-endian 32-bit numbers."""
    spark = docs.sparkSession
    prepare(spark)
    spec = spark.sparkContext.broadcast(read_spec(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(capacity, TaskContext.get().partitionId() << 40)
        end = np.array([end_id], np.int32)
        rows: list[tuple] = []
        for part, flat, edges in encoded_passes(batches, spec.value):
            for doc, a, b in zip(part.column("doc_id").to_pylist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                ids = np.concatenate((flat[a:b], end))
                at = 0
                for n in pieces_of(len(ids), capacity, least):
                    rows.extend(packer.add((doc, at, n, ids[at : at + n], len(ids))))
                    at += n
            while len(rows) >= _ROWS:
                yield out(rows[:_ROWS])
                rows = rows[_ROWS:]
        rows.extend(packer.rest())
        for a in range(0, len(rows), _ROWS):
            yield out(rows[a : a + _ROWS])

    def out(rows: list[tuple]) -> pa.RecordBatch:
        batch = _batch(rows)
        if not digests:
            return batch
        crc = [zlib.crc32(r[3].astype("<u4").tobytes()) for r in rows]
        return batch.set_column(3, "ids_crc32", pa.array(crc, pa.int64()))

    schema = PIECES.replace("ids array<int>", "ids_crc32 long") if digests else PIECES
    return texts(docs).mapInArrow(run, schema)
