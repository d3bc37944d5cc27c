"""BPE encoding and decoding with the vocabulary of a public tokenizer.

Encoding by forced boundaries: a pair of neighbouring bytes that lies inside no token of the
vocabulary can never be merged over, so a text is cut there for certain; each fragment is encoded
on its own, once for all its occurrences, and the ids are put together again. The library encodes
the fragments, and its ids of the whole text are those of the fragments in a row.

A cut needs more than the pair where the tokenizer first splits a text by a pattern. For a
byte-level tokenizer (the pattern with optional leading spaces) no cut follows white space, since
the pattern looks ahead there, nor goes before an apostrophe, since that may begin a contraction.
A tokenizer that drops white space is cut there, and where letters, digits and marks meet, which its pattern
parts too; never beside an apostrophe or a character outside ASCII and the letters of Latin-1.
Texts that hold the string of an added token are encoded whole. Fragments of one plain run go straight to
the vocabulary's merges, others through the library's whole way. A fragment met again is known by a 64-bit
hash; among the fragments that a task keeps, a wrong match has a chance below one in ten million.

A null text counts as empty and has no ids. Repeated rows get repeated results. Memory per task is
one pass of text, its ids, and a cache of at most ``CACHE`` fragments; a longer text than a pass
makes one pass of its own. Decoding holds the bytes of the vocabulary's tokens, and no tokenizer.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, compress
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from instructset.llm.common import prepare, sliced, small_scans
from instructset.llm.hashing import HashIndex, passes, span_hashes, text_buffer, word_spans

#: Fragments, and bytes of them, whose ids a task keeps before it starts its cache anew.
CACHE = 600_000
CACHE_BYTES = 16 << 20
#: Bytes that can end a white space character of more than one byte.
_SPACE_ENDS = np.zeros(256, bool)
_SPACE_ENDS[[0x85, 0xA0, *range(0x80, 0x8B), 0x9F, 0xA8, 0xA9, 0xAF]] = True
_LETTER = rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])"
#: One run of Latin-1 letters, a digit or ASCII marks, for a tokenizer that drops white space.
_PLAIN_RUN = re.compile(_LETTER + rb"+|[0-9]|[!-&(-/:-@\[-`{-~]+")
#: One run of letters in the pattern of a byte-level tokenizer.
_PLAIN_SPACED = re.compile(rb" ?" + _LETTER + rb"+")
#: 1 for letters, 2 for digits, 3 for marks but the apostrophe, 0 for what is never cut at.
_KIND = np.zeros(256, np.int8)
_KIND[[*range(33, 39), *range(40, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 3
_KIND[48:58] = 2
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_NO_LETTER = np.zeros(256, bool)
_NO_LETTER[[0x97, 0xB7]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ASCII_SPACE = np.zeros(256, bool)
_ASCII_SPACE[[*range(9, 14), *range(28, 33)]] = True


def byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: visible Latin-1
    characters stand for themselves, the other bytes for the characters from U+0100 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


def token_bytes(spec: dict) -> list[bytes]:
    """The bytes of each id, added tokens included; unused ids are empty."""
    to_byte = byte_of_char()
    suffix = spec["model"]["end_of_word_suffix"] or ""
    ids = spec["model"]["vocab"]
    out = [b""] * (1 + max([*ids.values(), *(a["id"] for a in spec["added_tokens"])]))
    for token, i in ids.items():
        out[i] = bytes(to_byte[c] for c in token.removesuffix(suffix))
    for added in spec["added_tokens"]:
        out[added["id"]] = added["content"].encode()
    return out


def vocabulary_size(spec: str) -> int:
    """One more than the largest id."""
    parsed = json.loads(spec)
    return 1 + max([*parsed["model"]["vocab"].values(), *(a["id"] for a in parsed["added_tokens"])])


def never_inside(tokens: list[bytes]) -> np.ndarray:
    """256 x 256: True for the pairs of bytes that lie inside no token."""
    free = np.ones((256, 256), bool)
    for token in tokens:
        pair = np.frombuffer(token, np.uint8)
        free[pair[:-1], pair[1:]] = False
    return free


class Encoder:
    """Encodes texts by fragments; each fragment is known by a 64-bit hash once it has been encoded."""

    def __init__(self, spec: str):
        # Spark runs a task per core; threads of the library would only wait for each other.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        parsed = json.loads(spec)
        self.added = [a["content"].encode() for a in parsed["added_tokens"]]
        self.by_space = parsed["pre_tokenizer"]["type"] != "ByteLevel"
        # Runs hold no line ends; these part them.
        self.char = {b: c for c, b in byte_of_char().items() if b != 10}
        self.free = never_inside(token_bytes({**parsed, "added_tokens": []}))
        self.free[:, 0x80:0xC0] = False
        if not self.by_space:
            self.free[_ASCII_SPACE] = False
            self.free[:, ord("'")] = False
        self._clear()

    def _clear(self) -> None:
        self.index = HashIndex()
        self.ids = np.zeros(1 << 16, np.int32)
        self.at = np.zeros(1 << 14, np.int64)
        self.size = np.zeros(1 << 14, np.int64)
        self.used = self.bytes = 0

    def _merged(self, runs: list[bytes]) -> list[list[int]]:
        """Ids of runs that the tokenizer's pattern takes whole."""
        text = b"\n".join(runs)
        shown = text.decode().lower().encode() if self.by_space else text
        tokenize = self.tokenizer.model.tokenize
        pieces = shown.decode("latin-1").translate(self.char).split("\n")
        return [[t.id for t in tokenize(piece)] for piece in pieces] if runs else []

    def fragments(self, fragments: list[bytes]) -> list[list[int]]:
        """Ids of fragments: merged as they are if they are plain, or else by the library's whole way."""
        plain = _PLAIN_RUN.fullmatch if self.by_space else _PLAIN_SPACED.fullmatch
        is_plain = [plain(f) is not None for f in fragments]
        merged = iter(self._merged(list(compress(fragments, is_plain))))
        return [next(merged) if p else self.whole(f) for f, p in zip(fragments, is_plain, strict=True)]

    def whole(self, text: bytes) -> list[int]:
        return self.tokenizer.encode(text.decode(), add_special_tokens=False).ids

    def _keep(self, hashes: np.ndarray, fragments: list[bytes]) -> None:
        n = self.index.n
        self.index.add(hashes)
        self.bytes += sum(map(len, fragments))
        rows = self.fragments(fragments)
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        total = int(sizes.sum())
        while n + len(rows) > len(self.at):
            self.at, self.size = np.resize(self.at, 2 * len(self.at)), np.resize(self.size, 2 * len(self.size))
        while self.used + total > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.ids[self.used : self.used + total] = np.fromiter(chain.from_iterable(rows), np.int32, total)
        self.at[n : n + len(rows)] = self.used + np.cumsum(sizes) - sizes
        self.size[n : n + len(rows)] = sizes
        self.used += total

    def cuts(self, data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the fragments in ``data``, and the first fragment of each text."""
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(edges), np.int64)
        cut = np.ones(len(data), bool)
        cut[1:] = self.free[data[:-1], data[1:]]
        if self.by_space:
            kind = _KIND[data]
            wide = np.flatnonzero(data[:-1] == 0xC3)
            wide = wide[~_NO_LETTER[data[wide + 1]]]
            kind[wide] = kind[wide + 1] = 1
            cut[1:] &= (kind[:-1] > 0) & (kind[1:] > 0) & ((kind[:-1] != kind[1:]) | (kind[1:] == 2))
            starts, ends, _ = word_spans(data, edges)
            inside = cut & ~_SPACE[data]
            inside[starts] = True
            cuts = np.flatnonzero(inside)
            # A fragment ends at the next one of its word, or with the word.
            stops = np.append(cuts[1:], len(data))
            last = np.searchsorted(cuts, starts)[1:] - 1
            if len(starts):
                stops[np.append(last, len(cuts) - 1)] = ends
            return cuts, stops, np.searchsorted(cuts, edges)
        wide = _SPACE_ENDS[data[:-1]] & (data[:-1] >= 0x80)
        if wide.any():
            # Of two-byte characters only those that begin with 0xC2 can be white space.
            lead = np.zeros(len(data) - 1, np.uint8)
            lead[1:] = data[:-2]
            cut[1:] &= ~wide | ((lead >= 0xC3) & (lead <= 0xDF))
        cut[edges[:-1][edges[:-1] < len(data)]] = True
        starts = np.flatnonzero(cut)
        return starts, np.append(starts[1:], len(data)), np.searchsorted(starts, edges)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the edges of each text's ids."""
        data, edges = text_buffer(texts)
        body = data.tobytes()
        special = [i for i in self._with_added(body, edges)]
        starts, ends, first = self.cuts(data, edges)
        hashes = span_hashes(data, starts, ends) | np.uint64(1)
        place = self.index.find(hashes)
        new, at = np.unique(np.where(place < 0, hashes, 0), return_index=True)
        new, at = (new[1:], at[1:]) if len(new) and not new[0] else (new, at)
        if self.index.n + len(new) > CACHE or self.bytes > CACHE_BYTES:
            self._clear()
            new, at = np.unique(hashes, return_index=True)
        if len(new):
            self._keep(new, [body[i:j] for i, j in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
            place = self.index.find(hashes)
        sizes = self.size[place]
        stops = np.cumsum(sizes)
        total = int(stops[-1]) if len(stops) else 0
        ids = self.ids[np.repeat(self.at[place] - stops + sizes, sizes) + np.arange(total)]
        out = np.concatenate(([0], stops))[first]
        if special:
            rows = np.split(ids, out[1:-1])
            for i in special:
                rows[i] = np.array(self.whole(body[edges[i] : edges[i + 1]]), np.int32)
            ids, out = np.concatenate(rows), np.cumsum([0, *map(len, rows)])
        return ids, out

    def _with_added(self, body: bytes, edges: np.ndarray) -> list[int]:
        """The texts that hold an added token's string."""
        found = set()
        for token in self.added:
            at = body.find(token)
            while at >= 0:
                found.add(int(np.searchsorted(edges, at, side="right")) - 1)
                at = body.find(token, at + 1)
        return sorted(found)


@lru_cache(maxsize=2)
def encoder(spec: str) -> Encoder:
    return Encoder(spec)


def read_spec(path: str) -> str:
    """A tokenizer file as text; the driver reads it and sends it with the tasks."""
    return Path(path).read_text(encoding="utf-8")


def bytes_of(column: pa.Array) -> list[bytes]:
    return column.cast(pa.large_string()).fill_null("").cast(pa.large_binary()).to_pylist()


def encoded_passes(
    batches: Iterator[pa.RecordBatch], spec: str, column: str = "text"
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with the ids and row edges of their texts."""
    own = encoder(spec)
    for batch in batches:
        for part in passes(batch, column):
            ids, edges = own.encode(part.column(column))
            yield part, ids, edges


def encode(df: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids", keep: bool = True) -> DataFrame:
    """``df`` with the ids of column ``text`` as ``ids`` (array of int), in place of a column of that name;
    without ``keep`` the text itself goes, and is not sent back from Python.

    ``tokenizer`` is the path of a tokenizers file. Map only: no row moves."""
    spark = df.sparkSession
    prepare(spark)
    small_scans(spark)
    spec = spark.sparkContext.broadcast(read_spec(tokenizer))
    given = df.drop(ids)
    kept = given if keep else given.drop(text)
    schema = T.StructType([*kept.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, flat, edges in encoded_passes(batches, spec.value, text):
            columns = [*(part if keep else part.drop_columns([text])).columns, sliced(flat, edges, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return given.mapInArrow(run, schema)


def decode(df: DataFrame, tokenizer: str, ids: str = "ids", text: str = "decoded", keep: bool = True) -> DataFrame:
    """``df`` with the text of the ids (special tokens included) as ``text``; null ids give an empty text.
    Without ``keep`` the ids themselves go, and are not sent back from Python.

    Bytes that aren't UTF-8, as ids cut inside a character give, become U+FFFD."""
    spark = df.sparkSession
    prepare(spark)
    # The bytes of all tokens in a row, and each one's size: tasks need no more of the file.
    tokens = token_bytes(json.loads(read_spec(tokenizer)))
    table = spark.sparkContext.broadcast((b"".join(tokens), np.fromiter(map(len, tokens), np.int32, len(tokens))))
    given = df.drop(text)
    kept = given if keep else given.drop(ids)
    schema = T.StructType([*kept.schema.fields, T.StructField(text, T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        body, sizes = np.frombuffer(table.value[0], np.uint8), table.value[1]
        at = np.cumsum(sizes) - sizes
        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                part = batch.slice(a, min(200, batch.num_rows - a))
                out = []
                for row in part.column(ids):
                    row = np.asarray(row.values if row.is_valid else [], np.int64)
                    size = sizes[row]
                    ends = np.cumsum(size)
                    take = np.repeat(at[row] - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)
                    out.append(body[take].tobytes().decode("utf-8", "replace"))
                columns = [*(part if keep else part.drop_columns([ids])).columns, pa.array(out, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return given.mapInArrow(run, schema)
