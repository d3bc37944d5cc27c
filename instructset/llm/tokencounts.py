"""Token counts of whole texts, by the libraries that the vocabularies are made for.

Arrow batches go to the library in calls of about ``CALL_BYTES`` of text, however many rows that is,
and only lengths come back: ids are counted and dropped call by call. A text longer than a piece is
split where splitting can't change its tokens, so a long text fills calls as short ones do:

* The place is a single space between two ASCII letters or digits. No pre-tokenizer here joins what
  stands before such a space to it, and none looks back over it; no normalizer changes it.
* A byte-level tokenizer takes the space with the word after it, so the space goes right. A tokenizer that drops
  white space loses it either way.
* A sentencepiece model turns the space into the mark that begins a word, and puts the same mark before a text.
  So the space itself is dropped, if the model does put that mark, and if none of its pieces has
  the mark after anything else (merging over the space would need one); else its texts stay whole.
* A tokenizer whose added tokens hold a space, or that changes texts in a way not named here, gets its texts whole.

A text without such places (one word, or a script without spaces) is encoded whole, in a call of its own.

A byte-level BPE tokenizer without a normalizer gets the texts of a call by fragments (``bpe.Encoder``): cut at pairs of bytes
inside no token, each distinct fragment is encoded by the library once and its ids are looked up by hash afterwards, so
words and parts of words that come again and again cost a look-up. All others get whole texts and pieces.

Null and empty texts have no bytes and no tokens. Repeated rows and ids get equal counts, each row its
own. An empty table gives an empty one. The columns that are added replace columns of
those names; all others stay. Map only: no row moves, and a task holds one batch of texts, one call's ids and the
encoder's bounded cache.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from instructset.llm import bpe
from instructset.llm.common import prepare

#: Bytes of text in a call of the library, and characters in a piece of a long text.
CALL_BYTES = 1 << 18
PIECE_CHARS = 1 << 16
_PLACE = re.compile(r"[A-Za-z0-9] (?=[A-Za-z0-9])")
#: What a tokenizers file may do to a text for the places to be safe.
_NORMALIZERS = {"NFC", "Lowercase", "Replace", "Sequence"}
_PRE_TOKENIZERS = {"ByteLevel", "Split", "Sequence"}
_MARK = "▁"


def _kinds(part: dict | None) -> set[str]:
    if part is None:
        return set()
    inner = part.get("normalizers", []) + part.get("pretokenizers", [])
    return {part["type"]}.union(*map(_kinds, inner))


def by_fragments(spec: dict) -> bool:
    """True for byte-level BPE of the plain kind that ``bpe.Encoder`` cuts without a change of tokens."""
    model, before = spec["model"], spec["pre_tokenizer"] or {}
    return (
        model["type"] == "BPE"
        and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        and before.get("type") == "ByteLevel"
        and before.get("use_regex", True)
        and not before.get("add_prefix_space")
        and spec["normalizer"] is None
        and not any(a[k] for a in spec["added_tokens"] for k in ("lstrip", "rstrip", "single_word"))
    )


class Counter:
    """Counts the tokens of texts; ``keep`` tells how many characters of a place (a letter and its
    space) stay to the left of the cut and how many are dropped, or is None where nothing is cut."""

    keep: tuple[int, int] | None
    lengths: Callable[[list[str]], list[int]]

    def pieces(self, text: str) -> list[str]:
        """The text, cut at safe places into pieces of ``PIECE_CHARS`` and a little more where there are such places."""
        if self.keep is None or len(text) <= PIECE_CHARS:
            return [text]
        left, dropped = self.keep
        out, at = [], 0
        while len(text) - at > PIECE_CHARS and (place := _PLACE.search(text, at + PIECE_CHARS)):
            out.append(text[at : place.start() + left])
            at = place.start() + left + dropped
        return [*out, text[at:]]

    def counts(self, texts: list[str]) -> np.ndarray:
        """One count per text, from calls that hold about equally many bytes."""
        cut = [self.pieces(t) for t in texts]
        parts = list(chain.from_iterable(cut))
        sizes = np.fromiter((len(p) if p.isascii() else len(p.encode()) for p in parts), np.int64, len(parts))
        call = np.cumsum(sizes) // CALL_BYTES
        edges = [0, *(np.flatnonzero(np.diff(call)) + 1).tolist(), len(parts)]
        found = np.zeros(len(parts) + 1, np.int64)
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            found[a:b] = self.lengths(parts[a:b]) if b > a else 0
        firsts = np.cumsum([0, *map(len, cut)])[:-1]
        return np.add.reduceat(found, firsts) if len(texts) else found[:0]


class LibraryCounter(Counter):
    """A tokenizers file, with the library's defaults for special strings in texts."""

    def __init__(self, spec: bytes):
        # Spark runs a task per core; threads of the library would only wait for each other.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        parsed = json.loads(spec)
        if by_fragments(parsed):
            own = bpe.encoder(spec.decode())
            self.lengths = lambda texts: np.diff(own.encode(pa.array(texts, pa.large_string()))[1]).tolist()
        else:
            whole = Tokenizer.from_str(spec.decode())
            whole.no_truncation()
            whole.no_padding()
            self.lengths = lambda texts: list(map(len, whole.encode_batch_fast(texts, add_special_tokens=False)))
        before = parsed["pre_tokenizer"]
        safe = (
            _kinds(parsed["normalizer"]) <= _NORMALIZERS
            and before is not None
            and _kinds(before) <= _PRE_TOKENIZERS
            and not before.get("add_prefix_space")
            and not any(" " in a["content"] or a["lstrip"] or a["rstrip"] for a in parsed["added_tokens"])
        )
        self.keep = (1, 0) if safe else None


class PieceCounter(Counter):
    """A sentencepiece model, without begin and end tokens."""

    def __init__(self, spec: bytes):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=spec)
        self.lengths = lambda texts: list(map(len, model.encode(texts, add_bos=False, add_eos=False, num_threads=1)))
        names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        begun = model.encode("a", out_type=str)[0].startswith(_MARK)
        inside = any(_MARK in n.lstrip(_MARK) for n in names)
        # A text's first word and a later one must come out alike.
        alike = model.encode("a b", out_type=str) == model.encode("a", out_type=str) + model.encode("b", out_type=str)
        self.keep = (1, 1) if begun and alike and not inside else None


@lru_cache(maxsize=2)
def counter(kind: str, spec: bytes) -> Counter:
    return PieceCounter(spec) if kind == "model" else LibraryCounter(spec)


def count_tokens(df: DataFrame, tokenizer: str, text: str = "text", limit: int | None = None) -> DataFrame:
    """``df`` with ``n_bytes`` (UTF-8) and ``n_tokens`` of column ``text``, and with ``limit`` the
    boolean ``over_limit`` (more tokens than that).

    ``tokenizer`` is the path of a tokenizers ``.json`` or a sentencepiece ``.model``; the driver reads
    it and sends it with the tasks."""
    kind = Path(tokenizer).suffix.removeprefix(".")
    if kind not in ("json", "model"):
        raise ValueError(f"{tokenizer!r} should be a .json or a .model file")
    spark = df.sparkSession
    prepare(spark)
    spec = spark.sparkContext.broadcast(Path(tokenizer).read_bytes())
    kept = df.drop("n_bytes", "n_tokens", *(["over_limit"] if limit is not None else []))
    # The text goes to Python only where it is asked for by name; a replaced column still is the text.
    source = df.select(*kept.columns, F.col(text).cast("string").alias("_counted text"))
    schema = T.StructType(
        [*kept.schema.fields, T.StructField("n_bytes", T.LongType(), False), T.StructField("n_tokens", T.LongType(), False)]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(kind, spec.value)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).cast(pa.large_string()).fill_null("")
            sizes = pc.binary_length(texts.cast(pa.large_binary())).cast(pa.int64())
            counts = pa.array(own.counts(texts.to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], sizes, counts], names=schema.names)

    counted = source.mapInArrow(run, schema)
    return counted if limit is None else counted.withColumn("over_limit", F.col("n_tokens") > limit)
