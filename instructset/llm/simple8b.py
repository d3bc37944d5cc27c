"""Token-id files in Simple-8b: 64-bit words whose first four bits tell how many ids they hold.

File format: a Parquet table (so any store that Spark writes will do) of groups of whole documents
in ascending doc_id order. A row has ``part`` and ``place`` (its file part and place in it),
``part_start`` (ids of the part before it), ``block_ids``, ``doc_ids`` and ``n_tokens`` (of each document),
``words`` (little-endian 64-bit words), and for its blocks of at most ``block_ids`` ids the
``word_edges`` in ``words``. Blocks hold ids of neighbouring documents without a gap, each can be
decoded by itself, and all blocks of a row are decoded at once.

A word is ``selector << 60 | payload``. Selectors 0 to 13 hold the counts of ``COUNTS`` at the
widths of ``WIDTHS``, lowest bits first. Selector 14 is a run: the low 20 bits are its length, the
40 bits above its id. Selector 15 escapes: the id fills the next word whole, so every 64-bit id
can be written. The last word of a block may hold fewer ids than its count; ``n_ids`` ends it.

Null and empty texts are the end id alone; repeated ids of documents are kept as rows in a row. An empty
table gives a folder without rows.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from instructset.llm.bpe import encoded_passes, read_spec, vocabulary_size
from instructset.llm.common import id_range, prepare, sliced, texts
from instructset.session import shared_dir

# Ids per word and bits per id of Simple-8b's selectors, widest count first.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
RUN, ESCAPE = 14, 15
#: A run shorter than this is packed like other ids.
LEAST_RUN = 16
_FOUR = np.uint64(60)
#: Bits of the ids of usual vocabularies.
_SMALL = np.frompyfunc(int.bit_length, 1, 1)(np.arange(1 << 17)).astype(np.int8)


def _bits(ids: np.ndarray) -> np.ndarray:
    """Bits that each id needs."""
    if len(ids) and ids.max() < len(_SMALL):
        return _SMALL[ids]
    bits, left = np.zeros(ids.shape, np.int8), ids.copy()
    for step in (32, 16, 8, 4, 2, 1):
        big = left >= np.uint64(1) << np.uint64(step)
        bits[big] += step
        left[big] >>= np.uint64(step)
    return bits + (left > 0).astype(np.int8)


def _selectors(bits: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """For each id the selector of the most ids that a word from there can hold in its block.

    Blocks lie one below another, padded with ids of no bits; widths of windows come from
    windows of half their size."""
    sizes = np.diff(edges)
    row = np.repeat(np.arange(len(sizes)), sizes)
    column = np.arange(len(bits)) - np.repeat(edges[:-1], sizes)
    across = int(sizes.max()) if len(sizes) else 0
    grid = np.zeros((len(sizes), across + int(COUNTS[0])), np.int8)
    grid[row, column] = bits
    windows, have = {1: grid}, 1
    while 2 * have <= COUNTS[0]:
        half = windows[have]
        windows[2 * have] = np.maximum(half[:, :-have], half[:, have:])
        have *= 2
    best = np.full((len(sizes), across), ESCAPE, np.int8)
    for selector in range(len(COUNTS) - 1, -1, -1):
        count = int(COUNTS[selector])
        part = 1 << (count.bit_length() - 1)
        window = windows[part]
        widest = np.maximum(window[:, :across], window[:, count - part : count - part + across])
        best[widest <= WIDTHS[selector]] = selector
    return best[row, column]


def encode_blocks(ids: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of blocks (``edges`` cuts ``ids``), and the edges of each block's words.

    All blocks advance together, a word each at a step; the words are filled afterwards."""
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(edges), np.int64)
    ids = ids.astype(np.uint64)
    bits = _bits(ids)
    selector = _selectors(bits, edges)
    count = np.where(selector < RUN, COUNTS[np.minimum(selector, 13)], 1)
    left = np.repeat(edges[1:], np.diff(edges)) - np.arange(n)
    change = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1], [True])))
    run = np.repeat(change[1:], np.diff(change)) - np.arange(n)
    run = np.minimum(np.minimum(run, left), (1 << 20) - 1)
    is_run = (run >= LEAST_RUN) & (run > count) & (bits <= 40)
    selector[is_run] = RUN
    count = np.where(is_run, run, np.minimum(count, left))
    at = edges[:-1][edges[:-1] < edges[1:]]
    ends = edges[1:][edges[:-1] < edges[1:]]
    visited = []
    while len(at):
        visited.append(at)
        at = at + count[at]
        more = at < ends
        if not more.all():
            at, ends = at[more], ends[more]
    first = np.sort(np.concatenate(visited))
    kind, size = selector[first].astype(np.int64), count[first]
    # An escape takes a second word, which is the id itself.
    place = np.arange(len(first)) + np.cumsum(kind == ESCAPE) - (kind == ESCAPE)
    words = np.zeros(len(first) + int((kind == ESCAPE).sum()), np.uint64)
    # first cuts the ids into the words' runs, so or-ing over these runs packs every word.
    width = np.where(kind < RUN, WIDTHS[np.minimum(kind, 13)], 0)
    shift = ((np.arange(n) - np.repeat(first, size)) * np.repeat(width, size)).astype(np.uint64)
    payload = np.bitwise_or.reduceat(ids << shift, first)
    ran, escaped = kind == RUN, kind == ESCAPE
    payload[ran] = (ids[first[ran]] << np.uint64(20)) | size[ran].astype(np.uint64)
    payload[escaped] = 0
    words[place] = (kind.astype(np.uint64) << _FOUR) | payload
    words[place[escaped] + 1] = ids[first[escaped]]
    cuts = np.append(place, len(words))[np.searchsorted(first, edges)]
    return words, cuts


def decode_blocks(words: np.ndarray, edges: np.ndarray, n_ids: np.ndarray) -> np.ndarray:
    """The ids of blocks in a row, from their words, word edges and numbers of ids."""
    selector = (words >> _FOUR).astype(np.int64)
    # The word after an escape is an id, whatever its first bits are; it may look like an escape.
    plain = np.zeros(len(words), bool)
    for i in np.flatnonzero(selector == ESCAPE).tolist():
        if not plain[i]:
            plain[i + 1] = True
    payload = words & np.uint64((1 << 60) - 1)
    count = np.where(selector < RUN, COUNTS[np.minimum(selector, 13)], 0)
    ran = (selector == RUN) & ~plain
    count[ran] = (payload[ran] & np.uint64((1 << 20) - 1)).astype(np.int64)
    count[plain] = 1
    count[(selector == ESCAPE) & ~plain] = 0
    # A block's last word holds what is left of n_ids.
    last = edges[1:] - 1
    sums = np.concatenate(([0], np.cumsum(count)))
    held = sums[edges[1:]] - sums[edges[:-1]]
    full = np.diff(edges) > 0
    count[last[full]] -= (held - n_ids)[full]
    head = np.cumsum(count) - count
    of = np.repeat(np.arange(len(words)), count)
    slot = np.arange(len(of)) - head[of]
    width = np.where(selector < RUN, WIDTHS[np.minimum(selector, 13)], 0)
    shift = (slot * width[of]).astype(np.uint64)
    mask = (np.uint64(1) << width.astype(np.uint64)) - np.uint64(1)
    out = (payload[of] >> shift) & mask[of]
    out = np.where(ran[of], payload[of] >> np.uint64(20), out)
    return np.where(plain[of], words[of], out)


BLOCKS = (
    "part int, place long, part_start long, block_ids int, doc_ids array<long>, n_tokens array<long>, "
    "word_edges array<long>, words binary"
)
#: A row takes documents until it has so many ids.
_ROW_IDS = 1 << 19


def _encoded(docs: DataFrame, spec, end_id: int, kind: str) -> DataFrame:
    """doc_id, and the ids with the end id as little-endian numbers of ``kind``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, flat, edges in encoded_passes(batches, spec.value):
            rows = [
                np.append(flat[a:b], end_id).astype(kind).tobytes()
                for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)
            ]
            columns = [part.column("doc_id"), pa.array(rows, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids"])

    return texts(docs).mapInArrow(run, "doc_id long, ids binary")


def write_ids(
    docs: DataFrame, tokenizer: str, end_id: int = 2, block_ids: int = 1024, parts: int | None = None
) -> str:
    """Write the ids of all documents, each with ``end_id`` after it, and return the folder.

    The folder is made in the one named by ``spark.checkpoint.dir``. Documents are encoded where
    they lie and only their ids are sorted (documents of one doc_id by their ids as bytes), over ``parts`` file parts (the session's number of
    shuffle partitions if not given)."""
    spark = docs.sparkSession
    prepare(spark)
    spec = spark.sparkContext.broadcast(read_spec(tokenizer))
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = "<u2" if max(end_id, vocabulary_size(spec.value)) < 1 << 16 else "<u4"
    folder = f"{shared_dir(spark)}/token-ids-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place, start, size = TaskContext.get().partitionId(), 0, 0, 0
        docs, rows = [], []

        def made() -> pa.RecordBatch:
            nonlocal docs, rows, place, start, size
            ids = np.frombuffer(b"".join(rows), kind)
            words, cuts = encode_blocks(ids, np.append(np.arange(0, len(ids), block_ids), len(ids)))
            counts = [len(r) // ids.itemsize for r in rows]
            columns = [
                pa.array([part], pa.int32()),
                pa.array([place], pa.int64()),
                pa.array([start], pa.int64()),
                pa.array([block_ids], pa.int32()),
                pa.array([docs], pa.list_(pa.int64())),
                pa.array([counts], pa.list_(pa.int64())),
                pa.array([cuts], pa.list_(pa.int64())),
                pa.array([words.astype("<u8").tobytes()], pa.binary()),
            ]
            place, start, size, docs, rows = place + 1, start + sum(counts), 0, [], []
            return pa.RecordBatch.from_arrays(
                columns, names=[f.split()[0] for f in BLOCKS.split(", ")]
            )

        for batch in batches:
            for doc, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                docs.append(doc)
                rows.append(ids.as_py())
                size += len(rows[-1]) // np.dtype(kind).itemsize
                if size >= _ROW_IDS:
                    yield made()
        if docs:
            yield made()

    # Ranges come from the ids alone; a range partitioning of encoded rows would encode them twice.
    coded = _encoded(docs, spec, end_id, kind).withColumn("range", id_range(texts(docs), n))
    ordered = coded.repartitionById(n, "range").drop("range").sortWithinPartitions("doc_id", "ids")
    ordered.mapInArrow(run, BLOCKS).write.option("compression", "zstd").parquet(folder)
    return folder


def read_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of the files as they were written."""
    return spark.read.schema(BLOCKS).parquet(folder)


def read_documents(spark: SparkSession, folder: str, digests: bool = False) -> DataFrame:
    """Every document from the files: doc_id, start (ids of all documents before it), n_tokens, ids.

    Only the parts' totals, a row for each file part, are added up in one task. With ``digests``
    the column ids is replaced by ids_crc32 of the ids as little-endian 32-bit numbers."""
    blocks = read_blocks(spark, folder)
    totals = blocks.groupBy("part").agg(F.sum(F.expr("aggregate(n_tokens, 0L, (a, x) -> a + x)")).alias("ids"))
    earlier = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    before = totals.select("part", F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                counts = np.asarray(batch.column("n_tokens")[i].values, np.int64)
                edges = np.asarray(batch.column("word_edges")[i].values, np.int64)
                words = np.frombuffer(batch.column("words")[i].as_py(), "<u8")
                total = int(counts.sum())
                sizes = np.diff(np.append(np.arange(0, total, batch.column("block_ids")[i].as_py()), total))
                ids = decode_blocks(words, edges, sizes)
                cuts = np.concatenate(([0], np.cumsum(counts)))
                first = batch.column("before")[i].as_py() + batch.column("part_start")[i].as_py()
                if digests:
                    raw = ids.astype("<u4")
                    values = [zlib.crc32(raw[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                    last = pa.array(values, pa.int64())
                else:
                    last = sliced(ids.astype(np.int64), cuts, pa.int64())
                columns = [batch.column("doc_ids")[i].values, pa.array(first + cuts[:-1]), pa.array(counts), last]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", name])

    name = "ids_crc32" if digests else "ids"
    kind = "long" if digests else "array<long>"
    rows = blocks.join(F.broadcast(before), "part").select(
        "part_start", "doc_ids", "n_tokens", "word_edges", "words", "before", "block_ids"
    )
    return rows.mapInArrow(run, f"doc_id long, start long, n_tokens long, {name} {kind}")
