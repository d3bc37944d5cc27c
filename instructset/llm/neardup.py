"""Near-duplicate documents by MinHash bands, sequential Bayesian pruning and exact verification.

Documents are linked when their sets of distinct word shingles reach a Jaccard similarity; the
smallest id in each connected component stands for it.

* Equal sets are one class from the start, whatever their number; only classes go on.
* Bands of MinHash rows bring candidates together. Their number follows from the similarity so that a
  linked pair shares no band with a chance of ``miss_bands`` at most.
* A pair's byte signatures are compared in batches. After each batch the pair is dropped if, by the
  posterior of its similarity (uniform prior), reaching the limit has a chance below ``miss``.
  A table of least match counts holds that rule.
* Pairs that survive are verified on the full sets of their whole texts.

No bucket is taken apart into all its pairs at once. First, each member is compared with the smallest
member of its buckets. Members that are then in one component need no more comparison;
buckets with several components are compared block by block (``BLOCK`` members each, a task holds
two blocks), in the first band only that a pair shares, and only across components.

Words are runs of bytes other than white space, A-Z taken as a-z. A text with fewer words than a
shingle is one shingle; an empty or null text has none and is linked with nothing, nor is a row
without an id (it has a null component and is kept). Rows with the same id count as one document: what
either text is linked to. Shingles are known by 64-bit hashes, sets by 128-bit digests.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from instructset.llm.common import grouped_batches, materialize, prepare, texts
from instructset.llm.components import components
from instructset.llm.hashing import mix, passes, words_of

ROWS_OF_BAND = 5
#: Byte signature for verification, and the hashes of a batch.
SIGNATURE, BATCH = 512, 64
#: Members of a block of a bucket.
BLOCK = 256
_MULTIPLIERS = np.random.Generator(np.random.PCG64(77)).integers(0, 1 << 32, (2, 4096), dtype=np.uint32)
_MULTIPLIERS[0] |= 1


def band_count(percent: int, miss_bands: float) -> int:
    return math.ceil(math.log(miss_bands) / math.log(1 - (percent / 100) ** ROWS_OF_BAND))


def least_matches(percent: int, miss: float) -> list[int]:
    """For each batch, the fewest matches so far with which a pair stays.

    With m matches of n and a uniform prior, the chance that a match has at least the limit's
    probability p is that of at most m successes in n + 1 trials of p. Bytes also match by chance."""
    s = percent / 100
    p = s + (1 - s) / 256
    out = []
    for n in range(BATCH, SIGNATURE + 1, BATCH):
        logs = [
            math.lgamma(n + 2) - math.lgamma(i + 1) - math.lgamma(n + 2 - i) + i * math.log(p) + (n + 1 - i) * math.log1p(-p)
            for i in range(n + 1)
        ]
        tail = np.cumsum(np.exp(logs))
        out.append(int(np.searchsorted(tail, miss)))
    return out


def shingle_sets(batch: pa.RecordBatch, k: int, column: str = "text") -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    w = words_of(batch, column, lower=True)
    runs = w.runs(k)
    short = {n: w.runs(n) for n in range(1, k)}
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(runs[a : b - k + 1]))
        else:
            out.append(short[b - a][a : a + 1] if b > a else np.zeros(0, np.uint64))
    return out


def minima(shingles: np.ndarray, first: int, count: int) -> np.ndarray:
    """The MinHash values ``first`` to ``first + count`` of a set that isn't empty."""
    a, c = _MULTIPLIERS[:, first : first + count]
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(count, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 1024):
        np.minimum(out, (x[i : i + 1024, None] * a + c).min(0), out=out)
    return out


def band_keys(rows: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit key of each band's number and rows."""
    out = mix(np.arange(1, bands + 1, dtype=np.uint64))
    for row in rows.astype(np.uint64).reshape(bands, ROWS_OF_BAND).T:
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + row)
    return out.view(np.int64)


def signed(docs: DataFrame, k: int, bands: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set (null if empty) and the keys of its bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in passes(batch):
                sizes, digests, keys = [], [], []
                for s in shingle_sets(part, k):
                    sizes.append(len(s))
                    if not len(s):
                        digests.append(None)
                        keys.append(None)
                        continue
                    digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    keys.append(band_keys(minima(s, 0, bands * ROWS_OF_BAND), bands))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                    names=["doc_id", "n_shingles", "digest", "keys"],
                )

    return docs.mapInArrow(run, "doc_id long, n_shingles long, digest binary, keys array<long>")


def candidates(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """id, text, n, signature of the documents in ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in passes(batch):
                sets = shingle_sets(part, k)
                sizes = pa.array([len(s) for s in sets], pa.int64())
                signatures = [
                    minima(s, len(_MULTIPLIERS[0]) - SIGNATURE, SIGNATURE).astype(np.uint8).tobytes() if len(s) else bytes(SIGNATURE)
                    for s in sets
                ]
                columns = [part.column("doc_id"), part.column("text"), sizes, pa.array(signatures, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "text", "n", "signature"])

    found = docs.join(ids, docs.doc_id == ids.id, "left_semi")
    return found.mapInArrow(run, "id long, text string, n long, signature binary")


def _array(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def passing(left: np.ndarray, right: np.ndarray, least: list[int]) -> np.ndarray:
    """Places of the pairs of signature rows that stay after every batch."""
    alive, matches = np.arange(len(left)), np.zeros(len(left), np.int64)
    for i, need in enumerate(least):
        part = slice(i * BATCH, (i + 1) * BATCH)
        matches = matches + (left[alive, part] == right[alive, part]).sum(1)
        on = matches >= need
        alive, matches = alive[on], matches[on]
        if not len(alive):
            break
    return alive


def _similar(a, b, percent: int):
    """Set sizes that allow the similarity."""
    return 100 * np.minimum(a, b) >= percent * np.maximum(a, b)


def pruned(pairs: DataFrame, found: DataFrame, percent: int, least: list[int]) -> DataFrame:
    """The pairs (a, b) that stay by their signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                on = _similar(*(batch.column(c).to_numpy() for c in ("an", "bn")), percent)
                at = np.flatnonzero(on)
                left, right = (_array(batch.column(c), SIGNATURE)[at] for c in ("asig", "bsig"))
                at = at[passing(left, right, least)]
                yield batch.select(["a", "b"]).take(pa.array(at))

    one, two = (found.select(F.col("id").alias(x), F.col("n").alias(x + "n"), F.col("signature").alias(x + "sig")) for x in "ab")
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "an", "bn", "asig", "bsig")
    return both.mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, found: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole texts reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in passes(batch, "at"):
                left, right = shingle_sets(part, k, "at"), shingle_sets(part, k, "bt")
                on = []
                for i, (x, y) in enumerate(zip(left, right, strict=True)):
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * common >= percent * (len(x) + len(y) - common):
                        on.append(i)
                yield part.select(["a", "b"]).take(pa.array(on, pa.int64()))

    one, two = (found.select(F.col("id").alias(x), F.col("text").alias(x + "t")) for x in "ab")
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "at", "bt")
    return both.mapInArrow(run, "a long, b long")


def across(members: DataFrame, percent: int, least: list[int]) -> DataFrame:
    """Pairs of buckets' members (key, id, component, size, n, signature, keys) in different components
    that stay by their signatures, each in the first bucket that it shares."""
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = members.withColumn("own", F.pmod(F.xxhash64("id"), blocks).cast("int"))
    own = own.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    own = own.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")}).drop("other", "size")
    dealt = own.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped_batches(batches, ["key", "low", "high"]):
            group = group.combine_chunks()
            ids, parts, n, block = (group.column(c).to_numpy() for c in ("id", "component", "n", "own"))
            if parts.min() == parts.max():
                continue
            key, low = group.column("key")[0].as_py(), group.column("low")[0].as_py()
            within = low == group.column("high")[0].as_py()
            signatures = _array(group.column("signature").combine_chunks(), SIGNATURE)
            keys = np.asarray(group.column("keys").combine_chunks().flatten()).reshape(len(ids), -1)
            out = []
            for i in np.flatnonzero(block == low).tolist():
                others = np.arange(i + 1, len(ids)) if within else np.flatnonzero(block != low)
                others = others[(parts[others] != parts[i]) & _similar(n[others], n[i], percent)]
                shared = keys[others] == keys[i]
                others = others[keys[i][shared.argmax(1)] == key] if len(others) else others
                others = others[passing(signatures[others], np.broadcast_to(signatures[i], (len(others), SIGNATURE)), least)]
                out.append(np.stack((np.minimum(ids[i], ids[others]), np.maximum(ids[i], ids[others]))))
            a, b = np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(
    docs: DataFrame, k: int = 5, percent: int = 80, miss_bands: float = 1e-8, miss: float = 1e-7
) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable), kept (it is the smallest), one row per row."""
    spark = docs.sparkSession
    prepare(spark)
    docs = texts(docs)
    bands, least = band_count(percent, miss_bands), least_matches(percent, miss)
    sets = materialize(signed(docs, k, bands), "sets")
    classes = materialize(
        sets.where("digest IS NOT NULL AND doc_id IS NOT NULL")
        .groupBy("digest")
        .agg(F.min("doc_id").alias("id"), F.any_value("keys").alias("keys")),
        "classes",
    )
    banded = classes.select("id", F.explode("keys").alias("key"))
    shared = banded.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("size")).where("size > 1")
    members = materialize(banded.join(shared, "key"), "members")
    found = materialize(candidates(docs, members.select("id").distinct(), k), "candidates")

    pairs = members.where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct()
    near = materialize(pruned(pairs, found, percent, least), "near")
    links = materialize(verified(near, found, k, percent), "links")
    labels = components(links)

    own = F.coalesce("component", members.id).alias("component")
    placed = members.join(labels, "id", "left").select("key", "id", "size", own)
    split = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    rows = placed.join(split.select("key"), "key").join(found.select("id", "n", "signature"), "id")
    rows = rows.join(classes.select("id", "keys"), "id")
    rest = materialize(across(rows, percent, least).distinct(), "rest")
    more = materialize(verified(rest, found, k, percent), "links")
    if not more.isEmpty():
        labels = components(links.union(more))

    of = classes.select("digest", F.col("id").alias("class_id"))
    of = of.join(labels, F.col("class_id") == labels.id, "left")
    of = of.select("digest", F.coalesce("component", "class_id").alias("component_id"))
    out = sets.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest"))
    out = out.join(of, "digest", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def representatives(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group, all columns as they were; of rows with the same id all stay or go."""
    found = near_duplicates(docs, k, percent).where("NOT kept").select(F.col("doc_id").alias("_gone"))
    return docs.join(found, docs.doc_id == F.col("_gone"), "left_anti")
