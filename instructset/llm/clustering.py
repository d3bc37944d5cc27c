"""Lloyd's clustering with vectors and centroids split by dimension.

Vectors are cut into column blocks of ``width`` dimensions and stored by block, in groups of up to 1,000 rows.
A round has three steps, all exact in integers:

* tasks over one column block give the partial distances of their rows to the same dimensions of every centroid;
* the partial distances of a group meet by its key, are added over the blocks, and every row takes the nearest
  centroid, the smaller number where two are equally near;
* each column block adds up its own dimensions by cluster, in the tasks first, and replaces its own part of the centroids
  by the floor of the means; clusters without vectors stay as they are.

Only centroids (clusters times dimensions) pass through the driver. Per row and round, a partial distance per block and
centroid is shuffled, in as few bytes as the group needs, compressed by byte planes. No key is hot: a group has a bounded
number of rows, and sums are added before they are shuffled.

Vectors count if they have exactly ``dimensions`` components, none null or not finite; the rest have no row in the result.
A component x is the integer floor(scale * x), held within +-2^27 so that squared distances are exact 64-bit
integers. Repeated rows are vectors of their own. A null vec_id is a vector like others and is hashed as an empty one.
With fewer vectors than clusters every vector starts one; without any the result is empty. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from instructset.llm.common import materialize, prepare
from instructset.session import shared_dir

_LARGEST = 1 << 27
#: Up to this size of components a product of two blocks is exact in doubles.
_EXACT = 1 << 21
_CODEC = "zstd"
RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def usable(embeddings: DataFrame, dimensions: int) -> DataFrame:
    """vec_id and embedding of the vectors that count."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    own = [F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")]
    return embeddings.select(own).where(F.col("embedding").isNotNull() & (F.size("embedding") == dimensions) & finite)


def quantized(values: np.ndarray, scale: float) -> np.ndarray:
    return np.clip(np.floor(scale * values), -_LARGEST, _LARGEST).astype(np.int64)


def first_centroids(vectors: DataFrame, k: int, salt: int, scale: float) -> np.ndarray:
    """The ``k`` vectors with the least hashes of ``salt:vec_id``; equal ids in the order of their components."""
    name = F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    first = vectors.withColumn("hash", F.sha2(name, 256)).orderBy("hash", "vec_id", "embedding").limit(k)
    return np.array([quantized(np.array(r.embedding), scale) for r in first.select("embedding").collect()], np.int64)


def stored_blocks(vectors: DataFrame, dimensions: int, width: int, scale: float) -> DataFrame:
    """The vectors by column block (``shard``): group, data (rows by columns, 16 or 32 bits), and the vec_ids
    beside the first block; written by shard, so that a task reads its own dimensions only."""
    schema = "group long, n_rows int, data binary, vec_ids array<long>, shard int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = TaskContext.get().partitionId() << 32
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            # A slice's values begin at its offset.
            whole = quantized(batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(n, dimensions), scale)
            kind = "<i2" if np.abs(whole).max() < 1 << 15 else "<i4"
            parts = [whole[:, a : a + width].astype(kind).tobytes() for a in range(0, dimensions, width)]
            ids = pa.array([batch.column("vec_id").to_pylist(), *[None] * (len(parts) - 1)], pa.list_(pa.int64()))
            places = np.arange(len(parts), dtype=np.int32)
            groups = pa.array([group] * len(parts), pa.int64())
            counts = pa.array([n] * len(parts), pa.int32())
            columns = [groups, counts, pa.array(parts, pa.binary()), ids, pa.array(places)]
            yield pa.RecordBatch.from_arrays(columns, names=["group", "n_rows", "data", "vec_ids", "shard"])
            group += 1

    spark = vectors.sparkSession
    path = f"{shared_dir(spark)}/vector-blocks-{uuid.uuid4().hex}"
    vectors.mapInArrow(run, schema).write.partitionBy("shard").parquet(path)
    return spark.read.schema(schema).parquet(path)


def block_rows(data: bytes, rows: int, columns: int) -> np.ndarray:
    """A block as 64-bit integers."""
    kind = "<i2" if len(data) == 2 * rows * columns else "<i4"
    return np.frombuffer(data, kind).reshape(rows, columns).astype(np.int64)


def partial_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all centroids over some dimensions, exact."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) < _EXACT and x.shape[1] <= 512:
        # Doubles are exact up to 2 ** 53, and have the faster product.
        product = (x.astype(float) @ c.T.astype(float)).astype(np.int64)
    else:
        product = x @ c.T
    return (x * x).sum(1)[:, None] - 2 * product + (c * c).sum(1)[None, :]


def packed(distances: np.ndarray) -> bytes:
    """As few bytes an entry as the largest needs, first all lowest bytes, then the next, compressed."""
    size = max(1, (int(distances.max(initial=0)).bit_length() + 7) // 8)
    planes = distances.astype("<u8").reshape(-1, 1).view(np.uint8)[:, :size].T.tobytes()
    return bytes([size]) + len(planes).to_bytes(8, "little") + pa.compress(planes, codec=_CODEC, asbytes=True)


def unpacked(data: bytes, k: int) -> np.ndarray:
    size, length = data[0], int.from_bytes(data[1:9], "little")
    planes = np.frombuffer(pa.decompress(data[9:], length, codec=_CODEC, asbytes=True), np.uint8).reshape(size, -1)
    wide = np.zeros((planes.shape[1], 8), np.uint8)
    wide[:, :size] = planes.T
    return wide.view("<u8").astype(np.int64).reshape(-1, k)


def _partials(blocks: DataFrame, centroids: np.ndarray, width: int, ids: bool) -> DataFrame:
    """(group, partial, vec_ids) of every block; vec_ids only if asked for."""
    columns = ["group", "shard", "data", "n_rows", *(["vec_ids"] if ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for shard, data, n in zip(*(batch.column(c).to_pylist() for c in ("shard", "data", "n_rows")), strict=True):
                own = centroids[:, shard * width : (shard + 1) * width]
                out.append(packed(partial_distances(block_rows(data, n, own.shape[1]), own)))
            kept = [batch.column("group"), pa.array(out, pa.binary()), *([batch.column("vec_ids")] if ids else [])]
            yield pa.RecordBatch.from_arrays(kept, names=["group", "partial", *(["vec_ids"] if ids else [])])

    schema = "group long, partial binary" + (", vec_ids array<long>" if ids else "")
    return blocks.select(*columns).mapInArrow(run, schema)


def _added(parts: pa.Table, k: int) -> np.ndarray:
    whole = 0
    for data in parts.column("partial").to_pylist():
        whole = whole + unpacked(data, k)
    return whole


def _labels(blocks: DataFrame, centroids: np.ndarray, width: int) -> DataFrame:
    """(group, labels): the cluster of each row of the group, in 32 bits."""
    k = len(centroids)

    def add(parts: pa.Table) -> pa.Table:
        nearest = _added(parts, k).argmin(1).astype("<i4")
        return pa.table({"group": parts.column("group").slice(0, 1), "labels": pa.array([nearest.tobytes()], pa.binary())})

    return _partials(blocks, centroids, width, False).groupBy("group").applyInArrow(add, "group long, labels binary")


def _means(blocks: DataFrame, labels: DataFrame, k: int, dimensions: int, width: int) -> DataFrame:
    """(cluster, dimension, mean) of the clusters with vectors: each shard's sums, and their floors."""
    fields = ("shard", "data", "n_rows", "labels")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            for shard, data, n, label in zip(*(batch.column(c).to_pylist() for c in fields), strict=True):
                nearest = np.frombuffer(label, "<i4")
                rows = block_rows(data, n, min(width, dimensions - shard * width))
                if shard not in sums:
                    sums[shard], counts[shard] = np.zeros((k, rows.shape[1]), np.int64), np.zeros(k, np.int64)
                order = np.argsort(nearest, kind="stable")
                present, firsts = np.unique(nearest[order], return_index=True)
                sums[shard][present] += np.add.reduceat(rows[order], firsts)
                counts[shard] += np.bincount(nearest, minlength=k)
        for shard, own in sums.items():
            there = np.flatnonzero(counts[shard])
            wide = own.shape[1]
            columns = [
                np.repeat(there.astype(np.int32), wide),
                np.tile(np.arange(wide, dtype=np.int32) + shard * width, len(there)),
                own[there].ravel(),
                np.repeat(counts[shard][there], wide),
            ]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["cluster", "dimension", "total", "n"])

    beside = blocks.select("group", "shard", "data", "n_rows").join(labels, "group").drop("group")
    parts = beside.mapInArrow(run, "cluster int, dimension int, total long, n long")
    whole = parts.groupBy("cluster", "dimension").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    # An exact floor: what is left of the total is divided without remainder.
    return whole.select("cluster", "dimension", F.expr("(total - pmod(total, n)) div n").alias("mean"))


def lloyd(
    embeddings: DataFrame, k: int = 40, rounds: int = 5, dimensions: int = 64, width: int = 32, salt: int = 2, scale: float = 256.0
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every usable vector, written, and the final centroids."""
    spark = embeddings.sparkSession
    prepare(spark)
    vectors = usable(embeddings, dimensions)
    centroids = first_centroids(vectors, k, salt, scale)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), np.zeros((0, dimensions), np.int64)
    blocks = stored_blocks(vectors, dimensions, width, scale)
    for _ in range(rounds):
        means = _means(blocks, _labels(blocks, centroids, width), len(centroids), dimensions, width).collect()
        moved = centroids.copy()
        for r in means:
            moved[r.cluster, r.dimension] = r.mean
        if (moved == centroids).all():
            break  # All further rounds would be the same.
        centroids = moved
    count = len(centroids)

    def assign(parts: pa.Table) -> pa.Table:
        distances = _added(parts, count)
        nearest = distances.argmin(1)
        ids = next(x for x in parts.column("vec_ids") if x.is_valid).values
        least = distances[np.arange(len(nearest)), nearest]
        return pa.table({"vec_id": ids, "cluster": pa.array(nearest, pa.int32()), "distance": pa.array(least, pa.int64())})

    last = _partials(blocks, centroids, width, True).groupBy("group")
    return materialize(last.applyInArrow(assign, "vec_id long, cluster int, distance long"), "clusters"), centroids


def clusters(embeddings: DataFrame, **settings) -> DataFrame:
    """Every usable vector with its cluster, its squared distance, the sums of distances over its cluster and over all,
    and the digest of its centroid; ``settings`` as for ``lloyd``."""
    found, centroids = lloyd(embeddings, **settings)
    spark = embeddings.sparkSession
    if not len(centroids):
        return spark.createDataFrame([], RESULT)
    # A row per cluster at most, here and in the broadcast.
    sums = dict(found.groupBy("cluster").agg(F.sum("distance")).collect())
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    rows = [(i, n, sum(sums.values()), shas[i]) for i, n in sums.items()]
    about = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select(*[f.split()[0] for f in RESULT.split(", ")])
