"""Clusters against a plain version of the rounds."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from instructset.llm import clustering, queries

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain_clusters(rows, k=40, rounds=5):
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in first[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for j, members in groups.items():
            centroids[j] = [sum(x) // len(members) for x in zip(*members)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    sums = {}
    for _, c, d in found:
        sums[c] = sums.get(c, 0) + d
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, sums[c], sum(sums.values()), shas[c]) for i, c, d in found), key=str)


def result(df):
    return sorted(map(tuple, df.collect()), key=str)


def random_vectors(rng, n):
    rows = []
    for i in range(n):
        spread = rng.choice([0.01, 1, 30])
        rows.append((i, [float(np.float32(rng.gauss(0, spread))) for _ in range(64)]))
    return rows


def test_op12_with_odd_rows(spark, folder_of):
    rng = random.Random(1)
    rows = random_vectors(rng, 120)
    same = rows[3][1]
    rows += [(3, same)] * 30 + [(500 + i, same) for i in range(40)] + [(None, rows[0][1]), (None, rows[0][1])]
    rows += [(600, None), (601, []), (602, [0.5] * 63), (603, [0.5] * 65), (604, [None] + [0.1] * 63)]
    rows += [(605, [math.nan] + [0.1] * 63), (606, [math.inf] + [0.1] * 63), (607, [-0.0] * 64), (608, [400.0] * 64)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, v, None) for i, v in rows], SCHEMA).repartition(4)
    got = queries.QUERIES["op12_clusters"](spark, folder_of(embeddings=df))
    assert [n for n, _ in got.dtypes] == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert result(got) == plain_clusters(rows)


def test_op12_over_given_vectors(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    assert result(queries.QUERIES["op12_clusters"](spark, folder)) == plain_clusters(rows)


def test_width_and_number_of_parts_change_nothing(spark):
    rows = random_vectors(random.Random(2), 90)
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    want = plain_clusters(rows, 7, 3)
    for width, parts in ((64, 1), (24, 3), (5, 2)):
        assert result(clustering.clusters(df.repartition(parts), k=7, rounds=3, width=width)) == want


def test_fewer_vectors_than_clusters_and_none(spark, folder_of):
    rows = [(i, [i / 7] * 64) for i in range(5)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    assert result(clustering.clusters(df)) == plain_clusters(rows)
    assert queries.QUERIES["op12_clusters"](spark, folder_of(embeddings=df.limit(0))).collect() == []


def test_large_components_are_held_and_exact(spark):
    rows = [(0, [3e38] * 64), (1, [-3e38] * 64), (2, [5e5] * 64), (3, [5e5 + 1] * 64)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in clustering.clusters(df, k=2).collect()}
    bound = 1 << 27
    cells = {0: bound, 1: -bound, 2: 256 * 500_000, 3: 256 * 500_001}
    centroids = {}
    for i, r in got.items():
        centroids.setdefault(r.cluster, []).append(cells[i])
    for i, r in got.items():
        mean = sum(centroids[r.cluster]) // len(centroids[r.cluster])
        assert r.distance == 64 * (cells[i] - mean) ** 2


@pytest.mark.parametrize("top", [1, 200, 70_000, 2**33, 2**62])
def test_partial_distances_are_packed_whole(top):
    given = np.random.default_rng(3).integers(0, top, (37, 5))
    assert (clustering.unpacked(clustering.packed(given), 5) == given).all()
