import hashlib
import random

import pytest
from pyspark.sql import functions as F

from instructset.operators import selection as sel
from instructset.operators.positions import with_global_rank, with_row_index


def ids(df, col="id"):
    return sorted(r[0] for r in df.select(col).collect())


def brute(population, n, salt):
    key = lambda i: (hashlib.md5(f"1:{salt}:{i}".encode()).hexdigest(), i)
    return sorted(sorted(population, key=key)[:n])


@pytest.mark.parametrize("n", [0, 1, 7, 499, 500, 900])
def test_exact_sample(spark, n):
    df = spark.range(500)
    assert ids(sel.exact_sample(df, "id", n, "s")) == brute(range(500), n, "s")
    assert ids(sel.exact_sample(df.repartition(7), "id", n, "s")) == brute(range(500), n, "s")


def test_strict_sample_needs_its_population(spark):
    with pytest.raises(Exception, match="larger than its population"):
        sel.exact_sample(spark.range(5), "id", 6, strict=True).collect()
    assert ids(sel.exact_sample(spark.range(5), "id", 5, strict=True)) == list(range(5))


def test_empty_table(spark):
    empty = spark.range(0)
    assert ids(sel.exact_sample(empty, "id", 3)) == []
    assert ids(sel.shuffled_split(empty, "id")) == []
    assert ids(sel.first_rows(empty, "id", 3)) == []


def test_ladder(spark):
    rows = sel.sample_ladder(spark.range(1000), "id", {"a": 10, "b": 200}).collect()
    for rung, n in (("a", 10), ("b", 200)):
        assert sorted(r.id for r in rows if r.rung == rung) == brute(range(1000), n, rung)
    nested = sel.sample_ladder(spark.range(1000), "id", {"a": 10, "b": 200}, nested=True).collect()
    small, large = ({r.id for r in nested if r.rung == rung} for rung in "ab")
    assert len(small) == 10 and len(large) == 200 and small < large


@pytest.mark.parametrize("n", [1, 2, 10, 90, 91])
def test_split_sizes_use_doubles(spark, n):
    counts = dict(sel.shuffled_split(spark.range(n), "id").groupBy("split").count().collect())
    a, b = int(n * 0.7), int(n * 0.8)
    assert [counts.get(k, 0) for k in ("train", "dev", "test")] == [a, b - a, n - b]


def test_train_validation_split(spark):
    for n, held in ((10, 1), (1000, 1), (1001, 2)):
        rows = sel.train_validation_split(spark.range(n), "id")
        assert rows.filter("split = 'validation'").count() == held


def test_shuffle_is_a_permutation(spark):
    rows = sel.shuffle_rows(spark.range(300).repartition(5), "id").collect()
    assert sorted(r.shuffle_rank for r in rows) == list(range(1, 301))
    order = [r.id for r in sorted(rows, key=lambda r: r.shuffle_rank)]
    assert order == sorted(range(300), key=lambda i: hashlib.md5(f"1:shuffle:{i}".encode()).hexdigest())


@pytest.mark.parametrize("spread, top", [(1, 1 << 14), (1 << 40, 1 << 14), (1, 5), (1 << 40, 5)])
def test_first_rows(spark, monkeypatch, spread, top):
    monkeypatch.setattr(sel, "_TOP", top)
    df = spark.range(-50, 450).select((F.col("id") * spread).alias("id"))
    assert ids(sel.first_rows(df, "id", 70)) == [i * spread for i in range(-50, 20)]
    assert df.count() == sel.first_rows(df, "id", None).count() == sel.first_rows(df, "id", -1).count()
    assert sel.first_rows(df, "id", 501).count() == 500
    with pytest.raises(Exception, match="fewer than 501 rows"):
        sel.first_rows(df, "id", 501, must_exist=True).collect()


def test_clumped_positions(spark, monkeypatch):
    monkeypatch.setattr(sel, "_TOP", 3)
    values = [*range(1000), 1 << 50, -(1 << 60)]
    df = spark.createDataFrame([(v,) for v in values], "id bigint")
    for n in (1, 500, 1001, 1002):
        assert ids(sel.first_rows(df, "id", n)) == sorted(values)[:n]


def test_early_stop_against_a_loop(spark):
    rng = random.Random(5)
    for _ in range(6):
        kept = [rng.random() < 0.4 for _ in range(200)]
        limit, enough = rng.randint(0, 150), rng.randint(1, 100)
        expected = []
        for pos, keep in enumerate(kept):
            if keep:
                expected.append(pos)
                if pos > limit and len(expected) >= enough:
                    break
        df = spark.createDataFrame(list(enumerate(kept)), "id bigint, keep boolean")
        assert ids(sel.early_stop(df, "id", F.col("keep"), limit, enough)) == expected


def test_row_index_follows_the_files(spark, tmp_path):
    for name, values in (("b", range(100, 105)), ("a", range(50))):
        (tmp_path / f"{name}.json").write_text("".join(f'{{"v": {v}}}\n' for v in values))
    rows = with_row_index(spark.read.schema("v bigint").json(str(tmp_path))).collect()
    assert [r.v for r in sorted(rows, key=lambda r: r.pos)] == [*range(50), *range(100, 105)]
    assert sorted(r.pos for r in rows) == list(range(55))


def test_global_rank(spark):
    df = spark.range(500).select((F.col("id") % 7).alias("n"), F.col("id").cast("string").alias("w"))
    rows = with_global_rank(df, [F.desc("n"), F.asc("w")], "rank", "test").collect()
    expected = sorted(((r.n, r.w) for r in rows), key=lambda x: (-x[0], x[1]))
    assert [(r.n, r.w) for r in sorted(rows, key=lambda r: r.rank)] == expected
    assert sorted(r.rank for r in rows) == list(range(1, 501))
