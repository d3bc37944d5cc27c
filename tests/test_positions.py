"""Places of rows in files, and scans that end before the last file."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from instructset import schemas
from instructset.operators import positions, selection
from instructset.plans import building
from instructset.sources import readers, registry


def json_files(folder, counts, start=0):
    folder.mkdir()
    at = start
    for i, n in enumerate(counts):
        (folder / f"part-{i:03}.json").write_text("".join(json.dumps({"v": at + k}) + "\n" for k in range(n)))
        at += n
    return str(folder)


def places(df):
    return sorted((r.pos, r.v) for r in df.collect())


def test_places_over_blocks_of_text(spark, tmp_path):
    path = json_files(tmp_path / "a b%20c", [5000, 0, 1, 3000])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        df = positions.with_row_index(spark.read.schema("v bigint").json(path))
        assert df.rdd.getNumPartitions() > 10
        assert places(df) == [(i, i) for i in range(8001)]
        # Only the values that are asked for are read, and the places stay.
        assert df.filter("v % 1000 = 7").agg(F.sum(F.col("pos") - F.col("v"))).head()[0] == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_places_over_folders_go_by_path(spark, tmp_path):
    for folder, first in (("x", 0), ("y", 10)):
        json_files(tmp_path / folder, [5, 5], first)
    df = positions.with_row_index(spark.read.schema("v bigint").json([str(tmp_path / "y"), str(tmp_path / "x")]), start=100)
    assert places(df) == [(100 + i, i) for i in range(20)]


def parquet_files(spark, folder, counts):
    at = 0
    for i, n in enumerate(counts):
        rows = spark.range(at, at + n).select(F.col("id").alias("v"), F.lit("x" * 50).alias("payload"))
        rows.coalesce(1).sortWithinPartitions("v").write.option("parquet.block.size", 2000).parquet(f"{folder}/{i:03}")
        at += n
    return f"{folder}/*"


def test_parquet_rows_are_numbered_without_a_shuffle(spark, tmp_path):
    df = spark.read.parquet(parquet_files(spark, tmp_path / "p q", [700, 300, 5]))
    numbered = positions.with_row_index(df)
    assert places(numbered) == [(i, i) for i in range(1005)]
    plan = numbered._jdf.queryExecution().toString()
    # A filter on the payload goes to the scan, and a query of places alone reads no payload.
    assert "Exchange hash" not in plan and "Sort" not in plan
    narrow = numbered.select("pos")._jdf.queryExecution().executedPlan().toString()
    assert "payload" not in narrow
    assert numbered.filter("v >= 1000").count() == 5


def test_a_table_that_has_the_column_gets_new_places(spark, tmp_path):
    spark.range(3).select(F.col("id").alias("v"), F.lit("old").alias("pos")).coalesce(1).write.parquet(str(tmp_path / "t"))
    assert places(positions.with_row_index(spark.read.parquet(str(tmp_path / "t")))) == [(0, 0), (1, 1), (2, 2)]


def test_changed_files_are_noticed(spark, tmp_path):
    path = json_files(tmp_path / "j", [50])
    df = positions.with_row_index(spark.read.schema("v bigint").json(path))
    json_files(tmp_path / "k", [80])
    (tmp_path / "j" / "part-000.json").write_bytes((tmp_path / "k" / "part-000.json").read_bytes())
    (tmp_path / "j" / ".part-000.json.crc").unlink(missing_ok=True)
    with pytest.raises(Exception, match="the files changed"):
        df.collect()


def test_empty_tables(spark, tmp_path):
    spark.range(0).select(F.col("id").alias("v")).write.parquet(str(tmp_path / "none"))
    df = spark.read.parquet(str(tmp_path / "none"))
    assert positions.with_row_index(df).columns == ["v", "pos"] and positions.with_row_index(df).count() == 0
    assert selection.first_file_rows(df, 5).count() == 0
    with pytest.raises(ValueError, match="fewer than 5"):
        selection.first_file_rows(df, 5, must_exist=True)
    assert selection.early_stop_files(df, F.col("v") > 0, 1, 1).columns == ["v", "pos"]


def test_first_rows_leave_later_files_unopened(spark, tmp_path):
    path = parquet_files(spark, tmp_path / "p", [10, 10, 10, 10, 10])
    for i in (3, 4):
        for file in (tmp_path / "p" / f"00{i}").glob("part*"):
            file.write_bytes(b"not Parquet")
        for crc in (tmp_path / "p" / f"00{i}").glob(".part*"):
            crc.unlink()
    df = spark.read.schema("v bigint, payload string").parquet(path)
    assert places(selection.first_file_rows(df, 17)) == [(i, i) for i in range(17)]
    with pytest.raises(Exception, match="Parquet|parquet"):
        selection.first_file_rows(df, 31).collect()


def test_instructions_come_from_the_first_files(spark, tmp_path):
    rows = spark.range(60).select(F.col("id").cast("string").alias("question"), F.lit("r").alias("response"))
    rows.repartitionByRange(6, F.col("question").cast("int")).sortWithinPartitions(F.col("question").cast("int")).write.parquet(str(tmp_path / "q"))
    got = registry.load_instructions(spark, "orca", {"orca": str(tmp_path / "q")}, rows=25)
    assert sorted((r.pos, int(r.prompt)) for r in got.collect()) == [(i, i) for i in range(25)]


@pytest.mark.parametrize("limit, enough", [(0, 1), (12, 3), (12, 9), (30, 5), (500, 3), (3, 500)])
def test_early_stop_over_files_against_a_loop(spark, tmp_path, limit, enough):
    path = json_files(tmp_path / "j", [4, 9, 0, 7, 15, 3, 20])
    want = []
    for v in range(58):
        if v % 3:
            want.append((v, v))
            if v > limit and len(want) >= enough:
                break
    df = spark.read.schema("v bigint").json(path)
    assert places(selection.early_stop_files(df, F.col("v") % 3 != 0, limit, enough)) == want


def test_files_beyond_the_stop_are_unread(spark, tmp_path):
    folder = tmp_path / "products"
    folder.mkdir()
    for i in range(6):
        rows = [{"title": f"t{i}", "description": ["<b>w</b> " * 60] if k % 2 else ["short"]} for k in range(10)]
        (folder / f"{i}.json").write_text("".join(json.dumps(r) + "\n" for r in rows))
    for i in (4, 5):
        (folder / f"{i}.json").write_text("no JSON at all\n")
    df = readers.read_jsonl(spark, str(folder), schemas.PRODUCT_META)
    rows = building.description_pairs(df, limit=11, enough=3).collect()
    assert sorted(r.pos for r in rows) == [1, 3, 5, 7, 9, 11, 13]
    assert {r.output for r in rows} == {" ".join(["w"] * 60)}
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        building.description_pairs(df, limit=39, enough=3).collect()


def test_columns_of_late_records(spark, tmp_path):
    rows = [{"id": i} for i in range(5000)] + [{"highlights": "h", "article": "a"}] + [{"id": 1}] * 10
    (tmp_path / "late.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
    path = str(tmp_path / "late.jsonl")
    assert readers.json_columns(spark, path) == ["id", "highlights", "article"]
    known = readers.load_pairs(spark, {"train": path}, dataset="cnn_dailymail")
    assert known.filter("input IS NOT NULL").collect() == [("train", "a", "h")]
    assert readers.load_pairs(spark, {"train": path}, text_column="article").columns == ["split", "input", "output"]
    with pytest.raises(ValueError, match="not one of: id, highlights, article"):
        readers.load_pairs(spark, {"train": path}, text_column="nowhere", summary_column="id")
    # Without names the first two in order of appearance, however late the second comes.
    assert readers.load_pairs(spark, {"train": path}).filter("output IS NOT NULL").collect() == [("train", None, "h")]


def test_json_columns_over_several_files_and_blocks(spark, tmp_path):
    (tmp_path / "b.json").write_text('{"x": 1, "c": 2}\n' * 2000 + '{"z": 1}\n')
    (tmp_path / "a.json").write_text("\n" + '{"b": 1}\n' * 2000 + '{"y": 1, "b": 0, "x": 2}\n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        assert readers.json_columns(spark, str(tmp_path)) == ["b", "y", "x", "c", "z"]
        assert readers.has_json_key(spark, str(tmp_path), "z") and not readers.has_json_key(spark, str(tmp_path), "q")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
