"""Row positions, where the source has an order that counts."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from instructset.session import materialize

_ROW_BITS = (1 << 33) - 1


#: File blocks up to which their starts are broadcast: some 100 bytes each, and a block is a good
#: hundred megabytes of a large table. Beyond that the join is a plain one, in which no key is hot.
_MOST_BLOCKS = 1_000_000


def _pin_blocks(spark: SparkSession) -> None:
    """Two scans of the same files are cut alike even if executors come and go between them."""
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))


def _counts_rows(df: DataFrame) -> bool:
    """Whether the source itself numbers the rows of a file, as Parquet does."""
    return "row_index" in df.select("_metadata").schema["_metadata"].dataType.names


def _blocks(df: DataFrame) -> list[Row]:
    """``file, block, rows, first`` of all file blocks in the order of the files, ``first`` being
    the row number that the scan gives to the block's first row.

    Where the source numbers rows, a file is one block, and its rows are counted from the footers.
    Other sources are read once, with every column, so that each record counts that the scan finds."""
    file = F.col("_metadata.file_path").alias("file")
    if _counts_rows(df):
        counts = df.select(file).groupBy("file").agg(F.count("*").alias("rows"))
        found = counts.select("file", F.lit(0).cast("long").alias("block"), "rows", F.lit(0).cast("long").alias("first"))
    else:
        _pin_blocks(df.sparkSession)
        block = F.col("_metadata.file_block_start").alias("block")
        read = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).alias("read")
        rows = df.select(file, block, F.monotonically_increasing_id().alias("row"), read)
        # The hash is a part of the result, or else no column would be parsed.
        found = rows.groupBy("file", "block").agg(
            F.count("*").alias("rows"), F.min("row").alias("first"), F.max("read").alias("read")
        )
    return sorted(found.collect(), key=lambda b: (b.file, b.block))


def _indexed(df: DataFrame, blocks: list[Row], index_col: str, start: int) -> DataFrame:
    places, at = [], start
    for b in blocks:
        places.append((b.file, b.block, b.first, b.rows, at))
        at += b.rows
    starts = df.sparkSession.createDataFrame(places, "_file string, _block long, _first long, _rows long, _start long")
    starts = F.broadcast(starts) if len(places) <= _MOST_BLOCKS else starts
    file = F.col("_metadata.file_path").alias("_file")
    if _counts_rows(df):
        block, row = F.lit(0).cast("long"), F.col("_metadata.row_index")
    else:
        block, row = F.col("_metadata.file_block_start"), F.monotonically_increasing_id()
    placed = df.select(*[F.col(f"`{c}`") for c in df.columns], file, block.alias("_block"), row.alias("_row"))
    number = F.col("_row") - F.col("_first")
    # A block that was cut otherwise since it was counted has rows beyond its count, or none of its starts.
    fits = F.coalesce((number >= 0) & (number < F.col("_rows")), F.lit(False))
    changed = F.raise_error(F.lit("the files changed while their rows were numbered")).cast("long")
    position = F.when(fits, F.col("_start") + number).otherwise(changed)
    joined = placed.join(starts, ["_file", "_block"], "left")
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], position.alias(index_col))


def with_row_index(df: DataFrame, index_col: str = "pos", start: int = 0) -> DataFrame:
    """Adds the place (from ``start``) of each row over all files of a table as it was read, files
    in the order of their paths.

    Nothing is written and no row moves: a narrow pass counts the rows of each file block (for Parquet
    from the footers alone), and a row's place is its block's start and its number in there. A column of
    that name is replaced."""
    df = df.drop(index_col)
    return _indexed(df, _blocks(df), index_col, start)


def file_chunks(df: DataFrame, index_col: str = "pos") -> Iterator[tuple[DataFrame, int]]:
    """The rows of a table as it was read, with their places, as tables of ever more files in the order
    of their paths (1, 1, 2, 4, …), each with the number of rows up to its end.

    A file is opened only when its chunk is asked for. The listing of the files is the driver's already."""
    df = df.drop(index_col)
    files = sorted(set(df.inputFiles()))
    at, size, rows = 0, 1, 0
    while at < len(files):
        # The scan names local files with one slash.
        names = [n for f in files[at : at + size] for n in dict.fromkeys((f, f.replace("file:///", "file:/", 1)))]
        chunk = df.filter(F.col("_metadata.file_path").isin(names))
        blocks = _blocks(chunk)
        yield _indexed(chunk, blocks, index_col, rows), rows + sum(b.rows for b in blocks)
        rows += sum(b.rows for b in blocks)
        at, size = at + size, max(1, at + size)


def with_global_rank(df: DataFrame, order: list, rank_col: str, label: str) -> DataFrame:
    """Adds the 1-based rank of each row in a total order, without sorting in one task.

    Rows are range-partitioned, sorted inside their partition and written once; the rank
    is the number of rows in earlier partitions plus the place in the own one. ``order``
    must tell any two rows apart.
    """
    table = materialize(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_row", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright(F.col("_row"), 33))
        .withColumn("_row", F.col("_row").bitwiseAND(F.lit(_ROW_BITS))),
        label,
    )
    # One row per partition of the sort.
    starts = (
        table.groupBy("_part")
        .agg(F.count("*").alias("_n"))
        .withColumn("_start", F.sum("_n").over(W.orderBy("_part")) - F.col("_n"))
        .drop("_n")
    )
    return (
        table.join(F.broadcast(starts), "_part")
        .withColumn(rank_col, F.col("_start") + F.col("_row") + 1)
        .drop("_part", "_row", "_start")
    )
