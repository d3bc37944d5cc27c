"""Encoded examples: labels, lengths, padded batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from instructset.functions.arrays import IGNORE, attention_mask, pad_to, round_up
from instructset.operators.selection import SEED, shuffle_rows

# Fixed value: batches that are sorted by length together.
BATCHES_PER_GROUP = 50


def numbered_batches(df: DataFrame, rank_col: str, size: int) -> DataFrame:
    """Adds ``batch_id`` and ``slot`` from a 1-based rank."""
    place = F.col(rank_col) - 1
    return df.withColumns(
        {"batch_id": F.floor(place / size).cast("bigint"), "slot": (place % size).cast("int")}
    )


def length_batches(
    df: DataFrame, id_col: str, length: Column, size: int, seed: int = SEED
) -> DataFrame:
    """Shuffled batches of rows of like length: rows are shuffled, cut into groups of 50
    batches, and sorted by length, longest first, inside each group. Adds ``group_id``,
    ``batch_id`` and ``slot``."""
    group_rows = size * BATCHES_PER_GROUP
    shuffled = shuffle_rows(df, id_col, seed, "batches", "_rank").withColumns(
        {"group_id": F.floor((F.col("_rank") - 1) / group_rows), "_length": length}
    )
    longest_first = W.partitionBy("group_id").orderBy(F.desc("_length"), id_col)
    ranked = shuffled.withColumn(
        "_place", F.col("group_id") * group_rows + F.row_number().over(longest_first)
    )
    return numbered_batches(ranked, "_place", size).drop("_rank", "_length", "_place")


def padded_batches(
    df: DataFrame, pad: int, multiple: int | None = None, ids: str = "input_ids", labels: str = "labels"
) -> DataFrame:
    """One row per batch: id, label and mask matrices, as wide as the longest row.

    ``df`` has ``batch_id`` and ``slot``; a batch has a fixed number of rows. Where it
    has a ``group_id`` too, its rows lie together by group and are not shuffled again.
    """
    keys = [key for key in ("group_id", "batch_id") if key in df.columns]
    row = F.struct("slot", F.col(ids).alias("ids"), F.col(labels).alias("labels"))
    gathered = df.groupBy(*keys).agg(
        F.sort_array(F.collect_list(row)).alias("_rows"),
        round_up(F.max(F.size(ids)), multiple).alias("_ids_width"),
        round_up(F.max(F.size(labels)), multiple).alias("_labels_width"),
    )

    def matrix(part: str, width: str, fill: int) -> Column:
        return F.transform("_rows", lambda r: pad_to(r[part], F.col(width), fill))

    padded = gathered.select(
        "batch_id",
        matrix("ids", "_ids_width", pad).alias("input_ids"),
        matrix("labels", "_labels_width", IGNORE).alias("labels"),
    )
    return padded.withColumn(
        "attention_mask", F.transform("input_ids", lambda r: attention_mask(r, pad))
    )
