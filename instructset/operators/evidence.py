"""Evidence grouped by question, in reading order, and joined to answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Texts in a row of pooled evidence. A longer group goes on in further rows.
PART_ROWS = 100_000


def pooled_evidence(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    text_col: str,
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """A group's texts as ordered arrays ``evidence`` of at most ``part_rows``, with ``part``
    telling their order from 0; put together they are the whole group. Null texts are dropped.

    ``order`` is (source rank, position in source), integers; texts tell ties apart. What part a
    row is in follows from its place in its group alone, so other rows of the table change
    nothing. A group can hold any share of the table: its rows are ranked inside ranges of
    ``part_rows`` positions, and only the ranges' sizes are added up over the group.
    """
    source, position = order
    rows = df.filter(F.col(text_col).isNotNull()).select(
        *keys, source, position, text_col, F.expr(f"`{position}` div {part_rows}").alias("_range")
    )
    ranges = [*keys, source, "_range"]
    counts = rows.groupBy(*ranges).agg(F.count("*").alias("_n"))
    earlier = W.partitionBy(*keys).orderBy(source, "_range").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    inside = F.row_number().over(W.partitionBy(*ranges).orderBy(position, text_col)) - 1
    same = None
    for name in ranges:
        equal = F.col(f"r.{name}").eqNullSafe(F.col(f"s.{name}"))
        same = equal if same is None else same & equal
    placed = (
        rows.withColumn("_inside", inside)
        .alias("r")
        .join(starts.alias("s"), same)
        .select("r.*", (F.col("s._start") + F.col("_inside")).alias("_place"))
    )
    entry = F.struct("_place", F.col(text_col).alias("text"))
    return (
        placed.withColumn("part", F.expr(f"_place div {part_rows}"))
        .groupBy(*keys, "part")
        .agg(F.transform(F.sort_array(F.collect_list(entry)), lambda e: e["text"]).alias("evidence"))
    )


def answers_with_evidence(
    answers: DataFrame, pooled: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """Answers that have evidence, each with that of its question."""
    return answers.join(pooled, list(keys), "inner")
