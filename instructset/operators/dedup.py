"""First-seen rows and held-out pools."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from instructset.functions.text import text_digest

# A set of this many digests takes some 100 MB in memory. Only sets that are known not
# to be larger are broadcast; beyond it the join is left to the optimizer, which
# splits hot digests.
BROADCAST_DIGESTS = 1_000_000


def first_seen(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The first row of each key in scan order, null keys included.

    Every task drops all but its own first row of a key before the shuffle, so a key
    that holds most of the table costs no more than any other. Predicates belong after
    this operator: a key whose first row is bad is gone.
    """
    ranked = df.withColumn("_seen", F.row_number().over(W.partitionBy(key).orderBy(*order)))
    return ranked.filter(F.col("_seen") == 1).drop("_seen")


def used_texts(df: DataFrame, text_col: str = "output") -> DataFrame:
    """Distinct texts, by digest."""
    return df.select(text_digest(F.col(text_col)).alias("_digest")).distinct()


def held_out(
    df: DataFrame,
    used: DataFrame,
    text_col: str = "output",
    max_used: int | None = None,
    digest_col: str | None = None,
) -> DataFrame:
    """Rows of ``df`` whose text occurs nowhere in ``used``.

    Copies of a used text under other ids are excluded with it. ``max_used`` states how
    many rows ``used`` can have (a sum of sample sizes); a small bound saves the
    shuffle of ``df``. ``digest_col`` names a digest that both tables have already. Null
    texts are never used.
    """
    key = digest_col or "_digest"
    if digest_col:
        rows, digests = df, used.select(key).distinct()
    else:
        rows, digests = df.withColumn(key, text_digest(F.col(text_col))), used_texts(used, text_col)
    if max_used is not None and max_used <= BROADCAST_DIGESTS:
        digests = F.broadcast(digests)
    return rows.join(digests, key, "left_anti").select(*df.columns)


def overlap(first: DataFrame, second: DataFrame, text_col: str = "output") -> DataFrame:
    """One row: the number of distinct texts on both sides."""
    both = used_texts(first, text_col).join(used_texts(second, text_col), "_digest", "left_semi")
    return both.agg(F.count("*").alias("shared"))
