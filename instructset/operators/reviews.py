"""The most helpful reviews of a product, nested in its row or as a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from instructset.operators.filters import sentiment

# Reviews per summary, and the kinds of summary with the reviews they use.
TOP_REVIEWS = 4
VERDICT, PROS, CONS = "verdict", "pros", "cons"
REVIEWS_FOR = {VERDICT: None, PROS: "positive", CONS: "negative"}

_LAST = (1 << 63) - 1


def _check(kind: str) -> None:
    if kind not in REVIEWS_FOR:
        raise ValueError(f"unknown summary type {kind!r}, use one of {sorted(REVIEWS_FOR)}")


def top_review_text(reviews: Column, kind: str = VERDICT, n: int = TOP_REVIEWS) -> Column:
    """Texts of the ``n`` reviews with most helpful votes, one per line; among equals
    the earlier review comes first, and reviews without a number of votes come last."""
    _check(kind)
    wanted = REVIEWS_FOR[kind]
    placed = F.transform(
        reviews,
        lambda r, i: F.struct(
            F.coalesce(-r["helpful_votes"], F.lit(_LAST)).alias("order"), i.alias("at"), r["text"], r["rating"]
        ),
    )
    if wanted:
        placed = F.filter(placed, lambda r: sentiment(r["rating"]) == wanted)
    best = F.slice(F.sort_array(placed), 1, n)
    return F.array_join(F.transform(best, lambda r: r["text"]), "\n")


def summary_text(summaries: Column, kind: str = VERDICT) -> Column:
    """The wanted part of the first summary; null where there is no summary."""
    _check(kind)
    part = F.get(summaries, F.lit(0))[kind]
    return part if kind == VERDICT else F.array_join(part, "\n")


def top_reviews(
    df: DataFrame,
    product: str,
    votes: str,
    position: str,
    rating: str | None = None,
    kind: str = VERDICT,
    n: int = TOP_REVIEWS,
) -> DataFrame:
    """The table form: up to ``n`` rows per product, with their rank.

    Each task keeps its own best ``n`` rows of a product before the shuffle, so a
    product with most of the reviews is no burden.
    """
    _check(kind)
    wanted = REVIEWS_FOR[kind]
    if wanted:
        df = df.filter(sentiment(F.col(rating)) == wanted)
    best_first = W.partitionBy(product).orderBy(F.desc(votes), F.asc(position))
    return df.withColumn("rank", F.row_number().over(best_first)).filter(F.col("rank") <= n)


def joined_reviews(top: DataFrame, product: str, text: str) -> DataFrame:
    """One row per product: the texts of its top reviews, one per line."""
    entry = F.struct("rank", F.col(text).alias("text"))
    return top.groupBy(product).agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(entry)), lambda e: e["text"]), "\n"
        ).alias("reviews")
    )
