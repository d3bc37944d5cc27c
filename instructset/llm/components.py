"""Connected components of links between ids, by the smallest label within reach."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from instructset.llm.common import materialize


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in ``links`` (a, b), component being the smallest id reachable.

    Each round takes the smallest label among the neighbours, added up before the shuffle, and then
    the label of the label, so that chains shorten by half. Labels are written in every round."""
    both = links.select("a", "b").union(links.select(F.col("b"), F.col("a")))
    both = materialize(both, "links")
    labels = materialize(
        both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("low")).select("id", F.least("id", "low").alias("component")),
        "labels",
    )
    while True:
        near = both.join(labels, F.col("b") == F.col("id")).groupBy("a").agg(F.min("component").alias("low"))
        lower = labels.join(near, labels.id == near.a, "left").select(
            "id", F.col("component").alias("before"), F.least("component", "low").alias("component")
        )
        # An id is its label's label too: the label of an id is an id.
        jump = labels.select(F.col("id").alias("_of"), F.col("component").alias("_next"))
        lower = lower.join(jump, F.col("component") == F.col("_of"), "left").select(
            "id", "before", F.least("component", "_next").alias("component")
        )
        lower = materialize(lower, "labels")
        labels = lower.select("id", "component")
        if lower.where("before > component").isEmpty():
            return labels
