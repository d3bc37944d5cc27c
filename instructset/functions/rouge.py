"""ROUGE for pairs of texts.

``rouge_n`` is a JVM expression over token arrays. Scores of whole tables come from the kernel that works on all
pairs of an Arrow batch together.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from instructset.functions import rouge_kernel
from instructset.functions.lookup import places
from instructset.functions.stem import stem_table, token_stem
from instructset.session import materialize, small_batches

#: Stems up to which they are sent to the tasks.
MOST_STEMS = 1_000_000
# What a token is, and the metrics.
TOKEN = "[a-z0-9]+"
METRICS = ["rouge1", "rouge2", "rougeL", "rougeLsum"]


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def ngrams(words: Column, n: int) -> Column:
    grams = words
    for k in range(1, n):
        room = F.greatest(F.size(words) - k, F.lit(0))
        grams = F.zip_with(
            F.slice(grams, 1, room),
            F.slice(words, k + 1, room),
            lambda gram, word: F.concat(gram, F.lit(" "), word),
        )
    return grams


def overlap(left: Column, right: Column) -> Column:
    """Number of common elements, each counted as often as it is on both sides.

    Both sides are sorted together and walked once, left copies first: ``spare`` counts
    those of the current element that no right copy has used up.
    """

    def side(array: Column, number: int) -> Column:
        return F.transform(
            array, lambda g: F.struct(g.alias("gram"), F.lit(number).alias("side"))
        )

    def step(state: Column, item: Column) -> Column:
        spare = F.when(state["gram"] == item["gram"], state["spare"]).otherwise(F.lit(0))
        on_left = item["side"] == 0
        used = (~on_left & (spare > 0)).cast("int")
        return F.struct(
            item["gram"].alias("gram"),
            F.when(on_left, spare + 1).otherwise(spare - used).alias("spare"),
            (state["hits"] + used).alias("hits"),
        )

    start = F.struct(
        F.lit("").alias("gram"), F.lit(0).alias("spare"), F.lit(0).alias("hits")
    )
    merged = F.sort_array(F.concat(side(left, 0), side(right, 1)))
    return F.aggregate(merged, start, step, lambda state: state["hits"])


def f_measure(hits: Column, predicted: Column, true: Column) -> Column:
    """Harmonic mean of precision and recall; 0 where there is nothing in common."""
    return F.when(hits > 0, 2.0 * hits / (predicted + true)).otherwise(F.lit(0.0))


def rouge_n(reference: Column, prediction: Column, n: int) -> Column:
    """F-measure for token arrays."""
    ref, pred = ngrams(reference, n), ngrams(prediction, n)
    return f_measure(overlap(ref, pred), F.size(pred), F.size(ref))


def lowered(text: Column) -> Column:
    return F.coalesce(F.lower(text), F.lit(""))


def stemmed_text(text: Column) -> Column:
    """Lower-case text with every token stemmed where it stands; line ends stay."""
    lines = F.transform(F.split(text, "\n"), lambda line: F.array_join(F.transform(tokens(line), token_stem), " "))
    return F.array_join(lines, "\n")


def _known_stems(df: DataFrame, texts: Sequence[str]) -> pa.Table | None:
    """The stems of all tokens of the texts that have another stem, if they are few enough to send."""
    distinct = [df.select(F.explode(F.array_distinct(tokens(F.col(c)))).alias("token")) for c in texts]
    table = stem_table(distinct[0].union(distinct[1]))
    return table.toArrow() if table.limit(MOST_STEMS + 1).count() <= MOST_STEMS else None


def _hits(metrics: Sequence[str], known: Broadcast | None):
    fields = [T.StructField(f"{m}{part}", T.LongType()) for m in metrics for part in ("", "_left", "_right")]

    def stems(distinct: pa.Array) -> pa.Array:
        table = known.value
        place = places(distinct, table.column("token").combine_chunks())
        return pc.coalesce(table.column("stem").combine_chunks().cast(distinct.type).take(place), distinct)

    @F.arrow_udf(T.StructType(fields))
    def hits(left: pa.Array, right: pa.Array) -> pa.Array:
        found = rouge_kernel.hits(left, right, metrics, None if known is None else stems)
        return pa.StructArray.from_arrays([pa.array(v, pa.int64()) for v in found.values()], names=list(found))

    return hits


def with_scores(
    df: DataFrame, reference: str, prediction: str, stemming: bool = False, metrics: Sequence[str] = METRICS
) -> DataFrame:
    """Adds the F-measures named in ``metrics``; a missing text counts as empty. All of them come from one
    pass over Arrow batches.

    With ``stemming`` the distinct tokens of both columns are stemmed first, once for the whole table. Those with another stem go to the
    tasks if they are at most ``MOST_STEMS`` (some 20 bytes each); with more of them tokens are stemmed where they stand."""
    unknown = set(metrics) - set(METRICS)
    if unknown:
        raise ValueError(f"{', '.join(sorted(unknown))} is not one of: {', '.join(METRICS)}")
    if not metrics:
        return df
    sides = ["_reference", "_prediction"]
    texts = [lowered(F.col(c)) for c in (reference, prediction)]
    own, known = df.withColumns(dict(zip(sides, texts, strict=True))), None
    if stemming:
        table = _known_stems(own, sides)
        if table is None:
            # Spark can't hand so nested an expression to a Python function, so it goes by way of a table.
            own = materialize(own.withColumns({side: stemmed_text(F.col(side)) for side in sides}), "stemmed")
        else:
            known = df.sparkSession.sparkContext.broadcast(table)
    small_batches(df.sparkSession)
    counted = own.withColumn("_hits", _hits(metrics, known)(*sides)).drop(*sides)
    scores = {m: f_measure(*[F.col(f"_hits.{m}{part}") for part in ("", "_right", "_left")]) for m in metrics}
    return counted.withColumns(scores).drop("_hits")
