"""Reports over scored tables, and the hooks that fill them."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from instructset.functions import rouge
from instructset.functions.arrays import filled_size
from instructset.functions.labels import aligned_labels, entity_spans, tuple_labels
from instructset.functions.prompts import generation_prompt, without_echo
from instructset.functions.text import sentence_lines, word_count

def rouge_scores(
    df: DataFrame,
    reference: str = "output",
    prediction: str = "model_output",
    stemming: bool = False,
    metrics: Sequence[str] = rouge.METRICS,
) -> DataFrame:
    """Adds F-measures of each row. A missing text counts as empty."""
    return rouge.with_scores(df, reference, prediction, stemming, metrics)


def long_metrics(wide: DataFrame, names, by=()) -> DataFrame:
    """One ``(metric, value)`` row for each named column of each row of a small table."""
    pairs = [F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names]
    return wide.select(*by, F.inline(F.array(*pairs)))


def rouge_report(
    df: DataFrame,
    reference: str = "output",
    prediction: str = "model_output",
    stemming: bool = False,
    sentence_per_line: bool = False,
    percent: bool = False,
    by=(),
    metrics: Sequence[str] = rouge.METRICS,
) -> DataFrame:
    """Corpus means as ``(metric, value)``; with ``percent`` times 100, four digits. ``by``
    names columns, such as the rung of a sweep, that have means of their own."""
    if sentence_per_line:
        df = df.withColumns(
            {
                reference: sentence_lines(F.col(reference)),
                prediction: sentence_lines(F.col(prediction)),
            }
        )
    scored = rouge_scores(df, reference, prediction, stemming, metrics)

    def mean(name: str) -> Column:
        value = F.avg(name)
        return F.round(value * 100, 4) if percent else value

    means = scored.groupBy(*by).agg(*[mean(n).alias(n) for n in metrics])
    return long_metrics(means, metrics, by)


def generated_length(df: DataFrame, ids: str, pad: int) -> DataFrame:
    return df.agg(F.avg(filled_size(F.col(ids), pad)).alias("gen_len"))


def generation_report(
    df: DataFrame, reference: str, prediction: str, ids: str, pad: int
) -> DataFrame:
    """ROUGE of decoded texts, stemmed and in percent, and the mean generated length."""
    scores = rouge_report(df, reference, prediction, True, True, True)
    length = long_metrics(generated_length(df, ids, pad), ["gen_len"])
    return scores.unionByName(length)


def sample_count(df: DataFrame, limit: int | None, name: str = "samples") -> DataFrame:
    rows = F.count("*")
    return df.agg((rows if limit is None else F.least(F.lit(limit), rows)).alias(name))


def split_counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def word_profile(df: DataFrame, *text_cols: str) -> DataFrame:
    """Length in words of each text column: smallest, largest, mean, median."""
    sizes = df.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(c).alias("field"), word_count(F.col(c)).alias("n"))
                    for c in text_cols
                ]
            )
        )
    )
    # Counted by size first, so that a percentile sees one row for each size.
    counted = sizes.groupBy("field", "n").agg(F.count("*").alias("rows"))
    return counted.groupBy("field").agg(
        F.sum("rows").alias("rows"),
        F.min("n").alias("min_words"),
        F.max("n").alias("max_words"),
        (F.sum(F.col("n") * F.col("rows")) / F.sum("rows")).alias("mean_words"),
        F.percentile("n", 0.5, F.col("rows")).alias("median_words"),
    )


def label_pairs(df: DataFrame, reference: str = "output", prediction: str = "model_output") -> DataFrame:
    """Adds ``true_labels`` and ``pred_labels``, read from tagged text."""

    def labels(name: str) -> Column:
        return tuple_labels(F.coalesce(F.col(name), F.lit("")))

    found = df.withColumns({"true_labels": labels(reference), "_found": labels(prediction)})
    return found.withColumn(
        "pred_labels", aligned_labels(F.col("_found"), F.col("true_labels"))
    ).drop("_found")


def entity_report(df: DataFrame, strict: bool = False) -> DataFrame:
    """Precision, recall, F1 and support for each entity type and the three averages.

    Entities are compared inside their row, so only per-type counts are shuffled.
    """
    spans = df.select(
        entity_spans(F.col("true_labels"), strict).alias("true"),
        entity_spans(F.col("pred_labels"), strict).alias("pred"),
    ).withColumn("both", F.array_intersect("true", "pred"))

    def tally(name: str, *ones: int) -> Column:
        return F.transform(
            name,
            lambda s: F.struct(
                s["type"].alias("type"),
                *[F.lit(one).cast("bigint").alias(c) for one, c in zip(ones, ("hit", "predicted", "support"))],
            ),
        )

    counts = (
        spans.select(
            F.inline(F.concat(tally("both", 1, 0, 0), tally("pred", 0, 1, 0), tally("true", 0, 0, 1)))
        )
        .groupBy("type")
        .agg(*[F.sum(c).alias(c) for c in ("hit", "predicted", "support")])
    )
    per_type = _rates(counts)
    # Each type adds to its own line and to the averages; one grouping makes them all.
    lines = per_type.select(
        "*",
        F.inline(
            F.array(
                F.struct(F.col("type").alias("entity"), F.lit("entity").alias("kind")),
                *[
                    F.struct(F.lit(f"{kind} avg").alias("entity"), F.lit(kind).alias("kind"))
                    for kind in ("micro", "macro", "weighted")
                ],
            )
        ),
    )
    summed = lines.groupBy("kind", "entity").agg(
        *[F.sum(c).alias(c) for c in ("hit", "predicted", "support")],
        *[F.avg(c).alias(f"mean_{c}") for c in ("precision", "recall", "f1")],
        *[
            F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(f"weighted_{c}")
            for c in ("precision", "recall", "f1")
        ],
    )
    pooled = _rates(summed)

    def pick(name: str) -> Column:
        return (
            F.when(F.col("kind") == "macro", F.col(f"mean_{name}"))
            .when(F.col("kind") == "weighted", F.coalesce(F.col(f"weighted_{name}"), F.lit(0.0)))
            .otherwise(F.col(name))
        ).alias(name)

    return pooled.select(
        "kind", "entity", pick("precision"), pick("recall"), pick("f1"), "support"
    )


def _rates(counts: DataFrame) -> DataFrame:
    """Rates from counts; 0 where a denominator is 0."""

    def ratio(part: Column, whole: Column) -> Column:
        return F.coalesce(F.try_divide(part, whole), F.lit(0.0))

    return counts.withColumns(
        {
            "precision": ratio(F.col("hit"), F.col("predicted")),
            "recall": ratio(F.col("hit"), F.col("support")),
            "f1": ratio(2 * F.col("hit"), F.col("predicted") + F.col("support")),
        }
    )


def map_batches(
    df: DataFrame, fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema
) -> DataFrame:
    """Any function over batches of rows; it may return fewer rows."""
    return df.mapInPandas(fn, schema)


def predict(
    df: DataFrame,
    load: Callable[[], Callable[[list[str]], list[str]]],
    prompt: str = "input",
    separator: str = "<SEP>",
) -> DataFrame:
    """Adds ``model_output``: the text that a caller's model generates for each prompt,
    without the prompt. ``load`` is called once in each task and returns the function
    from prompts to texts."""
    schema = T.StructType([*df.schema.fields, T.StructField("_prompt", T.StringType()), T.StructField("_text", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            yield batch.assign(_text=model(batch["_prompt"].tolist()))

    prompted = df.withColumn("_prompt", generation_prompt(F.col(prompt), separator))
    return (
        map_batches(prompted, run, schema)
        .withColumn("model_output", without_echo(F.col("_text"), F.col("_prompt")))
        .drop("_prompt", "_text")
    )


def with_predictions(df: DataFrame, predictions: DataFrame, id_col: str) -> DataFrame:
    """Records with the prediction of the same id."""
    return df.join(predictions, id_col, "inner")
