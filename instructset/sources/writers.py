"""Sinks. Each is one distributed write; a split is a folder, not a file."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from instructset.functions.labels import conll_block
from instructset.functions.prompts import TRAINING_SEPARATOR, training_line
from instructset.functions.text import one_line, strip
from instructset.session import file_tasks, ship_package
from instructset.sources.named_files import FORMAT, NamedFiles


def write_jsonl(df: DataFrame, path: str, by: str | None = None, mode: str = "error") -> None:
    """JSON-lines with nulls written out; ``by`` names the column that makes folders."""
    writer = df.write.mode(mode).option("ignoreNullFields", False)
    (writer.partitionBy(by) if by else writer).json(path)


def write_documents(df: DataFrame, path: str, name_col: str = "file_name") -> None:
    """A folder for each input document, in any store that Spark writes to. Only for a few documents; for many see
    ``write_named_files``, or ``write_jsonl`` with the name as a column."""
    df.repartition(name_col).write.partitionBy(name_col).json(path)


def write_named_files(df: DataFrame, path: str, name_col: str = "file_name") -> None:
    """One JSON file for each name in one folder, as many files as there are names; rows of one name are
    lines of its file. A missing name, or one that isn't a plain visible file name, is an error.

    Rows are dealt out by name and sorted, so a task writes one file after another. The target must be a folder
    that executors share, or a store that Arrow reaches by its URI."""
    spark = df.sparkSession
    ship_package(spark)
    spark.dataSource.register(NamedFiles)
    name = F.col(name_col).cast("string")
    plain = F.coalesce(name.rlike(r"^[^/\x00._][^/\x00]*$"), F.lit(False))
    bad = F.raise_error(F.concat(F.lit("not a file name: "), F.coalesce(name, F.lit("null"))))
    fields = F.struct(*[F.col(f"`{c}`") for c in df.columns if c != name_col])
    value = F.to_json(fields, {"ignoreNullFields": "false"})
    rows = df.select(F.when(plain, name).otherwise(bad.cast("string")).alias("name"), value.alias("value"))
    rows.repartition(file_tasks(spark), "name").sortWithinPartitions("name", "value").write.format(FORMAT).mode("append").save(path)


def write_conll(df: DataFrame, path: str, tokens: str = "tokens", by: str | None = None) -> None:
    """``token label`` lines and an empty line after each sentence."""
    block = conll_block(F.col(tokens)).alias("value")
    if by:
        df.select(by, block).write.partitionBy(by).text(path)
    else:
        df.select(block).write.text(path)


def write_csv(df: DataFrame, path: str, by: str | None = None) -> None:
    writer = df.write.option("header", True).option("escape", '"').option("quote", '"')
    (writer.partitionBy(by) if by else writer).csv(path)


def training_lines(
    df: DataFrame, source: str = "input", target: str = "output", separator: str = TRAINING_SEPARATOR
) -> DataFrame:
    line = training_line(one_line(F.col(source)), one_line(F.col(target)), separator)
    return df.select(line.alias("value"))


def write_training_lines(df: DataFrame, path: str, **options) -> None:
    training_lines(df, **options).write.text(path)


def write_predictions(df: DataFrame, path: str, id_col: str, text_col: str = "model_output") -> None:
    """One stripped prediction per line, in order of ``id_col``: a distributed sort, the
    files in order of their names. A line break inside a prediction is not escaped."""
    df.orderBy(id_col).select(strip(F.col(text_col)).alias("value")).write.text(path)


def write_observed(df: DataFrame, write: Callable[[DataFrame], None], **measures: Column) -> dict[str, object]:
    """Hands ``df`` to ``write`` and returns aggregates of the rows that went by, from the same pass. They
    are taken where the write ends, so that rows of a task that is tried again count once."""
    seen = Observation()
    write(df.observe(seen, *[value.alias(name) for name, value in measures.items()]))
    return seen.get


def write_metrics(metrics: DataFrame, path: str, run: str, split: str) -> None:
    """Append ``metric, value`` rows, tagged with the run and the metric group."""
    metrics.select(
        F.lit(run.replace("/", "-")).alias("run"),
        F.lit(split).alias("split"),
        "metric",
        F.col("value").cast("double").alias("value"),
    ).write.mode("append").json(path)
