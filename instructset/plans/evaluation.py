"""Scores of prediction files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from instructset import schemas
from instructset.operators.scoring import entity_report, label_pairs, rouge_report, sample_count
from instructset.operators.scoring import long_metrics
from instructset.sources.readers import read_jsonl
from instructset.sources.writers import write_observed


def score_texts(spark: SparkSession, path: str, stemming: bool = False) -> DataFrame:
    """ROUGE of JSON-lines records with ``output`` and ``model_output``: plain means, or
    stemmed, by sentence and in percent."""
    scored = read_jsonl(spark, path, schemas.SCORED)
    return rouge_report(scored, stemming=stemming, sentence_per_line=stemming, percent=stemming)


def score_entities(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Entity report of JSON-lines records whose texts list tagged tokens; numbers to four
    digits."""
    report = entity_report(label_pairs(read_jsonl(spark, path, schemas.SCORED)), strict)
    return report.withColumns({c: F.round(c, 4) for c in ("precision", "recall", "f1")})


def sweep_report(predictions: DataFrame, rung: str = "rung") -> DataFrame:
    """``rung, metric, value`` for the predictions of all rungs of a sweep, in one job."""
    return rouge_report(predictions, stemming=True, sentence_per_line=True, percent=True, by=[rung])


def samples(df: DataFrame, limit: int | None, split: str) -> DataFrame:
    """The metric ``<split>_samples``."""
    name = f"{split}_samples"
    return long_metrics(sample_count(df, limit, name), [name])


def written_samples(
    df: DataFrame, limit: int | None, split: str, write: Callable[[DataFrame], None], **measures: Column
) -> DataFrame:
    """The metric ``<split>_samples`` of the rows that ``write`` writes, at most ``limit``, and sums or
    other aggregates of them as ``<split>_<name>``; all from the pass that writes."""
    seen = write_observed(df, write, samples=F.count("*"), **measures)
    if limit is not None:
        seen["samples"] = min(limit, seen["samples"])
    values = [(f"{split}_{name}", None if value is None else float(value)) for name, value in seen.items()]
    return df.sparkSession.createDataFrame(values, "metric string, value double")
