"""Quality rules: base counts of each text, and a hashed n-gram log-likelihood ratio.

Two multinomials over hashed features (words and runs of marks, and pairs of neighbours) are
estimated: one from trusted rows, one from the whole raw corpus. A document's score is the mean over
its features of the log of their ratio, so long texts weigh no more than short ones. It is kept if it
passes the base rules and its score reaches a threshold. The threshold is the lowest score that tells
trusted rows (good and not toxic) from those labelled bad as well as any score does, within ``SLACK`` (share of
trusted rows at or over it less share of bad ones), on trusted rows that didn't teach the target.

Native: all work on texts is column expressions, with no shuffle of texts. Counting sends one row
per feature bucket from each task; the driver holds ``buckets`` pairs of counts and the scores of at
most about ``trusted`` + ``others`` labelled rows. Trusted rows are a bounded sample of the labels (all, if
fewer), chosen by a hash of the id; the corpus counts take in every document.

Null text counts as empty. Rows repeat as they come. A document without words has no score (null) and
fails the base rules. Labels without a text, with null marks or repeated are left out or count once.
Without trusted labels every score is 0 and only the base rules decide; without bad ones every
score passes. Window hashes are 64 bits wide.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from instructset.llm.common import SPACES

_FEATURE = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+"
_MINE = "_quality_"
SLACK = 0.01


@dataclass
class Model:
    weights: list[float]
    threshold: float


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def with_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words with prefix ``_quality_``."""
    m = _MINE
    df = df.withColumn(f"{m}text", F.coalesce(F.col(text).cast("string"), F.lit("")))
    df = df.withColumn(f"{m}w", words(F.col(f"{m}text")))
    df = df.withColumn(f"{m}lines", F.expr(rf"filter(split({m}text, '\n'), x -> x rlike '[^\\x20\\x09-\\x0D]')"))
    df = df.withColumns(
        {
            f"{m}n_words": F.size(f"{m}w").cast("long"),
            f"{m}word_chars": F.length(F.array_join(f"{m}w", "")).cast("long"),
            f"{m}n_symbols": F.regexp_count(F.col(f"{m}text"), F.lit(r"[#*$%&|<>]")).cast("long"),
            f"{m}n_dup_lines": (F.size(f"{m}lines") - F.size(F.array_distinct(f"{m}lines"))).cast("long"),
            f"{m}h": F.expr(f"transform({m}w, x -> xxhash64(x))"),
        }
    ).drop(f"{m}lines", f"{m}w")
    h = f"{m}h"
    five = ", ".join(f"{h}[i + {k}]" for k in range(5))
    df = df.withColumn(f"{m}win", F.expr(f"IF(size({h}) < 5, array(), transform(sequence(0, size({h}) - 5), i -> xxhash64({five})))"))
    # Places are sorted by window only in the texts that repeat one.
    df = df.withColumn(
        f"{m}sorted",
        F.expr(
            f"IF(size(array_distinct({m}win)) = size({m}win), NULL,"
            f" sort_array(transform({m}win, (x, i) -> struct(x AS x, i AS i))))"
        ),
    )
    s = f"{m}sorted"
    df = df.withColumn(
        f"{m}at",
        F.expr(
            f"sort_array(transform(filter({s}, (e, i) -> (i > 0 AND e.x = get({s}, i - 1).x)"
            f" OR (i + 1 < size({s}) AND e.x = get({s}, i + 1).x)), e -> e.i))"
        ),
    )
    at = f"{m}at"
    repeated = F.expr(
        f"CASE WHEN {at} IS NULL THEN 0L ELSE"
        f" aggregate(transform({at}, (x, i) -> IF(i = 0, 5, least(5, x - get({at}, i - 1)))), 0L, (a, x) -> a + x) END"
    )
    return df.withColumn(f"{m}n_repeat_words", repeated).drop(h, f"{m}win", s, at)


def features(text: str, buckets: int) -> str:
    """SQL for the feature buckets of an array column expression's tokens, twice bound by lambdas."""
    one = f"transform(t, x -> pmod(xxhash64(x), {buckets}))"
    two = f"transform(slice(t, 2, greatest(size(t) - 1, 0)), (x, i) -> pmod(xxhash64(t[i], x), {buckets}))"
    tokens = f"regexp_extract_all({text}, r'{_FEATURE}', 0)"
    return f"flatten(transform(array({tokens}), t -> concat({one}, {two})))"


def _sampled(ids: DataFrame, most: int) -> DataFrame:
    """About ``most`` of the ids, by hash, or all."""
    n = ids.count()
    share = 1.0 if n <= most else most / n
    return ids if share == 1.0 else ids.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))


def fit(
    docs: DataFrame, labels: DataFrame, trusted: int = 20_000, others: int = 20_000, buckets: int = 1 << 14
) -> Model:
    """``docs`` needs doc_id and text, ``labels`` doc_id, quality and toxic (0 or 1)."""
    marks = (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    )
    good = _sampled(marks.where("quality = 1 AND toxic = 0").select("doc_id"), trusted)
    bad = _sampled(marks.where("quality = 0").select("doc_id"), others)
    # Half of the good rows teach the target, the other half sets the threshold, so that the threshold
    # doesn't rest on texts whose words the target has seen; a single row does both.
    half = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2))
    halves = {r.half: r.n for r in good.groupBy(half.alias("half")).agg(F.count("*").alias("n")).collect()}
    parted = len(halves) == 2
    teaches, sets = (half == 0, half == 1) if parted else (F.lit(True), F.lit(True))
    # Both have a bounded number of ids.
    good = good.select("doc_id", F.lit(1).alias("good"), teaches.cast("int").alias("teaches"), sets.alias("sets"))
    bad = bad.select("doc_id", F.lit(0).alias("good"), F.lit(0).alias("teaches"), F.lit(True).alias("sets"))
    chosen = good.union(bad)
    narrow = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    counted = (
        narrow.join(F.broadcast(chosen), "doc_id", "left")
        .select(F.coalesce("teaches", F.lit(0)).alias("teaches"), F.explode(F.expr(features("text", buckets))).alias("bucket"))
        .groupBy("bucket")
        .agg(F.count("*").alias("raw"), F.sum("teaches").alias("target"))
        .toPandas()
    )
    raw, target = np.zeros(buckets), np.zeros(buckets)
    raw[counted.bucket], target[counted.bucket] = counted.raw, counted.target
    if not target.sum():
        return Model([0.0] * buckets, -math.inf)
    ratio = np.log((target + 1) / (target.sum() + buckets)) - np.log((raw + 1) / (raw.sum() + buckets))
    model = Model(np.round(ratio, 9).tolist(), -math.inf)
    scored = with_score(narrow.join(F.broadcast(chosen.where("sets")), "doc_id"), "text", model, "score").select("good", "score")
    rows = scored.dropna().toPandas()
    model.threshold = best_cut(rows.score.to_numpy(), rows.good.to_numpy())
    return model


def best_cut(scores: np.ndarray, good: np.ndarray) -> float:
    """The lowest score that tells good rows (at or over it) from the others as well as any does, or
    worse by ``SLACK`` at most, since keeping a bad document costs less than losing a good one."""
    if not len(scores) or not (good == 0).any():
        return -math.inf
    cuts, place = np.unique(scores, return_inverse=True)
    of = [np.bincount(place, weights=good == g, minlength=len(cuts)) for g in (0, 1)]
    below = [np.concatenate(([0], np.cumsum(x)[:-1])) / max(1, x.sum()) for x in of]
    told = below[0] - below[1]
    return float(cuts[int(np.flatnonzero(told >= told.max() - SLACK)[0])])


def with_score(df: DataFrame, text: str, model: Model, name: str) -> DataFrame:
    """Adds the mean weight of the features of a text column; null if it has none."""
    total = "aggregate(f, 0D, (a, x) -> a + get(_weights, CAST(x AS INT)))"
    mean = f"transform(array({features(text, len(model.weights))}), f -> round({total} / nullif(size(f), 0), 9))[0]"
    return df.withColumn("_weights", F.lit(np.array(model.weights))).withColumn(name, F.expr(mean)).drop("_weights")


def judge(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with one struct column ``_quality``: the base counts, base_failed, score, kept."""
    m = _MINE
    df = with_counts(docs, text)
    df = with_score(df, f"{m}text", model, f"{m}score")
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    failed = (F.col(f"{m}n_words") < 10) | (100 * F.col(f"{m}n_repeat_words") > 20 * F.col(f"{m}n_words"))
    passed = F.coalesce(F.col(f"{m}score") >= F.lit(model.threshold), F.lit(False))
    fields = [*(F.col(m + c).alias(c) for c in counts), failed.alias("base_failed"), F.col(f"{m}score").alias("score")]
    return df.select(*docs.columns, F.struct(*fields, (~failed & passed).alias("kept")).alias("_quality"))


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass, all columns as they were."""
    judged = judge(docs, fit(docs, labels))
    # The optimizer would move a filter on the verdict below the steps that it is made in, and write
    # each of them out once for every use of the one before. It moves nothing below a
    # column that depends on the task, which this test, true of every task, does.
    verdict = F.col("_quality.kept") & (F.spark_partition_id() >= 0)
    return judged.withColumn("_quality", verdict).where("_quality").drop("_quality")
