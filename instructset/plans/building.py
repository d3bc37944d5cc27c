"""Data-set builders: from source tables to pairs and splits."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from instructset.functions.binding import bind
from instructset.functions.html import strip_html
from instructset.functions.labels import zip_tags
from instructset.functions.prompts import (
    SUMMARY_PROMPT,
    product_prompt,
    question_prompt,
    summary_prompt,
    without_prompt,
)
from instructset.functions.text import text_digest, word_count, words
from instructset.operators.dedup import first_seen, held_out
from instructset.operators.evidence import PART_ROWS, answers_with_evidence, pooled_evidence
from instructset.operators.filters import (
    described_in_locale,
    description_band,
    partition_rows,
    product_quality,
)
from instructset.operators.reviews import VERDICT, summary_text, top_review_text
from instructset.operators.positions import with_row_index
from instructset.operators.selection import (
    HELD_OUT,
    LADDER,
    RESPLIT_LADDER,
    SEED,
    SUMMARY_LADDER,
    early_stop,
    early_stop_files,
    exact_sample,
    sample_ladder,
    shuffled_split,
)
from instructset.session import materialize


def description_pairs(
    df: DataFrame,
    pos: str = "pos",
    title: str = "title",
    description: str = "description",
    limit: int | None = None,
    enough: int = 600_000,
) -> DataFrame:
    """``pos, input, output``: titles and their cleaned descriptions.

    Length is judged on the raw text, so that the cheap test comes before the clean-up.
    With ``limit`` the scan ends as ``early_stop`` says. A table without the column ``pos`` must be as it was
    read: its rows are numbered in the order of its files, and with ``limit`` files after the end aren't opened.
    """
    keep = description_band(F.col(title), F.col(description))
    if pos not in df.columns:
        kept = with_row_index(df, pos).filter(keep) if limit is None else early_stop_files(df, keep, limit, enough, pos)
    else:
        kept = df.filter(keep) if limit is None else early_stop(df, pos, keep, limit, enough)
    cleaned = F.array_join(F.transform(description, strip_html), " ")
    return kept.select(pos, F.col(title).alias("input"), cleaned.alias("output"))


def _assigned(narrow: DataFrame, id_col: str, name: str, size: int, seed: int, strict: bool) -> DataFrame:
    """``id, _digest, split`` of one more draw, written as a small table."""
    rows = exact_sample(narrow, id_col, size, name, seed, strict)
    return materialize(rows.select(id_col, "_digest", F.lit(name).alias("split")), name)


def ladder_with_held_out(
    pairs: DataFrame,
    id_col: str,
    rungs: Mapping[str, int] = LADDER,
    test: int = HELD_OUT,
    dev: int = HELD_OUT,
    seed: int = SEED,
    strict: bool = False,
) -> DataFrame:
    """Training rungs, a test set that shares no output with them and a dev set that
    shares none with either; one row per (split, pair).

    Everything is decided on ids and digests. The pairs themselves are read once more at
    the end, and joined to the assignment, which is no larger than the sizes asked for.
    """
    narrow = materialize(
        pairs.select(id_col, text_digest(F.col("output")).alias("_digest")), "digests"
    )
    total = sum(rungs.values())
    rows = sample_ladder(narrow, id_col, rungs, seed, strict=strict)
    taken = materialize(
        rows.select(id_col, "_digest", F.concat(F.lit("train_"), "rung").alias("split")), "rungs"
    )
    pool = held_out(narrow, taken, max_used=total, digest_col="_digest")
    if test:
        chosen = _assigned(pool, id_col, "test", test, seed, strict)
        taken = taken.unionByName(chosen)
    if dev:
        pool = held_out(narrow, taken, max_used=total + test, digest_col="_digest")
        taken = taken.unionByName(_assigned(pool, id_col, "dev", dev, seed, strict))
    return _joined(pairs, taken.select(id_col, "split"), id_col, total + test + dev)


def _joined(pairs: DataFrame, assignment: DataFrame, id_col: str, bound: int) -> DataFrame:
    """Pairs of an assignment of at most ``bound`` rows."""
    if bound <= 1_000_000:
        assignment = F.broadcast(assignment)
    return pairs.join(assignment, id_col)


def build_descriptions(
    products: DataFrame,
    pos: str = "pos",
    rungs: Mapping[str, int] = LADDER,
    test: int = HELD_OUT,
    dev: int = HELD_OUT,
    seed: int = SEED,
    limit: int | None = None,
    enough: int = 600_000,
    strict: bool = False,
) -> DataFrame:
    """Products to ``split, pos, input, output``; the cleaned pairs are written once."""
    pairs = materialize(description_pairs(products, pos, limit=limit, enough=enough), "pairs")
    return ladder_with_held_out(pairs, pos, rungs, test, dev, seed, strict).select(
        "split", pos, "input", "output"
    )


def resplit(
    pairs: DataFrame,
    id_col: str,
    rungs: Mapping[str, int] = RESPLIT_LADDER,
    test: int = HELD_OUT,
    extra: int = 150_000,
    extend: str = "50k",
    extended: str = "200k",
    seed: int = SEED,
    legacy_leak: bool = False,
    strict: bool = False,
) -> DataFrame:
    """New splits of an existing pair set: rungs, a test set apart from them, and one large
    rung of ``extend`` and ``extra`` more rows.

    The extra rows share no output with rungs or test; ``legacy_leak`` draws them from
    the pool that still has the test rows.
    """
    narrow = materialize(
        pairs.select(id_col, text_digest(F.col("output")).alias("_digest")), "digests"
    )
    total = sum(rungs.values())
    drawn_rungs = sample_ladder(narrow, id_col, rungs, seed, strict=strict)
    taken = materialize(
        drawn_rungs.select(id_col, "_digest", F.concat(F.lit("train_"), "rung").alias("split")),
        "rungs",
    )
    pool = held_out(narrow, taken, max_used=total, digest_col="_digest")
    chosen = _assigned(pool, id_col, "test", test, seed, strict)
    if not legacy_leak:
        used = taken.unionByName(chosen)
        pool = held_out(narrow, used, max_used=total + test, digest_col="_digest")
    more = _assigned(pool, id_col, "extra", extra, seed, strict)
    large = taken.filter(F.col("split") == f"train_{extend}").unionByName(more)
    whole = taken.unionByName(chosen).unionByName(
        large.withColumn("split", F.lit(f"train_{extended}"))
    )
    bound = total + test + extra + rungs[extend]
    return _joined(pairs, whole.select(id_col, "split"), id_col, bound)


def build_product_descriptions(
    products: DataFrame, order: tuple[str, ...] = ("split_rank", "pos"), locale: str = "us"
) -> DataFrame:
    """Search products to ``split, input, output``.

    Only the first row of a title counts, over all splits in their order, and only if it
    passes the quality test itself.
    """
    described = products.filter(
        described_in_locale(F.col("product_locale"), F.col("product_description"), locale)
    )
    firsts = first_seen(described, "product_title", order)
    good = firsts.filter(
        product_quality(
            F.col("product_title"), F.col("product_description"), F.col("product_bullet_point")
        )
    )
    return good.select(
        "split",
        product_prompt(
            strip_html(F.col("product_title")),
            F.col("product_brand"),
            F.col("product_color"),
            strip_html(F.col("product_bullet_point")),
        ).alias("input"),
        strip_html(F.col("product_description")).alias("output"),
    )


def build_question_answers(
    answers: DataFrame,
    evidence: DataFrame,
    keys: tuple[str, str] = ("ASIN", "question"),
    order: tuple[str, str] = ("source_rank", "pos"),
    candidate: str = "candidate",
    answer: str = "answer",
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """Answers in their split, evidence from all: ``split, part, input, output``.

    ``part`` is 0 for a prompt. Evidence too large for one row continues in rows of later
    parts, each to be put behind the one before.
    """
    pooled = pooled_evidence(evidence, keys, order, candidate, part_rows)
    context = F.array_join("evidence", "\n")
    text = F.when(F.col("part") == 0, question_prompt(F.col(keys[1]), context)).otherwise(
        F.concat(F.lit("\n"), context)
    )
    return answers_with_evidence(answers, pooled, keys).select(
        "split", "part", text.alias("input"), F.col(answer).alias("output")
    )


def build_review_summaries(products: DataFrame, kind: str = VERDICT) -> tuple[DataFrame, DataFrame]:
    """Reviewed products to ``file_name, input, output``, and the rejects that have no
    summary."""
    kept, rejects = partition_rows(products, F.size("website_summaries") > 0)
    return (
        kept.select(
            "file_name",
            summary_prompt(top_review_text(F.col("customer_reviews"), kind)).alias("input"),
            summary_text(F.col("website_summaries"), kind).alias("output"),
        ),
        rejects,
    )


def build_summary_ladder(
    pairs: DataFrame, id_col: str, rungs: Mapping[str, int] = SUMMARY_LADDER, seed: int = SEED, strict: bool = False
) -> DataFrame:
    """Rungs of the train split, and all splits as they are, with valid named dev."""
    train = pairs.filter(F.col("split") == "train")
    sampled = sample_ladder(train, id_col, rungs, seed, strict=strict)
    name = F.when(F.col("split") == "valid", F.lit("dev")).otherwise(F.col("split"))
    return pairs.withColumn("split", name).unionByName(
        sampled.withColumn("split", F.concat(F.lit("train_"), "rung")).drop("rung")
    )


def summary_table(pairs: DataFrame, prompt: str = SUMMARY_PROMPT, strict: bool = True) -> DataFrame:
    """``split, inputs, target`` without the prompt; an input that has none is an error,
    or null if not ``strict``."""
    text = without_prompt(F.col("input"), prompt)
    if strict:
        text = F.coalesce(text, F.raise_error(F.lit("input without the prompt")).cast("string"))
    return pairs.select("split", text.alias("inputs"), F.col("output").alias("target"))


def summary_rows(pairs: DataFrame, prompt: str = SUMMARY_PROMPT) -> tuple[DataFrame, DataFrame]:
    """``summary_table`` of the pairs that have the prompt, and the pairs that lack it, as they are."""
    kept, rejects = partition_rows(pairs, F.contains(F.coalesce("input", F.lit("")), F.lit(prompt)))
    return summary_table(kept, prompt), rejects


def tagged_sentences(
    df: DataFrame, text: str = "description", tags: str = "tag"
) -> tuple[DataFrame, DataFrame]:
    """Sentences with ``tokens`` (token and label), and rejects whose numbers differ."""
    fit = F.explode(
        bind(
            words(F.col(text)),
            lambda w: F.when(F.size(w) == F.size(tags), F.array(zip_tags(w, F.col(tags)))),
        )
    )
    fits = F.coalesce(word_count(F.col(text)) == F.size(tags), F.lit(False))
    # Making the tokens and dropping misfits are one step: a filter on the tokens would
    # have them made twice.
    return df.select("*", fit.alias("tokens")), df.filter(~fits)


def build_tagged_splits(
    df: DataFrame, id_col: str, text: str = "description", tags: str = "tag", seed: int = SEED
) -> DataFrame:
    """``id, tokens, split``: a shuffled 70/10/20 split of the sentences that fit. They are
    written once, since the cut-offs need scans of their ids."""
    fitting, _ = tagged_sentences(df, text, tags)
    sentences = materialize(fitting.select(id_col, "tokens"), "sentences")
    return shuffled_split(sentences, id_col, seed=seed)
