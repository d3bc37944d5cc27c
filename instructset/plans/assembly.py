"""Training-set assembly: from pairs to encoded examples."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from instructset.functions.arrays import ignore_padding, mask_prompt, pad_to, truncate
from instructset.functions.prompts import (
    EOS_TOKEN,
    instruction_prompt,
    mixed_prompt,
    mixed_text,
    prefixed,
)
from instructset.functions.text import strip, tokens
from instructset.operators.filters import (
    both_filled,
    both_present,
    instruction_only,
    valid_mixed,
    within_length,
)
from instructset.operators.selection import SEED, exact_sample, first_rows, train_validation_split
from instructset.operators.vocabulary import KeyedVocabularies, Vocabulary, build_vocabulary, encode
from instructset.session import materialize

# Length limits in tokens.
MAX_LENGTH = 512
MAX_SOURCE, MAX_TARGET, MAX_EVAL_TARGET = 512, 128, 1024


def instruction_vocabulary(df: DataFrame) -> Vocabulary:
    """A vocabulary of ``prompt, response`` rows that knows the words of the template too."""
    filled = instruction_prompt(strip(F.col("prompt"))).alias("filled")
    return build_vocabulary(df.select(filled, strip(F.col("response")).alias("answer")), "filled", "answer")


def mixed_vocabulary(df: DataFrame) -> Vocabulary:
    """A vocabulary of the whole texts of valid mixed rows, template and system message included."""
    parts = [F.col(c) for c in ("pretrain_marker", "system_message", "prompt", "response")]
    text = mixed_text(*parts, "", False).alias("text")
    return build_vocabulary(df.filter(valid_mixed(*parts)).select(text), "text")


def seq2seq_vocabulary(df: DataFrame, prefix: str = "") -> Vocabulary:
    """A vocabulary of ``input, output`` rows and the prefix before their inputs."""
    rows = df.select(prefixed(F.col("input"), prefix).alias("source"), "output")
    return build_vocabulary(rows, "source", "output")


def instruction_examples(
    df: DataFrame, id_col: str, vocabulary: Vocabulary, max_length: int = MAX_LENGTH
) -> DataFrame:
    """``prompt, response`` to ``input_ids, labels``: the filled template, the response and
    the end token, with the labels of the template ignored. Pairs with a null and examples
    over ``max_length`` are dropped.

    The template ends in a token of its own, so its tokens are a prefix of the whole.
    """
    given = tokens(instruction_prompt(strip(F.col("prompt"))))
    ready = (
        df.filter(both_present(F.col("prompt"), F.col("response")))
        .withColumn("_given", given)
        .withColumn(
            "_tokens",
            F.concat("_given", tokens(strip(F.col("response"))), F.array(F.lit(EOS_TOKEN))),
        )
        .withColumn("_given", F.size("_given"))
        .filter(within_length(F.col("_tokens"), max_length))
    )
    coded = encode(ready, id_col, "_tokens", vocabulary, keep=False)
    return coded.withColumn("labels", mask_prompt(F.col("input_ids"), F.col("_given"))).drop("_given")


def assemble_instructions(
    tables: Mapping[str, DataFrame],
    vocabulary: Vocabulary,
    pos: str = "pos",
    max_length: int = MAX_LENGTH,
    select_train: int = -1,
    select_eval: int = -1,
    seed: int = SEED,
) -> DataFrame:
    """All data sets as one table ``task, split, pos, input_ids, labels``; ``select_train`` and
    ``select_eval`` rows of each split (-1: all) are drawn at random."""
    parts = []
    for task, df in tables.items():
        rows = train_validation_split(df, pos, seed=seed).withColumn("task", F.lit(task))
        if (select_train, select_eval) == (-1, -1):
            parts.append(rows)
            continue
        # A choice from a choice would find its cut-offs inside those of the other.
        stored = materialize(rows, "split")
        for name, size in (("train", select_train), ("validation", select_eval)):
            own = stored.filter(F.col("split") == name)
            parts.append(own if size == -1 else exact_sample(own, pos, size, "select", seed))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    # A position is unique in its data set only.
    keyed = whole.withColumn("_id", F.concat_ws(":", "task", pos))
    return instruction_examples(keyed, "_id", vocabulary, max_length).select(
        "task", "split", pos, "input_ids", "labels"
    )


def assemble_mixed(
    df: DataFrame,
    id_col: str,
    vocabulary: Vocabulary,
    max_length: int = MAX_LENGTH,
    only_instructions: bool = False,
    first: int = -1,
    prompt_only: bool = False,
    mask: bool = True,
) -> DataFrame:
    """Pretraining and instruction rows to ``input_ids, labels``, cut at ``max_length``;
    only instruction rows have ignored labels."""
    rows = df.filter(instruction_only(F.col("pretrain_marker"))) if only_instructions else df
    rows = first_rows(rows, id_col, first)
    parts = [F.col(c) for c in ("pretrain_marker", "system_message", "prompt", "response")]
    marker, system, prompt, response = parts
    valid = rows.filter(valid_mixed(*parts))
    # The end token is an id of its own, so it is not part of the text here.
    ends = (marker == 1) | F.lit(not prompt_only)
    ready = valid.withColumn(
        "_tokens",
        F.concat(
            tokens(mixed_text(marker, system, prompt, response, "", prompt_only)),
            F.when(ends, F.array(F.lit(EOS_TOKEN))).otherwise(F.array().cast("array<string>")),
        ),
    )
    given = F.size(tokens(mixed_prompt(marker, system, prompt))) if mask else F.lit(0)
    # No texts beside their tokens, so that they aren't written with the rare ones.
    cut = ready.select(id_col, given.alias("_given"), truncate(F.col("_tokens"), max_length).alias("_tokens"))
    coded = encode(cut, id_col, "_tokens", vocabulary, keep=False)
    return coded.withColumn("labels", mask_prompt(F.col("input_ids"), F.col("_given"))).select(
        id_col, "input_ids", "labels"
    )


def assemble_seq2seq(
    df: DataFrame,
    id_col: str,
    vocabulary: Vocabulary | KeyedVocabularies,
    prefix: str = "",
    max_source: int = MAX_SOURCE,
    max_target: int = MAX_TARGET,
    first: int | None = None,
    pad_to_max: bool = False,
    ignore_pad: bool = True,
) -> DataFrame:
    """``input, output`` to ``input_ids, labels``, each cut at its limit and closed by the
    end token."""
    pairs = first_rows(df, id_col, first).filter(both_filled(F.col("input"), F.col("output")))
    end = F.array(F.lit(EOS_TOKEN))
    source = F.concat(truncate(tokens(prefixed(F.col("input"), prefix)), max_source - 1), end)
    target = F.concat(truncate(tokens(F.col("output")), max_target - 1), end)
    # Both sides are looked up as one array and parted again.
    ready = pairs.withColumns({"_source": source, "_target": target}).select(
        id_col, F.concat("_source", "_target").alias("_tokens"), F.size("_source").alias("_n")
    )
    coded = encode(ready, id_col, "_tokens", vocabulary, keep=False)
    ids = F.slice("input_ids", F.lit(1), F.col("_n"))
    labels = F.slice("input_ids", F.col("_n") + 1, F.size("input_ids"))
    if pad_to_max:
        ids = pad_to(ids, F.lit(max_source), vocabulary.pad_id)
        labels = pad_to(labels, F.lit(max_target), vocabulary.pad_id)
        if ignore_pad:
            labels = ignore_padding(labels, vocabulary.pad_id)
    return coded.select(id_col, ids.alias("input_ids"), labels.alias("labels"))


def sweep_examples(
    rungs: DataFrame, id_col: str, vocabulary: Vocabulary | KeyedVocabularies, **options
) -> DataFrame:
    """``assemble_seq2seq`` for every rung of a ladder in one job; ids are unique within
    their rung. The vocabulary is one for all, or one for each rung (``build_vocabularies`` by ``rung``)."""
    keyed = rungs.withColumn("_id", F.struct("rung", id_col))
    return assemble_seq2seq(keyed, "_id", vocabulary, **options).select(
        "_id.rung", F.col(f"_id.{id_col}").alias(id_col), "input_ids", "labels"
    )
