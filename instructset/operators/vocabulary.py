"""A vocabulary learned from text, and encoding and decoding with it.

It stands in for a pretrained tokenizer; a caller's own plugs in through
``encode_with``.
"""

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from instructset.functions.lookup import places
from instructset.functions.prompts import EOS_TOKEN, PAD_TOKEN, UNK_TOKEN
from instructset.functions.text import tokens
from instructset.operators.positions import with_global_rank
from instructset.session import materialize, small_batches

# The special tokens, which have the first ids.
SPECIALS = (PAD_TOKEN, EOS_TOKEN, UNK_TOKEN)

# Ids below this are broadcast: some 20 MB. Ids follow frequency, so these are the
# frequent tokens and every other token is rare.
COMMON_IDS = 1_000_000
# Values that are settled before the join of rare ones, and counters of the sketch that finds them.
HOT_VALUES, HOT_COUNTERS = 1_000, 20_000


@dataclass(frozen=True)
class Vocabulary:
    """``table`` has ``token``, ``token_id`` and ``n`` for all tokens but the specials. ``common`` is the
    number of ids that are broadcast, if it is to differ from ``COMMON_IDS``."""

    table: DataFrame
    size: int
    specials: tuple[str, ...] = SPECIALS
    common: int | None = None

    @property
    def pad_id(self) -> int:
        return self.specials.index(PAD_TOKEN)

    @property
    def eos_id(self) -> int:
        return self.specials.index(EOS_TOKEN)

    @property
    def unk_id(self) -> int:
        return self.specials.index(UNK_TOKEN)


@dataclass(frozen=True)
class KeyedVocabularies:
    """A vocabulary for each value of ``by`` in one ``table``: ``by``, ``token``, ``token_id`` (ids by frequency
    within the key, after those of the specials) and ``n``."""

    table: DataFrame
    by: str
    size: int
    specials: tuple[str, ...] = SPECIALS
    common: int | None = None

    @property
    def pad_id(self) -> int:
        return self.specials.index(PAD_TOKEN)

    @property
    def unk_id(self) -> int:
        return self.specials.index(UNK_TOKEN)


def token_counts(df: DataFrame, *text_cols: str) -> DataFrame:
    """How often each token occurs; frequent tokens are summed before the shuffle."""
    found = F.concat(*[F.coalesce(tokens(F.col(c)), F.array()) for c in text_cols])
    return df.select(F.explode(found).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def build_vocabulary(
    df: DataFrame, *text_cols: str, specials: Sequence[str] = SPECIALS, min_count: int = 1
) -> Vocabulary:
    """Ids by frequency, then by token, after those of the special tokens."""
    if len(set(specials)) != len(specials):
        raise ValueError("special tokens must differ, padding from end of text above all")
    counts = token_counts(df, *text_cols).filter(
        (F.col("n") >= min_count) & ~F.col("token").isin(*specials)
    )
    ranked = with_global_rank(counts, [F.desc("n"), F.asc("token")], "rank", "vocabulary")
    table = ranked.select(
        "token", (F.col("rank") + len(specials) - 1).cast("int").alias("token_id"), "n"
    )
    return Vocabulary(table, ranked.count(), tuple(specials))


def build_vocabularies(
    df: DataFrame, by: str, *text_cols: str, specials: Sequence[str] = SPECIALS, min_count: int = 1
) -> KeyedVocabularies:
    """``build_vocabulary`` for each value of ``by`` (a rung of a sweep, say) in one job: tokens of all keys are
    ranked together, and a token's id is its rank from the first of its key."""
    if len(set(specials)) != len(specials):
        raise ValueError("special tokens must differ, padding from end of text above all")
    found = F.concat(*[F.coalesce(tokens(F.col(c)), F.array()) for c in text_cols])
    counts = df.select(F.col(by).cast("string").alias(by), F.explode(found).alias("token")).groupBy(by, "token")
    kept = counts.agg(F.count("*").alias("n")).filter((F.col("n") >= min_count) & ~F.col("token").isin(*specials))
    ranked = with_global_rank(kept, [F.asc(by), F.desc("n"), F.asc("token")], "rank", "vocabularies")
    # One row per key.
    firsts = ranked.groupBy(by).agg(F.min("rank").alias("_first"), F.count("*").alias("_size"))
    firsts = firsts.withColumnRenamed(by, "_by")
    ids = (F.col("rank") - F.col("_first") + len(specials)).cast("int").alias("token_id")
    table = ranked.join(F.broadcast(firsts), F.col(by).eqNullSafe(F.col("_by"))).select(by, "token", ids, "n")
    return KeyedVocabularies(table, by, ranked.count(), tuple(specials))


def _common_ids(vocabulary: Vocabulary | KeyedVocabularies) -> int:
    return vocabulary.common or COMMON_IDS


def _common(vocabulary: Vocabulary) -> pa.Array:
    """Tokens by id, specials included, up to COMMON_IDS of them: what the driver and every
    executor can hold, however large the vocabulary."""
    rows = vocabulary.table.filter(F.col("token_id") < _common_ids(vocabulary)).select("token_id", "token")
    listed = rows.toArrow().sort_by("token_id").column("token").combine_chunks()
    return pa.concat_arrays([pa.array(vocabulary.specials, listed.type), listed])


def _is_large(vocabulary: Vocabulary) -> bool:
    return vocabulary.size + len(vocabulary.specials) > _common_ids(vocabulary)


def _look_up(values: Column, words: Broadcast, to_ids: bool) -> Column:
    """Each array element replaced by its id or token; null where it has none here."""
    target = T.IntegerType() if to_ids else T.StringType()

    @F.arrow_udf(T.ArrayType(target))
    def run(arrays: pa.Array) -> pa.Array:
        table = words.value
        flat = arrays.flatten()
        if to_ids:
            found = places(flat, table)
        else:
            known = pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(table)))
            found = table.take(pc.if_else(known, flat, pa.scalar(None, flat.type)))
        sizes = pc.fill_null(pc.list_value_length(arrays), 0).to_numpy(zero_copy_only=False)
        offsets = pa.array([0, *sizes.cumsum()], pa.int32())
        return pa.ListArray.from_arrays(offsets, found, mask=arrays.is_null())

    return run(values)


def _frequent(gaps: DataFrame) -> list:
    """Values that occur often, at most ``HOT_VALUES``: the largest counters of sketches that every task makes and
    that are merged. What isn't among them occurs in no more than one row of some thousands."""
    top = f"approx_top_k(_value, {HOT_VALUES}, {HOT_COUNTERS})"
    found = gaps.select("_value").agg(F.expr(top).alias("top")).head()[0]
    return [r["item"] for r in found or () if r["item"] is not None]


def _resolve_rare(
    looked_up: DataFrame, id_col: str, source: str, found: str, rare: DataFrame, keep: bool
) -> DataFrame:
    """Fill the nulls of ``found`` from ``rare`` (``_value``, ``_result``).

    Only array elements that were not among the common ones are spread out and shuffled. A value
    that the vocabulary lacks can still be frequent: such values are found by a sketch, looked up on their own and
    settled where they stand, so that no key of the join is hot. ``source`` is written only to ``keep`` it.
    """
    gaps = F.array_compact(
        F.transform(
            F.arrays_zip(F.col(source).alias("value"), F.col(found).alias("result")),
            lambda e, i: F.when(
                e["result"].isNull(), F.struct(i.alias("_at"), e["value"].alias("_value"))
            ),
        )
    )
    # Read by the sketch, by the join and by what is filled; the gaps are all that the first two read.
    open_ = looked_up.withColumn("_gaps", gaps)
    looked_up = materialize(open_ if keep else open_.drop(source), "looked-up")
    spread = looked_up.select(id_col, F.inline("_gaps"))
    looked_up = looked_up.drop("_gaps")
    hot = _frequent(spread)
    answers = spread.join(rare, "_value", "left")
    if hot:
        values = looked_up.sparkSession.createDataFrame([(v,) for v in hot], spread.select("_value").schema)
        # As many rows as there are hot values, here and in the broadcasts.
        known = rare.join(F.broadcast(values), "_value", "left_semi").collect()
        results = {r["_value"]: r["_result"] for r in known}
        kind = T.StructType([spread.schema["_value"], rare.schema["_result"], T.StructField("_hot", T.BooleanType())])
        settled = looked_up.sparkSession.createDataFrame([(v, results.get(v), True) for v in hot], kind)
        marked = spread.join(F.broadcast(settled), "_value", "left")
        others = marked.filter("_hot IS NULL").drop("_hot", "_result").join(rare, "_value", "left")
        answers = marked.filter("_hot").drop("_hot").select(answers.columns).unionByName(others)
    filled = (
        answers.groupBy(id_col)
        .agg(F.sort_array(F.collect_list(F.struct("_at", "_result"))).alias("_filled"))
    )
    slots = F.transform(found, lambda v, i: F.struct(i.alias("_at"), v.alias("_result")))
    known = F.filter(slots, lambda e: e["_result"].isNotNull())
    whole = F.sort_array(F.concat(known, F.coalesce("_filled", F.array())))
    return (
        looked_up.join(filled, id_col, "left")
        .withColumn(found, F.transform(whole, lambda e: e["_result"]))
        .drop("_filled")
    )


def encode(
    df: DataFrame,
    id_col: str,
    token_col: str,
    vocabulary: Vocabulary | KeyedVocabularies,
    out_col: str = "input_ids",
    keep: bool = True,
) -> DataFrame:
    """Adds the ids of an array of tokens, or without ``keep`` puts them in its place. Frequent tokens are looked up
    in place; with a vocabulary larger than that, the others are joined. With keyed vocabularies a row's key is the
    field of that name in its id."""
    small_batches(df.sparkSession)
    if isinstance(vocabulary, KeyedVocabularies):
        coded = _encode_keyed(df, id_col, token_col, vocabulary, out_col)
        return coded if keep else coded.drop(token_col)
    words = df.sparkSession.sparkContext.broadcast(_common(vocabulary))
    coded = df.withColumn(out_col, _look_up(F.col(token_col), words, to_ids=True))
    if _is_large(vocabulary):
        rare = vocabulary.table.filter(F.col("token_id") >= _common_ids(vocabulary)).select(
            F.col("token").alias("_value"), F.col("token_id").alias("_result")
        )
        coded = _resolve_rare(coded, id_col, token_col, out_col, rare, keep)
    elif not keep:
        coded = coded.drop(token_col)
    unknown = F.lit(vocabulary.unk_id)
    return coded.withColumn(out_col, F.transform(out_col, lambda x: F.coalesce(x, unknown)))


def _encode_keyed(
    df: DataFrame, id_col: str, token_col: str, vocabularies: KeyedVocabularies, out_col: str
) -> DataFrame:
    by = vocabularies.by
    spark = df.sparkSession

    def keyed(key: Column, token: Column) -> Column:
        return F.concat(F.coalesce(key, F.lit("")), F.lit("\x00"), token)

    keys = vocabularies.table.select(by).distinct()
    ids = F.posexplode(F.array(*[F.lit(t) for t in vocabularies.specials])).alias("token_id", "token")
    whole = vocabularies.table.select(by, "token", "token_id").unionByName(keys.select(by, ids))
    whole = whole.select(keyed(F.col(by), F.col("token")).alias("_value"), F.col("token_id").alias("_result"))
    # The most frequent tokens of each key, as many in all as of one vocabulary.
    share = max(_common_ids(vocabularies) // max(keys.count(), 1), len(vocabularies.specials))
    common = whole.filter(F.col("_result") < share).toArrow().combine_chunks()
    words = spark.sparkContext.broadcast((common.column("_value").combine_chunks(), common.column("_result").combine_chunks()))

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def run(arrays: pa.Array) -> pa.Array:
        listed, numbers = words.value
        at = places(arrays.flatten(), listed)
        sizes = pc.fill_null(pc.list_value_length(arrays), 0).to_numpy(zero_copy_only=False)
        offsets = pa.array([0, *sizes.cumsum()], pa.int32())
        return pa.ListArray.from_arrays(offsets, numbers.take(at), mask=arrays.is_null())

    key = F.col(f"{id_col}.{by}").cast("string")
    named = df.withColumn("_keyed", F.transform(token_col, lambda t: keyed(key, t)))
    coded = named.withColumn(out_col, run(F.col("_keyed")))
    if vocabularies.size > share:
        rare = whole.filter(F.col("_result") >= share)
        coded = _resolve_rare(coded, id_col, "_keyed", out_col, rare, False)
    unknown = F.lit(vocabularies.unk_id)
    return coded.withColumn(out_col, F.transform(out_col, lambda x: F.coalesce(x, unknown))).drop("_keyed")


def decode(
    df: DataFrame, id_col: str, ids_col: str, vocabulary: Vocabulary, out_col: str = "text", keep: bool = True
) -> DataFrame:
    """Adds the tokens of an array of ids, joined by spaces, or without ``keep`` puts them in its place; special ids
    are skipped."""
    small_batches(df.sparkSession)
    specials = len(vocabulary.specials)
    words = df.sparkSession.sparkContext.broadcast(_common(vocabulary))
    plain = df.withColumn("_ids", F.filter(ids_col, lambda x: x >= specials))
    if not keep:
        plain = plain.drop(ids_col)
    spelled = plain.withColumn(out_col, _look_up(F.col("_ids"), words, to_ids=False))
    if _is_large(vocabulary):
        rare = vocabulary.table.filter(F.col("token_id") >= _common_ids(vocabulary)).select(
            F.col("token_id").alias("_value"), F.col("token").alias("_result")
        )
        spelled = _resolve_rare(spelled, id_col, "_ids", out_col, rare, False)
    return spelled.withColumn(out_col, F.array_join(out_col, " ")).drop("_ids")


def encode_with(
    text: Column, load: Callable[[], Callable[[list[str]], list[list[int]]]]
) -> Column:
    """Ids from a caller's tokenizer, which ``load`` makes once in each task."""

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = load()
        for batch in batches:
            present = batch.notna()
            out = pd.Series([None] * len(batch), index=batch.index, dtype=object)
            encoded = tokenizer(batch[present].tolist())
            for at, ids in zip(batch.index[present], encoded):
                out.at[at] = list(ids)
            yield out

    return run(text)
