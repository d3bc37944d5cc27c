"""Exact samples, splits and limits that never sort or move whole tables.

A draw keeps the rows with the smallest keys, where the key of a row is the MD5 of
seed, salt and id: the same rows whatever the partitioning. The cut-off key of a draw
is found from scans of the id column alone: a histogram over key prefixes tells the
bucket that holds it, a second one over the next digits the part of that bucket, and ranking the
keys of this part tells the key. The rows are then chosen by one comparison in their
scan, without a shuffle. Ids are taken to be unique: rows with the same id are drawn together.

The cut-offs are scalar subqueries over the table they are for. Write a selection down
(``session.materialize``) before selecting from it again: that saves its scans from being
repeated, and the optimizer fails on some plans with subqueries inside subqueries.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from instructset.operators.positions import file_chunks, with_row_index
from instructset.session import materialize

# Hexadecimal digits of a key that make its bucket. A task adds at most 4,096 rows per salt
# to each of the two histograms of a draw. Where
# whole rows are ranked, buckets are finer: about one row in 65,536.
_CUT_DIGITS = 3
_RANK_DIGITS = 4
# Values of which every task may send its smallest to one.
_TOP = 1 << 14

# Sizes of the training ladders and of the held-out sets.
LADDER = {
    "1k": 1_000,
    "5k": 5_000,
    "10k": 10_000,
    "50k": 50_000,
    "100k": 100_000,
    "150k": 150_000,
    "200k": 200_000,
}
RESPLIT_LADDER = {"1k": 1_000, "5k": 5_000, "10k": 10_000, "50k": 50_000}
SUMMARY_LADDER = {"1k": 1_000, "5k": 5_000, "10k": 10_000, "25k": 25_000}
HELD_OUT = 10_000
SEED = 1


@dataclass(frozen=True)
class Draw:
    """``size`` rows, as a number or as a function of the number of rows."""

    size: int | Callable[[Column], Column]
    salt: str = ""

    def wanted(self, total: Column) -> Column:
        return self.size(total) if callable(self.size) else F.lit(self.size)


def draw_key(id_col: str, salt: str = "", seed: int = SEED) -> Column:
    """An id-dependent key with no ties and no order of its own."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(salt), F.col(id_col).cast("string")))


def _prefix(key: Column, digits: int) -> Column:
    return F.substring(key, 1, digits)


def _histogram(keyed: DataFrame, digits: int) -> DataFrame:
    """Rows per (salt, key prefix) with the number of rows before; at most 16 ** digits
    rows for each salt, whatever the table size."""
    counts = keyed.groupBy("salt", _prefix(F.col("key"), digits).alias("prefix")).agg(
        F.count("*").alias("n")
    )
    ordered = W.partitionBy("salt").orderBy("prefix")
    return counts.select(
        "salt",
        "prefix",
        "n",
        (F.sum("n").over(ordered) - F.col("n")).alias("before"),
        F.sum("n").over(W.partitionBy("salt")).alias("total"),
    )


def cutoffs(
    df: DataFrame, id_col: str, draws: Mapping[str, Draw], seed: int = SEED, strict: bool = False
) -> DataFrame:
    """One row ``(draw, key, id)`` per draw: the last row that belongs to it.

    A draw larger than the table takes every row, or fails with ``strict``.
    """
    salts = sorted({d.salt for d in draws.values()})
    keyed = df.select(
        F.col(id_col).alias("id"),
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(s).alias("salt"), draw_key(id_col, s, seed).alias("key"))
                    for s in salts
                ]
            )
        ),
    )

    def target(name: str, draw: Draw) -> Column:
        wanted = draw.wanted(F.col("total")).cast("bigint")
        if strict:
            wanted = F.when(wanted <= F.col("total"), wanted).otherwise(
                F.raise_error(F.lit(f"sample {name} is larger than its population")).cast("bigint")
            )
        return F.struct(
            F.lit(name).alias("draw"),
            F.lit(draw.salt).alias("of"),
            F.least(wanted, F.col("total")).alias("wanted"),
        )

    holding = (
        _histogram(keyed, _CUT_DIGITS)
        .select(
            "salt",
            "prefix",
            "n",
            "before",
            F.inline(F.array(*[target(name, draw) for name, draw in draws.items()])),
        )
        .filter(
            (F.col("of") == F.col("salt"))
            & (F.col("before") < F.col("wanted"))
            & (F.col("wanted") <= F.col("before") + F.col("n"))
        )
        .select("draw", "salt", "prefix", (F.col("wanted") - F.col("before")).alias("nth"))
    )
    # ``holding`` and ``narrowed`` have one row per draw, which bounds the broadcasts. The digits
    # that follow part the bucket again, so that one row in 16 million is ranked.
    inside = keyed.withColumn("prefix", _prefix(F.col("key"), _CUT_DIGITS)).join(
        F.broadcast(holding), ["salt", "prefix"]
    )
    inside = inside.withColumn("finer", F.substring("key", _CUT_DIGITS + 1, _CUT_DIGITS)).drop("prefix")
    counts = inside.groupBy("draw", "nth", "finer").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(W.partitionBy("draw").orderBy("finer"))
    narrowed = (
        counts.withColumn("before", upto - F.col("n"))
        .filter((F.col("before") < F.col("nth")) & (F.col("nth") <= F.col("before") + F.col("n")))
        .select("draw", "finer", (F.col("nth") - F.col("before")).alias("place"))
    )
    return (
        inside.join(F.broadcast(narrowed), ["draw", "finer"])
        .withColumn("rank", F.row_number().over(W.partitionBy("draw").orderBy("key", "id")))
        .filter(F.col("rank") == F.col("place"))
        .select("draw", "key", "id")
    )


def membership(
    df: DataFrame, id_col: str, draws: Mapping[str, Draw], seed: int = SEED, strict: bool = False
) -> dict[str, Column]:
    """For each draw the predicate that tells its rows.

    Equal keys mean equal ids, so the key alone is compared.
    """
    names = list(draws)
    last = [F.max(F.when(F.col("draw") == name, F.col("key"))).alias(f"cut{i}") for i, name in enumerate(names)]
    row = cutoffs(df, id_col, draws, seed, strict).agg(*last)
    limits = row.select(F.struct(*row.columns)).scalar()
    return {
        name: F.coalesce(draw_key(id_col, draws[name].salt, seed) <= limits[f"cut{i}"], F.lit(False))
        for i, name in enumerate(names)
    }


def exact_sample(
    df: DataFrame, id_col: str, n: int, salt: str = "", seed: int = SEED, strict: bool = False
) -> DataFrame:
    """Exactly ``n`` rows without replacement (fewer only where there are fewer)."""
    return df.filter(membership(df, id_col, {"sample": Draw(n, salt)}, seed, strict)["sample"])


def sample_ladder(
    df: DataFrame,
    id_col: str,
    sizes: Mapping[str, int],
    seed: int = SEED,
    nested: bool = False,
    strict: bool = False,
) -> DataFrame:
    """One row per (rung, drawn row). Rungs are independent and may overlap; with
    ``nested`` each rung contains the smaller ones. One scan serves all rungs."""
    draws = {name: Draw(n, "ladder" if nested else name) for name, n in sizes.items()}
    members = membership(df, id_col, draws, seed, strict)
    rungs = F.array(*[F.when(member, F.lit(name)) for name, member in members.items()])
    return df.filter(reduce(or_, members.values())).withColumn(
        "rung", F.explode(F.array_compact(rungs))
    )


def _share(fraction: float) -> Callable[[Column], Column]:
    return lambda total: F.floor(total * F.lit(float(fraction)))


def shuffled_split(
    df: DataFrame,
    id_col: str,
    cuts: Sequence[float] = (0.7, 0.8),
    names: Sequence[str] = ("train", "dev", "test"),
    seed: int = SEED,
    salt: str = "split",
) -> DataFrame:
    """Shuffle and cut at ``floor(n * cut)``; adds ``split``."""
    draws = {str(i): Draw(_share(cut), salt) for i, cut in enumerate(cuts)}
    members = membership(df, id_col, draws, seed)
    choice = F.lit(names[len(cuts)])
    for i in reversed(range(len(cuts))):
        choice = F.when(members[str(i)], F.lit(names[i])).otherwise(choice)
    return df.withColumn("split", choice)


def train_validation_split(
    df: DataFrame,
    id_col: str,
    test_size: float = 0.001,
    seed: int = SEED,
    salt: str = "validation",
) -> DataFrame:
    """Exactly ``ceil(n * test_size)`` rows go to ``validation``."""
    held = Draw(lambda total: F.ceil(total * F.lit(float(test_size))), salt)
    chosen = membership(df, id_col, {"validation": held}, seed)["validation"]
    return df.withColumn(
        "split", F.when(chosen, F.lit("validation")).otherwise(F.lit("train"))
    )


def shuffle_rows(
    df: DataFrame,
    id_col: str,
    seed: int = SEED,
    salt: str = "shuffle",
    rank_col: str = "shuffle_rank",
) -> DataFrame:
    """Adds the place (from 1) of each row in a random order of the whole table.

    Rows are ranked inside their key prefix and moved by the number of rows before it,
    so no task ever sees more than about one row in 65,536.
    """
    keyed = df.withColumn("_key", draw_key(id_col, salt, seed)).withColumn(
        "_prefix", _prefix(F.col("_key"), _RANK_DIGITS)
    )
    starts = _histogram(
        df.select(F.lit(salt).alias("salt"), draw_key(id_col, salt, seed).alias("key")),
        _RANK_DIGITS,
    ).select(F.col("prefix").alias("_prefix"), F.col("before").alias("_before"))
    inside = F.row_number().over(W.partitionBy("_prefix").orderBy("_key", id_col))
    return (
        keyed.join(F.broadcast(starts), "_prefix")
        .withColumn(rank_col, (F.col("_before") + inside).cast("bigint"))
        .drop("_key", "_prefix", "_before")
    )


def nth_smallest(df: DataFrame, order_col: str, n: int) -> DataFrame:
    """One row: the ``n``-th smallest value of a unique integer column, null if there
    are fewer. Only that column is read.

    Up to ``_TOP`` values, each task sends its ``n`` smallest. Beyond, digits of the value are
    counted from the left, each pass inside the range that the one before found, however
    the values are spread, until one value is left."""
    values = df.select(F.col(order_col).cast("bigint").alias("v")).filter(F.col("v").isNotNull())
    if n <= _TOP:
        first = values.orderBy("v").limit(n).agg(F.max("v").alias("v"), F.count("*").alias("n"))
        return first.select(F.when(F.col("n") == n, F.col("v")).alias("v"))
    if values.count() < n:
        return values.agg(F.max(F.lit(None).cast("bigint")).alias("v"))
    # Four digits of 16 bits; the first is signed, as the value is.
    found, left = 0, n
    for shift in (48, 32, 16, 0):
        digit = F.shiftright("v", shift)
        digit = digit if shift == 48 else digit.bitwiseAND(F.lit(0xFFFF))
        inside = values if shift == 48 else values.filter(F.shiftright("v", shift + 16) == found)
        for row in sorted(inside.groupBy(digit.alias("d")).agg(F.count("*").alias("n")).collect()):
            if left <= row.n:
                found = (found << 16) + row.d
                break
            left -= row.n
    return df.sparkSession.range(1).select(F.lit(found).cast("bigint").alias("v"))


def first_rows(
    df: DataFrame, order_col: str, n: int | None, must_exist: bool = False
) -> DataFrame:
    """The first ``n`` rows by a unique integer position; ``None`` or -1 keeps all.

    With ``must_exist`` a table with fewer rows is an error.
    """
    if n is None or n == -1:
        return df
    last = nth_smallest(df, order_col, n).scalar()
    if must_exist:
        last = F.coalesce(
            last, F.raise_error(F.lit(f"fewer than {n} rows")).cast("bigint")
        )
        return df.filter(F.col(order_col) <= last)
    return df.filter(last.isNull() | (F.col(order_col) <= last))


def early_stop(df: DataFrame, order_col: str, keep: Column, limit: int, enough: int) -> DataFrame:
    """Kept rows of a scan that stops once it is past position ``limit`` and has kept
    ``enough`` rows; the row that stops it is included.

    The stop is the first kept row past ``limit`` that is not before the ``enough``-th
    kept row, which needs no running count. The positions of kept rows are written once, so that
    ``keep`` is evaluated for them and for the rows up to the stop only.
    """
    kept = materialize(df.filter(keep).select(F.col(order_col).cast("bigint").alias("v")), "kept")
    full = nth_smallest(kept, "v", enough).scalar()
    stop = kept.filter((F.col("v") > limit) & (F.col("v") >= full)).agg(F.min("v")).scalar()
    return df.filter(stop.isNull() | (F.col(order_col) <= stop)).filter(keep)


def first_file_rows(
    df: DataFrame, n: int | None, index_col: str = "pos", must_exist: bool = False
) -> DataFrame:
    """The first ``n`` rows of a table as it was read, with their places; ``None`` or -1 keeps all.

    Files are counted in their order until they hold ``n`` rows; later ones are never opened. With
    ``must_exist`` fewer rows are an error."""
    if n is None or n == -1:
        return with_row_index(df, index_col)
    chunks, rows = [], 0
    for chunk, rows in file_chunks(df, index_col):
        chunks.append(chunk)
        if rows >= n:
            break
    if must_exist and rows < n:
        raise ValueError(f"fewer than {n} rows")
    if not chunks:
        return with_row_index(df, index_col)
    return reduce(DataFrame.unionByName, chunks).filter(F.col(index_col) < n)


def early_stop_files(
    df: DataFrame, keep: Column, limit: int, enough: int, index_col: str = "pos"
) -> DataFrame:
    """``early_stop`` over the files of a table as it was read, with the rows' places: files are read in
    their order, twice as many each time, until the row that stops the scan is among them.

    Places of kept rows are written for each step, so that the last pass evaluates ``keep`` once more for
    the files read, and no later file is opened."""
    chunks, kept, total = [], [], 0
    for chunk, _ in file_chunks(df, index_col):
        chunks.append(chunk)
        places = chunk.filter(keep).select(F.col(index_col).cast("bigint").alias("v"))
        kept.append(materialize(places, "kept"))
        total += kept[-1].count()
        if total < enough:
            continue
        known = reduce(DataFrame.unionByName, kept)
        full = nth_smallest(known, "v", enough).head()[0]
        stop = known.filter((F.col("v") > limit) & (F.col("v") >= full)).agg(F.min("v")).head()[0]
        if stop is not None:
            read = reduce(DataFrame.unionByName, chunks)
            return read.filter(F.col(index_col) <= stop).filter(keep)
    if not chunks:
        return with_row_index(df, index_col).filter(keep)
    return reduce(DataFrame.unionByName, chunks).filter(keep)


def preview(df: DataFrame, id_col: str, n: int = 2, seed: int = SEED) -> DataFrame:
    return exact_sample(df, id_col, n, "preview", seed)
