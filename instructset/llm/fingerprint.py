"""Fingerprints of documents as invertible Bloom lookup sketches, and the likeness of two versions.

A text's paragraphs are its lines, cut again after sentence ends. Their distinct digests (63 bits of a 64-bit
hash) are put into cells: each digest goes into three of fifteen, one in each third, and a
cell holds a count, the digests and their checks, the last two added up by exclusive or. Cells of
two versions subtract, and what they share cancels. A cell left with one digest gives it away (its
check tells); taking that digest out of its other cells lays open more, until nothing is left.

The fingerprint is the sketch of fifteen cells. If two fingerprints can't be peeled, both texts get larger
sketches: the digests are dealt into groups by their leading bits, fifteen cells to each, with
about four differing digests a group at most; on failure four times as many groups, and so on with new
places, ``RETRIES`` times. What none of them resolves (a chance of some 10^-6 or less) is counted by array difference.

Likeness is the Jaccard similarity that follows from the sizes and the number of differing
digests: 1 for equal sets, two empty ones included, 0 without a common paragraph.

Native: column expressions only. ``next_document`` deals rows into ranges of the id, so that one
shuffle finds every document's successor; each range also gets the first row of the one after it.
Null text is empty. A null id comes first. Rows with the same id follow each other by text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from instructset.llm.common import id_order, id_range

CELLS, THIRD = 15, 5
RETRIES = 4
#: A paragraph ends at a line end, or at white space after one of these marks.
_PARAGRAPH = r"\n|(?<=[.!?$])[ \t\r]+"
#: Rounds of peeling; a group holds few digests.
_ROUNDS = 9


def digests(text: str) -> str:
    """SQL: distinct digests of the paragraphs of a text column, lowest bit 0."""
    cut = f"array_remove(split(coalesce({text}, ''), r'{_PARAGRAPH}'), '')"
    return f"array_distinct(transform({cut}, x -> xxhash64(x) & -2L))"


def _hit(x: str, cell: str, seed: int) -> str:
    """SQL: digest x goes into the cell, by six bits of it for each third."""
    low = 1 + 18 * (seed % 3)
    return f"(((shiftright({x}, {low} + 6 * ({cell} div {THIRD})) & 63L) % {THIRD}) = ({cell} % {THIRD}))"


def _cells(signed: str, seed: int) -> str:
    """SQL: cells of an array of digests whose lowest bit tells which side they are from."""
    mine = f"filter(q, x -> {_hit('x', 'c', seed)})"
    return (
        f"transform(array({signed}), q -> transform(sequence(0, {CELLS - 1}), c -> transform(array({mine}), f -> struct("
        "aggregate(f, 0L, (a, x) -> a + 1 - 2 * (x & 1)) AS n,"
        "aggregate(f, 0L, (a, x) -> a ^ (x & -2L)) AS k,"
        "aggregate(f, 0L, (a, x) -> a ^ xxhash64(x & -2L)) AS h))[0]))[0]"
    )


def _peeled(cells: str, seed: int) -> str:
    """SQL: number of digests that the cells give away, or null if something stays in them."""
    pure = "filter(s.cells, x -> abs(x.n) = 1 AND x.h = xxhash64(x.k))"
    out = f"filter(p, y -> {_hit('y.k', 'i', seed)})"
    left = (
        f"transform(s.cells, (x, i) -> IF(x.n = 0 AND x.k = 0, x, transform(array({out}), f -> struct("
        "aggregate(f, x.n, (a, y) -> a - y.n) AS n,"
        "aggregate(f, x.k, (a, y) -> a ^ y.k) AS k,"
        "aggregate(f, x.h, (a, y) -> a ^ xxhash64(y.k)) AS h))[0]))"
    )
    step = (
        f"IF(s.done, s, transform(array(array_distinct(transform({pure}, x -> struct(x.k AS k, x.n AS n)))), p ->"
        f" IF(size(p) = 0, named_struct('cells', s.cells, 'found', s.found, 'done', true),"
        f" named_struct('cells', {left}, 'found', s.found + size(p), 'done', false)))[0])"
    )
    end = "IF(exists(s.cells, x -> x.n <> 0 OR x.k <> 0 OR x.h <> 0), CAST(NULL AS INT), s.found)"
    return (
        f"aggregate(sequence(1, {_ROUNDS}), named_struct('cells', {cells}, 'found', 0, 'done', false),"
        f" (s, r) -> {step}, s -> {end})"
    )


def sketch(digests: str) -> str:
    """SQL: the fifteen cells of a fingerprint."""
    return _cells(digests, 0)


def shown(cells: str) -> str:
    """SQL: a sketch as text, per cell count, digest and half the check in hexadecimal."""
    return (
        f"lower(array_join(transform({cells}, x -> concat(hex(x.n), '.', lpad(hex(x.k), 16, '0'),"
        " lpad(hex(x.h & 4294967295L), 8, '0'))), ' '))"
    )


def _first_try(a: str, b: str) -> str:
    """SQL: differing digests from two fingerprints, or null."""
    less = f"zip_with({a}, {b}, (x, y) -> struct(x.n - y.n AS n, x.k ^ y.k AS k, x.h ^ y.h AS h))"
    return _peeled(less, 0)


def _larger_try(signed: str, groups: str, seed: int) -> str:
    """SQL: differing digests from sketches with ``groups`` (a power of two) times the cells, or null.

    ``signed`` is sorted, so that a group, the leading bits, stands together."""
    group = "shiftrightunsigned({}, 64 - CAST(log2(g) AS INT))"
    starts = f"filter(sequence(0, size(v) - 1), i -> i = 0 OR {group.format('v[i]')} <> {group.format('v[i - 1]')})"
    parts = "transform(w, (j, i) -> slice(v, j + 1, IF(i + 1 < size(w), w[i + 1], size(v)) - j))"
    each = _peeled(_cells("o", seed), seed)
    total = f"aggregate({parts}, 0, (t, o) -> t + IF(size(o) = 1, 1, {each}))"
    return (
        f"transform(array({groups}), g -> transform(array({signed}), v -> IF(size(v) = 0, 0,"
        f" transform(array({starts}), w -> {total})[0]))[0])[0]"
    )


def with_likeness(df: DataFrame, name: str, a: str, b: str, a_cells: str, b_cells: str) -> DataFrame:
    """``df`` with the likeness of two digest columns, whose fingerprint cells are columns too."""
    df = df.withColumn("_d", F.expr(_first_try(a_cells, b_cells)))
    both = f"sort_array(concat({a}, transform({b}, x -> x | 1L)))"
    df = df.withColumn("_v", F.expr(f"IF(_d IS NULL, {both}, NULL)"))
    for i in range(RETRIES):
        least = f"CAST(power(2, ceil(log2(greatest(2, size(_v) / 4)))) AS INT) * {4**i}"
        df = df.withColumn("_d", F.expr(f"IF(_d IS NOT NULL, _d, {_larger_try('_v', least, i + 1)})"))
    exact = f"size(array_except({a}, {b})) + size(array_except({b}, {a}))"
    df = df.withColumn("_d", F.expr(f"coalesce(_d, {exact})"))
    total = f"size({a}) + size({b})"
    return df.withColumn(name, F.expr(f"IF({total} = 0, 1D, ({total} - _d) / CAST({total} + _d AS DOUBLE))")).drop("_d", "_v")


def next_document(docs: DataFrame, ranges: int, columns: list[str]) -> DataFrame:
    """``docs`` with ``_next``, a struct of the columns of the document with the next id; the last one's is the first."""
    key = id_order()
    own = docs.withColumn("_range", id_range(docs, ranges))
    firsts = own.groupBy("_range").agg(F.min(key).alias("first")).orderBy("_range").collect()
    before = {r._range: (r.first, firsts[i - 1]._range, i == 0) for i, r in enumerate(firsts)}
    if not before:
        return own.withColumn("_next", F.struct(*columns)).drop("_range")
    # A range's first row goes to the range before it too, behind all rows there; the very first goes behind the last.
    places = F.array(F.struct(F.col("_range").alias("range"), F.lit(False).alias("carried")))
    moved = F.create_map(*(F.lit(x) for r, (_, to, _) in before.items() for x in (r, to)))
    first = F.create_map(*(F.lit(x) for r, (low, _, _) in before.items() for x in (r, low)))
    extra = F.array(F.struct(moved[F.col("_range")].alias("range"), F.lit(True).alias("carried")))
    own = own.withColumn("_place", F.explode(F.when(key == first[F.col("_range")], F.concat(places, extra)).otherwise(places)))
    own = own.select("*", F.col("_place.range").alias("_at"), F.col("_place.carried").alias("_carried"))
    # A range to a partition: hashed numbers would leave some partitions with several ranges and some with none.
    own = own.repartitionById(ranges, "_at")
    found = own.withColumn("_next", F.lead(F.struct(*columns)).over(W.partitionBy("_at").orderBy("_carried", key, "text")))
    return found.where("NOT _carried").drop("_range", "_place", "_at", "_carried")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text, digests, cells of the fingerprint, fingerprint."""
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    own = own.withColumn("digests", F.expr(digests("text"))).withColumn("cells", F.expr(sketch("digests")))
    return own.withColumn("fingerprint", F.expr(shown("cells")))


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Each document beside its edited text (its last half replaced by the start of the next document's)
    and the next document, with fingerprints and likenesses."""
    spark = docs.sparkSession
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    own = own.withColumn("digests", F.expr(digests("text")))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df = next_document(own, ranges, ["text", "digests"])
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.expr("left(text, length(text) - CAST(floor(length(text) / 2) AS INT))"), F.left(F.col("_next.text"), half))
    df = df.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), "digests", edited.alias("edited"),
        F.col("_next.digests").alias("next_digests"),
    )
    df = df.withColumn("edited_digests", F.expr(digests("edited"))).withColumn("edited_sha256", F.sha2("edited", 256)).drop("edited")
    df = df.withColumn("cells", F.expr(sketch("digests"))).withColumn("edited_cells", F.expr(sketch("edited_digests")))
    df = df.withColumn("next_cells", F.expr(sketch("next_digests")))
    df = df.withColumn("fingerprint", F.expr(shown("cells"))).withColumn("edited_fingerprint", F.expr(shown("edited_cells")))
    df = with_likeness(df, "near_edited", "digests", "edited_digests", "cells", "edited_cells")
    df = with_likeness(df, "near_next", "digests", "next_digests", "cells", "next_cells")
    return df.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
