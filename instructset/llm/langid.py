"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of up to ``ORDER`` bytes with the counts of the bytes that
followed them in a training sample. A byte costs minus the binary logarithm of its share in the
longest known context; one that the context hasn't seen costs the escape (the number of distinct
followers weighs as one more count for each, so escapes cost more where few bytes follow) and goes
on in the next shorter context, at last among all 256 bytes. The counts are frozen after training, so a text's code length is
exact and the same wherever it is computed. The language with the shortest code wins, the first by
name on ties.

The trees of all languages lie in one hash table with a row of costs per context and byte, so
a batch of texts is scored by a look-up per byte. Texts are lower-cased first.

Training reads a documented bounded sample: about ``sample_bytes`` bytes over all languages, of texts
up to ``longest`` bytes, drawn by a hash of the id. Everything else covers all rows and whole texts.

A text that is null or has no letter gets ``und``, score 0 and no bits; so does every text where
there is nothing to learn from. Repeated rows get the same result. Rows with a null id are scored too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from instructset.llm.common import prepare
from instructset.llm.hashing import HashIndex, passes, text_buffer

ORDER = 4
UNKNOWN = "und"
_MASK = [np.uint64((1 << (8 * k)) - 1) for k in range(ORDER + 2)]


def _tag(keys: np.ndarray, order: int) -> np.ndarray:
    return keys | np.uint64((order + 1) << 56)


def contexts(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte the last ORDER + 1 bytes, itself lowest, and how many bytes of context it has."""
    packed = data.astype(np.uint64)
    for k in range(1, ORDER + 1):
        packed[k:] |= data[:-k].astype(np.uint64) << np.uint64(8 * k)
    depth = np.minimum(np.arange(len(data)) - np.repeat(edges[:-1], np.diff(edges)), ORDER)
    return packed, depth


class Trees:
    """The context trees of all languages."""

    def __init__(self, texts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.languages = sorted(texts)
        parts = [contexts(*texts[name]) for name in self.languages]
        grams, costs, known, escapes = [], [], [], []
        shorter: tuple[np.ndarray, np.ndarray] | None = None
        for order in range(ORDER + 1):
            seen = [np.unique(p[d >= order] & _MASK[order + 1], return_counts=True) for p, d in parts]
            every = np.unique(np.concatenate([g for g, _ in seen]))
            around = np.unique(every >> np.uint64(8))
            place = np.searchsorted(around, every >> np.uint64(8))
            cost, escape = np.zeros((len(every), len(seen))), np.zeros((len(around), len(seen)))
            if shorter is None:
                below = np.full((len(every), len(seen)), 8.0)
            else:
                below = shorter[1][np.searchsorted(shorter[0], every & _MASK[order])]
            for j, (gram, count) in enumerate(seen):
                at = np.searchsorted(around, gram >> np.uint64(8))
                total = np.bincount(at, weights=count, minlength=len(around))
                distinct = np.bincount(at, minlength=len(around))
                met = distinct > 0
                escape[met, j] = np.log2((total[met] + distinct[met]) / distinct[met])
                cost[:, j] = escape[place, j] + below[:, j]
                cost[np.searchsorted(every, gram), j] = np.log2((total + distinct)[at] / count)
            grams.append(_tag(every, order))
            costs.append(cost)
            known.append(_tag(around, order))
            escapes.append(escape)
            shorter = every, cost
        self.grams, self.costs = HashIndex(np.concatenate(grams)), np.concatenate(costs).astype(np.float32)
        self.known, self.escapes = HashIndex(np.concatenate(known)), np.concatenate(escapes).astype(np.float32)

    def bits(self, data: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Code length of each text (rows) in each language."""
        packed, depth = contexts(data, edges)
        cost = np.zeros((len(data), len(self.languages)), np.float32)
        left = np.zeros(0, np.int64)
        for order in range(ORDER, -1, -1):
            left = np.concatenate((left, np.flatnonzero(depth == order)))
            row = self.grams.find(_tag(packed[left] & _MASK[order + 1], order))
            hit = row >= 0
            cost[left[hit]] += self.costs[row[hit]]
            left = left[~hit]
            row = self.known.find(_tag(packed[left] >> np.uint64(8) & _MASK[order], order))
            cost[left[row >= 0]] += self.escapes[row[row >= 0]]
        cost[left] += np.float32(8)
        out = np.zeros((len(edges) - 1, len(self.languages)))
        full = np.flatnonzero(np.diff(edges))
        if len(full):
            out[full] = np.add.reduceat(cost, edges[full], axis=0, dtype=np.float64)
        return out


def _lowered(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(texts.cast(pa.large_string()))


def train(docs: DataFrame, sample_bytes: int = 6_000_000, longest: int = 1 << 20) -> Trees | None:
    """Trees from ``docs`` with doc_id, text and lang; rows with a null text or lang teach nothing.

    Each language has an equal share of ``sample_bytes``, drawn by hash, and one draw at least, so that none
    is left out. A text over ``longest`` bytes is drawn by pieces of a quarter of that many characters."""
    step = longest // 4
    whole = docs.select("doc_id", "text", "lang", F.octet_length("text").alias("size")).where(
        F.col("lang").isNotNull() & (F.col("size") >= 1)
    )
    long = F.col("size") > longest
    last = F.when(long, F.floor((F.length("text") - 1) / step)).otherwise(F.lit(0)).cast("int")
    pieces = whole.withColumn("piece", F.explode(F.sequence(F.lit(0), last)))
    text = F.when(long, F.substring(F.col("text"), F.col("piece") * step + 1, F.lit(step))).otherwise(F.col("text"))
    named = F.when(F.col("piece") == 0, F.xxhash64("doc_id", "size")).otherwise(F.xxhash64("doc_id", "size", "piece"))
    usable = pieces.select("lang", text.alias("text"), F.pmod(named, F.lit(1 << 30)).alias("draw"))
    shares = usable.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("size"), F.min("draw").alias("least")).collect()
    if not shares:
        return None
    share = F.lit(0)
    for r in shares:
        part = min(1.0, sample_bytes / len(shares) / r.size)
        share = F.when(F.col("lang") == r.lang, max(int(part * (1 << 30)), r.least + 1)).otherwise(share)
    drawn = usable.where(F.col("draw") < share)
    rows = drawn.select("lang", "text").toArrow()
    texts = {}
    for name in sorted(set(rows.column("lang").to_pylist())):
        own = rows.filter(pc.equal(rows.column("lang"), name)).column("text").combine_chunks()
        texts[name] = text_buffer(_lowered(own))
    return Trees(texts) if texts else None


def predict(docs: DataFrame, trees: Trees | None, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score (the winner's share of the likelihoods, 0 to 1) and bits
    (its code length per byte), in place of columns of these names. Map only."""
    spark = docs.sparkSession
    prepare(spark)
    model = spark.sparkContext.broadcast(trees)
    kept = docs.drop("lang_pred", "score", "bits")
    kept = kept.withColumn("_has a letter", F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits", T.DoubleType())]
    names = [c for c in kept.columns if c != "_has a letter"]
    schema = T.StructType([*(kept.schema[c] for c in names), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for batch in batches:
            for part in passes(batch, text, 1 << 20):
                if own is None:
                    results = [(UNKNOWN, 0.0, None)] * part.num_rows
                else:
                    data, edges = text_buffer(_lowered(part.column(text)))
                    bits = own.bits(data, edges)
                    best = bits.argmin(1)
                    least = bits.min(1, keepdims=True)
                    score = 1 / np.exp2(least - bits).sum(1)
                    rate = least[:, 0] / np.maximum(1, np.diff(edges))
                    letters = part.column("_has a letter").to_pylist()
                    results = [
                        (own.languages[b], s, r) if has else (UNKNOWN, 0.0, None)
                        for b, s, r, has in zip(best.tolist(), score.tolist(), rate.tolist(), letters, strict=True)
                    ]
                name, score, rate = zip(*results, strict=True)
                columns = [part.column(c) for c in names]
                columns += [pa.array(name, pa.string()), pa.array(score, pa.float64()), pa.array(rate, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([*(part.schema.field(c) for c in names), *new]))

    new = [pa.field("lang_pred", pa.string()), pa.field("score", pa.float64()), pa.field("bits", pa.float64())]
    return kept.mapInArrow(run, schema)


def held_out() -> Column:
    """True for the documents that train() must not see, in the registered query and the pipeline."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(4)) == 2


def identified(docs: DataFrame, most_bits: float = 6.0) -> DataFrame:
    """The documents with a language, all columns as they were: not those without a letter, nor those whose
    shortest code has over ``most_bits`` bits a byte, which are no text in any learned language."""
    trees = train(docs.where(~held_out()))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col("text").alias("_text"))
    found = predict(rows, trees, "_text").where((F.col("lang_pred") != UNKNOWN) & (F.col("bits") <= most_bits))
    return found.select("_row.*")
