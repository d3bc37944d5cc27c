"""Cross-entropy difference of documents under a target and a background language model.

Both are word bigram models over one vocabulary, all words of the corpus, and are matched: of the same order and with
the same smoothing. A word after another has the share ``PAIR`` from how often it follows there and the rest from how often it
occurs at all; of that, ``EVEN`` goes evenly to all words of the vocabulary and an unknown one, whatever a model has seen.
The background model is counted over all documents, the target model over trusted ones in the same pass. Each document is
left out of the models that score it: its own counts are taken off, so that a trusted document is judged by the
others, as any other document is. A document's score is the mean over its tokens of target bits less background bits: the
lower, the closer to the target.

No model is held in one place, so the models grow with the corpus. Documents are dealt into portions
by hash. A portion sends each of its distinct bigrams once, sorted and packed by range of hashes; a range adds up
what the portions sent and sends the totals back in the order of the keys, so that keys travel once and
a frequent bigram weighs no more than others. The words follow in the same way, and every portion writes to every range of
theirs, so that each range's sums come back to all portions and no pass is needed for the vocabulary's size. What a task
holds is one portion, or one range of all portions; their number grows with the text. The texts are dealt once.

Null and empty texts have no tokens and a null score. Without a trusted document the target is the
background and every score 0. A model that is empty without the document gives all words the same bits. Rows repeat as they come,
each being a document beside its copies; labels that repeat count once. Words and bigrams are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from instructset.llm.common import prepare
from instructset.llm.hashing import mix, passes, words_of

#: The weight of pairs against single words, and that of all words alike within single words.
PAIR, EVEN = 0.6, 0.05
#: Bitmaps of trusted ids that are sent, of 4 kB for 32,768 ids each: 64 MB at most.
MOST_BITMAPS = 1 << 14
#: Bytes of text in a portion, about; there are as many ranges of hashes as portions, and some at least for small tables.
PORTION, LEAST_PORTIONS = 1 << 24, 16
#: Tokens whose probabilities are worked out at a time.
STRETCH = 1 << 18
SCORES = "doc_id long, n_tokens long, target_bits double, background_bits double, score double"


def with_trust(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, trusted: by all labels of good and not toxic rows.

    Their ids go to the tasks as bitmaps, a bit for each id of a range, so that no text is shuffled; ids too far apart
    for that are joined."""
    good = (
        labels.where("doc_id IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.min((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).alias("good"))
        .where("good")
        .select(F.col("doc_id").cast("long").alias("doc_id"))
    )
    number, position = F.bitmap_bucket_number("doc_id").alias("_number"), F.bitmap_bit_position("doc_id")
    bits = good.groupBy(number).agg(F.bitmap_construct_agg(position).alias("_bits"))
    rows = docs.select("doc_id", "text")
    if good.select(number).distinct().limit(MOST_BITMAPS + 1).count() > MOST_BITMAPS:
        joined = rows.join(good.withColumn("_good", F.lit(True)), "doc_id", "left")
    else:
        byte = F.substring("_bits", F.floor(position / 8).cast("int") + 1, F.lit(1))
        bit = F.expr("getbit(CAST(conv(hex(_byte), 16, 10) AS int), CAST(_at AS int)) = 1")
        placed = rows.withColumn("_number", number).join(F.broadcast(bits), "_number", "left")
        joined = placed.select("doc_id", "text", byte.alias("_byte"), (position % 8).alias("_at")).withColumn("_good", bit)
    return joined.select("doc_id", "text", F.coalesce("_good", F.lit(False)).alias("trusted"))


class _Portion:
    """The tokens of a portion's texts, its distinct words and bigrams in order of their hashes."""

    def __init__(self, docs: pa.Table):
        hashes, n = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        self.rows = []
        for batch in docs.to_batches():
            for part in passes(batch):
                w = words_of(part)
                hashes.append(w.hashes | np.uint64(1))
                n.append(np.diff(w.first))
                self.rows.append(part)
        self.hashes, self.n = np.concatenate(hashes), np.concatenate(n)
        trusted = [p.column("trusted").to_numpy(zero_copy_only=False) for p in self.rows]
        self.trusted = np.repeat(np.concatenate([np.zeros(0, bool), *trusted]), self.n).astype(bool)
        self.first = np.cumsum(self.n) - self.n
        inner = np.ones(len(self.hashes), bool)
        inner[self.first[self.n > 0]] = False
        #: Tokens with one before them in their text.
        self.inner = np.flatnonzero(inner)
        self.pairs, self.pair = np.unique(mix(mix(self.hashes[self.inner - 1]) + self.hashes[self.inner]), return_inverse=True)

    def name_words(self) -> None:
        self.words, self.word = np.unique(self.hashes, return_inverse=True)
        self.hashes = self.hashes[:0]

    def stretches(self) -> Iterator[tuple[slice, slice, slice]]:
        """Texts, their tokens and the places of those in ``inner``, about ``STRETCH`` tokens at a time."""
        ends = np.cumsum(self.n)
        cuts = np.flatnonzero(np.diff(ends // STRETCH)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(self.n)], strict=True):
            start, stop = (int(ends[a - 1]) if a else 0), (int(ends[b - 1]) if b else 0)
            yield slice(a, b), slice(start, stop), slice(*np.searchsorted(self.inner, (start, stop)).tolist())


def _own(text: np.ndarray, of: np.ndarray) -> np.ndarray:
    """How often each number is found in its text."""
    _, place, counts = np.unique(text * (int(of.max(initial=0)) + 1) + of, return_inverse=True, return_counts=True)
    return counts[place]


def _small(values: np.ndarray, kind: type) -> bytes:
    """Values byte plane by byte plane, compressed: what is mostly zeros takes next to no room."""
    planes = np.ascontiguousarray(values, kind).reshape(-1, 1).view(np.uint8).T.tobytes()
    return pa.compress(planes, codec="zstd", asbytes=True)


def _large(packed: pa.Scalar, kind: type, n: int) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(packed.as_buffer(), n * width, codec="zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, -1).T).view(kind).ravel()


def _packed(portion: int, ranges: int, keys: np.ndarray, values: list[np.ndarray], every: bool = False) -> pa.Table:
    """A row for each range that has keys, or for ``every`` range: the sorted keys and the values of each."""
    of = (((keys >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)
    edges = np.searchsorted(of, np.arange(ranges + 1))
    sent = np.arange(ranges) if every else np.flatnonzero(np.diff(edges))
    grid = np.array(values, np.uint32)
    spans = list(zip(edges[sent].tolist(), edges[sent + 1].tolist(), strict=True))
    columns = [
        pa.array(np.full(len(sent), portion), pa.int64()),
        pa.array(sent, pa.int64()),
        pa.array([b - a for a, b in spans], pa.int64()),
        pa.array([_small(np.diff(keys[a:b], prepend=np.uint64(0)), np.uint64) for a, b in spans], pa.binary()),
        pa.array([_small(grid[:, a:b], np.uint32) for a, b in spans], pa.binary()),
    ]
    return pa.table(columns, names=["portion", "range", "size", "keys", "counts"])


_PACKED = "portion long, range long, size long, keys binary, counts binary"


def _added(part: pa.Table, kinds: int) -> pa.Table:
    """What each portion of a range gets back: totals for its keys in their order; and of all the
    range's keys, number and sums of the first two totals."""
    part = part.sort_by("portion")
    sizes = part.column("size").to_pylist()
    keys = [np.cumsum(_large(k, np.uint64, n), dtype=np.uint64) for k, n in zip(part.column("keys"), sizes, strict=True)]
    counts = [_large(c, np.uint32, n * kinds).reshape(kinds, n) for c, n in zip(part.column("counts"), sizes, strict=True)]
    key = np.concatenate(keys)
    order = np.argsort(key, kind="stable")
    new = np.ones(len(key), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    group, head = np.cumsum(new) - 1, np.flatnonzero(new)
    every = np.concatenate(counts, axis=1).astype(np.int64)
    out = np.empty((kinds, len(key)), np.int64)
    for row, values in zip(out, every, strict=True):
        row[order] = np.add.reduceat(values[order], head)[group] if len(head) else 0
    sums = (len(head), int(every[0].sum()), int(every[1].sum()))
    edges = np.cumsum([0, *map(len, keys)])
    blocks = [out[:, a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
    columns = [
        part.column("portion"), part.column("range"), part.column("size"), pa.array([_small(b, np.int64) for b in blocks], pa.binary()),
        *(pa.array([x] * len(blocks), pa.int64()) for x in sums),
    ]
    return pa.table(columns, names=["portion", "range", "size", "totals", "n", "raw", "target"])


_ADDED = "portion long, range long, size long, totals binary, n long, raw long, target long"


def _unpacked(answers: pa.Table, rows: int) -> np.ndarray:
    answers = answers.sort_by("range")
    sizes = answers.column("size").to_pylist()
    blocks = [_large(t, np.int64, n * rows).reshape(rows, n) for t, n in zip(answers.column("totals"), sizes, strict=True)]
    return np.concatenate([np.zeros((rows, 0), np.int64), *blocks], axis=1)


def _single(count: np.ndarray, total: np.ndarray, vocabulary: int) -> np.ndarray:
    """The probability of words; all are alike to a model without any."""
    even = 1 / (vocabulary + 1)
    return np.where(total > 0, (1 - EVEN) * count / np.maximum(total, 1) + EVEN * even, even)


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, target_bits and background_bits per token, and score, their difference, of ``docs`` (doc_id, text,
    trusted), each under the models of all other documents."""
    prepare(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    ranges = max(LEAST_PORTIONS, -(-size // PORTION))
    dealt = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(ranges)).alias("portion"), "doc_id", "text", "trusted").groupBy("portion")

    def pairs(key: tuple, rows: pa.Table) -> pa.Table:
        p = _Portion(rows)
        of_target = p.pair[p.trusted[p.inner]]
        counts = [np.bincount(p.pair, minlength=len(p.pairs)), np.bincount(of_target, minlength=len(p.pairs))]
        return _packed(key[0].as_py(), ranges, p.pairs, counts)

    pair_totals = dealt.applyInArrow(pairs, _PACKED).groupBy("range").applyInArrow(lambda part: _added(part, 2), _ADDED)

    def words(key: tuple, rows: pa.Table) -> pa.Table:
        p = _Portion(rows)
        p.name_words()
        before = p.word[p.inner - 1]
        # How often, and how often with a word after it.
        found = [p.word, p.word[p.trusted], before, before[p.trusted[p.inner]]]
        return _packed(key[0].as_py(), ranges, p.words, [np.bincount(f, minlength=len(p.words)) for f in found], every=True)

    word_totals = dealt.applyInArrow(words, _PACKED).groupBy("range").applyInArrow(lambda part: _added(part, 4), _ADDED)

    def bits(key: tuple, rows: pa.Table, answers: pa.Table) -> pa.Table:
        p = _Portion(rows)
        p.name_words()
        pair = _unpacked(answers.filter(pc.equal(answers.column("kind"), 2)), 2)
        of_words = answers.filter(pc.equal(answers.column("kind"), 1))
        word = _unpacked(of_words, 4)
        vocabulary, all_raw, all_target = (pc.sum(of_words.column(c)).as_py() or 0 for c in ("n", "raw", "target"))
        n, none = p.n, p.n == 0
        mean = np.zeros((len(n), 2))
        for some, tokens, inner in p.stretches():
            sizes = n[some]
            text = np.repeat(np.arange(len(sizes)), sizes)
            if not len(text):
                continue
            here, at, pairs_here = p.word[tokens], p.inner[inner] - tokens.start, p.pair[inner]
            left = here[at - 1]
            own_word, own_left, own_pair = _own(text, here), _own(text[at], left), _own(text[at], pairs_here)
            full = np.flatnonzero(sizes)
            for side, total, j in ((0, all_target, 1), (1, all_raw, 0)):
                taught = p.trusted[tokens] if j else np.ones(len(here), bool)
                if not total:
                    total, j, taught = all_raw, 0, np.ones(len(here), bool)
                # The text's own counts are taken off, as far as it taught.
                single = _single(word[j][here] - taught * own_word, total - taught * sizes[text], vocabulary)
                context = word[2 + j][left] - taught[at] * own_left
                follows = (pair[j][pairs_here] - taught[at] * own_pair) / np.maximum(context, 1)
                cost = -np.log2(single)
                cost[at] = -np.log2(np.where(context > 0, PAIR * follows + (1 - PAIR) * single[at], single[at]))
                firsts = np.cumsum(sizes) - sizes
                mean[some.start + full, side] = np.add.reduceat(cost, firsts[full]) / sizes[full]
        values = [mean[:, 0], mean[:, 1], mean[:, 0] - mean[:, 1]]
        ids = pa.chunked_array([r.column("doc_id") for r in p.rows], pa.int64())
        columns = [ids, pa.array(n, pa.int64()), *(pa.array(np.round(v, 9), mask=none) for v in values)]
        return pa.table(columns, names=["doc_id", "n_tokens", "target_bits", "background_bits", "score"])

    kept = ["portion", "range", "size", "totals", "n", "raw", "target"]
    answers = word_totals.select(F.lit(1).alias("kind"), *kept).unionByName(pair_totals.select(F.lit(2).alias("kind"), *kept))
    return dealt.cogroup(answers.groupBy("portion")).applyInArrow(bits, SCORES)
