"""Near duplicates and repeated passages against brute force."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from instructset.llm import hashing, neardup, queries, substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def invented(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def near_texts():
    """Groups of copies with more and more edits, chains, short texts, repeats, nulls."""
    rng = random.Random(11)
    out = [None, "", " \n ", "one", "One", "one two", "one two", "one two three", "one\x0btwo\tthree", "one two\x85three"]
    for _ in range(12):
        base = invented(rng, rng.choice([12, 40, 90, 300]))
        out.append(" ".join(base))
        chain = list(base)
        for edits in range(8):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = f"x{rng.random()}"
            out.append(" ".join(copy).upper() if edits == 2 else "  ".join(copy))
            chain[rng.randrange(len(chain))] = f"y{rng.random()}"
            out.append(" ".join(chain))
    out += [" ".join(invented(rng, 30)) for _ in range(40)]
    rng.shuffle(out)
    return out


def brute_components(rows, k, percent):
    ascii_lower = {c: c + 32 for c in range(65, 91)}
    sets = {}
    for i, t in rows:
        w = [x.translate(ascii_lower) for x in words(t)]
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    label = {i: i for i, _ in rows}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for (a, _), (b, _) in itertools.combinations(rows, 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            p, q = sorted((root(a), root(b)))
            label[q] = p
    return {i: (len(sets[i]), root(i)) for i, _ in rows}


@pytest.mark.parametrize("k, percent", [(3, 85), (5, 80)])
def test_components(spark, docs_of, k, percent):
    rows = [(3 * i + 5, t) for i, t in enumerate(near_texts())]
    got = neardup.near_duplicates(docs_of(rows), k, percent).collect()
    want = brute_components(rows, k, percent)
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert sum(r.kept for r in got) < len(got) - 40


def test_blocks_of_a_large_bucket(spark, docs_of, monkeypatch):
    """A bucket over many blocks: near copies of one text that differ too much from its smallest id."""
    monkeypatch.setattr(neardup, "BLOCK", 4)
    rng = random.Random(2)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for i in range(60):
        copy = list(base)
        for j in rng.sample(range(120), rng.choice([1, 4, 6, 8])):
            copy[j] = f"z{i}-{j}"
        texts.append(" ".join(copy))
    rows = list(enumerate(texts))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs_of(rows), 3, 85).collect()}
    assert got == brute_components(rows, 3, 85)


def test_null_ids_and_repeated_rows(spark, docs_of):
    got = neardup.near_duplicates(docs_of([(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (9, "a b c d")]), 3, 85).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in got) == [(-1, -1, True), (4, 4, True), (4, 4, True), (9, 4, False)]


def test_least_matches_keep_what_reaches_the_limit():
    least = neardup.least_matches(85, 1e-7)
    rng = np.random.default_rng(1)
    left = np.zeros((4000, neardup.SIGNATURE), np.uint8)
    right = (rng.random(left.shape) > 0.85).astype(np.uint8)
    assert len(neardup.passing(left, right, least)) == 4000
    right = (rng.random(left.shape) > 0.70).astype(np.uint8)
    assert len(neardup.passing(left, right, least)) < 40


def test_op2_and_op3_of_empty_tables(spark, docs_of, folder_of):
    folder = folder_of(documents=docs_of([]))
    assert queries.QUERIES["op2_neardup"](spark, folder).collect() == []
    assert queries.QUERIES["op3_substrings"](spark, folder).collect() == []


def brute_kept(texts, window):
    split = [words(t) for t in texts]
    count = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for w in split:
        stays = [True] * len(w)
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                stays[i : i + window] = [False] * window
        out.append([x for x, s in zip(w, stays) if s])
    return split, out


def passage_texts(window):
    rng = random.Random(7)
    shared = [invented(rng, n, 5000) for n in (window - 1, window, window + 1, 3 * window, 400)]
    out = [None, "", "\n", "a", "the same " * 200, "no " * (window + 1), "no " * window, "never " * (window - 1)]
    for _ in range(80):
        w = invented(rng, rng.randrange(300), 5000)
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(w) + 1)
            w[at:at] = rng.choice(shared)
        out.append(rng.choice([" ", "\n", "  \t"]).join(w))
    return out + out[20:25]


@pytest.mark.parametrize("window, bits, held", [(35, 27, 1 << 20), (35, 16, 300), (4, 16, 50), (1, 16, 1000)])
def test_repeated_passages(spark, docs_of, monkeypatch, window, bits, held):
    monkeypatch.setattr(substring, "HELD", held)
    texts = passage_texts(window)
    split, kept = brute_kept(texts, window)
    got = {r.doc_id: r for r in substring.dedup(docs_of(texts), window, most_bits=bits).collect()}
    assert len(got) == len(texts)
    for i in range(len(texts)):
        assert got[i].text == " ".join(kept[i])
        assert tuple(got[i]._removal) == (len(split[i]), len(split[i]) - len(kept[i]))


def test_op3_and_clashing_columns(spark, docs_of, folder_of):
    texts = passage_texts(35)
    _, kept = brute_kept(texts, 35)
    docs = docs_of(texts)
    for r in queries.QUERIES["op3_substrings"](spark, folder_of(documents=docs)).collect():
        assert r.kept_sha256 == hashlib.sha256(" ".join(kept[r.doc_id]).encode()).hexdigest()
    odd = docs.withColumnsRenamed({"lang": "salt", "source": "spans"})
    got = substring.deduplicated(odd)
    assert got.columns == odd.columns
    assert {r.doc_id: (r.text, r.n_chars) for r in got.collect()} == {
        i: (" ".join(k), len(" ".join(k))) for i, k in enumerate(kept)
    }


def test_repeated_rows_and_null_ids_lose_their_passages(spark, docs_of):
    long = " ".join(f"q{i}" for i in range(50))
    got = substring.dedup(docs_of([(1, long + " end"), (1, long), (None, "x " + long), (2, "only this"), (2, "only this")])).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == [(0, "x"), (1, ""), (1, "end"), (2, "only this"), (2, "only this")]


def test_windows_of_large_batches_take_little_memory(monkeypatch):
    """Neither a pass nor the tables that a worker keeps grow with the batch."""
    monkeypatch.setattr(hashing, "_powers", {})
    batch = pa.RecordBatch.from_pydict({"text": [" ".join(f"word{i * j % 997}" for j in range(900)) for i in range(1000)]})
    tracemalloc.start()
    try:
        for part in hashing.passes(batch):
            w = substring.Windows(part, 35, 14)
            w.words.runs(35, 1), w.words.runs(35, 2)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert batch.nbytes > 5e6 and most < 100e6
    assert sum(p.nbytes for p in hashing._powers.values()) < 50e6


def test_held_windows_are_given_up():
    n = 5
    held = [(np.arange(n, dtype=np.uint64),) * 2 + (pa.array(range(n)), np.zeros(n, np.uint64), np.arange(n))]
    rows = substring._portion(held)
    assert next(rows).num_rows == n and held == []


def test_leftmost_minimum():
    rng = np.random.default_rng(0)
    for width in (1, 2, 3, 7, 22):
        values = rng.integers(0, 9, 60).astype(np.uint64)
        want = [i + int(np.argmin(values[i : i + width])) for i in range(60 - width + 1)]
        assert substring.leftmost_minimum(values, width).tolist() == want


def test_word_hashes_tell_words_apart():
    import pyarrow as pa

    texts = ["a b", "a", "ab", "", "ba é", "É", None, "é a\x0bb\x0c"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    w = hashing.words_of(batch)
    split = [words(t) for t in texts]
    assert np.diff(w.first).tolist() == [len(s) for s in split]
    by_word = {}
    for word, h in zip(itertools.chain(*split), w.hashes.tolist(), strict=True):
        assert by_word.setdefault(word, h) == h
    assert len(set(by_word.values())) == len(by_word)
