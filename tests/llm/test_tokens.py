"""Encoding, decoding, packing and token files against the tokenizers library."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from instructset.llm import bpe, packing, queries, simple8b

FOLDER = "/root/testdata/sf0.001"
FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]


def random_texts(n: int) -> list[str]:
    rng = random.Random(3)
    parts = list("abcXYZ'sstrelvd  \n\t\r\x0b\x0c\x1c\x85\xa0  　 é́´ñÇß1289!?,.-|<>#")
    parts += ["<|endoftext|>", "<|startoftext|>", "'ll", "'re", " 's", "日本", "😀", "Σ", "İ"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(80))) for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    given = pq.read_table(f"{FOLDER}/documents.parquet").column("text").to_pylist()
    return ["", " ", "\n", "x" * 300_000, "word " * 50_000, *random_texts(2000), *given]


@pytest.mark.parametrize("name", FILES)
def test_fragments_give_the_library_ids(texts, name):
    path = public_tokenizers.path(name)
    ids, edges = bpe.Encoder(bpe.read_spec(path)).encode(pa.array(texts))
    want = Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)
    for i, w in enumerate(want):
        assert ids[edges[i] : edges[i + 1]].tolist() == w.ids, texts[i][:100]


def test_small_cache_changes_nothing(texts, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 50)
    own = bpe.Encoder(bpe.read_spec(public_tokenizers.path(FILES[0])))
    whole = Tokenizer.from_file(public_tokenizers.path(FILES[0]))
    for a in range(0, 400, 7):
        part = texts[5 + a : 12 + a]
        ids, edges = own.encode(pa.array(part))
        assert [ids[x:y].tolist() for x, y in zip(edges[:-1], edges[1:])] == [
            e.ids for e in whole.encode_batch(part, add_special_tokens=False)
        ]


def test_decoding_is_the_library_s(spark, docs_of):
    path = public_tokenizers.path(FILES[0])
    library = Tokenizer.from_file(path)
    rows = [(0, [50256, 262, 6184]), (1, []), (2, None), (3, [223, 224]), (4, [262] * 5)]
    df = spark.createDataFrame(rows, "doc_id long, ids array<int>")
    got = {r.doc_id: r.decoded for r in bpe.decode(df, path).collect()}
    assert got == {i: library.decode(x or [], skip_special_tokens=False) for i, x in rows}


def test_extra_columns_stay_and_a_clash_is_replaced(spark, docs_of):
    df = docs_of(["a b", None]).withColumnRenamed("source", "ids")
    got = bpe.encode(df, public_tokenizers.path(FILES[1]))
    assert got.columns == ["doc_id", "text", "lang", "n_chars", "ids"]
    assert {r.doc_id: len(r.ids) for r in got.collect()} == {0: 2, 1: 0}


def test_simple8b_round_trip():
    rng = random.Random(5)
    kinds = [
        lambda: rng.choice([0, 1, 5, 300, 49000, 2**33, 2**60 - 1, 2**60, 2**63 + 5]),
        lambda: rng.randrange(49408),
        lambda: rng.randrange(3),
        lambda: 7 if rng.random() < 0.98 else 2**40,
        lambda: rng.choice([2**64 - 1, 15 << 60]),
        lambda: 9,
    ]
    for trial in range(120):
        ids = np.array([kinds[trial % 6]() for _ in range(rng.randrange(2000))], np.uint64)
        size = rng.choice([1, 7, 64, 1024])
        edges = np.append(np.arange(0, len(ids), size), len(ids))
        words, cuts = simple8b.encode_blocks(ids, edges)
        assert (simple8b.decode_blocks(words, cuts, np.diff(edges)) == ids).all()
        # Every block by itself.
        for b in range(0, len(edges) - 1, 5):
            one = words[cuts[b] : cuts[b + 1]]
            n = edges[b + 1 : b + 2] - edges[b]
            assert (simple8b.decode_blocks(one, np.array([0, len(one)]), n) == ids[edges[b] : edges[b + 1]]).all()


def library_ids(name, rows, end=None):
    library = Tokenizer.from_file(public_tokenizers.path(name))
    return {i: library.encode(t or "", add_special_tokens=False).ids + ([end] if end else []) for i, t in rows}


ROWS = [(7, "A few words."), (3, None), (5, ""), (9, "many words " * 9000), (1, "A few words."), (20, "x")]


def test_op8(spark, docs_of, folder_of):
    got = queries.QUERIES["op8_bpe"](spark, folder_of(documents=docs_of(ROWS))).collect()
    want = library_ids(FILES[0], ROWS)
    assert len(got) == len(ROWS)
    for r in got:
        ids = want[r.doc_id]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        text = dict(ROWS)[r.doc_id] or ""
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("given", [True, False])
def test_op9(spark, docs_of, folder_of, given):
    if given:
        rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
        folder = FOLDER
    else:
        rows, folder = ROWS, folder_of(documents=docs_of(ROWS))
    want = library_ids(FILES[1], rows, 1)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in queries.QUERIES["op9_packing"](spark, folder).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(want)
    for doc, parts in pieces.items():
        at = 0
        for p in sorted(parts, key=lambda p: p.start):
            ids = np.array(want[doc][p.start : p.start + p.length], "<u4")
            assert p.start == at and p.doc_tokens == len(want[doc]) and p.ids_crc32 == zlib.crc32(ids.tobytes())
            at += p.length
        assert at == len(want[doc])
    held = total = 0
    for parts in sequences.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
        held += at
        total += at if at & (at - 1) == 0 else 2048
    if given:
        assert held / total > 0.98


def test_pieces_cover_and_classes_are_full():
    for n in [*range(1, 2100), 4096, 100_001]:
        parts = packing.pieces_of(n, 2048, 32)
        assert sum(parts) == n and all(p == 2048 or 2048 % p == 0 or p < 32 for p in parts)


def test_op10(spark, docs_of, folder_of):
    want = library_ids(FILES[1], ROWS, 2)
    got = {r.doc_id: r for r in queries.QUERIES["op10_token_files"](spark, folder_of(documents=docs_of(ROWS))).collect()}
    at = 0
    for doc in sorted(want):
        r = got.pop(doc)
        assert (r.start, r.n_tokens) == (at, len(want[doc]))
        assert r.ids_crc32 == zlib.crc32(np.array(want[doc], "<u4").tobytes())
        at += r.n_tokens
    assert not got


def test_files_hold_the_ids_themselves(spark, docs_of):
    files = simple8b.write_ids(docs_of(ROWS), public_tokenizers.path(FILES[1]), end_id=70_000, block_ids=100, parts=3)
    assert {r.doc_id: r.ids for r in simple8b.read_documents(spark, files).collect()} == library_ids(FILES[1], ROWS, 70_000)


def test_empty_tables(spark, docs_of, folder_of):
    folder = folder_of(documents=docs_of([]))
    for name in ("op8_bpe", "op9_packing", "op10_token_files"):
        assert queries.QUERIES[name](spark, folder).collect() == []


def test_equal_ids_have_one_order(spark, docs_of):
    """Whatever the partitions, documents of one id lie in the order of their ids."""
    rows = [(5, f"text number {i} " + "x " * (i % 7)) for i in range(40)] + [(None, "a b"), (None, "c"), (2, "d")]
    found = set()
    for parts in (1, 4, 9):
        files = simple8b.write_ids(docs_of(rows).repartition(parts), public_tokenizers.path(FILES[1]), parts=3)
        got = simple8b.read_documents(spark, files, digests=True).orderBy("start").collect()
        assert len(got) == len(rows) and sum(r.n_tokens for r in got[:-1]) == got[-1].start
        found.add(tuple(map(tuple, got)))
    assert len(found) == 1


def test_what_is_not_kept_is_not_sent_back(spark, docs_of):
    """Without ``keep`` only the other columns come back from Python, in their order and as with it."""
    path = public_tokenizers.path(FILES[0])
    rows = [(1, "A few words. 日本", "en"), (None, None, None), (1, "A few words. 日本", "en"), (2, "", "de")]
    docs = docs_of(rows).select("lang", "text", "doc_id")
    encoded = bpe.encode(docs, path, keep=False)
    assert encoded.columns == ["lang", "doc_id", "ids"]
    want = bpe.encode(docs, path).select("lang", "doc_id", "ids").collect()
    assert sorted(encoded.collect(), key=str) == sorted(want, key=str)
    decoded = bpe.decode(encoded.select("ids", "lang", "doc_id"), path, keep=False)
    assert decoded.columns == ["lang", "doc_id", "decoded"]
    assert sorted(map(tuple, decoded.collect()), key=str) == sorted(((r[2], r[0], r[1] or "") for r in rows), key=str)


def test_encoding_scans_few_texts_at_a_time(spark, docs_of):
    """A scan's batch of thousands of texts makes the executor's heap grow; a smaller number that is set stays."""
    name, path = "spark.sql.parquet.columnarReaderBatchSize", public_tokenizers.path(FILES[0])
    before = spark.conf.get(name)
    try:
        for given, want in (("4096", "256"), ("100", "100")):
            spark.conf.set(name, given)
            bpe.encode(docs_of(["a"]), path)
            assert spark.conf.get(name) == want
    finally:
        spark.conf.set(name, before)


def test_op8_digests_of_no_one_and_many_ids(spark, docs_of, folder_of):
    """The query's digests are of the decimal ids joined by commas, and it carries neither texts nor ids along."""
    rows = [(1, None), (1, ""), (None, "a"), (2, "a b c 日本 <|endoftext|>"), (2, "a b c 日本 <|endoftext|>")]
    df = queries.QUERIES["op8_bpe"](spark, folder_of(documents=docs_of(rows)))
    ids = [(i, Tokenizer.from_file(public_tokenizers.path(FILES[0])).encode(t or "", add_special_tokens=False).ids) for i, t in rows]
    want = [(i, len(x), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for i, x in ids]
    assert sorted(map(str, (tuple(r)[:3] for r in df.collect()))) == sorted(map(str, want))
    plan = df._jdf.queryExecution().executedPlan().toString()
    decoded, encoded = re.findall(r"MapInArrow .*\[([^\]]*)\], false", plan)
    assert "text#" not in encoded and "ids#" not in decoded
