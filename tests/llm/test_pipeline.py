"""The corpus pipeline, stage by stage, against brute force on each stage's own input."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from instructset.llm import quality
from tests.llm.test_dedup import brute_components, brute_kept
from tests.llm.test_models import plain_counts
from tests.llm.test_tokens import FILES, library_ids

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The input and output of each stage by name, written and reread as the pipeline does."""
    given = spark.read.parquet(f"{FOLDER}/documents.parquet")
    body = " ".join(f"plain{i} words of the text" for i in range(40))
    more = [(5000, None, "en"), (5001, "", "en"), (5002, "word " * 300, "en"), (5003, "12 " * 40 + "34 56", "en"), (5004, body, "en"), (5005, body + " end", "en")]
    planted = spark.createDataFrame([(i, t, g, "src0", len(t or "")) for i, t, g in more], given.schema)
    docs, out = given.unionByName(planted), {}
    folder = str(tmp_path_factory.mktemp("stages"))
    for name, stage in corpus_pipeline.STAGES:
        result = stage(spark, docs, FOLDER)
        if name != "packing":
            assert result.dtypes == given.dtypes
        result.write.parquet(f"{folder}/{name}")
        out[name] = docs, spark.read.parquet(f"{folder}/{name}")
        docs = out[name][1]
    return out


def texts_of(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_order_of_the_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "language", "near_duplicates", "repeated_passages", "packing"]


def test_quality(spark, stages):
    before, after = map(texts_of, stages["quality"])
    docs = stages["quality"][0]
    model = quality.fit(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    verdicts = {r.doc_id: r._quality for r in quality.judge(docs, model).collect()}
    want = set()
    for i, text in before.items():
        n_words, *_, repeated = plain_counts(text)
        if n_words >= 10 and 100 * repeated <= 20 * n_words and verdicts[i].score >= model.threshold:
            want.add(i)
    assert set(after) == want and all(before[i] == after[i] for i in after)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").where("toxic = 0").collect()}
    good = [i in after for i, q in labels.items() if q == 1 and plain_counts(before[i])[0] >= 10]
    assert np.mean(good) > 0.9


def test_language(stages):
    before, after = map(texts_of, stages["language"])
    gone = set(before) - set(after)
    assert all(not any(c.isalpha() for c in before[i]) for i in gone) or len(gone) <= 0.01 * len(before)


def test_near_duplicates(stages):
    before, after = map(texts_of, stages["near_duplicates"])
    found = brute_components(sorted(before.items()), 5, 80)
    assert set(after) == {i for i, (_, least) in found.items() if i == least}
    assert len(after) < len(before)


def test_repeated_passages(stages):
    before, after = map(texts_of, stages["repeated_passages"])
    ids = sorted(before)
    split, kept = brute_kept([before[i] for i in ids], 35)
    assert after == {i: " ".join(k) for i, k in zip(ids, kept)}
    assert any(len(s) > len(k) for s, k in zip(split, kept))


def test_packing(stages):
    docs, pieces = stages["packing"]
    want = library_ids(FILES[1], list(texts_of(docs).items()), 1)
    parts, ends = defaultdict(list), defaultdict(int)
    for r in pieces.collect():
        parts[r.doc_id].append((r.start, r.ids))
        ends[r.sequence_id] = max(ends[r.sequence_id], r.offset + r.length)
    assert {i: [x for _, ids in sorted(p) for x in ids] for i, p in parts.items()} == want
    assert max(ends.values()) <= 2048


def test_run_gives_the_last_stage(spark, stages):
    got = corpus_pipeline.run(spark, FOLDER)
    assert got.columns == stages["packing"][1].columns and got.count() > 0
