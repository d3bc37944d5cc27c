"""What holds for every registered operator: empty tables, repeated rows, nulls, and columns it doesn't know."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from instructset.llm import queries

WORDS = "the quick brown fox jumps over the lazy dog and runs away from all the others again."
DOCS = [(1, WORDS, "en"), (2, f"{WORDS} {WORDS}", "en"), (3, None, None), (4, "", "en"), (None, "ein kurzer Text mit einigen Wörtern darin und mehr.", "de"),
        (6, "ein kurzer Text mit einigen Wörtern darin und mehr, noch viel mehr.", "de"), (7, "x", None), (8, WORDS, None)]
PAGE = f"<body><nav>menu</nav><article><h1>T</h1><p>{WORDS}</p></article></body>"
CLASHING = [
    "_letter", "_html", "_page html", "_has a letter", "bits", "score", "ids", "n_tokens", "portion", "trusted", "digests", "cells", "range", "_range", "_at",
    "_next", "_quality", "_removal", "shingles", "component", "a", "b", "key", "kind", "piece", "part", "copies", "digest", "group", "shard", "data", "hash",
    "cluster", "distance", "n_bytes", "over_limit", "_counted text", "sequence_id", "offset", "held_out", "lang_pred", "kept", "fingerprint",
]
OPERATORS = sorted(queries.QUERIES)


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame([(*d, "src", None) for d in DOCS], "doc_id long, text string, lang string, source string, n_chars long")
    return {
        "documents": docs,
        "labels": spark.createDataFrame([(1, 1, 0), (2, 1, 0), (7, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int"),
        "pages": spark.createDataFrame([(1, "u", PAGE), (2, None, None), (None, "v", "")], "page_id long, url string, html string"),
        "embeddings": spark.createDataFrame([(i, [(i or 5) / 9 + j / 70 for j in range(64)], 0) for i in (1, 2, 3, None)], "vec_id long, embedding array<float>, label int"),
        "conversations": spark.createDataFrame(
            [(1, 0, "user", "Yes."), (1, 1, "assistant", "No"), (2, None, None, None), (None, 3, "user", "x")], "conv_id long, turn long, role string, text string"
        ),
    }


def run(spark, name, tables, folder):
    for table, df in tables.items():
        df.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
    df = queries.QUERIES[name](spark, str(folder))
    return df.columns, sorted(map(str, df.collect()))


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables_give_none(spark, tables, tmp_path, name):
    columns, rows = run(spark, name, {k: df.limit(0) for k, df in tables.items()}, tmp_path)
    assert rows == [] and len(columns) == len(set(columns))


@pytest.mark.parametrize("name", OPERATORS)
def test_other_columns_change_nothing_and_rows_repeat(spark, tables, tmp_path, name):
    plain = run(spark, name, tables, tmp_path / "plain")
    more = {k: df.withColumns({c: F.lit("other") for c in CLASHING if c not in df.columns}) for k, df in tables.items()}
    assert run(spark, name, more, tmp_path / "more") == plain
    twice = {k: df.union(df) for k, df in tables.items()}
    _, rows = run(spark, name, twice, tmp_path / "twice")
    if name == "op9_packing":
        assert len(rows) >= 2 * len(DOCS)
    elif name == "op13_conversations":
        assert len(rows) == len(plain[1])
    else:
        assert len(rows) == 2 * len(plain[1])
