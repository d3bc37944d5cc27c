from __future__ import annotations

import pytest
from pyspark.sql import Row
from pyspark.sql import types as T

DOCS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
     T.StructField("n_chars", T.LongType())]
)


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from texts, numbered from 0, or from (doc_id, text[, lang]) tuples, over three partitions."""

    def make(rows, **extra):
        full = []
        for i, r in enumerate(rows):
            r = r if isinstance(r, tuple) else (i, r)
            full.append(Row(r[0], r[1], r[2] if len(r) > 2 else None, None, len(r[1]) if r[1] else None))
        return spark.createDataFrame(full, DOCS).repartition(3)

    return make


@pytest.fixture
def folder_of(tmp_path):
    """A folder of tables, as the queries take it."""

    def make(**tables):
        for name, df in tables.items():
            df.write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return make
