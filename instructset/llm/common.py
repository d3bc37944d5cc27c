"""What the operators of this package share: batch sizes, tables that cut lineage, contiguous groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from instructset.session import materialize, ship_package

__all__ = ["grouped_batches", "materialize", "prepare", "sliced", "small_scans", "table"]

#: The words of all contracts: runs of anything but space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
#: Rows that a scan of Parquet holds at a time where ``small_scans`` is called.
SCAN_ROWS = 256


def prepare(spark: SparkSession) -> None:
    """Small Arrow batches, so that a Python worker holds a few MB of text at a time, and this
    package on the executors."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def small_scans(spark: SparkSession) -> None:
    """Scans of Parquet that hold ``SCAN_ROWS`` texts at a time in place of 4,096: their arrays of many MB, doubled and copied as
    they fill, make the JVM's heap grow far beyond what is live. It holds for the session; a smaller number that is set stays."""
    name = "spark.sql.parquet.columnarReaderBatchSize"
    spark.conf.set(name, str(min(int(spark.conf.get(name)), SCAN_ROWS)))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def texts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the key and the text, whatever else the table holds or is called."""
    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def sliced(values: np.ndarray, edges: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and row edges."""
    return pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(values, kind))


def id_order() -> Column:
    """The id as a number that puts rows without one first."""
    return F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))


def id_range(docs: DataFrame, ranges: int) -> Column:
    """The number of a row's range of ids, in order; ``ranges`` of about equal size. Only ids are
    read for it, in one pass that sends a summary from each task."""
    shares = [i / ranges for i in range(1, ranges)] or [0.5]
    points = docs.select(F.percentile_approx(id_order(), shares, 10_000)).collect()[0][0]
    points = sorted(set(points or []))
    bounds = F.lit(points).cast("array<long>") if points else F.array().cast("array<long>")
    return F.size(F.filter(bounds, lambda b: b <= id_order()))


def grouped_batches(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of the rows with equal keys from sorted batches; a group may go over batch ends.

    Groups must be bounded by their maker."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)
