"""Row-wise work over files as they arrive.

Line-by-line jobs (text export, prediction) need no other row, so the same functions run
on a file stream: each file is processed once, and a run that is cut off goes on
where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def follow_jsonl(
    spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int | None = None
) -> DataFrame:
    """JSON-lines files of a folder as a stream."""
    reader = spark.readStream.schema(schema).option("mode", "FAILFAST")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(folder)


def append_available(
    stream: DataFrame, path: str, progress: str, fmt: str = "json"
) -> StreamingQuery:
    """Process what has arrived since the last run and stop. ``progress`` is a folder on
    shared storage that belongs to this sink alone."""
    writer = stream.writeStream.format(fmt).outputMode("append").trigger(availableNow=True)
    if fmt == "json":
        writer = writer.option("ignoreNullFields", "false")
    return writer.option("checkpointLocation", progress).start(path)
