"""Named training sets as ``prompt, response`` tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from instructset import schemas
from instructset.operators.positions import with_row_index
from instructset.operators.selection import first_file_rows
from instructset.sources.readers import read_jsonl, read_parquet

Loader = Callable[[SparkSession, str, Mapping[str, str]], DataFrame]

# Number of instruction rows used, and parts of names that choose a loader.
INSTRUCTION_ROWS = 50_000
INSTRUCTION_NAME = "orca"
TASK_NAME = "esci_task2"


def load_instructions(
    spark: SparkSession, name: str, paths: Mapping[str, str], rows: int | None = INSTRUCTION_ROWS
) -> DataFrame:
    """The first ``rows`` rows of the Parquet files of questions and responses; ``None`` takes all."""
    table = read_parquet(spark, paths[name], schemas.INSTRUCTION.names)
    first = first_file_rows(table, rows, must_exist=True)
    return first.select("pos", F.col("question").alias("prompt"), "response")


def load_task(spark: SparkSession, name: str, paths: Mapping[str, str]) -> DataFrame:
    """JSON pairs of one size, the file chosen by the full name."""
    table = with_row_index(read_jsonl(spark, paths[name], schemas.PAIR))
    return table.withColumnsRenamed({"input": "prompt", "output": "response"})


LOADERS: dict[str, Loader] = {INSTRUCTION_NAME: load_instructions, TASK_NAME: load_task}


def load_datasets(
    spark: SparkSession, names: str, paths: Mapping[str, str], loaders: Mapping[str, Loader] = LOADERS
) -> dict[str, DataFrame]:
    """``"a#b"`` gives the tables of ``a`` and ``b``; a loader is found by a part of the
    name, and ``paths`` tells where each name lies."""
    tables = {}
    for name in names.split("#"):
        loader = next((load for part, load in loaders.items() if part in name), None)
        if loader is None:
            raise NotImplementedError(f"dataset {name!r} is not known")
        if name not in paths:
            raise ValueError(f"no path is given for dataset {name!r}")
        tables[name] = loader(spark, name, paths)
    return tables
