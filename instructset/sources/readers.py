"""Sources. Every schema is explicit, and a malformed record fails the read."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from instructset import schemas
from instructset.operators.positions import with_row_index
from instructset.session import file_tasks, materialize, ship_package, small_files
from instructset.sources.named_files import FOLDERS, NAMES, TEXTS, is_folder, list_files, read_files

# Accepted extensions of pair files, column pairs of known datasets, and the
# texts that a tab-separated source means as missing.
PAIR_EXTENSIONS = ("csv", "json", "jsonl")
KNOWN_PAIR_COLUMNS = {
    "amazon_reviews_multi": ("review_body", "review_title"),
    "big_patent": ("description", "abstract"),
    "cnn_dailymail": ("article", "highlights"),
    "orange_sum": ("text", "summary"),
    "pn_summary": ("article", "summary"),
    "psc": ("extract_text", "summary_text"),
    "samsum": ("dialogue", "summary"),
    "thaisum": ("body", "summary"),
    "xglue": ("news_body", "news_title"),
    "xsum": ("document", "summary"),
    "wiki_summary": ("article", "highlights"),
    "multi_news": ("document", "summary"),
}
MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` over all cores where it comes from fewer files than that (few, small or
    compressed ones); others are left as they are. Only file names are asked for, so no job runs."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if len(df.inputFiles()) < cores else df


def read_jsonl(
    spark: SparkSession, path: str | Sequence[str], schema: T.StructType, partitions: int | None = None
) -> DataFrame:
    """JSON-lines files. A ``.gz`` file is one task whatever its size, so give
    ``partitions`` to spread its rows right after."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return df.repartition(partitions) if partitions else df


def read_documents(spark: SparkSession, path: str | Sequence[str], schema: T.StructType) -> DataFrame:
    """Files of one JSON document each; adds ``file_name``."""
    df = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return df.withColumn("file_name", F.col("_metadata.file_name"))


def stored_documents(df: DataFrame) -> DataFrame:
    """``df``, read from many small files, as a table: each file is opened once, thousands of them in a task, for
    all that is made of it."""
    with small_files(df.sparkSession):
        return materialize(df, "documents")


def read_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType | None = None,
    separator: str = ",",
    multi_line: bool = False,
    missing: Sequence[str] = (),
) -> DataFrame:
    """Delimited text with a header, RFC 4180 quoting. Columns are found by the header's
    names, and a name of the schema that it lacks is an error, as is a file with another header.

    Quoted line breaks need ``multi_line``, which reads a file in one task. Without a schema all
    columns are strings.
    """
    df = (
        spark.read.option("header", True)
        .option("sep", separator)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multi_line)
        .option("mode", "FAILFAST")
        .option("enforceSchema", False)
        .csv(path)
    )
    wanted = schema.fields if schema is not None else df.schema.fields
    lacking = [f.name for f in wanted if f.name not in df.columns]
    if lacking:
        raise ValueError(f"the header has no column {', '.join(lacking)}, only {', '.join(df.columns)}")

    def value(field: T.StructField) -> Column:
        text = F.col(f"`{field.name}`")
        text = F.when(~text.isin(*missing), text) if missing else text
        return text.cast(field.dataType).alias(field.name)

    return df.select(*map(value, wanted))


def read_tsv(
    spark: SparkSession, path: str | Sequence[str], schema: T.StructType, multi_line: bool = False
) -> DataFrame:
    return read_csv(spark, path, schema, "\t", multi_line, MISSING)


def read_parquet(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str] = ()) -> DataFrame:
    df = spark.read.parquet(path) if isinstance(path, str) else spark.read.parquet(*path)
    return df.select(*columns) if columns else df


def split_of(df: DataFrame, names: Sequence[str], by_folder: bool = False) -> Column:
    """Split name from the file path: the folder the file lies in, or the start of its
    name. Use it on a table as it was read."""
    any_name = "|".join(names)
    pattern = rf"/({any_name})/[^/]*$" if by_folder else rf"/({any_name})(?:[^/]*|\.[^/]*/[^/]*)$"
    found = F.regexp_extract(F.col("_metadata.file_path"), pattern, 1)
    return F.when(found != "", found)


def _plain_folder(spark: SparkSession, path: str) -> str | None:
    """``path`` as Arrow names it, where it is a folder that Arrow reaches and no pattern."""
    if any(c in path for c in "*?[]{}\\"):
        return None
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(place).toUri()
    name = uri.getPath() if uri.getScheme() == "file" else uri.toString()
    return name if is_folder(name) else None


def read_split_folders(
    spark: SparkSession,
    root: str,
    schema: T.StructType,
    splits: Sequence[str] = ("train", "valid", "test"),
    documents: bool = False,
) -> DataFrame:
    """``root/<split>/*`` as one table with a ``split`` column; JSON-lines, or one JSON
    document per file. Folders of documents are listed by tasks, one for each, as the driver would hold some kilobytes
    for each file; only patterns, and folders that Arrow doesn't reach, are listed by Spark in the driver."""
    folders = [_plain_folder(spark, f"{root}/{name}") for name in splits] if documents else [None]
    if all(folders):
        ship_package(spark)
        listed = spark.createDataFrame([*zip(splits, folders, strict=True)], FOLDERS).mapInArrow(list_files, NAMES)
        texts = listed.repartition(file_tasks(spark), "_folder", "_name").mapInArrow(read_files, TEXTS)
        # A document that is an array is a row for each of its elements, an empty one is none.
        rows = F.inline(F.from_json("_text", T.ArrayType(schema), {"mode": "FAILFAST"}))
        return texts.select("_split", rows).withColumn("split", F.col("_split")).drop("_split")
    reader = spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", documents)
    df = reader.json([f"{root}/{name}" for name in splits])
    return df.withColumn("split", split_of(df, splits, by_folder=True))


def read_ranked_tsv(
    spark: SparkSession,
    folder: str,
    schema: T.StructType,
    splits: Sequence[str] = ("dev", "test", "train"),
    multi_line: bool = False,
) -> DataFrame:
    """``folder/<split>.csv``, tab-separated, with ``split``, ``source_rank`` (the place of
    the split in ``splits``) and ``pos`` (the place of the row, files in the order of their paths)."""
    df = read_tsv(spark, [f"{folder}/{name}.csv" for name in splits], schema, multi_line)
    named = with_row_index(df.withColumn("split", split_of(df, splits)))
    rank = F.array_position(F.lit(list(splits)), F.col("split")) - 1
    return named.withColumn("source_rank", rank)


def read_named_dataset(spark: SparkSession, root: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    """All splits of a local dataset, ``root/<split>/*`` in any format."""
    df = spark.read.schema(schema).option("pathGlobFilter", f"*.{fmt}*").option("mode", "FAILFAST").format(
        "json" if fmt in ("json", "jsonl") else fmt
    ).load(f"{root}/*")
    return df.withColumn(
        "split", F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/[^/]+$", 1)
    )


def read_rungs(spark: SparkSession, folder: str, schema: T.StructType = schemas.PAIR) -> DataFrame:
    """All ``train_<rung>.json*`` files, or folders of files, in a folder, with the column ``rung``."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(f"{folder}/train_*.json*")
    return df.withColumn(
        "rung", F.regexp_extract(F.col("_metadata.file_path"), r"/train_([^./]+)\.json[^/]*(?:/[^/]*)?$", 1)
    )


def pair_columns(
    columns: Sequence[str],
    text_column: str | None = None,
    summary_column: str | None = None,
    dataset: str | None = None,
) -> tuple[str, str]:
    """Names of the input and the output column: as asked for, else as known for the
    dataset, else the first two."""
    chosen = []
    for place, asked in enumerate((text_column, summary_column)):
        if asked is not None and asked not in columns:
            raise ValueError(f"column {asked!r} is not one of: {', '.join(columns)}")
        known = KNOWN_PAIR_COLUMNS.get(dataset or "")
        chosen.append(asked or (known[place] if known else columns[place]))
    return chosen[0], chosen[1]


def json_columns(spark: SparkSession, path: str) -> list[str]:
    """Keys of all records of a JSON-lines file, in order of first appearance.

    Each file block sends a row per key with the first place it has there."""
    rows = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("row"),
        F.json_object_keys("value").alias("keys"),
    )
    keys = rows.select("file", "block", "row", F.posexplode("keys").alias("place", "key"))
    # The row in its task and the key's place in its record as one number, which partial sums keep by hash.
    at = F.shiftleft("row", 20) + F.least("place", F.lit((1 << 20) - 1))
    first = keys.groupBy("file", "block", "key").agg(F.min(at).alias("at"))
    found = sorted((r.file, r.block, r.at, r.key) for r in first.collect())
    return list(dict.fromkeys(key for *_, key in found))


def has_json_key(spark: SparkSession, path: str, key: str) -> bool:
    """Whether any record of a JSON-lines file has the key; the search ends with the first that has."""
    lines = spark.read.text(path)
    return not lines.filter(F.array_contains(F.json_object_keys("value"), key)).isEmpty()


def _json_pair(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None,
    text_column: str | None,
    summary_column: str | None,
    dataset: str | None,
) -> tuple[str, str]:
    """``pair_columns`` for a file that names its columns record by record."""
    if schema is not None:
        return pair_columns(schema.names, text_column, summary_column, dataset)
    known = KNOWN_PAIR_COLUMNS.get(dataset or "", (None, None))
    wanted = [asked or name for asked, name in zip((text_column, summary_column), known, strict=True)]
    if all(wanted) and all(has_json_key(spark, path, name) for name in wanted):
        return wanted[0], wanted[1]
    columns = json_columns(spark, path)
    source, target = pair_columns(columns, text_column, summary_column, dataset)
    lacking = [c for c in (source, target) if c not in columns]
    if lacking:
        raise ValueError(f"{path!r} has no {', '.join(lacking)}, only {', '.join(columns)}")
    return source, target


def load_pairs(
    spark: SparkSession,
    files: Mapping[str, str | None],
    schema: T.StructType | None = None,
    text_column: str | None = None,
    summary_column: str | None = None,
    dataset: str | None = None,
) -> DataFrame:
    """Pair files by split (``train``, ``validation``, ``test``) as ``split, input,
    output``; the format follows from the extension, the columns from the names asked for, the
    data set, or the file (its first two)."""
    given = {split: path for split, path in files.items() if path}
    if not given:
        raise ValueError("need a training, validation, or test file")
    tables = []
    for split, path in given.items():
        extension = path.rsplit(".", 1)[-1]
        if extension not in PAIR_EXTENSIONS:
            raise ValueError(f"{path!r} should be one of: {', '.join(PAIR_EXTENSIONS)}")
        if extension == "csv":
            df = read_csv(spark, path, schema)
            source, target = pair_columns(df.columns, text_column, summary_column, dataset)
        else:
            source, target = _json_pair(spark, path, schema, text_column, summary_column, dataset)
            own = T.StructType([T.StructField(c, T.StringType()) for c in (source, target)])
            df = read_jsonl(spark, path, schema or own)
        tables.append(
            df.select(
                F.lit(split).alias("split"),
                F.col(source).alias("input"),
                F.col(target).alias("output"),
            )
        )
    whole = tables[0]
    for table in tables[1:]:
        whole = whole.unionByName(table)
    return whole
