import gzip
import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from instructset import schemas
from instructset.functions.text import one_line
from instructset.operators.scoring import long_metrics
from instructset.plans import building, evaluation
from instructset.sources import readers, registry, writers
from instructset.streaming.incremental import append_available, follow_jsonl


def lines(path):
    return [line for f in sorted(path.rglob("part-*")) for line in f.read_text(encoding="utf8").split("\n")[:-1]]


def put(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(json.dumps(r) + "\n" for r in rows), encoding="utf8")


def test_jsonl(spark, tmp_path):
    rows = [{"input": "a", "output": None}, {"input": "é\n", "output": "ü"}]
    put(tmp_path / "x.jsonl", rows)
    df = readers.read_jsonl(spark, str(tmp_path / "x.jsonl"), schemas.PAIR)
    writers.write_jsonl(df, str(tmp_path / "out"))
    assert [json.loads(line) for line in lines(tmp_path / "out")] == rows
    (tmp_path / "bad.jsonl").write_text('{"input": "a"\n')
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        readers.read_jsonl(spark, str(tmp_path / "bad.jsonl"), schemas.PAIR).collect()


def test_gzip_is_spread(spark, tmp_path):
    with gzip.open(tmp_path / "x.jsonl.gz", "wt") as out:
        out.write('{"input": "a", "output": "b"}\n' * 50)
    df = readers.read_jsonl(spark, str(tmp_path / "x.jsonl.gz"), schemas.PAIR, partitions=5)
    assert df.rdd.getNumPartitions() == 5 and df.count() == 50


def test_split_folders_and_documents(spark, tmp_path):
    for split in ("train", "valid", "test"):
        put(tmp_path / "lines" / split / "a.json", [{"input": split, "output": "1"}, {"input": split, "output": "2"}])
        (tmp_path / "docs" / split).mkdir(parents=True)
        (tmp_path / "docs" / split / "d.json").write_text(json.dumps({"input": split, "output": "x"}, indent=2))
    flat = readers.read_split_folders(spark, str(tmp_path / "lines"), schemas.PAIR)
    assert sorted((r.split, r.input) for r in flat.collect()) == sorted((s, s) for s in ("train", "valid", "test") for _ in "12")
    nested = readers.read_split_folders(spark, str(tmp_path / "docs"), schemas.PAIR, documents=True)
    assert sorted((r.split, r.input) for r in nested.collect()) == [(s, s) for s in ("test", "train", "valid")]
    named = readers.read_named_dataset(spark, str(tmp_path / "lines"), schemas.PAIR, "json")
    assert named.groupBy("split").count().count() == 3


def test_documents_keep_their_names(spark, tmp_path):
    product = {
        "website_summaries": [{"verdict": "good", "pros": ["p"], "cons": []}],
        "customer_reviews": [{"text": "t1", "rating": 5.0, "helpful_votes": 1}, {"text": "t2", "rating": 1.0, "helpful_votes": 3}],
    }
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "p1.json").write_text(json.dumps(product, indent=1))
    df = readers.read_documents(spark, str(tmp_path / "in"), schemas.REVIEWED_PRODUCT)
    built, _ = building.build_review_summaries(df)
    writers.write_documents(built, str(tmp_path / "out"))
    (folder,) = [p for p in (tmp_path / "out").iterdir() if p.is_dir()]
    assert folder.name == "file_name=p1.json"
    record = json.loads(lines(folder)[0])
    assert record["output"] == "good" and record["input"].endswith("reviews.\nt2\nt1")


def test_tsv_and_csv(spark, tmp_path):
    head = "qid\tASIN\tqa_pair_id\tquestion\tcandidate\tlabel\tsource\tconfidence\n"
    (tmp_path / "dev.csv").write_text(head + '1\tA\t2\tq1\t"say ""hi""\tnow\nok"\t1\ts\t0.5\n1\tA\t2\tq1\tNA\t0\ts\t0.1\n')
    df = readers.read_tsv(spark, str(tmp_path / "dev.csv"), schemas.EVIDENCE, multi_line=True)
    assert [r.candidate for r in df.collect()] == ['say "hi"\tnow\nok', None]
    split = spark.read.schema(schemas.EVIDENCE).csv(str(tmp_path))
    assert {r[0] for r in split.select(readers.split_of(split, ["dev", "test", "train"])).collect()} == {"dev"}

    pairs = spark.createDataFrame([('a "b"\nc', "NA"), (None, "x,y")], schemas.CSV_PAIR)
    writers.write_csv(pairs, str(tmp_path / "csv"))
    back = readers.read_csv(spark, str(tmp_path / "csv"), schemas.CSV_PAIR, multi_line=True).collect()
    assert sorted(back, key=str) == sorted(pairs.collect(), key=str)


def test_load_pairs(spark, tmp_path):
    put(tmp_path / "t.jsonl", [{"input": "i", "output": "o"}])
    (tmp_path / "v.csv").write_text("inputs,target\nx,y\n")
    files = {"train": str(tmp_path / "t.jsonl"), "validation": str(tmp_path / "v.csv"), "test": None}
    assert sorted(readers.load_pairs(spark, files).collect()) == [("train", "i", "o"), ("validation", "x", "y")]
    with pytest.raises(ValueError, match="need a training"):
        readers.load_pairs(spark, {"train": None})
    with pytest.raises(ValueError, match="should be one of"):
        readers.load_pairs(spark, {"train": "x.parquet"})


def test_columns_are_found_by_name(spark, tmp_path):
    (tmp_path / "swapped.csv").write_text("target,inputs\nt,i\n")
    assert readers.read_csv(spark, str(tmp_path / "swapped.csv"), schemas.CSV_PAIR).collect() == [("i", "t")]
    (tmp_path / "other.csv").write_text("target,source\nt,i\n")
    with pytest.raises(ValueError, match="no column inputs"):
        readers.read_csv(spark, str(tmp_path / "other.csv"), schemas.CSV_PAIR)
    put(tmp_path / "foreign.jsonl", [{"id": 1, "article": "a", "highlights": "h"}])
    path = {"train": str(tmp_path / "foreign.jsonl")}
    assert readers.load_pairs(spark, path, dataset="cnn_dailymail").collect() == [("train", "a", "h")]
    assert readers.load_pairs(spark, path, text_column="highlights", summary_column="article").collect() == [("train", "h", "a")]
    with pytest.raises(ValueError, match="has no document, summary"):
        readers.load_pairs(spark, path, dataset="xsum")


def test_a_broken_record_fails_every_json_reader(spark, tmp_path):
    (tmp_path / "train").mkdir()
    (tmp_path / "train" / "x.json").write_text('{"input": "a", "output": "b"}\n{"input": \n')
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        readers.read_named_dataset(spark, str(tmp_path), schemas.PAIR, "json").collect()


def test_pair_columns():
    assert readers.pair_columns(["a", "b", "c"]) == ("a", "b")
    assert readers.pair_columns(["a", "document", "summary"], dataset="xsum") == ("document", "summary")
    assert readers.pair_columns(["a", "b", "c"], "c", None, "xsum") == ("c", "summary")
    with pytest.raises(ValueError, match="not one of: a, b"):
        readers.pair_columns(["a", "b"], "z")


def test_rungs(spark, tmp_path):
    for name in ("train_1k.json", "train_5k.jsonl", "test.json"):
        put(tmp_path / name, [{"input": name, "output": "o"}])
    rows = readers.read_rungs(spark, str(tmp_path)).collect()
    assert sorted((r.rung, r.input) for r in rows) == [("1k", "train_1k.json"), ("5k", "train_5k.jsonl")]


def test_registry(spark, tmp_path):
    put(tmp_path / "t.json", [{"input": f"i{n}", "output": "o"} for n in range(5)])
    spark.createDataFrame([("q", "r")], schemas.INSTRUCTION).write.parquet(str(tmp_path / "p"))
    paths = {"esci_task2_1k": str(tmp_path / "t.json"), "my_orca": str(tmp_path / "p")}
    task = registry.load_datasets(spark, "esci_task2_1k", paths)["esci_task2_1k"]
    assert [(r.pos, r.prompt) for r in task.orderBy("pos").collect()] == [(n, f"i{n}") for n in range(5)]
    with pytest.raises(NotImplementedError):
        registry.load_datasets(spark, "esci_task2_1k#other", paths)
    assert [(r.prompt, r.response) for r in registry.load_instructions(spark, "my_orca", paths, None).collect()] == [("q", "r")]
    with pytest.raises(Exception, match="fewer than 50000 rows"):
        registry.load_datasets(spark, "my_orca", paths)["my_orca"].collect()


def test_conll_and_splits(spark, tmp_path):
    df = spark.createDataFrame(
        [(i, "big  red box", ["B-A", "I-A", "O"]) for i in range(10)] + [(10, "one two", ["O"])],
        "id bigint, description string, tag array<string>",
    )
    splits = building.build_tagged_splits(df, "id")
    writers.write_conll(splits, str(tmp_path / "c"), by="split")
    blocks = {p.name: "\n".join([*lines(p), ""]) for p in (tmp_path / "c").iterdir() if p.is_dir()}
    one = "big B-A\nred I-A\nbox O\n\n"
    assert blocks == {"split=train": one * 7, "split=dev": one, "split=test": one * 2}
    _, rejects = building.tagged_sentences(df)
    assert [r.id for r in rejects.collect()] == [10]


def test_text_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "b\nb", " o2 "), (1, "a", "o\n1")], "id int, input string, output string")
    writers.write_training_lines(df, str(tmp_path / "lm"))
    assert sorted(lines(tmp_path / "lm")) == ["a <SEP> o1", "bb <SEP>  o2 "]
    writers.write_predictions(df.select("id", one_line(F.col("output")).alias("model_output")), str(tmp_path / "pred"), "id")
    assert lines(tmp_path / "pred") == ["o1", "o2"]
    metrics = long_metrics(spark.range(3).agg(F.count("*").alias("n")), ["n"])
    writers.write_metrics(metrics, str(tmp_path / "m"), "a/b", "eval")
    writers.write_metrics(metrics, str(tmp_path / "m"), "a/b", "predict")
    assert {tuple(json.loads(line).values()) for line in lines(tmp_path / "m")} == {("a-b", "eval", "n", 3.0), ("a-b", "predict", "n", 3.0)}


def test_summary_table(spark):
    prompt = building.SUMMARY_PROMPT
    df = spark.createDataFrame([("train", prompt + "text", "s")], "split string, input string, output string")
    assert building.summary_table(df).first() == ("train", "text", "s")
    bad = df.withColumn("input", F.lit("no prompt"))
    with pytest.raises(Exception, match="input without the prompt"):
        building.summary_table(bad).collect()
    assert building.summary_table(bad, strict=False).first().inputs is None


def test_incremental_run(spark, tmp_path):
    put(tmp_path / "in" / "1.json", [{"input": "a", "output": "b\nc"}])
    args = (str(tmp_path / "out"), str(tmp_path / "progress"), "text")
    for expected in (["a <SEP> bc"], ["a <SEP> bc", "d <SEP> e"]):
        stream = writers.training_lines(follow_jsonl(spark, str(tmp_path / "in"), schemas.PAIR, 1))
        append_available(stream, *args).awaitTermination(120)
        assert sorted(lines(tmp_path / "out")) == expected
        put(tmp_path / "in" / "2.json", [{"input": "d", "output": "e"}])


def test_question_files(spark, tmp_path):
    head = "qid\tASIN\tqa_pair_id\tquestion\tcandidate\tlabel\tsource\tconfidence\n"
    answers = "ASIN\tquestion\tcandidate\tanswer\tsource\n"
    for folder in ("evidence", "answers"):
        (tmp_path / folder).mkdir()
    for name in ("train", "dev", "test"):
        rows = "".join(f"1\tA\t1\tq\t{name}{i}\t1\ts\t1\n" for i in range(3)) + "1\tB\t1\tq\tNaN\t1\ts\t1\n"
        (tmp_path / "evidence" / f"{name}.csv").write_text(head + rows)
        (tmp_path / "answers" / f"{name}.csv").write_text(answers + f"A\tq\tc\tans-{name}\ts\nB\tq\tc\tnone\ts\n")
    evidence = readers.read_ranked_tsv(spark, str(tmp_path / "evidence"), schemas.EVIDENCE)
    asked = readers.read_ranked_tsv(spark, str(tmp_path / "answers"), schemas.ANSWERS)
    rows = building.build_question_answers(asked, evidence).collect()
    assert sorted((r.split, r.output) for r in rows) == [(n, f"ans-{n}") for n in ("dev", "test", "train")]
    context = "\n".join(f"{n}{i}" for n in ("dev", "test", "train") for i in range(3))
    assert {r.input.split("Context: ")[1] for r in rows} == {context}


def test_scored_files(spark, tmp_path):
    put(tmp_path / "s.jsonl", [{"input": "", "output": "red, B-A box, O", "model_output": "red, B-A box, O"}])
    report = {r.entity: r.f1 for r in evaluation.score_entities(spark, str(tmp_path / "s.jsonl")).collect()}
    assert report == {"A": 1.0, "micro avg": 1.0, "macro avg": 1.0, "weighted avg": 1.0}
    assert {r.value for r in evaluation.score_texts(spark, str(tmp_path / "s.jsonl")).collect()} == {1.0}
    df = spark.createDataFrame([("1k", "a b", "a b"), ("5k", "a", "b")], "rung string, output string, model_output string")
    sweep = {(r.rung, r.metric): r.value for r in evaluation.sweep_report(df).collect()}
    assert sweep[("1k", "rougeL")] == 100.0 and sweep[("5k", "rougeL")] == 0.0 and len(sweep) == 8
    assert evaluation.samples(df, 1, "eval").first() == ("eval_samples", 1.0)


def test_one_file_for_each_name(spark, tmp_path):
    rows = [(f"d{i % 40}.json", i, None if i % 7 else "x\ny") for i in range(200)]
    df = spark.createDataFrame(rows, "file_name string, n int, text string").repartition(7)
    for _ in range(2):
        # A second run leaves the same files.
        writers.write_named_files(df, str(tmp_path / "out"))
        names = sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.endswith(".crc"))
        assert names == sorted([*{r[0] for r in rows}, "_SUCCESS"])
    for name in {r[0] for r in rows}:
        found = [json.loads(line) for line in (tmp_path / "out" / name).read_text().splitlines()]
        assert sorted((r["n"], r["text"]) for r in found) == sorted((n, t) for f, n, t in rows if f == name)
    back = spark.read.schema("n int, text string").json(str(tmp_path / "out")).withColumn("file_name", F.col("_metadata.file_name"))
    assert sorted(map(str, back.select("file_name", "n", "text").collect())) == sorted(map(str, df.collect()))


@pytest.mark.parametrize("name", [None, "", "a/b", ".hidden", "_part", "../up"])
def test_names_that_are_no_file_names_fail(spark, tmp_path, name):
    df = spark.createDataFrame([(name, 1)], "file_name string, n int")
    with pytest.raises(Exception, match="not a file name"):
        writers.write_named_files(df, str(tmp_path / "out"))


def test_documents_without_rows(spark, tmp_path):
    writers.write_named_files(spark.createDataFrame([], "file_name string, n int"), str(tmp_path / "none"))
    assert [p.name for p in (tmp_path / "none").iterdir()] == ["_SUCCESS"]


def test_summaries_without_the_prompt_are_kept_beside(spark):
    prompt = building.SUMMARY_PROMPT
    rows = [("train", prompt + "text", "s"), ("test", "no prompt", "r"), ("test", None, "n")]
    kept, rejects = building.summary_rows(spark.createDataFrame(rows, "split string, input string, output string"))
    assert kept.collect() == [("train", "text", "s")]
    assert sorted(r.output for r in rejects.collect()) == ["n", "r"]


def test_metrics_come_from_the_pass_that_writes(spark, tmp_path):
    put(tmp_path / "in.json", [{"input": f"a {i}", "output": "o"} for i in range(30)])
    df = readers.read_jsonl(spark, str(tmp_path / "in.json"), schemas.PAIR)

    def write(rows):
        assert not (tmp_path / "out").exists()
        writers.write_jsonl(rows.repartition(3), str(tmp_path / "out"))
        (tmp_path / "in.json").unlink()

    # The source is gone before the metrics are read.
    found = evaluation.written_samples(df, 20, "train", write, chars=F.sum(F.length("input")), none=F.max(F.lit(None).cast("int")))
    assert sorted(found.collect()) == [("train_chars", 30 * 2 + 10 + 40), ("train_none", None), ("train_samples", 20.0)]
    assert len(lines(tmp_path / "out")) == 30
    empty = evaluation.written_samples(spark.createDataFrame([], schemas.PAIR), None, "eval", lambda r: writers.write_jsonl(r, str(tmp_path / "e")))
    assert empty.collect() == [("eval_samples", 0.0)]


def test_many_documents_are_read_once_in_few_tasks(spark, tmp_path):
    """Small files are written by as many tasks as there are partitions, and read thousands in a task."""
    rows = spark.range(400).select(F.concat("id", F.lit(".json")).alias("file_name"), F.col("id").alias("n"))
    writers.write_named_files(rows, f"{tmp_path}/docs")
    assert len([f for f in os.listdir(f"{tmp_path}/docs") if f.endswith(".json")]) == 400
    read = readers.read_documents(spark, f"{tmp_path}/docs", T.StructType.fromDDL("n bigint"))
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    stored = readers.stored_documents(read)
    assert spark.conf.get("spark.sql.files.openCostInBytes") == before
    assert {r.file_name: r.n for r in stored.collect()} == {f"{i}.json": i for i in range(400)}
    # Each task that read has left a file of the table.
    assert len(stored.inputFiles()) <= spark.sparkContext.defaultParallelism + 1
    assert all("documents-" in f for f in stored.inputFiles())


def test_folders_of_documents_are_listed_by_tasks(spark, tmp_path):
    """The driver knows no file of them, however many there are, and what is read is what Spark's own reader gives."""
    docs = {
        "train/object.json": json.dumps({"input": "a\nb", "output": "é"}, indent=1, ensure_ascii=False).encode(),
        "train/two.json": b'[{"input": "c"}, {"input": "d", "output": null}]',
        "train/later lines.json": b'{"input": "first"}\n{"input": "second"}\n',
        "train/wide.json": json.dumps({"input": "ü"}, ensure_ascii=False).encode("utf-16"),
        "train/packed.json.gz": gzip.compress(b'{"output": "z"}'),
        "train/empty.json": b"",
        "train/.hidden.json": b"{",
        "train/_SUCCESS": b"",
        "train/deeper/x.json": b'{"input": "not in the folder"}',
        "valid/none.json": b"{}",
        "test/one.json": b'{"output": "1", "other": 2}',
    }
    for name, data in docs.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    read = readers.read_split_folders(spark, str(tmp_path), schemas.PAIR, documents=True)
    assert not read.inputFiles()
    found = sorted(map(tuple, read.select("split", "input", "output").collect()), key=str)
    expected = [("a\nb", "é"), ("c", None), ("d", None), ("first", None), ("ü", None), (None, "z")]
    assert found == sorted([("train", *x) for x in expected] + [("valid", None, None), ("test", None, "1")], key=str)
    # A pattern is Spark's to read, by the same rules.
    listed = readers.read_split_folders(spark, f"{tmp_path.parent}/{tmp_path.name[:-1]}?", schemas.PAIR, documents=True)
    assert listed.inputFiles() and listed.columns == read.columns == ["input", "output", "split"]
    assert sorted(map(tuple, listed.select("split", "input", "output").collect()), key=str) == found
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readers.read_split_folders(spark, str(tmp_path), schemas.PAIR, ("train", "dev"), documents=True)


@pytest.mark.parametrize("name, data, error", [
    ("x.json", b'{"input": ', "MALFORMED_RECORD"),
    ("x.json", b'{"input": "\xff"}', "UnicodeDecodeError"),
    ("lang=de/x.json", b"{}", "partitioned table"),
])
def test_folders_that_hold_no_documents_fail(spark, tmp_path, name, data, error):
    (tmp_path / "train" / name).parent.mkdir(parents=True)
    (tmp_path / "train" / name).write_bytes(data)
    with pytest.raises(Exception, match=error):
        readers.read_split_folders(spark, str(tmp_path), schemas.PAIR, ("train",), documents=True).collect()
