import dataclasses
import random
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from instructset.functions import arrays
from instructset.functions.lookup import places
from instructset.functions.text import tokens
from instructset.operators import batching
from instructset.operators import vocabulary as voc
from instructset.plans import assembly
from instructset.session import materialize

TEXTS = [(1, "the cat sat, the cat ran"), (2, "a dog sat"), (3, ""), (4, None), (5, "the end.")]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(TEXTS, "id bigint, text string").withColumn("tokens", tokens(F.col("text")))


def test_vocabulary_order(texts):
    vocabulary = voc.build_vocabulary(texts, "text")
    listed = [(r.token, r.token_id, r.n) for r in vocabulary.table.orderBy("token_id").collect()]
    assert listed[:4] == [("the", 3, 3), ("cat", 4, 2), ("sat", 5, 2), (",", 6, 1)]
    assert vocabulary.size == len(listed) == 9
    assert (vocabulary.pad_id, vocabulary.eos_id, vocabulary.unk_id) == (0, 1, 2)
    frequent = voc.build_vocabulary(texts, "text", min_count=2)
    assert frequent.size == 3
    with pytest.raises(ValueError):
        voc.build_vocabulary(texts, "text", specials=("</s>", "</s>"))


@pytest.mark.parametrize("common", [4, 6, 1_000_000])
def test_encode_and_decode(spark, texts, monkeypatch, common):
    monkeypatch.setattr(voc, "COMMON_IDS", common)
    vocabulary = voc.build_vocabulary(texts, "text")
    coded = voc.encode(texts, "id", "tokens", vocabulary)
    ids = {r.id: r.input_ids for r in coded.collect()}
    assert ids[1] == [3, 4, 5, 6, 3, 4, 11] and ids[3] == [] and ids[4] is None
    back = {r.id: r.text for r in voc.decode(coded, "id", "input_ids", vocabulary).collect()}
    assert back[1] == "the cat sat , the cat ran" and back[3] == ""
    odd = spark.createDataFrame([(9, ["zebra", "cat", "</s>", "[PAD]"])], "id bigint, tokens array<string>")
    coded = voc.encode(odd, "id", "tokens", vocabulary)
    assert coded.first().input_ids == [2, 4, 1, 0]
    assert voc.decode(coded, "id", "input_ids", vocabulary).first().text == "cat"


def test_rare_and_hot_unknown_tokens(spark, monkeypatch):
    """Values that occur often are settled before the join, known ones and unknown ones."""
    monkeypatch.setattr(voc, "HOT_VALUES", 3)
    monkeypatch.setattr(voc, "HOT_COUNTERS", 64)
    rng = random.Random(3)
    words = ["hot", *["gone"] * 30, *["often"] * 20, *(f"w{i}" for i in range(40)), None]
    rows = [(i, [rng.choice(words) for _ in range(rng.randrange(30))]) for i in range(200)] + [(200, None), (201, [])]
    df = spark.createDataFrame(rows, "id bigint, tokens array<string>")
    known = spark.createDataFrame([(" ".join(["the"] * 9 + ["often", *(f"w{i}" for i in range(0, 40, 2))]),)], "text string")
    whole = voc.build_vocabulary(known, "text")
    small = dataclasses.replace(whole, common=4)
    ids = {r.token: r.token_id for r in whole.table.collect()}
    for vocabulary in (whole, small):
        got = {r.id: r.input_ids for r in voc.encode(df, "id", "tokens", vocabulary).collect()}
        assert got == {i: None if t is None else [ids.get(w, 2) for w in t] for i, t in rows}


@pytest.mark.parametrize("common", [None, 8])
def test_vocabularies_by_key(spark, common):
    rows = [("a", 1, "x y x"), ("a", 2, "y z x"), ("b", 1, "z z q"), ("b", 3, "x"), (None, 9, "k"), ("b", 4, None)]
    df = spark.createDataFrame(rows, "rung string, id int, text string")
    made = voc.build_vocabularies(df, "rung", "text")
    ids = {(r.rung, r.token): r.token_id for r in made.table.collect()}
    assert ids == {("a", "x"): 3, ("a", "y"): 4, ("a", "z"): 5, ("b", "z"): 3, ("b", "q"): 4, ("b", "x"): 5, (None, "k"): 3}
    made = dataclasses.replace(made, common=common)
    keyed = df.select(F.struct("rung", "id").alias("key"), F.split("text", " ").alias("tokens"))
    odd = keyed.unionByName(spark.createDataFrame([(("b", 7), ["y", "</s>", "z"])], keyed.schema))
    got = {tuple(r.key): r.input_ids for r in voc.encode(odd, "key", "tokens", made).collect()}
    assert got == {("a", 1): [3, 4, 3], ("a", 2): [4, 5, 3], ("b", 1): [3, 3, 4], ("b", 3): [5], (None, 9): [3], ("b", 4): None, ("b", 7): [2, 1, 3]}


def test_tokenizer_hook(texts):
    def load():
        return lambda batch: [[len(word) for word in text.split()] for text in batch]

    rows = {r.id: r.ids for r in texts.select("id", voc.encode_with(F.col("text"), load).alias("ids")).collect()}
    assert rows[2] == [1, 3, 3] and rows[3] == [] and rows[4] is None


def test_array_functions(spark):
    df = spark.createDataFrame([([5, 6, 7], 2), ([5], 4), ([], 0)], "ids array<int>, k int")
    c = F.col
    rows = df.select(
        arrays.mask_prompt(c("ids"), c("k")).alias("masked"),
        arrays.truncate(c("ids"), 2).alias("cut"),
        arrays.pad_to(c("ids"), F.lit(2), 0).alias("padded"),
    ).collect()
    assert [r.masked for r in rows] == [[-100, -100, 7], [-100], []]
    assert [r.cut for r in rows] == [[5, 6], [5], []]
    assert [r.padded for r in rows] == [[5, 6, 7], [5, 0], [0, 0]]
    padded = F.array(F.lit(4), F.lit(0))
    row = df.select(
        arrays.attention_mask(padded, 0).alias("mask"),
        arrays.ignore_padding(padded, 0).alias("ignored"),
        arrays.restore_padding(arrays.ignore_padding(padded, 0), 0).alias("restored"),
        arrays.filled_size(padded, 0).alias("size"),
    ).first()
    assert (row.mask, row.ignored, row.restored, row.size) == ([True, False], [4, -100], [4, 0], 1)


def test_batches(spark):
    df = spark.range(103).withColumn("input_ids", F.array_repeat(F.lit(7), (F.col("id") % 10 + 1).cast("int")))
    df = df.withColumn("labels", F.slice("input_ids", F.lit(1), F.greatest(F.size("input_ids") - 1, F.lit(0))))
    placed = batching.length_batches(df, "id", F.size("input_ids"), 4)
    rows = placed.collect()
    assert sorted((r.batch_id, r.slot) for r in rows) == [(i // 4, i % 4) for i in range(103)]
    lengths = [len(r.input_ids) for r in sorted(rows, key=lambda r: (r.batch_id, r.slot))]
    assert lengths == sorted(lengths, reverse=True)  # 103 rows are one group of 50 batches
    for multiple in (None, 8):
        batches = batching.padded_batches(placed, 0, multiple).collect()
        assert len(batches) == 26
        for b in batches:
            widths = {len(r) for r in b.input_ids}
            assert len(widths) == 1 and (multiple is None or widths.pop() % 8 == 0)
            assert [[x != 0 for x in r] for r in b.input_ids] == b.attention_mask
            assert len({len(r) for r in b.labels}) == 1


PAIRS = [(1, " the cat ", "sat\n"), (2, None, "x"), (3, "x", None), (4, "the dog", "ran " * 600)]


def test_instruction_examples(spark):
    df = spark.createDataFrame(PAIRS, "pos bigint, prompt string, response string")
    vocabulary = voc.build_vocabulary(df, "prompt", "response")
    rows = assembly.instruction_examples(df, "pos", vocabulary).collect()
    assert [r.pos for r in rows] == [1]
    row = rows[0]
    ignored = sum(x == -100 for x in row.labels)
    assert row.labels[ignored:] == row.input_ids[ignored:] and len(row.labels) == len(row.input_ids)
    assert row.labels[-1] == vocabulary.eos_id and len(row.input_ids) - ignored == 2
    # The limit itself is kept.
    size = len(row.input_ids)
    assert assembly.instruction_examples(df, "pos", vocabulary, size).count() == 1
    assert assembly.instruction_examples(df, "pos", vocabulary, size - 1).count() == 0


def test_assembled_instructions(spark):
    df = spark.createDataFrame([(i, f"p{i}", "r") for i in range(30)], "pos bigint, prompt string, response string")
    vocabulary = voc.build_vocabulary(df, "prompt", "response")
    rows = assembly.assemble_instructions({"a": df, "b": df}, vocabulary, select_train=10).collect()
    for task in "ab":
        assert sum(r.split == "train" and r.task == task for r in rows) == 10
        assert sum(r.split == "validation" and r.task == task for r in rows) == 1


def test_assembled_mixed(spark):
    rows = [(1, 1, None, "plain text", None), (2, 0, "sys", "ask", "tell"), (3, 0, None, "ask", "tell"), (4, None, "s", "p", "r")]
    df = spark.createDataFrame(rows, "id bigint, pretrain_marker int, system_message string, prompt string, response string")
    vocabulary = voc.build_vocabulary(df, "system_message", "prompt", "response")
    out = {r.id: r for r in assembly.assemble_mixed(df, "id", vocabulary).collect()}
    assert set(out) == {1, 2}
    assert out[1].labels == out[1].input_ids and len(out[1].labels) == 3
    assert out[2].labels[-2:] == out[2].input_ids[-2:] and set(out[2].labels[:-2]) == {-100}
    assert {r.id for r in assembly.assemble_mixed(df, "id", vocabulary, only_instructions=True).collect()} == {2}
    short = assembly.assemble_mixed(df, "id", vocabulary, max_length=2).collect()
    assert all(len(r.input_ids) == 2 for r in short)
    asked = assembly.assemble_mixed(df, "id", vocabulary, prompt_only=True, only_instructions=True).first()
    assert set(asked.labels) == {-100}


def test_assembled_seq2seq(spark):
    df = spark.createDataFrame([(1, "a b c", "d e"), (2, "", "x"), (3, "a", None)], "id bigint, input string, output string")
    vocabulary = voc.build_vocabulary(df, "input", "output")
    rows = assembly.assemble_seq2seq(df, "id", vocabulary, max_source=3, max_target=8).collect()
    assert len(rows) == 1 and len(rows[0].input_ids) == 3 and len(rows[0].labels) == 3
    assert rows[0].input_ids[-1] == rows[0].labels[-1] == vocabulary.eos_id
    padded = assembly.assemble_seq2seq(df, "id", vocabulary, max_source=6, max_target=8, pad_to_max=True).first()
    assert padded.input_ids[-2:] == [0, 0] and padded.labels[3:] == [-100] * 5
    swept = assembly.sweep_examples(
        df.withColumn("rung", F.explode(F.array(F.lit("1k"), F.lit("5k")))), "id", vocabulary
    )
    assert sorted((r.rung, r.id) for r in swept.collect()) == [("1k", 1), ("5k", 1)]


def test_lookup_makes_no_python_objects_of_the_list():
    """Places are found from the distinct values of a batch; nulls, absent values and slices are told apart."""
    listed = pa.array([f"t{i}" for i in range(50_000)])
    values = pa.array(["t7", None, "x", "t49999", "t7", "t0"])
    assert places(values, listed).to_pylist() == [7, None, None, 49999, 7, 0]
    assert places(values.slice(2, 2), listed).to_pylist() == [None, 49999]
    assert places(pa.array([], pa.string()), listed).to_pylist() == []
    tracemalloc.start()
    places(values, listed)
    assert tracemalloc.get_traced_memory()[1] < 1_000_000
    tracemalloc.stop()


def test_rare_lookup_writes_no_tokens_that_are_not_kept(spark, texts, monkeypatch):
    """With rare tokens the rows are written: ids and gaps, and batches sent to Python are small."""
    written = []
    monkeypatch.setattr(voc, "materialize", lambda df, label: written.append(df.columns) or materialize(df, label))
    vocabulary = dataclasses.replace(voc.build_vocabulary(texts, "text"), common=4)
    coded = voc.encode(texts.select("id", "tokens"), "id", "tokens", vocabulary, keep=False)
    assert {r.id: r.input_ids for r in coded.collect()}[1] == [3, 4, 5, 6, 3, 4, 11]
    back = voc.decode(coded, "id", "input_ids", vocabulary, keep=False)
    assert {r.id: r.text for r in back.collect()}[1] == "the cat sat , the cat ran"
    assert coded.columns == ["id", "input_ids"] and back.columns == ["id", "text"]
    assert written == [["id", "input_ids", "_gaps"], ["id", "text", "_gaps"]]
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
