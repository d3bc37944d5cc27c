import itertools
import random

import pytest
from pyspark.sql import functions as F

from instructset.operators import dedup, filters as flt
from instructset.operators.evidence import pooled_evidence
from instructset.operators.reviews import (
    joined_reviews,
    summary_text,
    top_review_text,
    top_reviews,
)
from instructset.plans import building
from instructset.schemas import REVIEWED_PRODUCT


def test_description_band(spark):
    sizes = [50, 51, 299, 300]
    rows = [("a b", ["w " * n]) for n in sizes] + [
        ("a b", []),
        ("t " * 60, ["w " * 60]),
        (None, ["w " * 60]),
        ("a", ["w " * 30, "w " * 30]),
    ]
    df = spark.createDataFrame(rows, "t string, d array<string>")
    kept = [r[0] for r in df.select(flt.description_band(F.col("t"), F.col("d"))).collect()]
    assert kept == [False, True, True, False, False, False, False, True]


def test_product_quality(spark):
    rows = [
        ("a b", "x y z", "p"), (None, "x y z", "p"), ("a b", None, "p"), ("a b", "x y z", None),
        ("x y", "x y", "p"), ("a", "x y z", "x y z"), ("a b c", "x y z", "p"),
    ]
    df = spark.createDataFrame(rows, "t string, d string, b string")
    kept = [r[0] for r in df.select(flt.product_quality(F.col("t"), F.col("d"), F.col("b"))).collect()]
    assert kept == [True, False, False, False, False, False, False]


def test_mixed_validity(spark):
    rows = [(1, None, "p", None), (None, "s", "p", "r"), (0, "s", "p", "r"), (0, None, "p", "r"),
            (0, "s", "p", None), (1, "s", None, "r")]
    df = spark.createDataFrame(rows, "m int, s string, p string, r string")
    kept = [bool(r[0]) for r in df.select(flt.valid_mixed(*map(F.col, "mspr"))).collect()]
    assert kept == [True, False, True, False, False, False]


def test_first_seen_comes_before_the_quality_test(spark):
    long, short = "x y z w", "x"
    rows = [
        ("train", 0, 2, "T1", long), ("train", 0, 1, "T1", short),
        ("test", 1, 0, "T2", long), ("train", 0, 9, "T2", long),
        ("train", 0, 3, None, long), ("train", 0, 4, "T3", ""),
        ("train", 0, 5, "T3", long),
    ]
    df = spark.createDataFrame(
        [(s, k, p, t, d, "b", None, None, "us") for s, k, p, t, d in rows],
        "split string, split_rank int, pos int, product_title string, product_description string, "
        "product_bullet_point string, product_brand string, product_color string, product_locale string",
    )
    out = building.build_product_descriptions(df).collect()
    # T1 falls with its first row; T3's empty row was never a candidate.
    assert sorted((r.split, r.input.split("\n")[0]) for r in out) == [
        ("train", "Title: T2"), ("train", "Title: T3")
    ]
    assert out[0].input.split("\n")[1:] == ["Brand: None", "Color: None", "Bullet points: b"]


def test_first_seen_drops_rows_before_the_shuffle(spark):
    df = spark.range(10).select((F.col("id") % 2).alias("k"), "id")
    plan = dedup.first_seen(df, "k", ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_held_out(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "id int, output string")
    used = df.filter("id = 1")
    for bound in (None, 10, 10**9):
        assert sorted(r.id for r in dedup.held_out(df, used, max_used=bound).collect()) == [3, 4]
    assert dedup.overlap(df, used).first().shared == 1


def check_splits(rows, pairs, sizes):
    by = {k: [r for r in rows if r.split == k] for k in {r.split for r in rows}}
    assert {k: len(v) for k, v in by.items()} == sizes
    outputs = {k: {r.output for r in v} for k, v in by.items()}
    trains = set().union(*(v for k, v in outputs.items() if k.startswith("train")))
    assert not trains & outputs["test"]
    if "dev" in outputs:
        assert not (trains | outputs["test"]) & outputs["dev"]
    assert all(pairs[r.pos] == (r.input, r.output) for r in rows)


def some_pairs(spark, n=400):
    rng = random.Random(1)
    # A third of all rows share one output.
    pairs = {i: (f"t{i}", "same" if i % 3 == 0 else f"o{rng.randint(0, 250)}") for i in range(n)}
    return pairs, spark.createDataFrame([(i, *p) for i, p in pairs.items()], "pos bigint, input string, output string")


def test_ladder_with_held_out(spark):
    pairs, df = some_pairs(spark)
    rows = building.ladder_with_held_out(df, "pos", {"a": 5, "b": 40}, 20, 15).collect()
    check_splits(rows, pairs, {"train_a": 5, "train_b": 40, "test": 20, "dev": 15})
    again = building.ladder_with_held_out(df.repartition(5), "pos", {"a": 5, "b": 40}, 20, 15).collect()
    assert sorted(rows) == sorted(again)


def test_resplit(spark):
    pairs, df = some_pairs(spark)
    sizes = {"train_a": 5, "train_b": 20, "test": 20, "train_c": 50}
    rows = building.resplit(df, "pos", {"a": 5, "b": 20}, 20, 30, "b", "c").select("split", "pos", "input", "output").collect()
    check_splits(rows, pairs, sizes)
    leaky = building.resplit(df, "pos", {"a": 5, "b": 20}, 20, 30, "b", "c", legacy_leak=True).collect()
    assert len(leaky) == len(rows)
    with pytest.raises(Exception, match="larger than its population"):
        building.resplit(df, "pos", {"a": 5}, 4000, 1, "a", "b", strict=True).collect()


def test_early_stopped_descriptions(spark):
    df = spark.createDataFrame(
        [(i, f"t{i}", ["<b>w</b> " * 60] if i % 2 else ["short"]) for i in range(40)],
        "pos bigint, title string, description array<string>",
    )
    rows = building.description_pairs(df, limit=10, enough=3).collect()
    assert sorted(r.pos for r in rows) == [1, 3, 5, 7, 9, 11]
    assert rows[0].output == " ".join(["w"] * 60)


def evidence_rows():
    rng = random.Random(2)
    rows = [("A", "hot", s, p, f"h{s}-{p}") for s in range(3) for p in range(100)]
    rows += [("A", "q", 0, 200, "first"), ("A", "q", 2, 201, "last"), ("A", "q", 1, 202, None)]
    rows += [("B", "q", 1, 203, "other")]
    rng.shuffle(rows)
    return rows


def test_evidence_of_a_large_group_is_whole(spark):
    schema = "asin string, q string, src int, pos bigint, text string"
    rows = evidence_rows()
    df = spark.createDataFrame(rows, schema)
    expected = {
        key: [r[4] for r in sorted(group, key=lambda r: r[2:4]) if r[4]]
        for key, group in itertools.groupby(sorted(rows, key=lambda r: r[:2]), key=lambda r: r[:2])
    }
    for part_rows in (10, 37, 1000):
        parts = pooled_evidence(df, ["asin", "q"], ["src", "pos"], "text", part_rows).collect()
        assert max(len(p.evidence) for p in parts) <= part_rows
        seen = {}
        for p in sorted(parts, key=lambda p: p.part):
            assert (p.part == 0) == ((p.asin, p.q) not in seen)
            seen.setdefault((p.asin, p.q), []).extend(p.evidence)
        assert seen == expected


def test_evidence_does_not_depend_on_other_rows(spark):
    schema = "asin string, q string, src int, pos bigint, text string"
    rows = evidence_rows()
    more = [("Z", f"q{i % 7}", i % 3, 1000 + i, "more") for i in range(900)]
    few, many = (
        {(p.asin, p.q, p.part): p.evidence for p in pooled_evidence(df, ["asin", "q"], ["src", "pos"], "text", 16).collect()}
        for df in (spark.createDataFrame(rows, schema), spark.createDataFrame(rows + more, schema))
    )
    assert len(many) > len(few) and few == {k: v for k, v in many.items() if k in few}


def test_question_answers(spark):
    evidence = spark.createDataFrame(evidence_rows(), "ASIN string, question string, source_rank int, pos bigint, candidate string")
    answers = spark.createDataFrame(
        [("dev", "A", "q", "yes"), ("test", "B", "q", "no"), ("test", "C", "q", "none"), ("dev", "A", "hot", "big")],
        "split string, ASIN string, question string, answer string",
    )
    whole = {r.output: r for r in building.build_question_answers(answers, evidence).collect()}
    assert set(whole) == {"yes", "no", "big"}
    assert whole["yes"].input.endswith("context. \nQuestion: q\nContext: first\nlast")
    parts = building.build_question_answers(answers, evidence, part_rows=16).filter("output = 'big'").collect()
    assert len(parts) > 10
    assert "".join(p.input for p in sorted(parts, key=lambda p: p.part)) == whole["big"].input


def test_reviews(spark):
    def review(text, rating, votes):
        return {"text": text, "rating": float(rating), "helpful_votes": votes}

    reviews = [review("z", 1, None), review("a", 3, 5), review("b", 4, 5), review("c", 1, 9), review("d", 5, 1),
               review("e", 4, 5), review("f", 5, 0), review("g", 5, 7)]
    summary = {"verdict": "V", "pros": ["p1", "p2"], "cons": ["c1"]}
    df = spark.createDataFrame(
        [([summary], reviews), ([summary], []), ([], reviews)], REVIEWED_PRODUCT
    ).withColumn("file_name", F.lit("x.json"))
    texts = {k: [r[0] for r in df.select(top_review_text(F.col("customer_reviews"), k)).collect()] for k in ("verdict", "pros", "cons")}
    assert texts["verdict"][0] == "c\ng\na\nb"
    assert texts["pros"][0] == "g\nb\ne\nd" and texts["cons"][0] == "c\nz"
    assert texts["verdict"][1] == ""
    pros = [r[0] for r in df.select(summary_text(F.col("website_summaries"), "pros")).collect()]
    assert pros == ["p1\np2", "p1\np2", None]
    built, rejects = building.build_review_summaries(df, "cons")
    assert [r.output for r in built.collect()] == ["c1", "c1"] and rejects.count() == 1
    with pytest.raises(ValueError):
        top_review_text(F.col("customer_reviews"), "neutral")


def test_flat_reviews_agree_with_nested(spark):
    rng = random.Random(4)
    rows = [(rng.randint(0, 4), i, f"t{i}", float(rng.randint(1, 5)), rng.randint(0, 3)) for i in range(300)]
    df = spark.createDataFrame(rows, "product int, pos int, text string, rating double, helpful_votes bigint")
    nested = df.groupBy("product").agg(
        F.sort_array(F.collect_list(F.struct("pos", "text", "rating", "helpful_votes"))).alias("reviews")
    )
    for kind in ("verdict", "pros", "cons"):
        top = top_reviews(df, "product", "helpful_votes", "pos", "rating", kind)
        flat = dict(joined_reviews(top, "product", "text").collect())
        assert flat == dict(nested.select("product", top_review_text(F.col("reviews"), kind)).collect())
