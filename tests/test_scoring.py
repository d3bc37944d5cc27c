import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from instructset.functions import rouge
from instructset.functions.labels import aligned_labels, entity_spans, tuple_labels, tuple_tokens
from instructset.functions import rouge_kernel
from instructset.functions import stem as stems
from instructset.operators import scoring
from tests.plain_stem import stem as plain_stem


def python_spans(labels, strict=False):
    spans, open_ = [], None
    for i, label in enumerate([*labels, "O"]):
        kind = label[2:]
        goes_on = open_ is not None and label[0] == "I" and kind == open_[0]
        if not goes_on:
            if open_ is not None and open_[2]:
                spans.append((open_[0], open_[1], i - 1))
            open_ = None if label == "O" else (kind, i, label[0] == "B" or not strict)
    return spans


@pytest.mark.parametrize("strict", [False, True])
def test_spans_of_random_labels(spark, strict):
    rng = random.Random(6)
    rows = [[rng.choice(["O", "B-A", "I-A", "B-B", "I-B"]) for _ in range(rng.randint(0, 12))] for _ in range(1500)]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, l array<string>")
    for r in df.select("i", entity_spans(F.col("l"), strict).alias("s")).collect():
        found = [] if r.s is None else [tuple(s) for s in r.s]
        assert found == python_spans(rows[r.i], strict), rows[r.i]


PATTERN = re.compile(r"(\w+?,\s+[BI]-\w+|\w+?,\s+O)")


def test_tuples_follow_the_pattern(spark):
    rng = random.Random(7)
    pieces = ["a", "é1", "t-shirt", ", ", ",", " ", "B-X", "I-Yé", "O", "Other", " ", "_", "\n"]
    texts = ["".join(rng.choices(pieces, k=20)) for _ in range(600)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in df.select("i", tuple_tokens(F.col("t")).alias("tok"), tuple_labels(F.col("t")).alias("lab")).collect():
        halves = [[h.strip() for h in found.split(",")] for found in PATTERN.findall(texts[r.i])]
        assert r.tok == [h[0] for h in halves] and r.lab == [h[1] for h in halves], texts[r.i]


def test_mismatched_predictions_become_o(spark):
    df = spark.createDataFrame([(["B-A"], ["B-A", "O"]), (["B-A"], ["I-A"])], "p array<string>, t array<string>")
    rows = [r[0] for r in df.select(aligned_labels(F.col("p"), F.col("t"))).collect()]
    assert rows == [["O", "O"], ["B-A"]]


def brute_report(pairs):
    true = Counter((i, *s) for i, (t, _) in enumerate(pairs) for s in python_spans(t))
    pred = Counter((i, *s) for i, (_, p) in enumerate(pairs) for s in python_spans(p))
    kinds = sorted({s[1] for s in true} | {s[1] for s in pred})
    div = lambda a, b: a / b if b else 0.0
    rows = {}
    for k in kinds:
        hit = sum(1 for s in true if s[1] == k and s in pred)
        n_pred, n_true = (sum(1 for s in side if s[1] == k) for side in (pred, true))
        rows[k] = (div(hit, n_pred), div(hit, n_true), div(2 * hit, n_pred + n_true), n_true)
    hit, n_pred, n_true = sum((true & pred).values()), len(pred), len(true)
    rows["micro avg"] = (div(hit, n_pred), div(hit, n_true), div(2 * hit, n_pred + n_true), n_true)
    rows["macro avg"] = (*(sum(rows[k][i] for k in kinds) / len(kinds) for i in range(3)), n_true)
    rows["weighted avg"] = (*(div(sum(rows[k][i] * rows[k][3] for k in kinds), n_true) for i in range(3)), n_true)
    return rows


def test_entity_report(spark):
    rng = random.Random(8)
    labels = ["O", "B-A", "I-A", "B-B", "I-B"]
    pairs = []
    for _ in range(200):
        true = [rng.choice(labels) for _ in range(10)]
        pairs.append((true, [rng.choice(labels) if rng.random() < 0.3 else t for t in true]))
    pairs.append((["O"], ["B-C"]))
    df = spark.createDataFrame(pairs, "true_labels array<string>, pred_labels array<string>")
    rows = {r.entity: (r.precision, r.recall, r.f1, r.support) for r in scoring.entity_report(df).collect()}
    expected = brute_report(pairs)
    assert rows.keys() == expected.keys()
    for k in rows:
        assert rows[k] == pytest.approx(expected[k])


def table(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t


def path(a, b):
    t, i, j, out = table(a, b), len(a), len(b), []
    while i and j:
        if a[i - 1] == b[j - 1]:
            out.append(i - 1)
            i, j = i - 1, j - 1
        elif t[i][j - 1] > t[i - 1][j]:
            j -= 1
        else:
            i -= 1
    return out[::-1]


def test_common_subsequences():
    rng = random.Random(9)
    for _ in range(500):
        a, b = (rng.choices("abcdef", k=rng.randint(0, 25)) for _ in range(2))
        assert rouge_kernel.lcs_length(a, b) == table(a, b)[-1][-1]
        assert rouge_kernel.lcs_positions(a, b) == path(a, b)


def brute_scores(ref, pred):
    lines = [[re.findall("[a-z0-9]+", line.lower()) for line in text.split("\n")] for text in (ref, pred)]
    a, b = ([t for line in side for t in line] for side in lines)
    f = lambda h, m, n: 2 * h / (m + n) if h else 0.0
    out = []
    for n in (1, 2):
        x, y = (Counter(tuple(s[i : i + n]) for i in range(len(s) - n + 1)) for s in (a, b))
        out.append(f(sum((x & y).values()), sum(x.values()), sum(y.values())))
    out.append(f(table(a, b)[-1][-1], len(a), len(b)))
    left, right, hits = Counter(a), Counter(b), 0
    for line in lines[0]:
        union = sorted(set().union(*(path(line, other) for other in lines[1])))
        for token in (line[i] for i in union):
            if left[token] > 0 and right[token] > 0:
                left[token] -= 1
                right[token] -= 1
                hits += 1
    out.append(f(hits, len(a), len(b)))
    return out


def test_rouge_scores(spark):
    rng = random.Random(10)
    words = ["the", "cat", "sat", "Café", "on", "x1", "mat.", "\n", "!"]
    rows = [(i, *(" ".join(rng.choices(words, k=rng.randint(0, 20))) for _ in range(2))) for i in range(300)]
    rows += [(300, "same text", "same text"), (301, "", "text"), (302, "", "")]
    df = spark.createDataFrame(rows, "id int, output string, model_output string").repartition(3)
    tokenized = scoring.rouge_scores(df).withColumns(
        {"a": rouge.tokens(F.col("output")), "b": rouge.tokens(F.col("model_output"))}
    )
    native = {f"n{n}": rouge.rouge_n(F.col("a"), F.col("b"), n) for n in (1, 2)}
    for r in tokenized.withColumns(native).collect():
        expected = brute_scores(*rows[r.id][1:])
        assert [r.rouge1, r.rouge2, r.rougeL, r.rougeLsum] == pytest.approx(expected), rows[r.id]
        assert [r.n1, r.n2] == pytest.approx(expected[:2])


def test_rouge_reports(spark):
    df = spark.createDataFrame(
        [("The cats were running. They jumped!", "the cat runs. they jump"), ("a", None)],
        "output string, model_output string",
    )
    plain = dict(scoring.rouge_report(df).collect())
    assert plain["rouge1"] == pytest.approx((2 * 2 / 11 + 0) / 2)
    stemmed = dict(scoring.rouge_report(df, stemming=True, sentence_per_line=True, percent=True).collect())
    assert stemmed["rouge1"] == pytest.approx(round(100 * (2 * 5 / 11) / 2, 4))


# Published examples of the algorithm and of its extensions.
STEMS = {
    "caresses": "caress", "ponies": "poni", "ties": "tie", "cats": "cat", "feed": "feed", "agreed": "agre",
    "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing", "conflated": "conflat",
    "troubled": "troubl", "sized": "size", "hopping": "hop", "falling": "fall", "hissing": "hiss",
    "filing": "file", "happy": "happi", "sky": "sky", "enjoy": "enjoy", "relational": "relat",
    "conditional": "condit", "rational": "ration", "valenci": "valenc", "digitizer": "digit",
    "radicalli": "radic", "vietnamization": "vietnam", "operator": "oper", "feudalism": "feudal",
    "decisiveness": "decis", "hopefulness": "hope", "callousness": "callous", "formaliti": "formal",
    "sensibiliti": "sensibl", "triplicate": "triplic", "formative": "form", "electriciti": "electr",
    "goodness": "good", "revival": "reviv", "allowance": "allow", "airliner": "airlin",
    "adjustable": "adjust", "replacement": "replac", "adoption": "adopt", "communism": "commun",
    "effective": "effect", "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control",
    "roll": "roll", "dying": "die", "news": "news", "geologi": "geolog", "spied": "spi", "died": "die",
    "by": "by", "generalizations": "gener", "oscillators": "oscil",
}


def test_stems(spark):
    """Published examples, and many made-up words against a plain version."""
    assert {w: plain_stem(w) for w in STEMS} == STEMS
    rng = random.Random(12)
    ends = [*stems.PLURAL, *stems.DERIVED, *stems.ADJECTIVAL, *stems.RESIDUAL, "ed", "ing", "eed", "ied", "y", "ies",
            "logi", "alli", "e", "ll", "at", "bl", "iz", "tt", "ss", ""]
    words = {*STEMS, *stems.IRREGULAR, *(x + "y" * n + e for x in ("", "a", "b") for n in range(1, 8) for e in ("", "ing"))}
    while len(words) < 6000:
        root = "".join(rng.choices("aeiouybcdlnrstwxyz9", k=rng.randrange(6)))
        words.add(root + "".join(rng.choices(ends, k=rng.randrange(3))) or "a")
    df = spark.createDataFrame([(w,) for w in sorted(words)], "token string")
    assert {r.token: r.stem for r in df.select("token", stems.stem(F.col("token")).alias("stem")).collect()} == {
        w: plain_stem(w) for w in words
    }
    table = {r.token: r.stem for r in stems.stem_table(df.union(df)).collect()}
    assert table == {w: plain_stem(w) for w in words if len(w) > 3 and plain_stem(w) != w}


@pytest.mark.parametrize("most", [10**6, 3])
def test_stemmed_scores_with_and_without_a_table(spark, monkeypatch, most):
    monkeypatch.setattr(rouge, "MOST_STEMS", most)
    rng = random.Random(13)
    words = ["running", "runs", "Run", "happily", "happy", "cats", "cat", "\n", "generalizations", "ponies", "é"]
    rows = [(i, *(" ".join(rng.choices(words, k=rng.randint(0, 15))) for _ in range(2))) for i in range(60)]
    df = spark.createDataFrame([*rows, (60, None, "cats")], "id int, output string, model_output string")
    for r in scoring.rouge_scores(df, stemming=True).collect():
        ref, pred = (re.sub("[a-z0-9]+", lambda m: plain_stem(m[0]) if len(m[0]) > 3 else m[0], (x or "").lower()) for x in (r.output, r.model_output))
        assert [r.rouge1, r.rouge2, r.rougeL, r.rougeLsum] == pytest.approx(brute_scores(ref, pred))


@pytest.mark.parametrize("few, bytes_, words", [(4, 4 << 20, 1 << 22), (1, 2000, 3000), (10**9, 500, 1 << 22)])
def test_hits_of_a_batch_against_pairs(monkeypatch, few, bytes_, words):
    """All ways through the kernel: stepped together, in small passes and tables, and one by one."""
    monkeypatch.setattr(rouge_kernel, "_FEW", few)
    monkeypatch.setattr(rouge_kernel, "PASS_BYTES", bytes_)
    monkeypatch.setattr(rouge_kernel, "TABLE_WORDS", words)
    rng = random.Random(14)
    for sizes in ([0, 1, 3, 10, 30], [0, 2, 70, 150, 300]):
        vocabulary = [rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(8)]
        texts = [["".join(rng.choice(vocabulary) + rng.choice(["  ", " ", "\n", ", ", "é"]) for _ in range(rng.choice(sizes)))
                  for _ in range(25)] + extra for extra in ([None, "", "x"], ["a b", None, "x"])]
        found = rouge_kernel.hits(*(pa.array(t, pa.string()).slice(1) for t in texts), rouge.METRICS)
        for i, (ref, pred) in enumerate(zip(*(t[1:] for t in texts), strict=True)):
            got = [2 * found[m][i] / (found[m + "_left"][i] + found[m + "_right"][i]) if found[m][i] else 0.0 for m in rouge.METRICS]
            assert got == pytest.approx(brute_scores(ref or "", pred or ""))


def test_no_pairs_and_long_texts():
    empty = pa.array([], pa.string())
    assert all(len(v) == 0 for v in rouge_kernel.hits(empty, empty, rouge.METRICS).values())
    long = pa.array(["a b c d\n" * 4000])
    found = rouge_kernel.hits(long, pa.array(["b d " * 3000]), rouge.METRICS)
    assert int(found["rougeL"][0]) == 6000 and int(found["rouge1"][0]) == 2 * 4000 - 2000


def test_prediction_hook(spark):
    def load():
        return lambda prompts: [p + "answer" + p for p in prompts]

    df = spark.createDataFrame([(1, "q", "r")], "id int, input string, output string")
    out = scoring.predict(df, load)
    assert out.columns == ["id", "input", "output", "model_output"]
    assert out.first().model_output == "answer"


def test_profiles_and_counts(spark):
    df = spark.createDataFrame([("a b c", "x"), ("", "x y"), ("q", None)], "i string, o string")
    rows = {r.field: r for r in scoring.word_profile(df, "i", "o").collect()}
    assert (rows["i"].min_words, rows["i"].max_words, rows["i"].median_words) == (0, 3, 1.0)
    assert rows["i"].mean_words == pytest.approx(4 / 3)
    assert scoring.sample_count(df, 2).first().samples == 2
    assert scoring.sample_count(df, None).first().samples == 3
    ids = spark.createDataFrame([([0, 1, 2],), ([1, 0, 0],)], "ids array<int>")
    assert scoring.generated_length(ids, "ids", 0).first().gen_len == 1.5
