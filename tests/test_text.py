import random
from html.parser import HTMLParser

from pyspark.sql import functions as F

from instructset.functions import prompts as P
from instructset.functions.html import strip_html
from instructset.functions.text import (
    has_text,
    one_line,
    sentence_lines,
    strip,
    text_digest,
    tokens,
    word_count,
    words,
)


def column(spark, values, expression):
    df = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("t"))).collect()]


def test_words_follow_python(spark):
    rng = random.Random(3)
    alphabet = "ab.é \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0    　​﻿"
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 30))) for _ in range(400)]
    assert column(spark, texts, word_count) == [len(t.split()) for t in texts]
    assert column(spark, texts, words) == [t.split() for t in texts]
    assert column(spark, texts, strip) == [t.strip() for t in texts]


def test_small_text_functions(spark):
    assert column(spark, ["a\nb", "\n", "x"], one_line) == ["ab", "", "x"]
    assert column(spark, [" One. Two!  Three? four", ""], sentence_lines) == ["One.\nTwo!\nThree?\nfour", ""]
    assert column(spark, ["", None, " "], has_text) == [False, False, True]
    assert column(spark, ["Don't x1-é!"], tokens) == [["Don", "'", "t", "x1", "-", "é", "!"]]
    a, b = column(spark, ["a" * 10_000, "a" * 10_001], text_digest)
    assert len(a) == 64 and a != b


def test_html_edges(spark):
    cases = {
        "a<b>b</b>c": "a b c",
        "&amp;lt; &lt;b&gt;": "&lt; <b>",
        '<p title="x>y">hi</p>': "hi",
        "a < b > c": "a < b > c",
        "<!-- <script> --> keep <script>var x='</p>';</script> after": "keep after",
        "<STYLE>p{}</STYLE>x<br/>y": "x y",
        "<script>never closed": "",
        "&#146;&#x27;&#65;&eacute;": "’'Aé",
        "<p>&nbsp;</p><p> z </p>": "z",
        "&#0;&#xD800;&#99999999999;": "���",
        "AT&T &unknown; &": "AT&T &unknown &",
        "": "",
    }
    assert column(spark, list(cases), strip_html) == list(cases.values())
    assert column(spark, [None], strip_html) == [None]


class _Visible(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes, self.hidden = [""], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")
        self.nodes.append("")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style")
        self.nodes.append("")

    def handle_comment(self, data):
        self.nodes.append("")

    def handle_data(self, data):
        if not self.hidden:
            self.nodes[-1] += data


def test_html_agrees_with_a_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for row in pages.select("html", strip_html(F.col("html")).alias("text")).collect():
        parser = _Visible()
        parser.feed(row.html)
        parser.close()
        assert row.text == " ".join(n.strip() for n in parser.nodes if n.strip())


def test_prompts(spark):
    df = spark.createDataFrame(
        [("T", None, "red", "b1")], "title string, brand string, color string, bullets string"
    )
    c = F.col
    row = df.select(
        P.product_prompt(c("title"), c("brand"), c("color"), c("bullets")).alias("product"),
        P.instruction_prompt(c("title"), c("brand")).alias("short"),
        P.instruction_prompt(c("title"), c("color")).alias("long"),
        P.question_prompt(c("title"), c("color")).alias("question"),
        P.without_prompt(P.summary_prompt(P.summary_prompt(c("title")))).alias("twice"),
        P.without_prompt(c("title")).alias("missing"),
        P.training_line(c("title"), c("color")).alias("line"),
        P.without_echo(F.concat(P.generation_prompt(c("title")), c("color")), P.generation_prompt(c("title"))).alias("echo"),
        P.training_text(c("title"), c("brand")).alias("null"),
    ).first()
    assert row.product == "Title: T\nBrand: None\nColor: red\nBullet points: b1"
    assert row.short.endswith("### Instruction:\nT\n\n### Response:")
    assert "### Input:\nred\n\n### Response:" in row.long
    assert row.question.endswith("context. \nQuestion: T\nContext: red")
    assert row.twice == "" and row.missing is None and row.null is None
    assert row.line == "T <SEP> red" and row.echo == "red"


def test_mixed_texts(spark):
    rows = [(1, None, " p ", None), (0, "S", " q ", " r ")]
    df = spark.createDataFrame(rows, "m int, s string, p string, r string")
    c = F.col
    args = (c("m"), c("s"), c("p"), c("r"))
    plain, taught = [r[0] for r in df.select(P.mixed_text(*args)).collect()]
    assert plain == "p</s>"
    assert taught.startswith("S\n\nBelow is") and taught.endswith("q\n\n### Response:r</s>")
    asked = df.select(P.mixed_text(*args, prompt_only=True)).collect()[1][0]
    assert asked.endswith("q\n\n### Response:")
