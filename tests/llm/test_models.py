"""Language, quality, page text, language models and fingerprints against plain versions of themselves."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from instructset.llm import fingerprint, langid, lmscore, pages, quality, queries

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \n", "12 34!", "a", "é", "x" * 50_000, "same line\n" * 400, "a b c d e f g h i j a b c d e f g h i j"]


def plain_code(contexts, text: bytes) -> float:
    """Code length by one dictionary of counters per context, byte by byte."""
    bits = 0.0
    for i in range(len(text)):
        for k in range(min(i, langid.ORDER), -1, -1):
            seen = contexts.get(text[i - k : i])
            if not seen:
                continue
            total, distinct = sum(seen.values()), len(seen)
            if text[i] in seen:
                bits += math.log2((total + distinct) / seen[text[i]])
                break
            bits += math.log2((total + distinct) / distinct)
        else:
            bits += 8
    return bits


def test_code_lengths_are_those_of_the_trees():
    train = {"aa": ["the cat sat on the mat", "cats", ""], "bb": ["die katze saß auf der matte", "ß"]}
    texts = {n: langid.text_buffer(pa.array(t)) for n, t in train.items()}
    trees = langid.Trees(texts)
    given = ["the mat", "", "der", "zzz", "saßé the", "x"]
    got = trees.bits(*langid.text_buffer(pa.array(given)))
    for j, name in enumerate(trees.languages):
        contexts = defaultdict(Counter)
        for t in train[name]:
            raw = t.encode()
            for i in range(len(raw)):
                for k in range(min(i, langid.ORDER) + 1):
                    contexts[raw[i - k : i]][raw[i]] += 1
        assert np.allclose(got[:, j], [plain_code(contexts, t.encode()) for t in given], atol=1e-3)


def test_held_out_language_accuracy(spark):
    got = queries.QUERIES["op1_language"](spark, FOLDER)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = got.join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_texts(spark, docs_of, folder_of):
    rows = [(i, t, "en") for i, t in enumerate(ODD)] + [(100, "the text", None), (None, "the words of it", "en")]
    got = {r.doc_id: r for r in queries.QUERIES["op1_language"](spark, folder_of(documents=docs_of(rows))).collect()}
    assert [got[i].lang_pred for i in range(4)] == ["und"] * 4 and got[4].lang_pred == "en" and None in got
    assert got[0].score == 0


def test_nothing_to_learn_from(spark, docs_of, folder_of):
    folder = folder_of(documents=docs_of([(0, "some text"), (1, None, "en")]))
    assert {r.lang_pred for r in queries.QUERIES["op1_language"](spark, folder).collect()} == {"und"}


def plain_counts(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_and_verdicts(spark, docs_of, folder_of):
    given = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    rows = given + [(10_000 + i, t) for i, t in enumerate(ODD)] + [(None, "a b c d")]
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    got = queries.QUERIES["op4_quality"](spark, folder_of(documents=docs_of(rows), labels=labels)).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        n_words, *rest = plain_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n_words, *rest)
        assert r.base_failed == (n_words < 10 or 100 * rest[3] > 20 * n_words)
        assert not (r.kept and r.base_failed)
    kept = {r.doc_id: r.kept for r in got if not r.base_failed}
    marks = {r.doc_id: (r.quality, r.toxic) for r in labels.collect()}
    good = [kept[d] for d, m in marks.items() if m == (1, 0) and d in kept]
    bad = [kept[d] for d, m in marks.items() if m[0] == 0 and d in kept]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.2


def test_log_likelihood_ratio(spark, docs_of):
    """Weights and scores by hand, with words in place of hashes."""
    rows = [(0, "good good text"), (1, "good words!"), (2, "bad ** bad"), (3, "bad"), (4, None)]
    labels = spark.createDataFrame([(0, 1, 0), (1, 1, 0), (1, 1, 0), (2, 0, 0), (3, None, 0), (9, 1, 0)], "doc_id long, quality int, toxic int")
    docs = docs_of(rows)
    buckets = 1 << 14
    model = quality.fit(docs, labels, buckets=buckets)

    def features(text):
        t = re.findall(r"\w+|[^\w\s]+", text or "")
        return t + list(zip(t, t[1:]))

    half = spark.range(2).selectExpr("id", "pmod(xxhash64(id, 'half'), 2) AS half").collect()
    both = len({r.half for r in half}) == 1
    teach = [r.id for r in half if both or r.half == 0]
    raw = Counter(f for _, t in rows for f in features(t))
    target = Counter(f for i, t in rows if i in teach for f in features(t))
    n_raw, n_target = sum(raw.values()), sum(target.values())

    def score(text):
        f = features(text)
        w = [math.log((target[x] + 1) / (n_target + buckets)) - math.log((raw[x] + 1) / (n_raw + buckets)) for x in f]
        return sum(w) / len(w) if w else None

    got = {r.doc_id: r._quality for r in quality.judge(docs, model).collect()}
    for i, t in rows:
        assert got[i].score == (pytest.approx(score(t), abs=1e-6) if t else None)
    held = [r.id for r in half if both or r.half == 1]
    assert model.threshold == pytest.approx(min(score(rows[i][1]) for i in held), abs=1e-6)


def test_quality_without_labels_or_rows(spark, docs_of, folder_of):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    folder = folder_of(documents=docs_of(["w " * 3, "a b c d e f g h i j k l"]), labels=none)
    assert [r.kept for r in queries.QUERIES["op4_quality"](spark, folder).orderBy("doc_id").collect()] == [False, True]
    odd = docs_of(["a b c d e f g h i j k l"]).withColumnRenamed("source", "_quality")
    assert quality.judge(odd.drop("_quality"), quality.Model([0.0] * 8, -1.0)).count() == 1
    assert quality.judge(docs_of([]), quality.Model([0.0] * 8, -1.0)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="home menu-open">
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home page of the site</a></li></ul></nav>
<div class="cookie-notice">We use cookies to improve many things for you</div>
<article><h1>The  title</h1><p>First &amp; <b>bold</b> words<br>of the article, long enough &#8212; surely.</p>
<div class="ad-box">Buy this now and here and today</div><script>var x = "</p> not text";</script>
<ul><li>One item in it</li><li>Another <a href="x">linked</a> item</li></ul><!-- no <p>text</p> --><p>Last paragraph of it.</p></article>
<section id="comments"><p>A reader writes that this is a long comment and more.</p></section>
<aside>Read also these pages</aside><footer>&copy; all rights</footer></body></html>"""
TEXT = "The title\n\nFirst & bold words of the article, long enough — surely.\n\nOne item in it\n\nAnother linked item\n\nLast paragraph of it."


def test_main_text(spark, folder_of):
    rows = [(0, "u", PAGE), (1, "u", None), (2, None, ""), (3, "u", "just words"), (4, "u", "<p>open <script>never closed"),
            (5, "u", "<nav>only a menu</nav>"), (6, "u", PAGE.replace("article>", "div>")), (7, "u", "<p>a" * 20_000), (0, "u", PAGE)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    rows_of = queries.QUERIES["op5_main_text"](spark, folder_of(pages=df)).collect()
    assert len(rows_of) == len(rows)
    got = {r.page_id: r.text for r in rows_of}
    assert got[0] == TEXT and got[6] == TEXT
    assert [got[i] for i in (1, 2, 3, 4, 5)] == ["", "", "just words", "open", ""]
    assert got[7] == "\n\n".join(["a"] * 20_000)
    assert all(r.n_chars == len(r.text) for r in rows_of)


def test_best_region_is_the_best_of_all():
    rng = random.Random(1)
    for _ in range(200):
        s = [rng.choice([-3, -1, -0.5, 0, 1, 2]) for _ in range(rng.randrange(12))]
        a, b = pages.best_region(s)
        best = max([0, *(sum(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1))])
        assert sum(s[a:b]) == pytest.approx(best)


def test_no_kind_of_wanted_word_is_lost_after_training():
    """Thousands of like pages without lists, tables or bare text in the article, but with such text around it."""
    p = "<p>Some words of the article that go on for a while here.</p>"
    page = f"<body><ul><li>out of it</li></ul><div>outside</div><table><tr><td>a cell</td></tr></table><nav>{'menu ' * 90}</nav><article>{p * 9}</article><aside>ad</aside></body>"
    one = pages.counted(page)
    weight = pages.weights({k: 5000 * n for k, n in one.items()})
    assert all(w >= 0.5 if k != "word:out" else w == 0 for k, w in weight.items() if k.startswith("word:"))
    assert 4 * weight["word:link"] <= weight["word:text"] + 1e-5
    assert all(w < 0 for k, w in weight.items() if not k.startswith("word:") and k != "out")
    items, cells = [f"item {i} of the list with more words to it" for i in range(4)], [f"cell {i} with words in it" for i in range(4)]
    few, advert = "<p>Only a few words stand here.</p>", f"<aside>{'buy this now ' * 10}</aside>"
    rows = "".join(f"<tr><td>{c}</td></tr>" for c in cells)
    text = pages.main_text(f"<body>{few}{advert}{p}<table>{rows}</table><ul>{''.join(f'<li>{i}</li>' for i in items)}</ul></body>", weight)
    assert text == "\n\n".join([few[3:-4], p[3:-4], *cells, *items])
    bare = "Text that stands straight in a div. " * 3
    assert pages.main_text(f"<body><nav>menu</nav><div>{bare}</div></body>", weight) == bare.strip()


ARTICLE = "<h1>The title</h1><p>Words of the article, enough of them to be most of the page.</p><p>And some more.</p>"
ARTICLE_TEXT = "The title\n\nWords of the article, enough of them to be most of the page.\n\nAnd some more."


@pytest.mark.parametrize("tag", [
    'body style="overflow-x:hidden"', 'div style="overflow:hidden"', 'div class="overflow-hidden"', 'div title="The hidden city"', 'article data-hidden="no"',
    'div class="content has-sidebar"', 'div class="no-comments"', 'div class="search-results"', 'form action="/"', 'div class="page-sidebar"',
])
def test_names_that_do_not_make_an_article_unwanted(tag):
    html = f"<nav>a menu</nav><{tag}>{ARTICLE}</{tag.split()[0]}><footer>the end</footer>"
    assert pages.main_text(html, pages.weights({})) == ARTICLE_TEXT


@pytest.mark.parametrize("tag", [
    "div hidden", 'div hidden=""', 'div aria-hidden="true"', 'div style="color:red; display: none"', 'div class="a-b sidebar"', 'div id="site-footer"',
    'div class="ad-box"', 'div class="related-posts"', 'div class="share-buttons"', 'form action="/search"', 'p class="notice"', 'div role="complementary"',
])
def test_names_that_make_a_part_unwanted(tag):
    html = f"<body>{ARTICLE.replace('<p>And', f'<{tag}>Not this.</{tag.split()[0]}><p>And')}</body>"
    assert pages.main_text(html, pages.weights({})) == ARTICLE_TEXT


def test_long_comments_and_left_out_end_tags():
    comments = f"<section class='comments'>{'<p>A reader writes much more than the page has.</p>' * 20}</section>"
    assert pages.main_text(f"<body>{ARTICLE}{comments}</body>", pages.weights({})) == ARTICLE_TEXT
    assert pages.main_text(f"<body><p class=notice>A notice.{ARTICLE}</body>", pages.weights({})) == ARTICLE_TEXT
    items = "<ul><li class=ad>Buy<li>one item<li>another item</ul>"
    assert pages.main_text(f"<body>{ARTICLE}{items}</body>", pages.weights({})) == ARTICLE_TEXT + "\n\none item\n\nanother item"


LONG = "".join(f"<p>{'Words of the article that go on for a while here. ' * 10}</p>" for _ in range(4))
BESIDE = [
    '<div class="teasers"><h3>Another story</h3><p>Its first words.</p></div>', '<div class="relatedPosts"><p>One of the others we have.</p></div>',
    '<div class="more-stories"><a href="1">First story</a><a href="2">Second story</a><a href="3">Third</a></div>',
    '<table><tr><td><a href="1">Home page</a></td><td><a href="2">News</a></td><td><a href="3">About us</a></td></tr></table>',
    '<section id="discussion"><p>A reader says much about it all.</p></section>', '<div id="thread"><p>A reader says much.</p></div>',
    '<div id="kommentare"><p>Ein Leser schreibt viel dazu.</p></div>', '<div class="werbung">Jetzt kaufen</div>', '<div id="commentList"><p>A reader.</p></div>',
    '<div class="x1"><div class="x2"><a href="y">All about this</a></div><div class="x3">Share</div></div>', "<ul><li><a href=1>a b</a><li><a href=2>c d</a><li><a href=3>e</a></ul>",
]


def test_no_language_is_left_out_of_the_draw(spark, docs_of):
    """Few documents, long ones only, and a share that is less than a document."""
    long = "ein sehr langer Text mit Umlauten wie äöü und ß. " * 30_000
    rows = [(i, "the words of this and that are here with others. " * 40, "en") for i in range(300)]
    rows += [(1000, long, "de"), (1001, "les mots de cette langue sont là et ailleurs. " * 200, "fr"), (1002, None, "xx"), (1003, "", "yy")]
    df = docs_of(rows)
    for size in (6_000_000, 1000, 1):
        trees = langid.train(df, size)
        assert trees.languages == ["de", "en", "fr"]
        assert langid.train(df.repartition(7), size).languages == trees.languages
    asked = docs_of([(0, "ein Text mit Umlauten und langer"), (1, "the words that are here"), (2, "les mots de langue sont ailleurs")])
    assert [r.lang_pred for r in langid.predict(asked, langid.train(df)).orderBy("doc_id").collect()] == ["de", "en", "fr"]
    odd = asked.withColumnsRenamed({"lang": "_letter"})
    assert langid.predict(odd, langid.train(df)).columns == ["doc_id", "text", "_letter", "source", "n_chars", "lang_pred", "score", "bits"]


def trained_weights():
    page = f"<body><nav><ul><li><a href=x>x</a></ul></nav><div>ad</div><article><h1>t</h1>{LONG}</article></body>"
    return pages.weights({k: 3000 * n for k, n in pages.counted(page).items()})


@pytest.mark.parametrize("beside", BESIDE)
@pytest.mark.parametrize("place", ["before", "after", "between"])
@pytest.mark.parametrize("around", ["div", "article"])
def test_what_stands_beside_the_article(beside, place, around):
    """By names in any form, by links, by the place outside the content element, and by the scan."""
    article = f"<{around}>{LONG}</{around}>"
    if place == "between":
        half = len(LONG) // 2
        article = f"<{around}>{LONG[:half]}{beside}{LONG[half:]}</{around}>"
        if "x1" in beside or "<ul>" in beside and around == "article":
            pytest.skip("nothing tells it from a part of the article there")
        if around == "article" and ("more-stories" not in beside and "<a " in beside):
            pytest.skip("links inside of an article are its own")
    body = {"before": beside + article, "after": article + beside, "between": article}[place]
    for weight in (pages.weights({}), trained_weights()):
        got = pages.main_text(f"<body><nav>{'menu ' * 20}</nav>{body}<footer>end</footer></body>", weight)
        assert got == "\n\n".join([("Words of the article that go on for a while here. " * 10).strip()] * 4)


def test_the_scan_itself_leaves_words_out():
    """No names, links or content elements: short runs in divisions cost more than they bring, long ones do not."""
    weight = trained_weights()
    short = "<div><div>Posted in May</div><div>by someone</div></div>"
    text = " ".join(["Text that stands in a division and goes on for quite some time, as articles do."] * 6)
    long = f"<div><div>{text}</div></div>"
    body = f"{short}{long}{short}{long}{short}"
    assert pages.main_text(f"<body>{body}</body>", weight) == f"{text}\n\nPosted in May\n\nby someone\n\n{text}"
    row = list(pages.Page(f"<body>{body}</body>").scored())
    scores = [weight[k] * (1 if t is None else len(t.split())) for k, t, _ in row]
    a, b = pages.best_region(scores)
    assert sum(len(t.split()) for _, t, _ in row[:a] + row[b:] if t) == 10


def test_a_heading_before_the_content_element_stays():
    html = f"<body><div class=top>Site</div><div><h1>The title</h1><p>by line</p><article>{LONG}</article></div><p>after</p></body>"
    text = pages.main_text(html, pages.weights({}))
    assert text.startswith("The title\n\nWords") and "by line" not in text and "after" not in text and "Site" not in text
    # A small article beside the text of the page is a card, not the content.
    assert "card" not in pages.main_text(f"<body>{LONG}<div><article>card</article></div></body>", pages.weights({}))[:200]


def test_many_nested_names_take_linear_time():
    import time

    html = '<div class="sidebar">' * 900 + ARTICLE + "</div>" * 900
    start = time.perf_counter()
    assert pages.main_text(f"<body>{html}</body>", pages.weights({})) == ARTICLE_TEXT
    assert time.perf_counter() - start < 0.1


def test_pages_of_the_tables(spark):
    from html import unescape

    given = {r.page_id: r.html for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    for r in queries.QUERIES["op5_main_text"](spark, FOLDER).collect():
        article = re.search(r"<article>(.*?)</article>", given[r.page_id], re.DOTALL)[1]
        parts = re.split(r"</?(?:p|h1|ul|li)\b[^>]*>", article.replace("<br>", " "))
        want = [" ".join(unescape(re.sub(r"</?b>", "", p)).split()) for p in parts]
        assert r.text == "\n\n".join(p for p in want if p)


@pytest.mark.parametrize("trust", [True, False])
def test_lm_scores_by_every_word_and_pair(spark, docs_of, folder_of, trust):
    """More distinct words and pairs than any fixed bound of before, and repeated ids, against counts by hand."""
    rng = random.Random(3)
    word = lambda: f"w{int(rng.paretovariate(0.5)) % 1000 if rng.random() < 0.5 else rng.randrange(1_000_000)}"
    rows = [(i, " ".join(word() for _ in range(rng.randrange(1, 120)))) for i in range(4000)]
    rows += [(0, rows[0][1]), (0, rows[0][1]), (5, "a b a b a"), (None, "a b"), (9_000, None), (9_001, " ")]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 4000, 7) if trust] + [(1, 0, 0)], "doc_id long, quality int, toxic int")
    got = queries.QUERIES["op6_lm_score"](spark, folder_of(documents=docs_of(rows), labels=labels)).collect()
    seqs = [(i, WORD.findall(t or "")) for i, t in rows]
    models = []
    for ids in (set(range(0, 4000, 7)) if trust else None, None):
        taught = [s for i, s in seqs if ids is None or i in ids]
        one, two = Counter(w for s in taught for w in s), Counter(p for s in taught for p in zip(s, s[1:]))
        models.append((ids, one, two, Counter(p[0] for s in taught for p in zip(s, s[1:]))))
    vocabulary = len(models[1][1])
    assert len(models[1][2]) > 1 << 16 and vocabulary > 1 << 16

    def mean_bits(model, i, s):
        """With the text's own counts taken off, if it taught."""
        ids, one, two, left = model
        mine = ids is None or i in ids
        own = Counter(s), Counter(zip(s, s[1:])), Counter(s[:-1])
        c1, c2, cx = (lambda key, c=c, o=o: c[key] - (o[key] if mine else 0) for c, o in zip((one, two, left), own))
        total = one.total() - (len(s) if mine else 0)
        single = [0.95 * c1(w) / total + 0.05 / (vocabulary + 1) for w in s]
        prob = single[:1]
        for x, y, alone in zip(s, s[1:], single[1:]):
            prob.append(0.6 * c2((x, y)) / cx(x) + 0.4 * alone if cx(x) else alone)
        return -sum(map(math.log2, prob)) / len(s)

    want = [(i or -1, len(s), *((mean_bits(m, i, s) for m in models) if s else (0, 0))) for i, s in seqs]
    have = [(r.doc_id or -1, r.n_tokens, r.target_bits or 0, r.background_bits or 0) for r in got]
    assert np.allclose(sorted(have), sorted(want), atol=1e-6)
    assert all((r.score is None) == (r.n_tokens == 0) for r in got)


def test_lm_of_the_tables_and_of_none(spark, docs_of, folder_of):
    got = queries.QUERIES["op6_lm_score"](spark, FOLDER).join(spark.read.parquet(f"{FOLDER}/labels.parquet"), "doc_id").collect()
    mean = {q: np.mean([r.score for r in got if r.quality == q]) for q in (0, 1)}
    assert mean[1] < mean[0] - 0.3
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert queries.QUERIES["op6_lm_score"](spark, folder_of(documents=docs_of([]), labels=none)).collect() == []


def test_lm_counts_words_and_deals_texts_in_one_job(spark, docs_of):
    """Only the size of the texts is asked for before the scores are; the vocabulary's size comes with the totals."""
    rows = [(i, f"a{i % 3} b{i} c d") for i in range(50)]
    docs = lmscore.with_trust(docs_of(rows), spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int"))
    jobs = {}
    for name, run in (("size", lambda: docs.agg(F.sum(F.octet_length("text"))).collect()), ("scored", lambda: lmscore.scored(docs))):
        spark.sparkContext.setJobGroup(f"lm {name}", name)
        out = run()
        jobs[name] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"lm {name}"))
    assert jobs["scored"] == jobs["size"] > 0
    assert out.count() == 50


def test_every_range_of_words_answers_every_portion():
    keys = np.array([1 << 40, 3 << 40, 7 << 60], np.uint64)
    one = lmscore._packed(0, 4, keys, [[1, 2, 3], [0, 2, 0]], every=True)
    two = lmscore._packed(1, 4, keys[:1], [[5], [1]], every=True)
    none = lmscore._packed(2, 4, keys[:0], [[], []], every=True)
    assert [t.column("range").to_pylist() for t in (one, two, none)] == [[0, 1, 2, 3]] * 3
    assert lmscore._packed(0, 4, keys, [[1, 2, 3], [0, 2, 0]]).column("range").to_pylist() == [0, 1]
    sent = pa.concat_tables([one, two, none])
    sums = {p: [0, 0, 0] for p in range(3)}
    for r in range(4):
        for row in lmscore._added(sent.filter(pc.equal(sent.column("range"), r)), 2).to_pylist():
            sums[row["portion"]] = [x + row[c] for x, c in zip(sums[row["portion"]], ("n", "raw", "target"))]
    assert sums == dict.fromkeys(range(3), [3, 11, 3])


def test_a_trusted_text_is_scored_as_if_it_had_not_taught(spark, docs_of):
    """Its score is the one it gets beside the same others without trust, and a lone text teaches itself nothing."""
    rows = [(i, " ".join(f"w{(i * k) % 7}" for k in range(1, 30))) for i in range(20)]
    labels = "doc_id long, quality int, toxic int"
    both = []
    for ids in ((1, 2, 3, 4), (1, 2, 3)):
        docs = lmscore.with_trust(docs_of(rows), spark.createDataFrame([(i, 1, 0) for i in ids], labels))
        both.append({r.doc_id: r for r in lmscore.scored(docs).collect()})
    assert both[0][4] == both[1][4] and both[0][5] != both[1][5]
    alone = lmscore.scored(lmscore.with_trust(docs_of([(1, "a b a")]), spark.createDataFrame([(1, 1, 0)], labels))).collect()[0]
    assert alone.target_bits == alone.background_bits == pytest.approx(math.log2(3)) and alone.score == 0


@pytest.mark.parametrize("most", [0, 1 << 14])
def test_every_good_row_is_trusted(spark, monkeypatch, most):
    """However many labels there are, all of them count, by bitmaps or by a join."""
    monkeypatch.setattr(lmscore, "MOST_BITMAPS", most)
    ids = spark.range(-40_000, 40_000).select(F.when(F.col("id") != 3, F.col("id")).alias("doc_id"))
    far = spark.createDataFrame([(1 << 62,), (-(1 << 62),)], "doc_id long")
    docs = ids.unionByName(far).withColumn("text", F.lit("a b"))
    labels = docs.where("doc_id % 3 = 0 OR doc_id % 5 = 1 OR doc_id IS NULL").select(
        "doc_id", F.lit(1).alias("quality"), F.when(F.col("doc_id") % 5 == 1, F.lit(1)).alias("toxic")
    )
    labels = labels.unionByName(labels.where("doc_id % 7 = 0"))
    got = lmscore.with_trust(docs, labels).select(
        "trusted", F.coalesce((F.col("doc_id") % 3 == 0) & (F.col("doc_id") % 5 != 1), F.lit(False)).alias("wanted")
    )
    counts = {(r.trusted, r.wanted): r["count"] for r in got.groupBy("trusted", "wanted").count().collect()}
    assert set(counts) == {(True, True), (False, False)} and sum(counts.values()) == 80_002 and counts[True, True] > 20_000


def test_teaching_moves_a_score_by_little(spark):
    """Good rows of the tables that taught and good rows that did not, beside bad ones."""
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    taught = labels.where("quality = 1 AND doc_id % 2 = 0")
    docs = lmscore.with_trust(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"), taught)
    rows = lmscore.scored(docs).join(labels, "doc_id").where("n_tokens > 20").collect()
    mean = {k: np.mean([r.score for r in rows if (r.quality, r.doc_id % 2 == 0 and r.quality == 1) == k]) for k in ((1, True), (1, False), (0, False))}
    assert abs(mean[1, True] - mean[1, False]) < 0.25 * (mean[0, False] - mean[1, False])


def paragraphs(text):
    return {p for p in re.split(r"\n|(?<=[.!?$])[ \t\r]+", text) if p}


def likeness(a, b):
    x, y = paragraphs(a), paragraphs(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def test_fingerprints(spark, docs_of, folder_of):
    given = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    odd = [(1000 + 7 * i, t) for i, t in enumerate(ODD)]
    odd += [(3000, "One. Two. Three. Four."), (3001, "One. Two. Three. Four."), (3002, " ".join(f"S{i}." for i in range(3000)))]
    rows = sorted(given + odd)
    texts = [t or "" for _, t in rows]
    got = {r.doc_id: r for r in queries.QUERIES["op7_fingerprint"](spark, folder_of(documents=docs_of(rows))).collect()}
    assert len(got) == len(rows)
    prints = {}
    for i, (doc, _) in enumerate(rows):
        own, following, r = texts[i], texts[(i + 1) % len(rows)], got[doc]
        half = len(own) // 2
        edited = own[: len(own) - half] + following[:half]
        assert r.n_chars == len(own)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest(), doc
        assert r.near_edited == pytest.approx(likeness(own, edited)) and r.near_next == pytest.approx(likeness(own, following))
        for text, shown in ((own, r.fingerprint), (edited, r.edited_fingerprint)):
            assert prints.setdefault(frozenset(paragraphs(text)), shown) == shown
    assert len(set(prints.values())) == len(prints)


@pytest.mark.parametrize("rows", [[], [(5, "Only. One.")], [(1, "A. B."), (1, "A. C."), (None, "B. C."), (2, None)]])
def test_few_rows(spark, docs_of, folder_of, rows):
    got = queries.QUERIES["op7_fingerprint"](spark, folder_of(documents=docs_of(rows))).collect()
    assert len(got) == len(rows)
    ordered = [t or "" for _, t in sorted(rows, key=lambda r: (r[0] if r[0] is not None else -1, r[1] or ""))]
    want = sorted(likeness(t, ordered[(i + 1) % len(ordered)]) for i, t in enumerate(ordered))
    assert sorted(r.near_next for r in got) == pytest.approx(want)


def test_peeling_without_larger_sketches_gives_up(spark):
    """Two sets of 40 can't be peeled from fifteen cells; four retries resolve them."""
    df = spark.range(30).selectExpr(
        "id", "transform(sequence(0, 40), x -> xxhash64(x, id) & -2L) AS a", "transform(sequence(20, 60), x -> xxhash64(x, id) & -2L) AS b"
    )
    df = df.selectExpr("*", f"{fingerprint.sketch('a')} AS ac", f"{fingerprint.sketch('b')} AS bc")
    assert df.selectExpr(f"{fingerprint._first_try('ac', 'bc')} AS d").where("d IS NOT NULL").isEmpty()
    got = fingerprint.with_likeness(df, "near", "a", "b", "ac", "bc").collect()
    assert all(r.near == pytest.approx(21 / 61) for r in got)


def test_stretches_hold_every_text_and_token_once(monkeypatch):
    monkeypatch.setattr(lmscore, "STRETCH", 5)
    texts = ["a b c", None, "", "d", "e f g h i j k l m", "n o", "", "p q r s t u"]
    rows = {"doc_id": range(len(texts)), "text": texts, "trusted": [i % 2 == 0 for i in range(len(texts))]}
    p = lmscore._Portion(pa.table({**rows, "doc_id": list(rows["doc_id"])}))
    p.name_words()
    parts = list(p.stretches())
    assert len(parts) > 2
    assert [i for s, _, _ in parts for i in range(s.start, s.stop)] == list(range(len(texts)))
    assert [i for _, t, _ in parts for i in range(t.start, t.stop)] == list(range(len(p.word)))
    assert [i for _, _, j in parts for i in range(j.start, j.stop)] == list(range(len(p.inner)))
    for some, tokens, inner in parts:
        assert p.n[some].sum() == tokens.stop - tokens.start
        assert all(tokens.start < x < tokens.stop for x in p.inner[inner])
