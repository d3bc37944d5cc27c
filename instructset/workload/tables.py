"""Queries over whole tables: samples, splits, joins, groups, reports, builders."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import functions as F
from pyspark.sql import types as T

from instructset.functions import arrays
from instructset.functions import prompts as P
from instructset.functions import rouge
from instructset.functions.labels import entity_spans
from instructset.functions.stem import stem_table
from instructset.functions.text import TOKEN, WORD, tokens, word_count
from instructset.operators import batching, dedup, evidence as ev, filters as flt, scoring, selection as sel
from instructset.operators.reviews import joined_reviews, top_reviews
from instructset.operators.vocabulary import build_vocabularies, build_vocabulary, decode, encode
from instructset.plans import assembly, building, evaluation
from instructset.session import materialize, shared_dir
from instructset.sources.readers import read_rungs, spread
from instructset.sources.writers import write_jsonl
from instructset.workload import rouge_sql
from instructset.workload.inputs import (
    ID,
    BAND,
    CHAT,
    EVIDENCE,
    MIXED,
    NL,
    PRODUCTS,
    RECOGNIZED,
    REVIEWS,
    TAGGED,
    TITLED_PAIRS,
    answers,
    chat,
    evidence,
    mixed,
    products,
    recognized,
    reviews,
    sql_rank,
    sql_words,
    tagged,
    titled_pairs,
    turn_id,
)
from instructset.workload.registry import query
from instructset.workload.rows import QUALITY, SQL_HTML, SQL_TUPLE, sql_fill, sql_html, sql_strip

RUNGS = {"20": 20, "50": 50, "100": 100}
TEST, DEV = 30, 30


@query("exact_sample", f"SELECT doc_id, text FROM documents QUALIFY {sql_rank('doc_id', 's')} <= 100")
def _(t):
    return sel.exact_sample(t.documents.select("doc_id", "text"), "doc_id", 100, "s")


def _sql_rungs(table: str, id_col: str, columns: str) -> str:
    return " UNION ALL ".join(
        f"(SELECT '{name}' AS rung, {columns} FROM {table} QUALIFY {sql_rank(id_col, name)} <= {n})"
        for name, n in RUNGS.items()
    )


@query("sample_ladder", _sql_rungs("documents", "doc_id", "doc_id, text"))
def _(t):
    return sel.sample_ladder(t.documents.select("doc_id", "text"), "doc_id", RUNGS)


@query(
    "nested_ladder",
    f"""WITH ranked AS (SELECT doc_id, {sql_rank('doc_id', 'ladder')} AS r FROM documents)
        {" UNION ALL ".join(f"SELECT '{k}' AS rung, doc_id FROM ranked WHERE r <= {n}" for k, n in RUNGS.items())}""",
)
def _(t):
    return sel.sample_ladder(t.documents.select("doc_id"), "doc_id", RUNGS, nested=True)


@query(
    "split_70_10_20",
    f"""WITH {TAGGED}, fit AS (SELECT doc_id FROM tagged WHERE len(words) = len(tag)),
        ranked AS (SELECT doc_id, {sql_rank('doc_id', 'split')} AS r, count(*) OVER () AS n FROM fit)
        SELECT doc_id, CASE WHEN r <= floor(n * 0.7::DOUBLE) THEN 'train'
            WHEN r <= floor(n * 0.8::DOUBLE) THEN 'dev' ELSE 'test' END AS split FROM ranked""",
)
def _(t):
    return building.build_tagged_splits(tagged(t), "doc_id", "text", "tag").select("doc_id", "split")


@query(
    "train_valid_split",
    f"""SELECT doc_id, CASE WHEN {sql_rank('doc_id', 'validation')}
        <= ceil(count(*) OVER () * 0.001::DOUBLE) THEN 'validation' ELSE 'train' END AS split FROM documents""",
)
def _(t):
    return sel.train_validation_split(t.documents.select("doc_id"), "doc_id")


@query(
    "early_stop",
    f"""WITH kept AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) AS kept_no
            FROM documents WHERE lang = 'en'),
        stop AS (SELECT min(doc_id) AS last FROM kept WHERE doc_id > 60 AND kept_no >= 50)
        SELECT doc_id, text FROM kept, stop WHERE last IS NULL OR doc_id <= last""",
)
def _(t):
    return sel.early_stop(
        t.documents.select("doc_id", "text", "lang"), "doc_id", F.col("lang") == "en", 60, 50
    ).drop("lang")


@query("shuffle_order", f"SELECT doc_id, {sql_rank('doc_id', 'shuffle')} AS shuffle_rank FROM documents")
def _(t):
    return sel.shuffle_rows(t.documents.select("doc_id"), "doc_id")


@query(
    "preview",
    f"SELECT doc_id, text FROM documents QUALIFY {sql_rank('doc_id', 'preview')} <= 2",
)
def _(t):
    return sel.preview(t.documents.select("doc_id", "text"), "doc_id")


@query(
    "first_seen_title",
    """SELECT p_name, p_partkey, p_brand FROM part
        QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) = 1""",
)
def _(t):
    return dedup.first_seen(t.part.select("p_name", "p_partkey", "p_brand"), "p_name", ["p_partkey"])


@query(
    "used_outputs",
    f"WITH {TITLED_PAIRS} SELECT DISTINCT sha256(output) AS digest FROM pairs",
)
def _(t):
    return dedup.used_texts(titled_pairs(t)).withColumnRenamed("_digest", "digest")


SPLITS = f"""{TITLED_PAIRS},
    drawn AS ({" UNION ALL ".join(f"(SELECT 'train_{k}' AS split, pos, output FROM pairs QUALIFY {sql_rank('pos', k)} <= {n})" for k, n in RUNGS.items())}),
    pool AS (SELECT pos, output FROM pairs WHERE output NOT IN (SELECT output FROM drawn)),
    test AS (SELECT 'test' AS split, pos, output FROM pool QUALIFY {sql_rank('pos', 'test')} <= {TEST}),
    pool2 AS (SELECT pos, output FROM pairs WHERE output NOT IN
        (SELECT output FROM drawn UNION SELECT output FROM test)),
    dev AS (SELECT 'dev' AS split, pos, output FROM pool2 QUALIFY {sql_rank('pos', 'dev')} <= {DEV})"""


@query("heldout_pool", f"WITH {SPLITS} SELECT pos, output FROM pool")
def _(t):
    pairs = titled_pairs(t).select("pos", "output")
    rungs = sel.sample_ladder(pairs, "pos", RUNGS)
    return dedup.held_out(pairs, rungs, max_used=sum(RUNGS.values()))


@query("heldout_pool_2", f"WITH {SPLITS} SELECT pos, output FROM pool2")
def _(t):
    pairs = titled_pairs(t).select("pos", "output")
    rungs = sel.sample_ladder(pairs, "pos", RUNGS).select("pos", "output")
    total = sum(RUNGS.values())
    test = sel.exact_sample(dedup.held_out(pairs, rungs, max_used=total), "pos", TEST, "test")
    return dedup.held_out(pairs, rungs.unionByName(test), max_used=total + TEST)


SPLIT_ROWS = f"""{SPLITS}, rows AS (
    SELECT s.split, p.pos, p.input, p.output FROM
        (SELECT split, pos FROM drawn UNION ALL SELECT split, pos FROM test
         UNION ALL SELECT split, pos FROM dev) s JOIN pairs p USING (pos))"""


def _title_splits(t):
    pairs = materialize(titled_pairs(t), "pairs")
    return building.ladder_with_held_out(pairs, "pos", RUNGS, TEST, DEV).select(
        "split", "pos", "input", "output"
    )


@query("title_split_build", f"WITH {SPLIT_ROWS} SELECT * FROM rows")
def _(t):
    return _title_splits(t)


@query(
    "leak_check",
    f"""WITH {SPLIT_ROWS} SELECT
        count(DISTINCT CASE WHEN split = 'test' AND output IN (SELECT output FROM rows WHERE split LIKE 'train%') THEN output END) AS test_in_train,
        count(DISTINCT CASE WHEN split = 'dev' AND output IN (SELECT output FROM rows WHERE split <> 'dev') THEN output END) AS dev_in_rest
        FROM rows""",
)
def _(t):
    rows = _title_splits(t)
    is_test, is_dev = F.col("split") == "test", F.col("split") == "dev"
    first = dedup.overlap(rows.filter(is_test), rows.filter(~is_test & ~is_dev))
    second = dedup.overlap(rows.filter(is_dev), rows.filter(~is_dev))
    return first.select(
        F.col("shared").alias("test_in_train"), second.scalar().alias("dev_in_rest")
    )


PAGE_PAIRS = f"""described AS (
        SELECT page_id AS pos, replace(regexp_replace(url, '^https?://', ''), '/', ' ') AS title,
            html AS description FROM pages),
    pairs AS (SELECT pos, title AS input, text AS output FROM described
        JOIN (SELECT page_id AS pos, {SQL_HTML} AS text FROM pages) USING (pos) WHERE {BAND})"""


def page_products(t):
    return spread(t.pages.select("page_id", "url", "html"), "page_id").select(
        F.col("page_id").alias("pos"),
        F.replace(F.regexp_replace("url", "^https?://", ""), F.lit("/"), F.lit(" ")).alias("title"),
        F.array("html").alias("description"),
    )


PAGE_RUNGS, PAGE_HELD = {"5": 5, "10": 10}, 5


def page_splits(t):
    return building.build_descriptions(page_products(t), "pos", PAGE_RUNGS, PAGE_HELD, PAGE_HELD)


@query(
    "title_desc_build",
    f"""WITH {PAGE_PAIRS},
    drawn AS ({" UNION ALL ".join(f"(SELECT 'train_{k}' AS split, pos, input, output FROM pairs QUALIFY {sql_rank('pos', k)} <= {n})" for k, n in PAGE_RUNGS.items())}),
    pool AS (SELECT * FROM pairs WHERE output NOT IN (SELECT output FROM drawn)),
    test AS (SELECT 'test' AS split, pos, input, output FROM pool QUALIFY {sql_rank('pos', 'test')} <= {PAGE_HELD}),
    pool2 AS (SELECT * FROM pool WHERE output NOT IN (SELECT output FROM test)),
    dev AS (SELECT 'dev' AS split, pos, input, output FROM pool2 QUALIFY {sql_rank('pos', 'dev')} <= {PAGE_HELD})
    SELECT * FROM drawn UNION ALL SELECT * FROM test UNION ALL SELECT * FROM dev""",
)
def _(t):
    return page_splits(t)


@query(
    "description_pairs",
    f"WITH {PAGE_PAIRS} SELECT pos, input, output FROM pairs",
)
def _(t):
    return building.description_pairs(page_products(t))


@query(
    "resplit_build",
    f"""WITH {SPLITS},
    extra AS (SELECT pos FROM pool2 QUALIFY {sql_rank('pos', 'extra')} <= 60)
    SELECT s.split, p.pos, p.input, p.output FROM (
        SELECT split, pos FROM drawn UNION ALL SELECT split, pos FROM test
        UNION ALL SELECT 'train_160', pos FROM drawn WHERE split = 'train_100'
        UNION ALL SELECT 'train_160', pos FROM extra) s JOIN pairs p USING (pos)""",
)
def _(t):
    return building.resplit(
        materialize(titled_pairs(t), "pairs"), "pos", RUNGS, TEST, extra=60, extend="100", extended="160"
    ).select("split", "pos", "input", "output")


@query(
    "summary_ladder",
    f"""WITH {CHAT}, pairs AS (SELECT id, CASE WHEN length(prompt) % 10 = 0 THEN 'test'
            WHEN length(prompt) % 10 = 1 THEN 'valid' ELSE 'train' END AS split, prompt AS input, response AS output FROM chat),
        train AS (SELECT * FROM pairs WHERE split = 'train')
        SELECT id, CASE split WHEN 'valid' THEN 'dev' ELSE split END AS split, input, output FROM pairs
        UNION ALL SELECT id, 'train_10', input, output FROM train QUALIFY {sql_rank('id', '10')} <= 10
        UNION ALL SELECT id, 'train_20', input, output FROM train QUALIFY {sql_rank('id', '20')} <= 20""",
)
def _(t):
    part = F.length("prompt") % 10
    pairs = chat(t).select(
        "id",
        F.when(part == 0, F.lit("test")).when(part == 1, F.lit("valid")).otherwise(F.lit("train")).alias("split"),
        F.col("prompt").alias("input"),
        F.col("response").alias("output"),
    )
    return building.build_summary_ladder(pairs, "id", {"10": 10, "20": 20})


@query(
    "product_description_build",
    f"""WITH {PRODUCTS}, firsts AS (
        SELECT *, row_number() OVER (PARTITION BY product_title ORDER BY split_rank, pos) AS seen
        FROM products WHERE product_locale = 'us' AND length(product_description) > 0)
        SELECT split, pos, {sql_words("product_title")} AS title_words FROM firsts WHERE seen = 1 AND {QUALITY}""",
)
def _(t):
    # The title is not cleaned here, so that SQL can tell the same rows.
    described = products(t).filter(
        flt.described_in_locale(F.col("product_locale"), F.col("product_description"))
    )
    parts = (F.col(f"product_{c}") for c in ("title", "description", "bullet_point"))
    return (
        dedup.first_seen(described, "product_title", ["split_rank", "pos"])
        .filter(flt.product_quality(*parts))
        .select("split", "pos", word_count(F.col("product_title")).alias("title_words"))
    )


@query(
    "product_pairs_build",
    f"""WITH {PRODUCTS}, firsts AS (
        SELECT *, row_number() OVER (PARTITION BY product_title ORDER BY split_rank, pos) AS seen
        FROM products WHERE product_locale = 'us' AND length(product_description) > 0)
        SELECT split, 'Title: ' || {sql_html("product_title")} || chr(10) || 'Brand: ' || coalesce(product_brand, 'None')
            || chr(10) || 'Color: ' || coalesce(product_color, 'None') || chr(10) || 'Bullet points: '
            || {sql_html("product_bullet_point")} AS input, {sql_html("product_description")} AS output
        FROM firsts WHERE seen = 1 AND {QUALITY}""",
)
def _(t):
    return building.build_product_descriptions(products(t))


@query(
    "evidence_join",
    f"""WITH {EVIDENCE}, placed AS (
        SELECT *, (row_number() OVER (PARTITION BY ASIN, question ORDER BY source_rank, pos, candidate) - 1) // {ev.PART_ROWS} AS part
        FROM evidence WHERE candidate IS NOT NULL), pooled AS (
        SELECT ASIN, question, part, string_agg(candidate, {NL} ORDER BY source_rank, pos, candidate) AS context
        FROM placed GROUP BY 1, 2, 3)
        SELECT ASIN, question, part, context, answer FROM answers JOIN pooled USING (ASIN, question)""",
)
def _(t):
    keys = ["ASIN", "question"]
    pooled = ev.pooled_evidence(evidence(t), keys, ["source_rank", "pos"], "candidate")
    return ev.answers_with_evidence(answers(t), pooled, keys).select(
        *keys, "part", F.array_join("evidence", "\n").alias("context"), "answer"
    )


@query(
    "question_answer_build",
    f"""WITH {EVIDENCE}, placed AS (
        SELECT *, (row_number() OVER (PARTITION BY ASIN, question ORDER BY source_rank, pos, candidate) - 1) // {ev.PART_ROWS} AS part
        FROM evidence WHERE candidate IS NOT NULL), pooled AS (
        SELECT ASIN, question, part, string_agg(candidate, {NL} ORDER BY source_rank, pos, candidate) AS context
        FROM placed GROUP BY 1, 2, 3)
        SELECT split, part, CASE WHEN part = 0 THEN
            {sql_fill(P.QUESTION_PROMPT + chr(10) + "Question: %s" + chr(10) + "Context: %s", "question", "context")}
            ELSE {NL} || context END AS input, answer AS output FROM answers JOIN pooled USING (ASIN, question)""",
)
def _(t):
    return building.build_question_answers(answers(t), evidence(t))


SMALL_PART = 4


@query(
    "evidence_parts",
    f"""WITH {EVIDENCE}, placed AS (
        SELECT *, (row_number() OVER (PARTITION BY ASIN ORDER BY source_rank, pos, candidate) - 1) // {SMALL_PART} AS part
        FROM evidence WHERE candidate IS NOT NULL)
        SELECT ASIN, part, string_agg(candidate, {NL} ORDER BY source_rank, pos, candidate) AS context
        FROM placed GROUP BY 1, 2""",
)
def _(t):
    pooled = ev.pooled_evidence(evidence(t), ["ASIN"], ["source_rank", "pos"], "candidate", SMALL_PART)
    return pooled.select("ASIN", "part", F.array_join("evidence", "\n").alias("context"))


@query(
    "prediction_join",
    f"""WITH {CHAT}, predictions AS (SELECT {ID} - 1 AS id, 'Answer: ' || text AS model_output FROM conversations WHERE role = 'assistant')
        SELECT id, prompt, response, model_output FROM chat JOIN predictions USING (id)""",
)
def _(t):
    predictions = t.conversations.filter(F.col("role") == "assistant").select(
        (turn_id() - 1).alias("id"), F.concat(F.lit("Answer: "), "text").alias("model_output")
    )
    return scoring.with_predictions(chat(t).drop("conv_id"), predictions, "id")


@query(
    "split_counts",
    f"WITH {PRODUCTS} SELECT product_locale AS task, split, count(*) AS n FROM products GROUP BY 1, 2",
)
def _(t):
    return scoring.split_counts(products(t).withColumnRenamed("product_locale", "task"), "task", "split")


@query(
    "word_profile",
    f"""WITH {CHAT}, sizes AS (
        SELECT 'prompt' AS field, {sql_words("prompt")} AS n FROM chat
        UNION ALL SELECT 'response', {sql_words("response")} FROM chat)
        SELECT field, count(*) AS rows, min(n) AS min_words, max(n) AS max_words,
            round(avg(n), 6) AS mean_words, round(quantile_cont(n, 0.5), 6) AS median_words
        FROM sizes GROUP BY 1""",
)
def _(t):
    return scoring.word_profile(chat(t), "prompt", "response").withColumns(
        {c: F.round(c, 6) for c in ("mean_words", "median_words")}
    )


VOCABULARY = f"""counts AS (
        SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '{TOKEN}')) AS token FROM documents)
        GROUP BY 1),
    vocabulary AS (SELECT token, (row_number() OVER (ORDER BY n DESC, token) + 2)::BIGINT AS token_id, n FROM counts)"""


def _documents(t):
    return spread(t.documents.select("doc_id", "text"), "doc_id")


@query("vocabulary", f"WITH {VOCABULARY} SELECT token, token_id, n FROM vocabulary")
def _(t):
    table = build_vocabulary(_documents(t), "text").table
    return table.withColumn("token_id", F.col("token_id").cast("bigint"))


ENCODED = f"""{VOCABULARY}, spread AS (
        SELECT doc_id, unnest(toks) AS token, unnest(range(1, len(toks) + 1)) AS place
        FROM (SELECT doc_id, regexp_extract_all(text, '{TOKEN}') AS toks FROM documents)),
    encoded AS (
        SELECT doc_id, list(token_id ORDER BY place) AS ids FROM spread JOIN vocabulary USING (token)
        GROUP BY doc_id
        UNION ALL SELECT doc_id, []::BIGINT[] FROM documents
            WHERE len(regexp_extract_all(text, '{TOKEN}')) = 0)"""


def _encoded(t):
    docs = _documents(t)
    vocabulary = build_vocabulary(docs, "text")
    rows = docs.select("doc_id", tokens(F.col("text")).alias("tokens"))
    return vocabulary, encode(rows, "doc_id", "tokens", vocabulary, "ids", keep=False)


def _text(ids):
    return F.array_join(ids.cast("array<string>"), " ")


@query(
    "encode_mask",
    f"""WITH {ENCODED} SELECT doc_id, array_to_string(ids, ' ') AS input_ids,
        array_to_string(list_transform(ids, lambda x, i: CASE WHEN i <= 5 THEN -100 ELSE x END), ' ') AS labels
        FROM encoded""",
)
def _(t):
    _, coded = _encoded(t)
    return coded.select(
        "doc_id",
        _text(F.col("ids")).alias("input_ids"),
        _text(arrays.mask_prompt(F.col("ids"), F.lit(5))).alias("labels"),
    )


@query(
    "truncate",
    f"WITH {ENCODED} SELECT doc_id, array_to_string(ids[1:512], ' ') AS input_ids FROM encoded",
)
def _(t):
    _, coded = _encoded(t)
    return coded.select("doc_id", _text(arrays.truncate(F.col("ids"), 512)).alias("input_ids"))


@query(
    "max_length_filter",
    f"WITH {ENCODED} SELECT doc_id, len(ids)::BIGINT AS n FROM encoded WHERE len(ids) <= 512",
)
def _(t):
    _, coded = _encoded(t)
    return coded.filter(flt.within_length(F.col("ids"), 512)).select(
        "doc_id", F.size("ids").cast("bigint").alias("n")
    )


@query(
    "decode_text",
    f"SELECT doc_id, array_to_string(regexp_extract_all(text, '{TOKEN}'), ' ') AS text FROM documents",
)
def _(t):
    vocabulary, coded = _encoded(t)
    return decode(coded, "doc_id", "ids", vocabulary, keep=False).select("doc_id", "text")


@query(
    "fixed_padding",
    f"""WITH {ENCODED}, cut AS (SELECT doc_id, ids[1:128] AS ids FROM encoded)
        SELECT doc_id, array_to_string(ids || list_transform(range(0, 128 - len(ids)), lambda x: -100), ' ')
            AS labels FROM cut""",
)
def _(t):
    _, coded = _encoded(t)
    padded = arrays.pad_to(arrays.truncate(F.col("ids"), 128), F.lit(128), 0)
    return coded.select("doc_id", _text(arrays.ignore_padding(padded, 0)).alias("labels"))


@query(
    "unmask",
    f"""WITH {ENCODED} SELECT doc_id, array_to_string(list_transform(ids,
        lambda x, i: CASE WHEN i <= 5 THEN 0 ELSE x END), ' ') AS ids FROM encoded""",
)
def _(t):
    _, coded = _encoded(t)
    masked = arrays.mask_prompt(F.col("ids"), F.lit(5))
    return coded.select("doc_id", _text(arrays.restore_padding(masked, 0)).alias("ids"))


@query(
    "gen_len",
    f"""WITH {ENCODED} SELECT round(avg(len(list_filter(ids, lambda x: x <> 3))), 6) AS gen_len FROM encoded""",
)
def _(t):
    # Id 3, the most frequent token, stands for padding.
    _, coded = _encoded(t)
    return scoring.generated_length(coded, "ids", 3).select(F.round("gen_len", 6).alias("gen_len"))


@query("sample_metric", "SELECT least(500, count(*)) AS samples FROM documents")
def _(t):
    return scoring.sample_count(t.documents, 500)


SIZED = f"""sized AS (SELECT doc_id, len(regexp_extract_all(text, '{TOKEN}')) AS n FROM documents),
    shuffled AS (SELECT doc_id, n, floor(({sql_rank('doc_id', 'batches')} - 1) / 400)::BIGINT AS g FROM sized),
    placed AS (SELECT doc_id, n, g * 400 + row_number() OVER (PARTITION BY g ORDER BY n DESC, doc_id) - 1 AS place
        FROM shuffled)"""


def _sized(t):
    return _documents(t).select("doc_id", tokens(F.col("text")).alias("tokens"))


@query(
    "length_batches",
    f"WITH {SIZED} SELECT doc_id, floor(place / 8)::BIGINT AS batch_id, (place % 8)::BIGINT AS slot FROM placed",
)
def _(t):
    sized = _sized(t).select("doc_id", F.size("tokens").alias("n"))
    return batching.length_batches(sized, "doc_id", F.col("n"), 8).select(
        "doc_id", "batch_id", F.col("slot").cast("bigint").alias("slot")
    )


@query(
    "pad_batch",
    f"""WITH {ENCODED}, {SIZED}, dealt AS (
        SELECT floor(place / 8)::BIGINT AS batch_id, place, n, ids, max(n) OVER (PARTITION BY floor(place / 8)) AS width
        FROM placed JOIN encoded USING (doc_id))
        SELECT batch_id, count(*) AS rows, max(n) AS width, sum(n)::BIGINT AS filled,
            string_agg(array_to_string(ids || list_resize([]::BIGINT[], width - n, 0), ' '), ';' ORDER BY place) AS input_ids
        FROM dealt GROUP BY 1""",
)
def _(t):
    _, coded = _encoded(t)
    # Ranks are counted before they are given, which would encode twice; labels are made where the rows end up.
    rows = materialize(coded.select("doc_id", F.col("ids").alias("input_ids")), "coded")
    dealt = batching.length_batches(rows, "doc_id", F.size("input_ids"), 8)
    batches = batching.padded_batches(
        dealt.withColumn("labels", arrays.mask_prompt(F.col("input_ids"), F.lit(5))), pad=0
    )
    return batches.select(
        "batch_id",
        F.size("input_ids").cast("bigint").alias("rows"),
        F.size(F.get("input_ids", F.lit(0))).cast("bigint").alias("width"),
        F.size(F.filter(F.flatten("attention_mask"), lambda m: m)).cast("bigint").alias("filled"),
        F.array_join(F.transform("input_ids", lambda row: F.array_join(row, " ")), ";").alias("input_ids"),
    )


@query(
    "concat_tasks",
    """SELECT 'documents' AS task, doc_id AS id, text FROM documents
        UNION ALL SELECT 'benchmark', item_id, text FROM benchmark""",
)
def _(t):
    first = t.documents.select(F.lit("documents").alias("task"), F.col("doc_id").alias("id"), "text")
    return first.unionByName(
        t.benchmark.select(F.lit("benchmark").alias("task"), F.col("item_id").alias("id"), "text")
    )


def _reviews_sql(kind: str) -> str:
    where = {"verdict": "true", "pros": "rating > 3", "cons": "rating < 3"}[kind]
    return f"""WITH {REVIEWS}, ranked AS (SELECT product, text, row_number() OVER (
            PARTITION BY product ORDER BY helpful_votes DESC, pos) AS rank FROM reviews WHERE {where})
        SELECT product, string_agg(text, {NL} ORDER BY rank) AS reviews FROM ranked
        WHERE rank <= 4 GROUP BY 1"""


def _reviews(kind: str):
    return lambda t: joined_reviews(
        top_reviews(reviews(t), "product", "helpful_votes", "pos", "rating", kind), "product", "text"
    )


for _name, _kind in (("top4_reviews", "verdict"), ("top4_positive", "pros"), ("top4_negative", "cons")):
    query(_name, _reviews_sql(_kind))(_reviews(_kind))


LABELED = f"""{RECOGNIZED}, found AS (
        SELECT doc_id,
            list_transform(regexp_extract_all(output, '{SQL_TUPLE}'), lambda x: {sql_strip("split_part(x, ',', 2)")}) AS gold,
            list_transform(regexp_extract_all(model_output, '{SQL_TUPLE}'), lambda x: {sql_strip("split_part(x, ',', 2)")}) AS pred
        FROM recognized),
    labeled AS (SELECT doc_id, gold, CASE WHEN len(pred) = len(gold) THEN pred
            ELSE list_transform(gold, lambda x: 'O') END AS pred FROM found)"""


def _spans_sql(side: str) -> str:
    return f"""{side}_rows AS (SELECT doc_id, unnest({side}) AS l, unnest(range(0, len({side}))) AS place FROM labeled),
    {side}_typed AS (SELECT doc_id, place, l[1] AS t, CASE WHEN l <> 'O' THEN l[3:] END AS y FROM {side}_rows),
    {side}_before AS (SELECT *, coalesce(lag(t) OVER w, 'O') AS pt, lag(y) OVER w AS py FROM {side}_typed
        WINDOW w AS (PARTITION BY doc_id ORDER BY place)),
    {side}_starts AS (SELECT *, (t = 'B' OR (t = 'I' AND (pt = 'O' OR y IS DISTINCT FROM py)))::INT AS s FROM {side}_before),
    {side}_groups AS (SELECT *, sum(s) OVER (PARTITION BY doc_id ORDER BY place) AS g FROM {side}_starts),
    {side}_spans AS (SELECT doc_id, y AS type, min(place)::BIGINT AS begin, max(place)::BIGINT AS "end" FROM {side}_groups
        WHERE t <> 'O' GROUP BY doc_id, g, y)"""


@query("bio_spans", f'WITH {LABELED}, {_spans_sql("gold")} SELECT doc_id, type, begin, "end" FROM gold_spans')
def _(t):
    labeled = scoring.label_pairs(recognized(t))
    return labeled.select("doc_id", F.inline(entity_spans(F.col("true_labels")))).select(
        "doc_id", "type", F.col("begin").cast("bigint"), F.col("end").cast("bigint")
    )


@query(
    "ner_report",
    f"""WITH {LABELED}, {_spans_sql("gold")}, {_spans_sql("pred")},
    counts AS (SELECT type, sum(hit) AS hit, sum(predicted) AS predicted, sum(support) AS support FROM (
        SELECT coalesce(a.type, b.type) AS type, (a.type IS NOT NULL AND b.type IS NOT NULL)::INT AS hit,
            (b.type IS NOT NULL)::INT AS predicted, (a.type IS NOT NULL)::INT AS support
        FROM gold_spans a FULL JOIN pred_spans b
            ON a.doc_id = b.doc_id AND a.type = b.type AND a.begin = b.begin AND a."end" = b."end") GROUP BY 1),
    rates AS (SELECT type, hit, predicted, support,
        coalesce(hit / nullif(predicted, 0), 0) AS p, coalesce(hit / nullif(support, 0), 0) AS r,
        coalesce(2 * hit / nullif(predicted + support, 0), 0) AS f FROM counts),
    report AS (
        SELECT 'entity' AS kind, type AS entity, p, r, f, support FROM rates
        UNION ALL SELECT 'micro', 'micro avg', sum(hit) / sum(predicted), sum(hit) / sum(support),
            2 * sum(hit) / (sum(predicted) + sum(support)), sum(support) FROM rates
        UNION ALL SELECT 'macro', 'macro avg', avg(p), avg(r), avg(f), sum(support) FROM rates
        UNION ALL SELECT 'weighted', 'weighted avg', sum(p * support) / sum(support),
            sum(r * support) / sum(support), sum(f * support) / sum(support), sum(support) FROM rates)
    SELECT kind, entity, round(p, 6) AS "precision", round(r, 6) AS recall, round(f, 6) AS f1,
        support::BIGINT AS support FROM report""",
)
def _(t):
    report = scoring.entity_report(scoring.label_pairs(recognized(t)))
    return report.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


def _rouge_sql(n: int) -> str:
    grams = (
        "regexp_extract_all(lower({c}), '[a-z0-9]+')"
        if n == 1
        else "list_transform(range(1, greatest(len(regexp_extract_all(lower({c}), '[a-z0-9]+')), 1)), lambda i: "
        "regexp_extract_all(lower({c}), '[a-z0-9]+')[i] || ' ' || regexp_extract_all(lower({c}), '[a-z0-9]+')[i + 1])"
    )
    return f"""WITH {CHAT}, grams AS (SELECT id, {grams.format(c="prompt")} AS a, {grams.format(c="response")} AS b FROM chat),
        a AS (SELECT id, g, count(*) AS n FROM (SELECT id, unnest(a) AS g FROM grams) GROUP BY 1, 2),
        b AS (SELECT id, g, count(*) AS n FROM (SELECT id, unnest(b) AS g FROM grams) GROUP BY 1, 2),
        hits AS (SELECT id, sum(least(a.n, b.n)) AS h FROM a JOIN b USING (id, g) GROUP BY 1)
        SELECT id, round(CASE WHEN coalesce(h, 0) > 0 THEN 2.0 * h / (len(a) + len(b)) ELSE 0.0 END::DOUBLE, 6) AS f
        FROM grams LEFT JOIN hits USING (id)"""


def _rouge(n: int):
    def build(t):
        pairs = spread(chat(t), "id").select(
            "id", rouge.tokens(F.col("prompt")).alias("a"), rouge.tokens(F.col("response")).alias("b")
        )
        return pairs.select("id", F.round(rouge.rouge_n(F.col("a"), F.col("b"), n), 6).alias("f"))

    return build


query("rouge1", _rouge_sql(1))(_rouge(1))
query("rouge2", _rouge_sql(2))(_rouge(2))


# The longest common subsequence row by row: a cell is the best of the cells above and
# left of it, where a match adds one to the cell diagonally before.
ROUGE_L = f"""WITH {CHAT}, toks AS (
        SELECT id, regexp_extract_all(lower(prompt), '[a-z0-9]+') AS a,
            regexp_extract_all(lower(response), '[a-z0-9]+') AS b FROM chat),
    matched AS (SELECT id, a, b, list_transform(a, lambda x: list_transform(b, lambda y: (x = y)::INT)) AS m FROM toks),
    longest AS (SELECT id, len(a) + len(b) AS n, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE
        list_max(list_reduce(list_prepend(list_transform(b, lambda y: 0), m), lambda above, match:
            list_transform(range(1, len(match) + 1), lambda j:
                list_max(list_transform(range(1, j + 1), lambda k: CASE WHEN match[k] = 1
                    THEN coalesce(above[k - 1], 0) + 1 ELSE above[k] END))::INT))) END AS h FROM matched)
    SELECT id, round(CASE WHEN h > 0 THEN 2.0 * h / n ELSE 0.0 END::DOUBLE, 6) AS "rougeL" FROM longest"""


@query("rouge_l", ROUGE_L)
def _(t):
    scored = scoring.rouge_scores(spread(chat(t), "id"), "prompt", "response", metrics=["rougeL"])
    return scored.select("id", F.round("rougeL", 6).alias("rougeL"))


CHAT_TEXTS = f"{CHAT}, texts AS (SELECT id, prompt AS a, response AS b FROM chat)"
CHAT_SENTENCES = f"""{CHAT}, texts AS (SELECT id, {rouge_sql.sentence_lines("prompt", sql_strip)} AS a,
    {rouge_sql.sentence_lines("response", sql_strip)} AS b FROM chat)"""


@query("rouge_lsum", f"""{rouge_sql.scores(CHAT_TEXTS, False)} SELECT id, round("rougeLsum", 6) AS "rougeLsum" FROM scores""")
def _(t):
    scored = scoring.rouge_scores(spread(chat(t), "id"), "prompt", "response", metrics=["rougeLsum"])
    return scored.select("id", F.round("rougeLsum", 6).alias("rougeLsum"))


def _mean_sql(n: int) -> str:
    return f"SELECT 'rouge{n}' AS metric, round(avg(f), 6) AS value FROM ({_rouge_sql(n)})"


@query(
    "rouge_report",
    f"""{_mean_sql(1)} UNION ALL {_mean_sql(2)}
        UNION ALL SELECT 'rougeL', round(avg("rougeL"), 6) FROM ({ROUGE_L})""",
)
def _(t):
    pairs = spread(chat(t), "id")
    report = scoring.rouge_report(pairs, "prompt", "response", metrics=["rouge1", "rouge2", "rougeL"])
    return report.select("metric", F.round("value", 6).alias("value"))


@query("rouge_all", rouge_sql.report(CHAT_TEXTS, False, False, 6))
def _(t):
    report = scoring.rouge_report(spread(chat(t), "id"), "prompt", "response")
    return report.select("metric", F.round("value", 6).alias("value"))


@query(
    "token_stems",
    f"""WITH raw AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM documents),
        {rouge_sql.stems("raw")} SELECT token, stem FROM stems WHERE stem <> token""",
)
def _(t):
    """The stem table of all documents."""
    found = _documents(t).select(F.explode(rouge.tokens(F.col("text"))).alias("token"))
    return stem_table(found)


@query("rouge_stemmed", rouge_sql.report(CHAT_SENTENCES, True, True, 4))
def _(t):
    return scoring.rouge_report(spread(chat(t), "id"), "prompt", "response", True, True, True)


def _load_echo():
    """A stand-in for a model: it repeats the prompt and answers with its last words."""
    return lambda prompts: [p + " ".join(p.split()[-5:]) for p in prompts]


@query(
    "score_job",
    f"""WITH {CHAT}, prompted AS (SELECT id, prompt AS input, response AS output,
            regexp_extract_all(prompt || '<SEP>', '{WORD}') AS w FROM chat)
        SELECT id, input, output, replace(input || '<SEP>' || array_to_string(list_slice(w, greatest(len(w) - 4, 1), len(w)), ' '),
            input || '<SEP>', '') AS model_output FROM prompted""",
)
def _(t):
    pairs = chat(t).select("id", F.col("prompt").alias("input"), F.col("response").alias("output"))
    return scoring.predict(spread(pairs, "id"), _load_echo)


def _coded_sql(ctes: str, texts: str, items: str, parted: bool = False, key: str = "id") -> str:
    """Ids of ``items`` (key, toks, given) in a vocabulary of ``texts`` (toks): all ids, and labels that
    ignore the given part, or with ``parted`` the ids of the given part and those of the rest."""
    place = "' ' ORDER BY place"
    if parted:
        ids = f"string_agg(CASE WHEN place <= given THEN token_id::VARCHAR END, {place})"
        labels = f"string_agg(CASE WHEN place > given THEN token_id::VARCHAR END, {place})"
    else:
        ids = f"string_agg(token_id::VARCHAR, {place})"
        labels = f"string_agg(CASE WHEN place <= given THEN '{arrays.IGNORE}' ELSE token_id::VARCHAR END, {place})"
    return f"""WITH {ctes}, texts AS ({texts}), vocabulary AS (
        SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) + 2 AS token_id
        FROM (SELECT unnest(toks) AS token FROM texts) GROUP BY token UNION ALL SELECT '{P.EOS_TOKEN}', 1),
    items AS ({items}), flat AS (
        SELECT {key}, given, unnest(toks) AS token, unnest(range(1, len(toks) + 1)) AS place FROM items)
    SELECT {key}, {ids} AS input_ids, {labels} AS labels FROM flat JOIN vocabulary USING (token) GROUP BY {key}"""


def _as_text(df, key: str):
    return df.select(key, *(F.array_join(c, " ").alias(c) for c in ("input_ids", "labels")))


SFT_TOKENS = f"""given AS (SELECT id, regexp_extract_all({sql_fill(P.INSTRUCTION_ONLY, sql_strip("prompt"))}, '{TOKEN}') AS g,
        regexp_extract_all({sql_strip("response")}, '{TOKEN}') AS r FROM chat)"""


@query(
    "instruction_assembly",
    _coded_sql(
        f"{CHAT}, {SFT_TOKENS}",
        "SELECT g AS toks FROM given UNION ALL SELECT r FROM given",
        f"SELECT id, g || r || ['{P.EOS_TOKEN}'] AS toks, len(g) AS given FROM given WHERE len(g) + len(r) + 1 <= 512",
    ),
)
def _(t):
    pairs = spread(chat(t), "id")
    return _as_text(assembly.instruction_examples(pairs, "id", assembly.instruction_vocabulary(pairs)), "id")


MIXED_TOKENS = f"""whole AS (SELECT id, CASE WHEN pretrain_marker = 1 THEN 0 ELSE
        len(regexp_extract_all(system_message || chr(10) || chr(10) || {sql_fill(P.INSTRUCTION_ONLY, sql_strip("prompt"))}, '{TOKEN}')) END AS given,
        regexp_extract_all(CASE WHEN pretrain_marker = 1 THEN {sql_strip("prompt")}
            ELSE system_message || chr(10) || chr(10) || {sql_fill(P.INSTRUCTION_ONLY, sql_strip("prompt"))}
            || {sql_strip("response")} END, '{TOKEN}') AS toks
        FROM mixed WHERE pretrain_marker = 1 OR (system_message IS NOT NULL AND response IS NOT NULL))"""


@query(
    "mixed_assembly",
    _coded_sql(
        f"{MIXED}, {MIXED_TOKENS}",
        "SELECT toks FROM whole",
        f"SELECT id, (toks || ['{P.EOS_TOKEN}'])[1:512] AS toks, given FROM whole",
    ),
)
def _(t):
    rows = spread(mixed(t), "id")
    return _as_text(assembly.assemble_mixed(rows, "id", assembly.mixed_vocabulary(rows)), "id")


SEQ2SEQ_TOKENS = f"""sides AS (SELECT pos, regexp_extract_all('summarize: ' || output, '{TOKEN}') AS a,
        regexp_extract_all(input, '{TOKEN}') AS b, length(input) > 0 AND length(output) > 0 AS filled FROM pairs)"""


@query(
    "seq2seq_assembly",
    _coded_sql(
        f"{TITLED_PAIRS}, {SEQ2SEQ_TOKENS}",
        "SELECT a AS toks FROM sides UNION ALL SELECT b FROM sides",
        f"""SELECT pos, a[1:511] || ['{P.EOS_TOKEN}'] || b[1:127] || ['{P.EOS_TOKEN}'] AS toks,
            least(511, len(a)) + 1 AS given FROM sides WHERE filled""",
        parted=True,
        key="pos",
    ),
)
def _(t):
    swapped = titled_pairs(t).select(
        "pos", F.col("output").alias("input"), F.col("input").alias("output")
    )
    pairs = materialize(swapped, "pairs")
    vocabulary = assembly.seq2seq_vocabulary(pairs, "summarize: ")
    return _as_text(assembly.assemble_seq2seq(pairs, "pos", vocabulary, prefix="summarize: "), "pos")


@query(
    "instruction_subset",
    f"""WITH {CHAT}, keyed AS (
        SELECT *, row_number() OVER (ORDER BY md5('1:validation:' || id)) AS v, count(*) OVER () AS total FROM chat),
    split AS (SELECT *, v <= ceil(total * 0.001) AS held FROM keyed),
    drawn AS (SELECT *, row_number() OVER (PARTITION BY held ORDER BY md5('1:select:' || id)) AS place FROM split),
    texts AS (SELECT id, held, place, regexp_extract_all({sql_fill(P.INSTRUCTION_ONLY, sql_strip("prompt"))}, '{TOKEN}') AS g,
        regexp_extract_all({sql_strip("response")}, '{TOKEN}') AS r FROM drawn)
    SELECT 'chat' AS task, CASE WHEN held THEN 'validation' ELSE 'train' END AS split, id,
        (len(g) + len(r) + 1)::BIGINT AS n, len(g)::BIGINT AS ignored
    FROM texts WHERE (held OR place <= 40) AND len(g) + len(r) + 1 <= 512""",
)
def _(t):
    """Forty training rows at random and the whole validation split."""
    pairs = chat(t).select("id", "prompt", "response")
    vocabulary = assembly.instruction_vocabulary(pairs)
    rows = assembly.assemble_instructions({"chat": pairs}, vocabulary, "id", select_train=40)
    ignored = F.size(F.filter("labels", lambda x: x == arrays.IGNORE))
    return rows.select(
        "task", "split", "id", F.size("input_ids").cast("bigint").alias("n"), ignored.cast("bigint").alias("ignored")
    )


@query(
    "rare_encoding",
    f"""WITH counts AS (
        SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '{TOKEN}')) AS token FROM documents)
        GROUP BY 1 HAVING count(*) > 1),
    vocabulary AS (SELECT token, (row_number() OVER (ORDER BY n DESC, token) + 2)::BIGINT AS token_id FROM counts),
    spread AS (SELECT doc_id, CASE WHEN unnest(toks) = '.' THEN 'no such token' ELSE unnest(toks) END AS token,
        unnest(range(1, len(toks) + 1)) AS place
        FROM (SELECT doc_id, regexp_extract_all(text, '{TOKEN}') AS toks FROM documents)),
    coded AS (SELECT doc_id, string_agg(coalesce(token_id, 2)::VARCHAR, ' ' ORDER BY place) AS ids
        FROM spread LEFT JOIN vocabulary USING (token) GROUP BY 1)
    SELECT doc_id, coalesce(ids, '') AS ids FROM documents LEFT JOIN coded USING (doc_id)""",
)
def _(t):
    """Most ids are found by the join, and the most frequent token is one that the vocabulary lacks."""
    docs = _documents(t)
    vocabulary = replace(build_vocabulary(docs, "text", min_count=2), common=100)
    unknown = F.transform(tokens(F.col("text")), lambda x: F.when(x == ".", "no such token").otherwise(x))
    coded = encode(docs.select("doc_id", unknown.alias("tokens")), "doc_id", "tokens", vocabulary, "ids", keep=False)
    return coded.select("doc_id", _text(F.col("ids")).alias("ids"))


def _sweep(t):
    """Rungs of training files, read back with their names."""
    path = f"{shared_dir(t.spark)}/sweep-{uuid.uuid4().hex}"
    rows = chat(t).select("id", F.col("prompt").alias("input"), F.col("response").alias("output"))
    for rung, test in (("long", F.length("input") > 300), ("short", F.length("input") <= 300)):
        write_jsonl(rows.filter(test), f"{path}/train_{rung}.jsonl")
    return read_rungs(t.spark, path, T.StructType.fromDDL("id bigint, input string, output string"))


SWEEP = f"""{CHAT}, rungs AS (SELECT CASE WHEN length(prompt) > 300 THEN 'long' ELSE 'short' END AS rung, id, prompt AS input,
    response AS output FROM chat)"""


def _sweep_ids(column: str, size: int) -> str:
    return f"""SELECT rung, id, string_agg(token_id::VARCHAR, ' ' ORDER BY place) AS ids FROM (
        SELECT rung, id, unnest(toks) AS token, unnest(range(1, len(toks) + 1)) AS place FROM (
            SELECT rung, id, regexp_extract_all({column}, '{TOKEN}')[1:{size - 1}] AS toks FROM rungs))
        JOIN vocabularies USING (rung, token) GROUP BY rung, id"""


@query(
    "sweep_assembly",
    f"""WITH {SWEEP}, counts AS (SELECT rung, token, count(*) AS n FROM (
            SELECT rung, unnest(regexp_extract_all(input, '{TOKEN}') || regexp_extract_all(output, '{TOKEN}')) AS token FROM rungs) GROUP BY ALL),
        vocabularies AS (SELECT rung, token, row_number() OVER (PARTITION BY rung ORDER BY n DESC, token) + 2 AS token_id FROM counts)
    SELECT rung, id, coalesce(a.ids || ' ', '') || '1' AS input_ids, coalesce(b.ids || ' ', '') || '1' AS labels
    FROM rungs LEFT JOIN ({_sweep_ids("input", 64)}) a USING (rung, id) LEFT JOIN ({_sweep_ids("output", 32)}) b USING (rung, id)
    WHERE length(input) > 0 AND length(output) > 0""",
)
def _(t):
    """The examples of all rungs of a sweep in one job, each rung with its own vocabulary."""
    rungs = _sweep(t)
    vocabularies = replace(build_vocabularies(rungs, "rung", "input", "output"), common=2000)
    rows = assembly.sweep_examples(rungs, "id", vocabularies, max_source=64, max_target=32)
    return rows.select("rung", "id", _text(F.col("input_ids")).alias("input_ids"), _text(F.col("labels")).alias("labels"))


SWEEP_TEXTS = f"""{SWEEP}, texts AS (SELECT id, rung, {rouge_sql.sentence_lines("input", sql_strip)} AS a,
    {rouge_sql.sentence_lines("output", sql_strip)} AS b FROM rungs)"""


@query("sweep_metrics", rouge_sql.report(SWEEP_TEXTS, True, True, 4, by="rung"))
def _(t):
    """Scores of the predictions of all rungs, the inputs standing in for references."""
    scored = _sweep(t).select("rung", F.col("input").alias("output"), F.col("output").alias("model_output"))
    return evaluation.sweep_report(scored)


DECODED = f"""{CHAT}, decoded AS (SELECT id, prompt, regexp_extract_all(response, '{TOKEN}') AS ids FROM chat),
    texts AS (SELECT id, {rouge_sql.sentence_lines("prompt", sql_strip)} AS a,
        {rouge_sql.sentence_lines("array_to_string(ids, ' ')", sql_strip)} AS b FROM decoded)"""


@query(
    "generation_report",
    f"{rouge_sql.report(DECODED, True, True, 4)} UNION ALL SELECT 'gen_len', round(avg(len(ids)), 6) FROM decoded",
)
def _(t):
    pairs = spread(chat(t), "id")
    vocabulary = build_vocabulary(pairs, "prompt", "response")
    coded = encode(
        pairs.select("id", "prompt", tokens(F.col("response")).alias("tokens")), "id", "tokens", vocabulary, "ids", keep=False
    )
    decoded = decode(coded, "id", "ids", vocabulary, "generated")
    report = scoring.generation_report(decoded, "prompt", "generated", "ids", vocabulary.pad_id)
    return report.select("metric", F.round("value", 6).alias("value"))
