"""Queries over single rows: prompts, filters, text and array functions, scans."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from instructset import schemas
from instructset.functions import prompts as P
from instructset.functions.html import strip_html
from instructset.functions.labels import aligned_labels, conll_block, tuple_labels, tuple_tokens
from instructset.functions.text import (
    SENTENCE_END,
    WHITESPACE,
    one_line,
    run_tag,
    sentence_lines,
    strip,
    word_count,
)
from instructset.operators import filters as flt
from instructset.operators.positions import with_row_index
from instructset.operators.selection import first_rows
from instructset.plans import building, evaluation
from instructset.plans.building import tagged_sentences
from instructset.sources import readers, registry, writers
from instructset.session import shared_dir
from instructset.workload.inputs import (
    BAND,
    CHAT,
    MIXED,
    NL,
    PRODUCTS,
    RECOGNIZED,
    REVIEWS,
    TAGGED,
    TITLED,
    TITLED_PAIRS,
    chat,
    mixed,
    products,
    recognized,
    reviews,
    sql_words,
    tagged,
    titled,
    titled_pairs,
)
from instructset.workload.registry import query


def sql_text(text: str) -> str:
    """A SQL literal, line breaks included."""
    return " || chr(10) || ".join("'" + line.replace("'", "''") + "'" for line in text.split("\n"))


def sql_fill(template: str, *values: str) -> str:
    parts = template.split("%s")
    out = [sql_text(parts[0])]
    for value, text in zip(values, parts[1:]):
        out += [value, sql_text(text)]
    return "(" + " || ".join(out) + ")"


SQL_SPACES = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(28)||chr(29)||chr(30)||chr(31)||' '||chr(133)||chr(160)"


# The tuple pattern as one group, as a reader of the output format would write it.
_W, _S = r"[\p{L}\p{N}_]", rf"[{WHITESPACE}]"
SQL_TUPLE = rf"{_W}+?,{_S}+[BI]-{_W}+|{_W}+?,{_S}+O"


def sql_strip(text: str) -> str:
    return f"trim({text}, {SQL_SPACES})"


@query("pair_rename", "SELECT conv_id, turn, role AS prompt, text AS response FROM conversations")
def _(t):
    return t.conversations.withColumnsRenamed({"role": "prompt", "text": "response"})


@query(
    "product_prompt",
    """SELECT p_partkey, 'Title: ' || p_name || chr(10) || 'Brand: '
        || coalesce(CASE WHEN p_size >= 10 THEN p_brand END, 'None') || chr(10) || 'Color: '
        || coalesce(CASE WHEN p_size < 40 THEN split_part(p_name, ' ', 1) END, 'None')
        || chr(10) || 'Bullet points: ' || p_type AS input FROM part""",
)
def _(t):
    return t.part.select(
        "p_partkey",
        P.product_prompt(
            F.col("p_name"),
            F.when(F.col("p_size") >= 10, F.col("p_brand")),
            F.when(F.col("p_size") < 40, F.substring_index("p_name", " ", 1)),
            F.col("p_type"),
        ).alias("input"),
    )


@query(
    "instruction_prompt",
    f"""WITH {CHAT} SELECT id, CASE WHEN length(response) > 400
        THEN {sql_fill(P.INSTRUCTION_WITH_INPUT, "prompt", "response")}
        ELSE {sql_fill(P.INSTRUCTION_ONLY, "prompt")} END AS text FROM chat""",
)
def _(t):
    context = F.when(F.length("response") > 400, F.col("response"))
    return chat(t).select("id", P.instruction_prompt(F.col("prompt"), context).alias("text"))


@query(
    "question_prompt",
    f"""WITH {CHAT} SELECT id,
        {sql_fill(P.QUESTION_PROMPT + chr(10) + "Question: %s" + chr(10) + "Context: %s", "prompt", "response")}
        AS input FROM chat""",
)
def _(t):
    return chat(t).select(
        "id", P.question_prompt(F.col("prompt"), F.col("response")).alias("input")
    )


@query(
    "description_prompt",
    f"WITH {TITLED} SELECT pos, {sql_text(P.DESCRIPTION_PROMPT)} || title AS input FROM titled",
)
def _(t):
    return titled(t).select("pos", P.description_prompt(F.col("title")).alias("input"))


@query("summary_prompt", f"SELECT doc_id, {sql_text(P.SUMMARY_PROMPT)} || text AS input FROM documents")
def _(t):
    return t.documents.select("doc_id", P.summary_prompt(F.col("text")).alias("input"))


@query(
    "unprompt",
    f"""WITH prompted AS (SELECT doc_id, CASE WHEN lang = 'de' THEN text
            WHEN lang = 'fr' THEN {sql_text(P.SUMMARY_PROMPT)} || text || {sql_text(P.SUMMARY_PROMPT)} || source
            ELSE {sql_text(P.SUMMARY_PROMPT)} || text END AS input FROM documents)
        SELECT doc_id, CASE WHEN contains(input, {sql_text(P.SUMMARY_PROMPT)})
            THEN split_part(input, {sql_text(P.SUMMARY_PROMPT)}, 2) END AS inputs FROM prompted""",
)
def _(t):
    prompt = F.lit(P.SUMMARY_PROMPT)
    text = (
        F.when(F.col("lang") == "de", F.col("text"))
        .when(F.col("lang") == "fr", F.concat(prompt, "text", prompt, "source"))
        .otherwise(F.concat(prompt, "text"))
    )
    return t.documents.select("doc_id", P.without_prompt(text).alias("inputs"))


@query("source_prefix", f"WITH {CHAT} SELECT id, 'summarize: ' || prompt AS input FROM chat")
def _(t):
    return chat(t).select("id", P.prefixed(F.col("prompt"), "summarize: ").alias("input"))


@query(
    "training_text",
    f"""WITH {CHAT} SELECT id, {sql_fill(P.INSTRUCTION_ONLY, sql_strip("prompt"))}
        || {sql_strip("response")} || '</s>' AS text FROM chat""",
)
def _(t):
    return chat(t).select(
        "id",
        P.training_text(
            P.instruction_prompt(strip(F.col("prompt"))), strip(F.col("response"))
        ).alias("text"),
    )


@query(
    "mixed_text",
    f"""WITH {MIXED} SELECT id, CASE WHEN pretrain_marker = 1 THEN {sql_strip("prompt")} || '</s>'
        ELSE system_message || chr(10) || chr(10) || {sql_fill(P.INSTRUCTION_ONLY, sql_strip("prompt"))}
            || {sql_strip("response")} || '</s>' END AS text
        FROM mixed WHERE pretrain_marker IS NOT NULL AND prompt IS NOT NULL AND (pretrain_marker = 1
            OR (system_message IS NOT NULL AND response IS NOT NULL))""",
)
def _(t):
    parts = [F.col(c) for c in ("pretrain_marker", "system_message", "prompt", "response")]
    return mixed(t).filter(flt.valid_mixed(*parts)).select("id", P.mixed_text(*parts).alias("text"))


@query(
    "instruction_only",
    f"""WITH {MIXED} SELECT id, prompt, response FROM mixed WHERE pretrain_marker = 0""",
)
def _(t):
    return mixed(t).filter(flt.instruction_only(F.col("pretrain_marker"))).select("id", "prompt", "response")


@query(
    "run_tag",
    """SELECT replace(lang || '/' || source, '/', '-') AS run, count(*) AS n
        FROM documents GROUP BY 1""",
)
def _(t):
    return t.documents.groupBy(run_tag(F.concat_ws("/", "lang", "source")).alias("run")).agg(
        F.count("*").alias("n")
    )


@query(
    "locale_filter",
    f"""WITH {PRODUCTS} SELECT pos, product_title FROM products
        WHERE product_locale = 'us' AND length(product_description) > 0""",
)
def _(t):
    return products(t).filter(
        flt.described_in_locale(F.col("product_locale"), F.col("product_description"))
    ).select("pos", "product_title")


QUALITY = f"""coalesce(product_title IS NOT NULL AND product_description IS NOT NULL
        AND product_bullet_point IS NOT NULL AND product_description <> product_title
        AND product_description <> product_bullet_point
        AND {sql_words("product_title")} < {sql_words("product_description")}, false)"""


@query("quality_filter", f"WITH {PRODUCTS} SELECT pos FROM products WHERE {QUALITY}")
def _(t):
    parts = (F.col(f"product_{c}") for c in ("title", "description", "bullet_point"))
    return products(t).filter(flt.product_quality(*parts)).select("pos")


@query(
    "length_band",
    f"""WITH {TITLED} SELECT pos, {sql_words("title")} AS title_words,
        {sql_words("description")} AS description_words FROM titled WHERE {BAND}""",
)
def _(t):
    return titled(t).filter(
        flt.description_band(F.col("title"), F.array("description"))
    ).select(
        "pos",
        word_count(F.col("title")).alias("title_words"),
        word_count(F.col("description")).alias("description_words"),
    )


@query(
    "null_pairs",
    f"WITH {MIXED} SELECT id, response FROM mixed WHERE prompt IS NOT NULL AND response IS NOT NULL",
)
def _(t):
    return mixed(t).filter(flt.both_present(F.col("prompt"), F.col("response"))).select("id", "response")


@query(
    "empty_pairs",
    f"WITH {TITLED} SELECT pos, title FROM titled WHERE length(title) > 0 AND length(description) > 0",
)
def _(t):
    return titled(t).filter(flt.both_filled(F.col("title"), F.col("description"))).select("pos", "title")


@query(
    "rating_buckets",
    f"""WITH {REVIEWS} SELECT product, CASE WHEN rating < 3 THEN 'negative' WHEN rating > 3
        THEN 'positive' ELSE 'neutral' END AS mood, count(*) AS n FROM reviews GROUP BY 1, 2""",
)
def _(t):
    return reviews(t).groupBy("product", flt.sentiment(F.col("rating")).alias("mood")).agg(
        F.count("*").alias("n")
    )


@query(
    "tag_mismatch_rejects",
    f"WITH {TAGGED} SELECT doc_id, text FROM tagged WHERE len(words) <> len(tag)",
)
def _(t):
    _, rejects = tagged_sentences(tagged(t), "text", "tag")
    return rejects.select("doc_id", "text")


@query(
    "token_tag_zip",
    f"""WITH {TAGGED} SELECT doc_id, unnest(words) AS token, unnest(tag) AS label,
        unnest(range(0, len(words)))::BIGINT AS at FROM tagged WHERE len(words) = len(tag)""",
)
def _(t):
    sentences, _ = tagged_sentences(tagged(t), "text", "tag")
    return sentences.select("doc_id", F.posexplode("tokens").alias("at", "pair")).select(
        "doc_id", "pair.token", "pair.label", F.col("at").cast("bigint").alias("at")
    )


@query(
    "conll_lines",
    f"""WITH {TAGGED} SELECT doc_id, CASE WHEN len(words) = 0 THEN '' ELSE array_to_string(
        list_transform(words, lambda w, i: w || ' ' || tag[i]), chr(10)) || chr(10) END AS value
        FROM tagged WHERE len(words) = len(tag)""",
)
def _(t):
    sentences, _ = tagged_sentences(tagged(t), "text", "tag")
    return sentences.select("doc_id", conll_block(F.col("tokens")).alias("value"))




def sql_html(html: str) -> str:
    """Markup removed by one replacement after another; enough where markup is not nested in
    comments or scripts and only these references occur."""
    markup = html
    for pattern in (
        r"(?is)<!--.*?-->",
        r"(?is)<script\b[^>]*>.*?</script\s*>",
        r"(?is)<style\b[^>]*>.*?</style\s*>",
        r"</?[a-zA-Z!][^>]*>",
    ):
        markup = f"regexp_replace({markup}, '{pattern}', chr(1), 'g')"
    for name, text in (("quot", '"'), ("copy", "©"), ("middot", "·"), ("amp", "&")):
        markup = f"replace({markup}, '&{name};', '{text}')"
    return f"""array_to_string(list_filter(list_transform(string_split({markup}, chr(1)),
        lambda x: {sql_strip("x")}), lambda x: length(x) > 0), ' ')"""


SQL_HTML = sql_html("html")


@query("strip_html", f"SELECT page_id, {SQL_HTML} AS text FROM pages")
def _(t):
    pages = readers.spread(t.pages.select("page_id", "html"), "page_id")
    return pages.select("page_id", strip_html(F.col("html")).alias("text"))


@query(
    "training_lines",
    f"""WITH {TITLED_PAIRS} SELECT replace(input, {NL}, '') || ' <SEP> ' || replace(output, {NL}, '')
        AS value FROM pairs""",
)
def _(t):
    return writers.training_lines(titled_pairs(t))


@query("one_line", f"SELECT doc_id, replace(text, {NL}, '') AS line FROM documents")
def _(t):
    return t.documents.select("doc_id", one_line(F.col("text")).alias("line"))


@query(
    "strip_prompt",
    f"""WITH {CHAT} SELECT id, prompt || '<SEP>' AS prompt, replace(prompt || '<SEP>' || response
        || prompt || '<SEP>', prompt || '<SEP>', '') AS model_output FROM chat""",
)
def _(t):
    prompt = P.generation_prompt(F.col("prompt"))
    return chat(t).select(
        "id",
        prompt.alias("prompt"),
        P.without_echo(F.concat(prompt, "response", prompt), prompt).alias("model_output"),
    )


@query(
    "sentence_lines",
    f"""SELECT doc_id, regexp_replace({sql_strip("text")}, '{SENTENCE_END}',
        concat('\\1', chr(10)), 'g') AS lines FROM documents""",
)
def _(t):
    return t.documents.select("doc_id", sentence_lines(F.col("text")).alias("lines"))


@query(
    "ner_tuples",
    f"""WITH {RECOGNIZED}, found AS (
        SELECT doc_id,
            list_transform(regexp_extract_all(output, '{SQL_TUPLE}'), lambda x: {sql_strip("split_part(x, ',', 2)")}) AS true_labels,
            list_transform(regexp_extract_all(output, '{SQL_TUPLE}'), lambda x: {sql_strip("split_part(x, ',', 1)")}) AS tokens,
            list_transform(regexp_extract_all(model_output, '{SQL_TUPLE}'), lambda x: {sql_strip("split_part(x, ',', 2)")}) AS pred
        FROM recognized)
        SELECT doc_id, array_to_string(tokens, ' ') AS tokens, array_to_string(true_labels, ' ') AS true_labels,
            array_to_string(CASE WHEN len(pred) = len(true_labels) THEN pred
                ELSE list_transform(true_labels, lambda x: 'O') END, ' ') AS pred_labels FROM found""",
)
def _(t):
    found = recognized(t).select(
        "doc_id",
        tuple_tokens(F.col("output")).alias("tokens"),
        tuple_labels(F.col("output")).alias("true"),
        tuple_labels(F.col("model_output")).alias("pred"),
    )
    return found.select(
        "doc_id",
        F.array_join("tokens", " ").alias("tokens"),
        F.array_join("true", " ").alias("true_labels"),
        F.array_join(aligned_labels(F.col("pred"), F.col("true")), " ").alias("pred_labels"),
    )


@query("head_n", "SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 50")
def _(t):
    return first_rows(t.documents.select("doc_id", "text"), "doc_id", 50)


def _copy(t, fmt: str) -> str:
    """A fresh folder in the shared folder for a table that is written and read back."""
    return f"{shared_dir(t.spark)}/{fmt}-{uuid.uuid4().hex}"


def _in_order(df, key: str):
    """Rows in order over as many files as there are ranges: file names begin with the range's number."""
    return df.repartitionByRange(key).sortWithinPartitions(key)


DOCUMENT = "doc_id bigint, text string, lang string, source string"


@query("jsonl_scan", "SELECT doc_id, text, lang, source FROM documents")
def _(t):
    path = _copy(t, "jsonl")
    writers.write_jsonl(t.documents.select("doc_id", "text", "lang", "source"), path)
    return readers.read_jsonl(t.spark, path, T.StructType.fromDDL(DOCUMENT))


@query("csv_scan", "SELECT doc_id, text, lang, source FROM documents")
def _(t):
    path = _copy(t, "csv")
    writers.write_csv(t.documents.select("doc_id", "text", "lang", "source"), path)
    return readers.read_csv(t.spark, path, T.StructType.fromDDL(DOCUMENT), multi_line=True)


@query("split_folders_scan", "SELECT coalesce(lang, 'none') AS split, doc_id, text FROM documents")
def _(t):
    path = _copy(t, "splits")
    rows = t.documents.select(F.coalesce("lang", F.lit("none")).alias("split"), "doc_id", "text")
    writers.write_jsonl(rows, path, by="split")
    named = readers.read_named_dataset(t.spark, path, T.StructType.fromDDL("doc_id bigint, text string"), "json")
    return named.withColumn("split", F.substring_index("split", "=", -1))


@query(
    "rungs_scan",
    f"WITH {CHAT} SELECT CASE WHEN length(prompt) > 300 THEN 'long' ELSE 'short' END AS rung, prompt AS input, response AS output FROM chat",
)
def _(t):
    path = _copy(t, "rungs")
    rows = chat(t).select(
        F.when(F.length("prompt") > 300, F.lit("long")).otherwise(F.lit("short")).alias("rung"),
        F.col("prompt").alias("input"),
        F.col("response").alias("output"),
    )
    for rung in ("long", "short"):
        own = rows.filter(F.col("rung") == rung).drop("rung")
        writers.write_jsonl(own, f"{path}/train_{rung}.jsonl")
    return readers.read_rungs(t.spark, path).select("rung", "input", "output")


PAIR_SQL = f"WITH {CHAT} SELECT 'train' AS split, prompt AS input, response AS output FROM chat"


@query("pairs_scan", PAIR_SQL)
def _(t):
    """JSON pairs under a known data set's column names."""
    path = _copy(t, "pairs") + ".jsonl"
    rows = chat(t).select("conv_id", F.col("prompt").alias("article"), F.col("response").alias("highlights"))
    writers.write_jsonl(rows, path)
    return readers.load_pairs(t.spark, {"train": path}, dataset="cnn_dailymail")


@query(
    "tsv_ranked_scan",
    """SELECT CASE WHEN doc_id % 2 = 0 THEN 'dev' ELSE 'train' END AS split, (1 - doc_id % 2)::BIGINT AS source_rank,
        (row_number() OVER (ORDER BY doc_id % 2, doc_id) - 1)::BIGINT AS pos, doc_id, source, lang FROM documents""",
)
def _(t):
    """Ranked tab-separated files in the order of their rows; the columns stand in another order than in the schema."""
    path = _copy(t, "tsv")
    for name, rest in (("dev", 0), ("train", 1)):
        rows = t.documents.filter(F.col("doc_id") % 2 == rest).select("lang", "doc_id", "source")
        _in_order(rows, "doc_id").write.option("header", True).option("sep", "\t").csv(f"{path}/{name}.csv")
    schema = T.StructType.fromDDL("doc_id bigint, source string, lang string")
    read = readers.read_ranked_tsv(t.spark, path, schema, ("train", "dev"))
    rank = F.col("source_rank").cast("bigint").alias("source_rank")
    return read.select("split", rank, "pos", "doc_id", "source", "lang")


@query("file_positions", "SELECT (row_number() OVER (ORDER BY doc_id) - 1)::BIGINT AS pos, doc_id, text FROM documents")
def _(t):
    """Places of all rows of a Parquet table of several files."""
    path = _copy(t, "numbered")
    _in_order(t.documents.select("doc_id", "text"), "doc_id").write.parquet(path)
    return with_row_index(readers.read_parquet(t.spark, path)).select("pos", "doc_id", "text")


@query(
    "task_rows",
    """SELECT task, (row_number() OVER (PARTITION BY task ORDER BY doc_id) - 1)::BIGINT AS pos, source AS prompt, text AS response
        FROM (SELECT *, CASE WHEN lang = 'en' THEN 'esci_task2_english' ELSE 'esci_task2_other' END AS task FROM documents)""",
)
def _(t):
    """JSON pairs of two tasks, found by their full names."""
    path, names = _copy(t, "tasks"), ("esci_task2_english", "esci_task2_other")
    task = F.when(F.col("lang") == "en", names[0]).otherwise(names[1])
    rows = t.documents.select("doc_id", F.col("source").alias("input"), F.col("text").alias("output"), task.alias("task"))
    for name in names:
        own = _in_order(rows.filter(F.col("task") == name), "doc_id")
        writers.write_jsonl(own.select("input", "output"), f"{path}/{name}")
    loaded = registry.load_datasets(t.spark, "#".join(names), {name: f"{path}/{name}" for name in names})
    named = [df.select(F.lit(name).alias("task"), "pos", "prompt", "response") for name, df in loaded.items()]
    return named[0].unionByName(named[1])


@query(
    "early_stop_files",
    f"""WITH {TITLED}, kept AS (SELECT pos, title, description, row_number() OVER (ORDER BY pos) AS kept_no FROM
            (SELECT (row_number() OVER (ORDER BY pos) - 1)::BIGINT AS pos, title, description FROM titled) WHERE {BAND}),
        stop AS (SELECT min(pos) AS last FROM kept WHERE pos > 60 AND kept_no >= 20)
        SELECT pos, title AS input, {sql_html("description")} AS output FROM kept, stop WHERE last IS NULL OR pos <= last""",
)
def _(t):
    """Descriptions of a scan that ends; files after its end are not opened."""
    path = _copy(t, "products")
    rows = titled(t).select("pos", "title", F.array("description").alias("description"))
    writers.write_jsonl(_in_order(rows, "pos").drop("pos"), path)
    read = readers.read_jsonl(t.spark, path, T.StructType.fromDDL("title string, description array<string>"))
    return building.description_pairs(read, limit=60, enough=20)


#: Rows of a block of events; a product's reviews are one document per block, so a document is bounded.
REVIEW_BLOCK = 8192


def _review_kind(kind: str, wanted: str, output: str) -> str:
    top = f"""SELECT file_name, string_agg(text, chr(10) ORDER BY helpful_votes DESC NULLS LAST, pos) AS texts
        FROM (SELECT * FROM blocks WHERE {wanted}
            QUALIFY row_number() OVER (PARTITION BY file_name ORDER BY helpful_votes DESC NULLS LAST, pos) <= 4) GROUP BY 1"""
    return f"""SELECT '{kind}' AS kind, file_name, {sql_text(P.SUMMARY_PROMPT)} || coalesce(texts, '') AS input, {output} AS output
        FROM summaries LEFT JOIN ({top}) USING (file_name)"""


def _review_texts(wanted: str) -> str:
    return f"coalesce(string_agg(text, chr(10) ORDER BY pos) FILTER (WHERE {wanted}), '')"


@query(
    "review_documents",
    f"""WITH {REVIEWS}, blocks AS (SELECT *, product || '-' || (pos // {REVIEW_BLOCK}) || '.json' AS file_name FROM reviews),
        whole AS (SELECT file_name, max(helpful_votes) AS most, {_review_texts("rating > 3")} AS pros, {_review_texts("rating < 3")} AS cons
            FROM blocks GROUP BY 1),
        summaries AS (SELECT * FROM whole WHERE most % 7 <> 0)
    {_review_kind("verdict", "true", "'most votes ' || most")} UNION ALL {_review_kind("pros", "rating > 3", "pros")}
    UNION ALL {_review_kind("cons", "rating < 3", "cons")}
    UNION ALL SELECT 'reject', file_name, NULL, NULL FROM whole WHERE most % 7 = 0""",
)
def _(t):
    """Products with reviews, one document per file, to files of the same names with their summaries, and back."""
    given, built = _copy(t, "products"), _copy(t, "summaries")
    name = F.concat_ws("-", "product", F.floor(F.col("pos") / REVIEW_BLOCK).cast("string"))
    review = F.struct("pos", "text", "rating", "helpful_votes")
    blocks = reviews(t).groupBy(F.concat(name, F.lit(".json")).alias("file_name")).agg(
        F.sort_array(F.collect_list(review)).alias("all"), F.max("helpful_votes").alias("most")
    )

    def texts(test):
        return F.transform(F.filter("all", lambda r: test(r["rating"])), lambda r: r["text"])

    verdict = F.concat(F.lit("most votes "), F.col("most").cast("string"))
    summary = F.struct(verdict.alias("verdict"), texts(lambda r: r > 3).alias("pros"), texts(lambda r: r < 3).alias("cons"))
    products = blocks.select(
        "file_name",
        F.when(F.col("most") % 7 != 0, F.array(summary)).otherwise(F.array().cast(summary_type())).alias("website_summaries"),
        F.transform("all", lambda r: F.struct(r["text"], r["rating"], r["helpful_votes"])).alias("customer_reviews"),
    )
    writers.write_named_files(products, given)
    read = readers.stored_documents(readers.read_documents(t.spark, given, schemas.REVIEWED_PRODUCT))
    out = []
    for kind in ("verdict", "pros", "cons"):
        found, rejects = building.build_review_summaries(read, kind)
        writers.write_named_files(found, f"{built}/{kind}")
        summaries = readers.read_documents(t.spark, f"{built}/{kind}", T.StructType.fromDDL("input string, output string"))
        again = readers.stored_documents(summaries)
        out.append(again.select(F.lit(kind).alias("kind"), "file_name", "input", "output"))
    none = F.lit(None).cast("string")
    out.append(rejects.select(F.lit("reject").alias("kind"), "file_name", none.alias("input"), none.alias("output")))
    return reduce(DataFrame.unionByName, out)


def summary_type() -> T.DataType:
    return schemas.REVIEWED_PRODUCT["website_summaries"].dataType


@query(
    "summary_documents",
    f"""WITH prompted AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'valid' ELSE 'test' END AS split,
            CASE WHEN lang = 'de' THEN text ELSE {sql_text(P.SUMMARY_PROMPT)} || text END AS input, source AS output FROM documents)
        SELECT split, 'row' AS kind, split_part(input, {sql_text(P.SUMMARY_PROMPT)}, 2) AS inputs, output AS target FROM prompted
        WHERE contains(input, {sql_text(P.SUMMARY_PROMPT)})
        UNION ALL SELECT split, 'reject', input, output FROM prompted WHERE NOT contains(input, {sql_text(P.SUMMARY_PROMPT)})""",
)
def _(t):
    """Summary pairs, one document per file in a folder per split, to CSV without the prompt; pairs without it beside."""
    path, csv = _copy(t, "summary-pairs"), _copy(t, "summary-csv")
    text = F.when(F.col("lang") == "de", F.col("text")).otherwise(F.concat(F.lit(P.SUMMARY_PROMPT), "text"))
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".json")).alias("file_name")
    splits = ("train", "valid", "test")
    for i, split in enumerate(splits):
        rows = t.documents.filter(F.col("doc_id") % 3 == i).select(name, text.alias("input"), F.col("source").alias("output"))
        writers.write_named_files(rows, f"{path}/{split}")
    pairs = readers.stored_documents(readers.read_split_folders(t.spark, path, schemas.PAIR, splits, documents=True))
    kept, rejects = building.summary_rows(pairs)
    writers.write_csv(kept, csv, by="split")
    table = readers.read_csv(t.spark, [f"{csv}/split={s}" for s in splits], schemas.CSV_PAIR, multi_line=True)
    table = table.withColumn("split", F.regexp_extract(F.col("_metadata.file_path"), "split=([a-z]+)/", 1))
    rows = table.select("split", F.lit("row").alias("kind"), "inputs", "target")
    return rows.unionByName(
        rejects.select("split", F.lit("reject").alias("kind"), F.col("input").alias("inputs"), F.col("output").alias("target"))
    )


@query("gzip_scan", "SELECT doc_id, text FROM documents")
def _(t):
    path = _copy(t, "gz")
    t.documents.select("doc_id", "text").write.option("compression", "gzip").json(path)
    return readers.read_jsonl(t.spark, path, T.StructType.fromDDL("doc_id bigint, text string"), partitions=8)


@query(
    "prediction_lines",
    f"WITH {CHAT} SELECT {sql_strip("replace(response, chr(10), ' ')")} AS value FROM chat",
)
def _(t):
    path = _copy(t, "predictions")
    rows = chat(t).select("id", F.replace("response", F.lit("\n"), F.lit(" ")).alias("model_output"))
    writers.write_predictions(rows, path, "id")
    return t.spark.read.text(path)


@query(
    "metrics_scan",
    f"""WITH sized AS (SELECT lang = 'en' AS held, {sql_words("text")} AS n FROM documents)
        SELECT 'model-small' AS run, 'train' AS split, 'train_samples' AS metric, count(*)::DOUBLE AS value FROM sized WHERE NOT held
        UNION ALL SELECT 'model-small', 'train', 'train_words', sum(n)::DOUBLE FROM sized WHERE NOT held
        UNION ALL SELECT 'model-small', 'eval', 'eval_samples', least(50, count(*))::DOUBLE FROM sized WHERE held
        UNION ALL SELECT 'model-small', 'eval', 'eval_words', sum(n)::DOUBLE FROM sized WHERE held""",
)
def _(t):
    """Metrics of two sets of documents from the passes that write them."""
    path, data = _copy(t, "metrics"), _copy(t, "measured")
    held = F.col("lang") == "en"
    for split, limit, test in (("train", None, ~held), ("eval", 50, held)):
        rows = t.documents.filter(test).select("doc_id", "text")
        found = evaluation.written_samples(
            rows, limit, split, lambda df, to=f"{data}/{split}": writers.write_jsonl(df, to), words=F.sum(word_count(F.col("text")))
        )
        writers.write_metrics(found, path, "model/small", split)
    return t.spark.read.schema("run string, split string, metric string, value double").json(path)


@query(
    "instruction_rows",
    f"""WITH {CHAT} SELECT (row_number() OVER (ORDER BY id) - 1)::BIGINT AS pos, prompt, response
        FROM chat QUALIFY pos < 20""",
)
def _(t):
    """The first twenty rows of a Parquet table of questions, in the order of its files."""
    path = _copy(t, "orca")
    rows = chat(t).select("id", F.col("prompt").alias("question"), "response")
    _in_order(rows, "id").drop("id").write.parquet(path)
    return registry.load_instructions(t.spark, "orca", {"orca": path}, rows=20)
