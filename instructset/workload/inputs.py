"""How the driver tables stand in for the kinds of input the operators take; each as a
DataFrame and as the same thing in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from instructset.functions.text import WORD
from instructset.operators.filters import description_band
from instructset.sources.readers import spread
from instructset.workload.registry import Tables

NL = "chr(10)"


def sql_words(text: str) -> str:
    return f"len(regexp_extract_all({text}, '{WORD}'))::BIGINT"


def sql_key(id_col: str, salt: str = "") -> str:
    return f"md5(concat_ws(':', '1', '{salt}', {id_col}::VARCHAR))"


def sql_rank(id_col: str, salt: str = "") -> str:
    return f"row_number() OVER (ORDER BY {sql_key(id_col, salt)}, {id_col})"


def titled(t: Tables) -> DataFrame:
    """Documents as title (first line) and description (all other lines)."""
    at = F.instr("text", "\n")
    return spread(t.documents.select("doc_id", "text", "lang", "source"), "doc_id").select(
        F.col("doc_id").alias("pos"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.when(at > 0, F.substring(F.col("text"), at + 1, F.length("text")))
        .otherwise(F.lit(""))
        .alias("description"),
        "lang",
        "source",
    )


TITLED = f"""titled AS (
    SELECT doc_id AS pos, split_part(text, {NL}, 1) AS title,
        CASE WHEN contains(text, {NL}) THEN substr(text, strpos(text, {NL}) + 1) ELSE '' END
            AS description,
        lang, source
    FROM documents)"""

BAND = f"""{sql_words("description")} > 50 AND {sql_words("description")} < 300
        AND {sql_words("description")} > {sql_words("title")}"""

TITLED_PAIRS = f"""{TITLED}, pairs AS (
    SELECT pos, title AS input, description AS output FROM titled WHERE {BAND})"""


def titled_pairs(t: Tables) -> DataFrame:
    rows = titled(t)
    return rows.filter(description_band(F.col("title"), F.array("description"))).select(
        "pos", F.col("title").alias("input"), F.col("description").alias("output")
    )


#: A turn is a 32-bit integer, so no two turns share an id.
ID = "conv_id * 4294967296 + turn"


def turn_id() -> Column:
    return F.col("conv_id") * (1 << 32) + F.col("turn")


def chat(t: Tables) -> DataFrame:
    """User turns with the assistant turn that follows, and the system text of their
    conversation, if any. Joined on (conversation, turn), which no conversation makes hot."""
    turns = t.conversations
    asked = turns.filter(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("prompt")
    )
    answered = turns.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response")
    )
    return asked.join(answered, ["conv_id", "turn"]).select(
        turn_id().alias("id"), "conv_id", "prompt", "response"
    )


CHAT = f"""chat AS (
    SELECT u.{ID.replace("turn", "u.turn")} AS id, u.conv_id, u.text AS prompt, a.text AS response
    FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
    WHERE u.role = 'user' AND a.role = 'assistant')"""


def mixed(t: Tables) -> DataFrame:
    """Documents as pretraining rows (even ids), chat pairs as instruction rows (odd)."""
    system = t.conversations.filter((F.col("role") == "system") & (F.col("turn") == 0)).select(
        "conv_id", F.col("text").alias("system_message")
    )
    taught = (
        chat(t)
        .join(system, "conv_id", "left")
        .select(
            (F.col("id") * 2 + 1).alias("id"),
            F.lit(0).alias("pretrain_marker"),
            "system_message",
            "prompt",
            "response",
        )
    )
    plain = t.documents.select(
        (F.col("doc_id") * 2).alias("id"),
        F.lit(1).alias("pretrain_marker"),
        F.lit(None).cast("string").alias("system_message"),
        F.col("text").alias("prompt"),
        F.lit(None).cast("string").alias("response"),
    )
    return plain.unionByName(taught)


MIXED = f"""{CHAT}, mixed AS (
    SELECT doc_id * 2 AS id, 1 AS pretrain_marker, NULL::VARCHAR AS system_message,
        text AS prompt, NULL::VARCHAR AS response FROM documents
    UNION ALL
    SELECT c.id * 2 + 1, 0, s.text, c.prompt, c.response
    FROM chat c LEFT JOIN conversations s
        ON s.conv_id = c.conv_id AND s.role = 'system' AND s.turn = 0)"""


def products(t: Tables) -> DataFrame:
    """Documents as search products in two splits."""
    is_test = F.col("source").isin("src0", "src1", "src2", "src3")
    return titled(t).select(
        "pos",
        F.when(is_test, F.lit("test")).otherwise(F.lit("train")).alias("split"),
        F.when(is_test, F.lit(1)).otherwise(F.lit(0)).alias("split_rank"),
        F.col("title").alias("product_title"),
        F.col("description").alias("product_description"),
        F.when(F.col("source") != "src9", F.concat_ws(" ", "lang", "source")).alias(
            "product_bullet_point"
        ),
        F.when(F.col("source") != "src5", F.col("source")).alias("product_brand"),
        F.when(F.col("source") == "src6", F.col("lang")).alias("product_color"),
        F.when(F.col("lang") == "en", F.lit("us")).otherwise(F.col("lang")).alias("product_locale"),
    )


PRODUCTS = f"""{TITLED}, products AS (
    SELECT pos,
        CASE WHEN source IN ('src0', 'src1', 'src2', 'src3') THEN 'test' ELSE 'train' END AS split,
        CASE WHEN source IN ('src0', 'src1', 'src2', 'src3') THEN 1 ELSE 0 END AS split_rank,
        title AS product_title, description AS product_description,
        CASE WHEN source <> 'src9' THEN lang || ' ' || source END AS product_bullet_point,
        CASE WHEN source <> 'src5' THEN source END AS product_brand,
        CASE WHEN source = 'src6' THEN lang END AS product_color,
        CASE WHEN lang = 'en' THEN 'us' ELSE lang END AS product_locale
    FROM titled)"""


def reviews(t: Tables) -> DataFrame:
    """Events as reviews of the product ``user_id``."""
    return t.events.select(
        F.col("user_id").alias("product"),
        F.col("event_id").alias("pos"),
        F.concat_ws(" ", "event_type", F.col("event_id").cast("string")).alias("text"),
        (1 + F.floor("value") % 5).cast("double").alias("rating"),
        F.get_json_object("props", "$.k").cast("bigint").alias("helpful_votes"),
    )


REVIEWS = """reviews AS (
    SELECT user_id AS product, event_id AS pos, event_type || ' ' || event_id::VARCHAR AS text,
        (1 + floor(value)::BIGINT % 5)::DOUBLE AS rating,
        CAST(json_extract_string(props, '$.k') AS BIGINT) AS helpful_votes
    FROM events)"""


def evidence(t: Tables) -> DataFrame:
    """Order lines as evidence on the question ``l_returnflag`` about an order."""
    return t.lineitem.select(
        F.col("l_orderkey").alias("ASIN"),
        F.col("l_returnflag").alias("question"),
        F.when(
            F.col("l_quantity") <= 45,
            F.concat_ws(" ", "l_linestatus", F.col("l_quantity").cast("bigint").cast("string")),
        ).alias("candidate"),
        (F.col("l_linenumber") % 3).cast("bigint").alias("source_rank"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos"),
    )


def answers(t: Tables) -> DataFrame:
    status = F.col("o_orderstatus")
    return t.orders.select(
        F.col("o_orderkey").alias("ASIN"),
        F.when(status == "F", F.lit("R")).when(status == "O", F.lit("N")).otherwise(F.lit("A")).alias("question"),
        F.col("o_orderpriority").alias("answer"),
        status.alias("split"),
    )


EVIDENCE = """evidence AS (
    SELECT l_orderkey AS ASIN, l_returnflag AS question,
        CASE WHEN l_quantity <= 45 THEN l_linestatus || ' ' || l_quantity::BIGINT::VARCHAR END
            AS candidate,
        (l_linenumber % 3)::BIGINT AS source_rank, l_orderkey * 8 + l_linenumber AS pos
    FROM lineitem),
answers AS (
    SELECT o_orderkey AS ASIN,
        CASE o_orderstatus WHEN 'F' THEN 'R' WHEN 'O' THEN 'N' ELSE 'A' END AS question,
        o_orderpriority AS answer, o_orderstatus AS split
    FROM orders)"""


def tagged(t: Tables) -> DataFrame:
    """Documents as tagged sentences: a capitalized word begins an entity, the word behind
    it goes on; tags fit the words only where the text has an even number of them."""
    rows = spread(t.documents.select("doc_id", "text"), "doc_id").select(
        "doc_id", "text", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("_words")
    )
    before = F.concat(
        F.array(F.lit("")), F.slice("_words", 1, F.greatest(F.size("_words") - 1, F.lit(0)))
    )
    tags = F.zip_with("_words", before, _tag)
    fitting = F.size("_words") % 2 == 0
    return rows.select(
        "doc_id",
        "text",
        F.when(fitting, tags).otherwise(F.concat(tags, F.array(F.lit("O")))).alias("tag"),
    )


def _kind(word):
    return F.when(F.length(word) % 2 == 0, F.lit("X")).otherwise(F.lit("Y"))


def _tag(word, before):
    return (
        F.when(word.rlike(r"^\p{Lu}"), F.concat(F.lit("B-"), _kind(word)))
        .when(before.rlike(r"^\p{Lu}"), F.concat(F.lit("I-"), _kind(before)))
        .otherwise(F.lit("O"))
    )


def _sql_tag(word: str, before: str) -> str:
    return f"""CASE WHEN regexp_matches({word}, '^\\p{{Lu}}')
            THEN 'B-' || CASE WHEN length({word}) % 2 = 0 THEN 'X' ELSE 'Y' END
        WHEN regexp_matches(coalesce({before}, ''), '^\\p{{Lu}}')
            THEN 'I-' || CASE WHEN length({before}) % 2 = 0 THEN 'X' ELSE 'Y' END
        ELSE 'O' END"""


TAGGED = f"""worded AS (
    SELECT doc_id, text, regexp_extract_all(text, '{WORD}') AS words FROM documents),
tagged AS (
    SELECT doc_id, text, words,
        list_transform(words, lambda w, i: {_sql_tag("w", "words[i - 1]")})
            || CASE WHEN len(words) % 2 = 0 THEN []::VARCHAR[] ELSE ['O'] END AS tag
    FROM worded)"""

_PLAIN = r"[\p{L}\p{N}_]+"


def recognized(t: Tables) -> DataFrame:
    """Documents as entity recognition output: ``output`` has the tags of the words,
    ``model_output`` misses words of some lengths, and the last word of some texts."""
    rows = spread(t.documents.select("doc_id", "text"), "doc_id").select(
        "doc_id", F.regexp_extract_all("text", F.lit(_PLAIN), F.lit(0)).alias("_words")
    )
    before = F.concat(
        F.array(F.lit("")), F.slice("_words", 1, F.greatest(F.size("_words") - 1, F.lit(0)))
    )
    true = F.zip_with("_words", before, lambda w, b: F.concat(w, F.lit(", "), _tag(w, b)))
    found = F.zip_with(
        "_words",
        before,
        lambda w, b: F.concat(
            w, F.lit(", "), F.when(F.length(w) % 7 == 0, F.lit("O")).otherwise(_tag(w, b))
        ),
    )
    size = F.size("_words")
    found = F.when(size % 10 == 0, F.slice(found, 1, F.greatest(size - 1, F.lit(0)))).otherwise(found)
    return rows.select(
        "doc_id",
        F.array_join(true, " ").alias("output"),
        F.array_join(found, " ").alias("model_output"),
    )


RECOGNIZED = f"""plain AS (
    SELECT doc_id, regexp_extract_all(text, '{_PLAIN}') AS words FROM documents),
recognized AS (
    SELECT doc_id,
        array_to_string(list_transform(words,
            lambda w, i: w || ', ' || {_sql_tag("w", "words[i - 1]")}), ' ') AS output,
        array_to_string(list_transform(
            CASE WHEN len(words) % 10 = 0 THEN words[1:len(words) - 1] ELSE words END,
            lambda w, i: w || ', ' || CASE WHEN length(w) % 7 = 0 THEN 'O'
                ELSE {_sql_tag("w", "words[i - 1]")} END), ' ') AS model_output
    FROM plain)"""
