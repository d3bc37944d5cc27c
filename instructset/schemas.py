"""Explicit input schemas; nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType()) for name in names])


PAIR = _strings("input", "output")
SCORED = _strings("input", "output", "model_output")
PROMPT_RESPONSE = _strings("prompt", "response")
CSV_PAIR = _strings("inputs", "target")
INSTRUCTION = _strings("question", "response")

PRODUCT_META = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("description", T.ArrayType(T.StringType())),
    ]
)

PRODUCT_INFO = _strings(
    "product_title",
    "product_description",
    "product_bullet_point",
    "product_brand",
    "product_color",
    "product_locale",
)

TAGGED = T.StructType(
    [
        T.StructField("description", T.StringType()),
        T.StructField("tag", T.ArrayType(T.StringType())),
    ]
)

EVIDENCE = _strings(
    "qid", "ASIN", "qa_pair_id", "question", "candidate", "label", "source", "confidence"
)
ANSWERS = _strings("ASIN", "question", "candidate", "answer", "source")

REVIEW = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("rating", T.DoubleType()),
        T.StructField("helpful_votes", T.LongType()),
        T.StructField("verified", T.BooleanType()),
        T.StructField("publication_date", T.StringType()),
    ]
)

SUMMARY = T.StructType(
    [
        T.StructField("verdict", T.StringType()),
        T.StructField("pros", T.ArrayType(T.StringType())),
        T.StructField("cons", T.ArrayType(T.StringType())),
    ]
)

REVIEWED_PRODUCT = T.StructType(
    [
        T.StructField("website_summaries", T.ArrayType(SUMMARY)),
        T.StructField("customer_reviews", T.ArrayType(REVIEW)),
    ]
)

MIXED = T.StructType(
    [
        T.StructField("pretrain_marker", T.IntegerType()),
        T.StructField("system_message", T.StringType()),
        T.StructField("prompt", T.StringType()),
        T.StructField("response", T.StringType()),
    ]
)
