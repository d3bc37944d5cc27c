"""The registered queries of this package: one per operator, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from instructset.llm import (
    bpe,
    clustering,
    fingerprint,
    langid,
    lmscore,
    neardup,
    oracles,
    packing,
    pages,
    quality,
    repair,
    simple8b,
    substring,
    tokencounts,
)
from instructset.llm.common import prepare, table, texts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {
    "op2_neardup": oracles.NEAR_DUPLICATES,
    "op3_substrings": oracles.SUBSTRINGS,
    "op12_clusters": oracles.CLUSTERS,
    "op13_conversations": oracles.CONVERSATIONS,
}


def query(run: Query) -> Query:
    def prepared(spark: SparkSession, folder: str) -> DataFrame:
        prepare(spark)
        return run(spark, folder)

    QUERIES[run.__name__] = prepared
    return run


@query
def op1_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    trees = langid.train(docs.where(~langid.held_out()))
    found = langid.predict(texts(docs), trees)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "bits")


@query
def op2_neardup(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, folder, "documents"), k=3, percent=85)


@query
def op3_substrings(spark: SparkSession, folder: str) -> DataFrame:
    found = substring.dedup(texts(table(spark, folder, "documents")))
    return found.select("doc_id", "_removal.*", F.sha2("text", 256).alias("kept_sha256"))


@query
def op4_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = texts(table(spark, folder, "documents"))
    model = quality.fit(docs, table(spark, folder, "labels"))
    return quality.judge(docs, model).select("doc_id", "_quality.*")


@query
def op5_main_text(spark: SparkSession, folder: str) -> DataFrame:
    found = pages.extract(table(spark, folder, "pages").select("page_id", "url", "html"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


@query
def op6_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    docs = lmscore.with_trust(texts(table(spark, folder, "documents")), table(spark, folder, "labels"))
    return lmscore.scored(docs)


@query
def op7_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprint.edited_pairs(texts(table(spark, folder, "documents")))


@query
def op8_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = texts(table(spark, folder, "documents"))
    # JSON writes the ids into one buffer; in an array of strings each would be objects for the collector.
    json = F.to_json("ids")
    digest = F.sha2(json.substr(F.lit(2), F.length(json) - 2), 256)
    encoded = bpe.encode(docs, path, keep=False)
    digested = encoded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"))
    both = bpe.decode(digested, path, keep=False)
    return both.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(table(spark, folder, "documents"), path, digests=True)


@query
def op10_token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    files = simple8b.write_ids(table(spark, folder, "documents"), path)
    return simple8b.read_documents(spark, files, digests=True)


@query
def op11_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = texts(table(spark, folder, "documents"))
    counted = tokencounts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), limit=1024)
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


@query
def op12_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return clustering.clusters(table(spark, folder, "embeddings").select("vec_id", "embedding"))


@query
def op13_conversations(spark: SparkSession, folder: str) -> DataFrame:
    given = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return repair.repair_report(repair.pieces_of(repair.damaged(given), given))
