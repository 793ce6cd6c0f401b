"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dwell.llm import imatch, language, leaks, lines, packing, simhash, substrings, tokens, toxicity, urls
from dwell.sources.tables import read_table as table


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_classes(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = language.train(documents.where(~language.held_out()), per_language=2000)
    named = language.identify(documents, model)
    return named.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("print")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.drop_repeats(table(spark, sf_dir, "documents"), window=20)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), run=3)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.suffix_sums(tokens.length_histogram(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(urls.RULES, "verdict string, host string, path string")
    return urls.judge_urls(table(spark, sf_dir, "pages"), rules)


def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return imatch.fingerprint_edits(documents, imatch.lexicon(documents))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.with_digest(packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = toxicity.train(documents.where(~toxicity.held_out()), table(spark, sf_dir, "labels"), per_class=3000)
    scored = toxicity.score(documents, model, threshold=0.7)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted", "spans")


QUERIES = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_language_id": op2_language_id,
    "op3_decontamination": op3_decontamination,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_line_dedup": op5_line_dedup,
    "op6_token_counts": op6_token_counts,
    "op7_url_filters": op7_url_filters,
    "op8_document_fingerprints": op8_document_fingerprints,
    "op9_packing": op9_packing,
    "op10_toxicity": op10_toxicity,
}
ORACLE_SQL = {
    "op4_substring_dedup": substrings.SQL.format(window=20),
    "op5_line_dedup": lines.SQL.format(run=3),
    "op7_url_filters": urls.SQL,
}
