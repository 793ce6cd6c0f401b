"""A training corpus from raw documents: toxicity, line repeats, near copies, leaks, then packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dwell.llm import leaks, lines, near, packing, toxicity
from dwell.llm.common import checkpointed
from dwell.sources.tables import read_table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays under 0.7."""
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"), per_class=3000)
    return toxicity.drop_toxic(docs, model, threshold=0.7)


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later repeats of three lines or of 50 words in fewer; n_chars follows the text."""
    kept = lines.drop_repeated_lines(docs, run=3, words=50)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of documents that share 0.8 of their five-word shingles."""
    return near.drop_similar(docs, width=5, similarity=0.8)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return leaks.drop_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed token sequences."""
    return packing.with_digest(packing.pack(docs, TOKENIZER))


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", cut_repeated_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("packing", pack_windows),
]

#: Stages 1, 3 and 5 can't be written as SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is materialised for the next."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
