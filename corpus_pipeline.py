"""Corpus pipeline: documents through five stages of the corpus operators.

Each stage takes what the one before it kept. Labels are only read by the first stage, to learn from.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.llm import neardup, packing, secrets, substrings, toxicity
from tidecast.llm.common import stored


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half."""
    machine = toxicity.learned(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs, machine, column="_toxicity")
    return scored.where("_toxicity < 0.5").select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: five words, similarity 0.8; the smallest id stays.

    Of rows that repeat an id and a text one stays. An id on several texts is judged text by text: its row goes
    if the component of that text has a smaller id. Rows without an id stay.
    """
    groups = neardup.groups(docs.withColumn("_text", F.xxhash64("text")), words=5, percent=80, keep=["_text"])
    kept = stored(groups.where("kept AND doc_id IS NOT NULL").groupBy("doc_id", "_text").agg(F.count("*").alias("_rows")))
    tagged = docs.withColumn("_text", F.xxhash64("text")).join(kept, ["doc_id", "_text"], "left")
    made = tagged.where("_rows = 1 OR doc_id IS NULL")
    again = tagged.where("_rows > 1").dropDuplicates(["doc_id", "_text"])
    if not kept.where("_rows > 1").isEmpty():  # without such rows there is nothing to add
        made = made.unionByName(again)
    return made.select(*docs.columns)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that a document with a smaller id holds; `n_chars` follows the text."""
    cleaned = substrings.remove(docs)
    length = F.when(F.col("_n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cleaned.withColumn("n_chars", length).select(*docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every secret masked; `n_chars` follows the text."""
    length = F.when(F.col("text") != F.col("_text"), F.length("text").cast("long")).otherwise(F.col("n_chars"))
    masked = secrets.redact(docs.withColumn("_text", F.col("text")))
    return masked.withColumn("n_chars", length).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", without_toxic),
    ("near_copies", without_near_copies),
    ("repeated_passages", without_repeated_passages),
    ("secrets", without_secrets),
    ("packing", packed),
]

# A learned model and signature orders are no SQL; the stages are tested against plain versions instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each stage is stored before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
