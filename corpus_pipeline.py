"""The corpus pipeline: documents in, mixed and tokenised training text out.

Every stage takes (spark, docs, sf_dir) and gets all that its predecessor kept; all but the last
return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.llm import linededup, mixing, pieces, simhash, toxicity
from arbora.llm.common import fresh, shared_folder, table
from arbora.runtime import delete_on_exit


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (probability 0.5 or more) go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Aligned common blocks of lines go from the later document; every document stays, n_chars follows its text."""
    out = linededup.dedup_lines(docs)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return simhash.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source is taken up to its target: a document stands as often as the mix takes it."""
    mixed = mixing.mix(docs).where("copies > 0")
    (each,) = fresh(mixed, "_copy")
    return mixed.withColumn(each, F.explode(F.sequence(F.lit(1), "copies"))).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, tokens and exact of every row.

    Tokens are decoded again; exact says whether that gives the text (a null text counts as empty). It does
    unless the text holds U+2581, which the format keeps for spaces.
    """
    text = F.xxhash64(F.coalesce("text", F.lit(""))).alias("_hash")  # the text itself need not come back from the encoder
    both = pieces.encode_column(docs.select("doc_id", "source", "text", text), decoded=True, keep=["doc_id", "source", "_hash"])
    return both.select("doc_id", "source", F.size("tokens").alias("n_tokens"), "tokens", (F.col("decoded_hash") == F.col("_hash")).alias("exact"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: Hashes, trees and merges are not expressible in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet to the shared folder, which is deleted with the session, and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    delete_on_exit(spark, folder)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{i}_{name}")
            docs = spark.read.parquet(f"{folder}/{i}_{name}")
    return docs
