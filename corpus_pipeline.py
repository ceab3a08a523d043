"""The corpus pipeline: each stage works on all that its predecessor kept, written as Parquet and read again in between.

All stages but the last return the columns of documents. Language identification lets go what has no known language,
the two deduplications what repeats a text that stays, mixing what the mix doesn't take; a document that the mix takes more than
once gives a row for each pass. The last stage returns each row's token ids and their digests.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strictbefore.llm import bpe, exact_dedup, lang_id, mixing, near_copies
from strictbefore.llm.common import materialise, trim


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    net = lang_id.learn(docs)
    trim()  # training is over, and what it took on the driver isn't needed any more
    return lang_id.keep_known(docs, net)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select(
        F.col("id").alias("doc_id"),
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        "ids",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language ID", known_language),
    ("exact dedup", drop_exact_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing sources", mix_sources),
    ("BPE", encode),
]

#: A trained network, fingerprints over hashes that DuckDB lacks and a tokeniser have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES):
            docs = materialise(docs, name.replace(" ", "-"))
    return docs
