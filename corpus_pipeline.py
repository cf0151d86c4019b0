"""From raw documents to token counts in five stages.

Each stage takes what its predecessor kept, stored as Parquet, and all but the last return the columns of ``documents``. Rows with
null text or without a letter are rejected by language identification; nulls in other columns pass through every stage; an empty
table gives an empty result.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import byte_bpe, exact_dedup, language_id, mixing, simhash
from plumbline.llm.queries import SEED, VOCABULARY, WEIGHTS, source_tree
from plumbline.session import checkpoint_dir

SHARE = 0.8  # of the tokens that reach the mixture
EPOCHS = 1  # no document is repeated


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled documents that are not held out and rejects those whose language is undetermined."""
    model = language_id.train(docs.where(~language_id.held_out(F.col("doc_id"))))
    return language_id.accepted(docs, model)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of equal texts."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each SimHash component."""
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps each source's seeded prefix under its budget."""
    return mixing.mix(docs, source_tree(), WEIGHTS, SHARE, EPOCHS, SEED).drop("__copies")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document: ``doc_id, n_tokens, ids_sha256, decoded_sha256``."""
    return byte_bpe.round_trip(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("simhash", drop_near_copies),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]
ORACLE_SQL = None  # language identification and encoding are beyond SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written under the shared checkpoint folder and read again."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
    return docs
