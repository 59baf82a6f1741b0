"""A corpus pipeline over the document table: filter, deduplicate, decontaminate, mix, write tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last return the
columns of documents; the last returns a row for each document of the token files.

Rows with nulls in any column pass through: a null text counts as empty, is not toxic, has no near copies and no benchmark
passage. A row without an id is never dropped. Rows that repeat an id and a text share every decision. Columns beyond those of
documents are kept, whatever their names. An empty table gives an empty result at every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrashift.llm import decontaminate, mixing, near_dedup, token_store, toxicity
from terrashift.llm.common import crc_mod, cut, table
from terrashift.session import ship


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar scores under 0.5; learned from labelled rows outside the held-out fifth."""
    ship(spark)
    labels = table(spark, sf_dir, "labels").where(crc_mod(F.col("doc_id"), 5) != 0)
    return toxicity.drop_toxic(docs, toxicity.fit(docs, labels))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group; documents without an id stay."""
    ship(spark)
    groups = near_dedup.near_groups(docs)
    gone = groups.where("not kept").select(F.col("doc_id").alias("_gone_id")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone_id"], "left_anti")


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, neither literally nor with its numbers, names and units replaced."""
    ship(spark)
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once; small sources up to a quarter more often."""
    ship(spark)
    return mixing.mixed(docs, mixing.MixSpec(max_repeats=1.25))


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in ascending doc_id order, reported from what was read back; a document that the mix repeats is written again."""
    ship(spark)
    return token_store.token_digest(docs, token_store.TokenSpec(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", keep_one_of_near_copies),
    ("decontaminate", drop_benchmark_leaks),
    ("mix", mix_sources),
    ("tokens", write_tokens),
]

#: Learned scores, signatures, bisection and byte-pair encoding have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written as Parquet and read back."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return stage_last(spark, docs, sf_dir)


def stage_last(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return cut(STAGES[-1][1](spark, docs, sf_dir), f"stage-{STAGES[-1][0]}")
