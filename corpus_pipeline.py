"""A training-data pipeline over ``documents``: quality rules, line dedup, near-dedup, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; its result is written as
Parquet and read again as the next one's docs, so a stage first removes the intermediate tables of the one
before it. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import best_fit, fuzzy_lines, minhash_odd, quality
from plumbline.llm.queries import TOKENIZERS
from plumbline.plans.scratch import Scratch, drop_all


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and are not depleted, without their hosts' boilerplate lines.

    Each such line stays in one document, so that a large group of near copies leaves one to the later stages.
    """
    return quality.clean(spark, docs, keep_first=True)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One line of each component of similar lines; documents that lose all their lines go."""
    drop_all("quality", docs)
    return fuzzy_lines.dedup_lines(spark, docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates (five-word shingles, similarity of 0.8 or more)."""
    drop_all("fuzzy-lines", docs)
    return minhash_odd.dedup(spark, docs, percent=80)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 4096 tokens."""
    drop_all("near-duplicates", docs)
    return best_fit.pack(spark, docs, f"{TOKENIZERS}/word_bpe_49k.json")


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("packing", packing)]

#: Tokenisation and MinHash are beyond SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what the last one returns."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
