"""From raw documents to packed training sequences: five stages, each over all that the one before kept.

Every stage but the last returns the columns of ``documents``. Rejected documents
go, near duplicates leave one document of each group, repeated passages stay where
they stand first, live-looking secrets are masked, and what is left is packed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from warraq.llm.common import saved
from warraq.llm.ngram_join import keep_one
from warraq.llm.packing import pack_documents
from warraq.llm.quality import keep_documents
from warraq.llm.registry import BPE_50K
from warraq.llm.repeats import remove_repeats
from warraq.llm.secrets import redact


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the current policy."""
    return keep_documents(docs, "v1")


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by word 5-shingles at a Jaccard similarity of 0.8 or more: that of the least id."""
    return keep_one(docs, size=5, num=8, den=10)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of 200 bytes or more that stand earlier, in the order of document ids."""
    return remove_repeats(docs, length=200, keep="first")


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with secrets of few owners masked; widely copied examples stay."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens."""
    return pack_documents(docs, BPE_50K, memo=80_000)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("suffix_array_dedup", suffix_array_dedup),
    ("secret_scans", secret_scans),
    ("packing", packing),
]

#: SQL expresses neither the joins on similarity nor the suffix arrays; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that the stages leave of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
