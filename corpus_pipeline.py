"""The corpus pipeline: score, deduplicate lines and documents, decontaminate, pack.

All stages take nulls in any column, repeated rows, empty and very long texts, tables without rows and further columns of any name, which
come out as they went in. Rows with a null text have no lines, words or classes: only the classifier can drop them, and they pack as one
end token. Rows with a null id come first in every order and are judged by their text. Rows that repeat in id and text lose the same
lines; of these, and of near-duplicates, one stays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import materialize, table
from cadenza.llm.decontaminate import find_contamination
from cadenza.llm.line_dedup import dedup_lines
from cadenza.llm.packing import pack
from cadenza.llm.probminhash import keep_representatives
from cadenza.llm.quality_model import score_quality
from cadenza.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    scored = score_quality(docs, table(spark, sf_dir, "labels"))
    return scored.where("predicted = 1").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated lines; a document goes if nothing but repeated lines was in it."""
    kept = dedup_lines(docs).where("n_removed = 0 or n_removed < n_lines")
    return kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return keep_representatives(docs).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of the benchmark."""
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"), remove=True)
    n_chars = F.when(F.size("hit_spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return found.withColumn("n_chars", n_chars).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences."""
    return pack(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality),
    ("line_dedup", lines),
    ("near_dedup", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: No SQL can say what a fitted network, a hash signature or a tokenizer decides; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
