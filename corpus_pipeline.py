"""The corpus pipeline: five stages from raw documents to packed token sequences.

quality: documents that the quality classifier scores under 0.3 go. exact dedup: of texts that are equal without white
space, one row stays. SimHash near-dedup: of every group that a five-word Jaccard similarity of 0.8 or more links, the
document with the smallest id stays; candidates come from SimHash fingerprints within 3 bits, and, as similar texts can differ
in more, from a prefix join that misses no pair; all are verified. suffix dedup: strings of 100 bytes that start earlier are cut from the
texts, and texts that are cut to nothing go. packing: what is left is packed into sequences of 1024 tokens.

A stage reads what its predecessor kept as a Parquet table, so a lost executor costs a task and not a stage. All stages but
the last return the columns of `documents`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriloom.llm._base import importable, mark, sweep, table, written
from veriloom.llm.lsm import drop_exact_duplicates
from veriloom.llm.packing import packed_documents
from veriloom.llm.quality import THRESHOLD, fit_texts, score
from veriloom.llm.shingles import drop_near_copies
from veriloom.llm.suffix import remove_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    importable(spark)
    into = "score" + "_" * max(map(len, docs.columns), default=0)  # no column's name
    return score(docs, fit_texts(docs, table(spark, sf_dir, "labels")), into=into).where(F.col(into) >= THRESHOLD).drop(into)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_copies(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """n_chars follows the text that is left."""
    had = "had" + "_" * max(map(len, docs.columns), default=0)  # no column's name
    cut = remove_repeats(docs.withColumn(had, F.length("text") > 0)).where(~F.coalesce(had, F.lit(False)) | (F.length("text") > 0))
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("exact dedup", exact_dedup),
    ("SimHash near-dedup", near_dedup),
    ("suffix-array dedup", suffix_dedup),
    ("best-fit packing", packing),
]

#: SQL can express neither the trained classifier nor the fingerprints; tests/llm holds run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; a stage's own tables and its input go once its result is written."""
    docs, began = table(spark, sf_dir, "documents"), mark()
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        sweep(spark, began, keep=1)
    return docs
