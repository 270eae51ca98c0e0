"""A corpus in five stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import bagminhash, decontamination, mixing, quality_rules, substring_dedup
from cairn.llm.words import free_names, set_aside
from cairn.sources.tables import scratch, table


COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def carrying(stage: Stage) -> Stage:
    """A stage that hands other columns than those of ``documents`` through, whatever their names."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        docs, restored = set_aside(docs, [c for c in docs.columns if c not in COLUMNS])
        return restored(stage(spark, docs, sf_dir))

    return run_stage


@carrying
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without their frequent lines; ``n_chars`` follows the text.

    Null, empty and short texts fail the rules and go. Repeated rows stay or go together and don't make their lines
    frequent; very long texts are treated alike. No documents give none.
    """
    ruled = quality_rules.quality_rules(docs).where("kept")
    n_chars = F.when(F.col("n_removed_words") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return ruled.withColumns({"text": F.col("kept_text"), "n_chars": n_chars}).select(*docs.columns)


@carrying
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates, the document with the least id.

    Documents with a null id, a null text or no word are in no class and stay; rows that repeat an id stay or go together, for it
    names one document. Texts of any length are compared whole. No documents give none.
    """
    classes = bagminhash.near_duplicates(docs.select("doc_id", "text"))
    others = classes.where("doc_id <> class_id").select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(*docs.columns)


@carrying
def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has; those of which no word is left go.

    A document that loses nothing keeps its text as it is, null or empty ones too; ``n_chars`` follows the text. Rows of
    one id lose the same passages and none to each other; a null id neither loses nor is a source. Very long texts are
    treated alike. No documents give none.
    """
    (whole,) = free_names(docs, "_whole")
    cut = substring_dedup.remove_repeats(docs.withColumn(whole, F.col("text")))
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col(whole))
    left = cut.where("n_removed = 0 or n_removed < n_words").withColumn("text", text)
    return left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


@carrying
def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark.

    Null and empty texts have none and stay, repeated rows stay or go together, very long texts are scanned whole. No
    documents give none, an empty benchmark keeps all.
    """
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


@carrying
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's rate says, with the number of the ``copy``.

    Null and empty texts have no words and follow their source's rate; null is a source. Repeated rows are drawn alike,
    each for itself; a very long text is one document. No documents give none.
    """
    return mixing.mix_sources(docs)


STAGES = [
    ("quality rules", quality),
    ("minhash near-dedup", near_dedup),
    ("substring dedup", passages),
    ("benchmark decontamination", benchmarks),
    ("mixing to target weights", mixed),
]

#: SQL can't express the signatures of the second stage; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch(spark) as keep:  # what a stage stored on its way isn't needed once its rows are written
            docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
