"""A corpus pipeline of five stages; each is written as Parquet and read again by the next."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm import op7_quality, op9_exact, op10_langid
from recordloom.llm.op3_packing import pack_documents
from recordloom.llm.op6_jaccard import near_duplicates
from recordloom.operators.storage import materialize
from recordloom.shipping import shipped


#: Parts of texts whose ids a Python worker keeps in the last stage; its workers also hold what earlier stages left.
KEPT_PARTS = 150_000
#: Bytes of rows sent to a Python worker at once (a longer row goes alone); by default it is 10,000 rows or 64 MiB, which
#: the JVM and the worker both hold more than once.
BATCH_BYTES = 1 << 21
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def bounded(stage: Stage) -> Stage:
    """A shipped stage in a session whose batches for Python are bounded by BATCH_BYTES, or by what the session was set to.

    Batches are cut when the frame that a stage returns is written, so the session keeps the setting.
    """

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if _BATCH_BYTES not in spark.conf.getAll:
            spark.conf.set(_BATCH_BYTES, str(BATCH_BYTES))
        return stage(spark, docs, sf_dir)

    return shipped(run)


@bounded
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that fail the base rules or the likelihood ratio.

    A null or empty text fails the base rules. A very long one is counted whole; repeated rows and
    ties are judged alike, a null id is never trusted, other columns stay as they are, and an empty
    table stays empty.
    """
    return op7_quality.kept_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@bounded
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in no learned language: without letters, or too far from every profile.

    A null or empty text has no letter and goes. Null languages and ids are not learned from. A very
    long text is profiled whole; repeated rows and ties are judged alike, other columns stay as they
    are, and an empty table stays empty.
    """
    found = op10_langid.profiles(docs)
    return op10_langid.kept_documents(docs, found, op10_langid.farthest(docs, found))


@bounded
def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave one row of equal texts, that of the largest doc_id.

    Null and empty texts are equal. Of rows that repeat both id and text one stays; a null id never
    beats another. A very long text is compared whole; columns may have any name and stay as they
    are, and an empty table stays empty.
    """
    return op9_exact.kept_documents(docs)


@bounded
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave the least doc_id of each class of near duplicates.

    Null and empty texts and those without words, and rows with a null id, are their own class and
    stay; so do all rows of the id that stays. A very long text is compared by all its shingles.
    Columns may have any name and stay as they are, and an empty table stays empty.
    """
    (kept_id,) = op9_exact.fresh_names(docs, "kept_id")
    kept = near_duplicates(docs).filter(F.col("doc_id").eqNullSafe(F.col("class_id")))
    kept = materialize(kept.select(F.col("doc_id").alias(kept_id)).distinct(), "kept-ids")
    # as many ids as documents: never broadcast
    return docs.join(kept.hint("merge"), F.col("doc_id").eqNullSafe(F.col(kept_id)), "left_semi")


@bounded
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences.

    A null or empty text is one piece, the end id. Repeated rows and equal lengths have places of
    their own, a very long text many; a null id is an id like any other, other columns are left
    out, and an empty table gives no rows.
    """
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), kept=KEPT_PARTS)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("language ID", language_id),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", near_dedup),
    ("best-fit packing", packing),
]

#: None: SQL can't express the likelihood ratio, the language profiles or the tokens.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
