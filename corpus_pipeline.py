"""A corpus pipeline of five operators, each stage written and read again before the next.

Toxic documents go, then documents of low quality, then all but one of each near-duplicate group; the
rest is mixed to target weights and packed into sequences.

Defined cases, for every stage: nulls in any column are kept as they are (a null text is an empty one to the operators); repeated ids and
equal rows are documents of their own, but in the near-duplicate stage; columns beyond those of `documents`, of any name, pass
through; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm.common import materialise, read
from lamina.llm.mixing import mix
from lamina.llm.packing import pack
from lamina.llm.quality import keep_good
from lamina.llm.simhash import drop_near_duplicates
from lamina.llm.toxicity import THRESHOLD, toxicity_column


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold, row by row. Without labelled rows every score is low and all stay."""
    labels = read(spark, sf_dir, "labels")
    return docs.where(toxicity_column(docs, labels, F.col("text")) < THRESHOLD)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior of being good reaches the threshold, row by row; hosts and paths are those of what is left here."""
    return keep_good(docs, read(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, told apart by id and text: the smallest id, then the smallest hash of its text."""
    return drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; null is a source of its own."""
    return mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences; each copy of a document is one of its own."""
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("near_duplicates", drop_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL cannot express the learned stages and the fingerprints; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again but the last."""
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs, f"pipeline-{name}")
    return docs
