"""Corpus pipeline: language ID, near-dedup, decontamination, mixing, token output.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's ``docs``. All but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselight.llm import decontaminate, langid, minhash, mixing, token_store
from tesselight.llm.common import fresh, table, written

#: A prediction is a rejection if, against a code of no language, it is this unlikely.
LEAST_SCORE = 0.1


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the classifier knows."""
    return langid.known(docs, langid.train(docs), LEAST_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest doc_id.

    Rows that share a doc_id are one document and stay or go together.
    """
    name = fresh(docs, "kept_id")
    kept = minhash.groups(docs).where("kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col(name)), "left_semi")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: documents repeated, left out or cut at the budget."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token store's documents, read back from its files."""
    return token_store.write(docs).read(ids=False)


STAGES = [
    ("language_id", language),
    ("near_dedup", near_duplicates),
    ("decontamination", decontaminated),
    ("mixing", mix),
    ("token_output", tokens),
]

#: Learned statistics and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
