"""The corpus pipeline: from documents to token files in five stages.

A stage takes (spark, docs, sf_dir) and returns a table, which is written as Parquet and read again as the next
stage's docs. ``run`` applies all of them to the documents.

Every stage takes rows with NULL keys and texts, empty and very long texts, repeated rows, empty tables, and further
columns of any name; what becomes of them is said at each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowquarry.llm.decontamination import decontaminate
from flowquarry.llm.jaccard_join import drop_near_duplicates
from flowquarry.llm.mixing import fit_domains, mix, plan_mixture, quality_domains
from flowquarry.llm.registry import table
from flowquarry.llm.token_store import store_digest
from flowquarry.llm.toxicity import drop_toxic, fit_toxicity
from flowquarry.session import settle

# Targets near what such corpora hold; as every document stays at least once, they are met by repeating others.
WEIGHTS = {"en": 0.50, "de": 0.15, "fr": 0.15, "es": 0.12, "low": 0.08}


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic. The model is fitted on the labelled documents among them.

    NULL and empty texts are never toxic. Repeated rows share their verdict; texts are read whole. Without labels of both
    kinds nothing goes.
    """
    return drop_toxic(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest doc_id; of rows that repeat it, one.

    Texts without words are duplicates of nothing and stay all. NULL keys come after all others.
    """
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages. NULL and empty texts hold none; repeated rows share their verdict."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that the domains' tokens have the target weights; each stays at least once.

    Documents without tokens stay once. Repeated rows are repeated alike.
    """
    model = fit_domains(docs, quality_domains(docs, table(spark, sf_dir, "labels")), F.col("domain"), list(WEIGHTS))
    return mix(docs, plan_mixture(docs, model, WEIGHTS, size=None, low=1.0))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token store's documents as read back: doc_id, start, n_tokens, ids_crc32.

    A NULL text has the end id only; NULL keys come first, rows of one key in the order of their texts.
    """
    return store_digest(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("tokens", tokens),
]

#: SQL can express neither the fitted models nor the tokenizer; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
