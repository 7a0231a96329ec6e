"""Corpus pipeline: toxic documents go, near-duplicates leave one, repeated strings go, personal data is replaced, the
rest is packed into sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written as Parquet and read again
as the next one's documents, so each stage starts from a table that survives the loss of any executor. All stages but
the last return the columns of `documents`; n_chars follows the text. Tables that a stage wrote on its way are removed
once its result is written.

Defined results: a null text is an empty one; texts are read whole, whatever their length; of rows that tie (equal ids in
a group of near-duplicates, pieces of equal length) each operator's docstring says which comes first; repeated rows are
near-duplicates of each other, so one stays; an empty table gives an empty result; further columns stay up to the last
stage, whatever their names; ids are cast to long.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.llm import packing, pii, simhash, suffix_dedup, toxicity
from revlens.llm.common import table
from revlens.plans.durable import settled


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles, Jaccard similarity of 0.8 or more."""
    return simhash.keep_one(docs)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every repeated string of 200 bytes goes; the documents stay."""
    return _counted(suffix_dedup.strip(docs))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and terms that disclose it are replaced by their kind; the documents stay."""
    return _counted(pii.sanitise(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their places in the training sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("simhash", simhash_stage),
    ("suffix_dedup", suffix_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: A trained classifier, fingerprints and a tokenizer are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    own: list[DataFrame] = []  # the stage's input, if it is a table of ours, goes with its intermediate tables
    for _, stage in STAGES[:-1]:
        docs = settled(partial(stage, spark, docs, sf_dir), *own)
        own = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
