"""A corpus pipeline of the subpackage ``llm``: each stage reads what the one before it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import bpe, crf, mixing, simhash
from corpusloom.llm.catalog import byte_bpe_path
from corpusloom.llm.common import bound_batches, table
from corpusloom.session import materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier rejects go."""
    bound_batches(spark)
    model = crf.fit(docs, table(spark, sf_dir, "labels"))
    return crf.classify(docs, model, COLUMNS).where("predicted = 1").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    bound_batches(spark)
    return simhash.keep_first(docs).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of its source takes it: a row per copy, none for those left out."""
    return mixing.mix(docs).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every row that the mix holds, encoded and decoded back."""
    bound_batches(spark)
    return bpe.round_trip(docs, byte_bpe_path())


STAGES = [("quality", quality), ("simhash_dedup", near_duplicates), ("mixing", mixed), ("bpe", encoded)]

ORACLE_SQL = None  # a learnt model, fingerprints and tokenizer output are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over all documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
