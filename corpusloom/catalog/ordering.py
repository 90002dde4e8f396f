"""Shuffle keys, positions, samples and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.catalog.common import (
    GIVEN_SPLIT, SEED, ceil_div, documents, given_split, given_split_sql, nested_split_sql, shuffle_hash, table,
)
from corpusloom.functions.labels import fold_number
from corpusloom.operators import sampling, splits
from corpusloom.operators.ordering import Order, shuffle_key, with_position

SAMPLE_LIMIT = 100
SHUFFLED = Order(seed=SEED)


def _ids(spark, sf):
    return table(spark, sf, "documents").select("doc_id")


def _docid_fold_export(spark, sf):
    docs = with_position(_ids(spark, sf), seed=SEED)
    return docs.select("position", F.col("doc_id").cast("string").alias("docid_line"), fold_number("doc_id").cast("string").alias("fold_line"))


_POSITION = f"row_number() OVER (ORDER BY {shuffle_hash()}, doc_id) - 1"

QUERIES = {
    "seeded_shuffle": (
        lambda spark, sf: shuffle_key(_ids(spark, sf), seed=SEED),
        f"SELECT doc_id, {shuffle_hash()} AS shuffle_key FROM documents",
    ),
    "positions": (
        lambda spark, sf: with_position(_ids(spark, sf), seed=SEED),
        f"SELECT doc_id, {_POSITION} AS position FROM documents",
    ),
    "positions_by_key": (
        lambda spark, sf: with_position(_ids(spark, sf)),
        "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS position FROM documents",
    ),
    "split_ratio": (
        lambda spark, sf: splits.split_ratio(_ids(spark, sf), (8, 2), ("train", "test"), SHUFFLED),
        f"""SELECT doc_id, CASE WHEN position < {ceil_div('n', 10)} * 8 THEN 'train' ELSE 'test' END AS split
            FROM (SELECT doc_id, {_POSITION} AS position, count(*) OVER () AS n FROM documents)""",
    ),
    "split_ratio_by_key": (
        lambda spark, sf: splits.split_ratio(_ids(spark, sf), (5, 3, 2), ("a", "b", "c")),
        f"""SELECT doc_id, CASE WHEN position < {ceil_div('n', 10)} * 5 THEN 'a'
                               WHEN position < {ceil_div('n', 10)} * 8 THEN 'b' ELSE 'c' END AS split
            FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS position, count(*) OVER () AS n FROM documents)""",
    ),
    "split_fraction": (
        lambda spark, sf: splits.split_fraction(
            table(spark, sf, "labels").where("quality + toxic = 1").select("doc_id"), (1, 1), order=SHUFFLED
        ),
        f"""SELECT doc_id, CASE WHEN position < {ceil_div('n', 2)} THEN 'train' ELSE 'test' END AS split
            FROM (SELECT doc_id, {_POSITION} AS position, count(*) OVER () AS n FROM labels WHERE quality + toxic = 1)""",
    ),
    "split_nested": (
        lambda spark, sf: splits.split_nested(_ids(spark, sf), order=SHUFFLED),
        nested_split_sql("SELECT doc_id FROM documents", f"{shuffle_hash()}, doc_id", "doc_id"),
    ),
    "split_given": (
        lambda spark, sf: splits.split_given(given_split(documents(spark, sf)).select("doc_id", "split")),
        given_split_sql(GIVEN_SPLIT, "doc_id", "doc_id"),
    ),
    "sample_per_category": (
        lambda spark, sf: sampling.sample_per_category(
            documents(spark, sf).select("doc_id", "category"), "category", SAMPLE_LIMIT, SEED
        ),
        f"""SELECT doc_id, lang AS category FROM documents
            QUALIFY row_number() OVER (PARTITION BY lang ORDER BY {shuffle_hash(tag='samp')}, doc_id) <= {SAMPLE_LIMIT}""",
    ),
    "docid_fold_export": (
        _docid_fold_export,
        f"""SELECT {_POSITION} AS position, CAST(doc_id AS VARCHAR) AS docid_line,
                   CAST(CAST(floor(doc_id / 100) AS BIGINT) AS VARCHAR) AS fold_line FROM documents""",
    ),
}
