"""Cleaning, filtering, labelling and output lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.catalog.common import (
    CHOSEN, CLEAN_MOVIE_NEG, CLEAN_MOVIE_POS, CLEAN_NEWSGROUPS, CLEAN_REVIEWS, DOCUMENTS, GIVEN_SPLIT, LANGS,
    documents, given_split, sql_list, table,
)
from corpusloom.functions.labels import fold_number, svmlight_label, text_line
from corpusloom.functions.text import clean_text, drop_empty, strip_message_parts
from corpusloom.operators import corpus


def _clean(preset):
    return lambda spark, sf: clean_text(table(spark, sf, "documents").select("doc_id", "text"), preset=preset)


def _clean_sql(expr):
    return f"SELECT doc_id, {expr} AS text FROM documents"


# What marks a quoted line, as the oracle's pattern.
_QUOTE = "(writes in|writes:|wrote:|says:|said:|^In article|^Quoted from|^\\||^>)"


def _strip_sql(rows, headers=True):
    body = "CASE WHEN instr(text, chr(10) || chr(10)) > 0 THEN substr(text, instr(text, chr(10) || chr(10)) + 2) ELSE '' END"
    return f"""
WITH m AS ({rows}),
h AS (SELECT * REPLACE ({body if headers else 'text'} AS text) FROM m),
q AS (SELECT * REPLACE (array_to_string(list_filter(string_split(text, chr(10)),
                        lambda l: NOT regexp_matches(l, '{_QUOTE}')), chr(10)) AS text) FROM h),
s AS (SELECT *, string_split(trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)), chr(10)) AS lines FROM q),
f AS (SELECT *, list_position(list_reverse(list_transform(lines,
                lambda l: regexp_matches(l, '^\\s*-*\\s*$'))), true) AS back FROM s)
SELECT * EXCLUDE (lines, back) REPLACE (
    CASE WHEN back > 0 AND len(lines) > back THEN array_to_string(lines[1:len(lines) - back], chr(10))
         ELSE text END AS text) FROM f"""


def _category_filter(spark, sf):
    docs = documents(spark, sf)
    train = corpus.select_categories(docs.where("subset = 'train'"), CHOSEN)
    return train.select("doc_id", "category", "text")


def _category_label(spark, sf):
    labelled = corpus.label_categories(documents(spark, sf), ("fr", "en", "de"), LANGS)
    return labelled.select("doc_id", "category", F.col("label").cast("bigint").alias("label"))


def _complement(spark, sf):
    return corpus.complement_categories(documents(spark, sf), CHOSEN, LANGS).select("doc_id", "category", "text")


def _docid_offsets(spark, sf):
    """In input order, which is that of the ids in the table."""
    docs = given_split(documents(spark, sf, as_read=True)).select(F.col("doc_id").alias("row_id"), "split", "text")
    numbered = corpus.assign_doc_ids(docs, "split", ("train", "test", "unsup"))
    return drop_empty(numbered).select("row_id", "split", "doc_id")


def _binary_flag(spark, sf):
    docs = documents(spark, sf)
    chosen, all_of_them = (corpus.is_binary(corpus.label_categories(docs, c, LANGS)) for c in (CHOSEN, LANGS))
    return chosen.unionByName(all_of_them)


def _svmlight_label(spark, sf):
    docs = corpus.label_categories(given_split(documents(spark, sf)), LANGS, LANGS)
    label = F.when(F.col("split") != "unsup", F.col("label"))
    return docs.select(
        "doc_id",
        svmlight_label(label).alias("many"),
        svmlight_label(F.when(label <= 1, label), True).alias("two"),
    )


QUERIES = {
    "clean_newsgroups": (_clean("newsgroups"), _clean_sql(CLEAN_NEWSGROUPS)),
    "clean_reviews": (_clean("reviews"), _clean_sql(CLEAN_REVIEWS)),
    "clean_movie_neg": (_clean("movie_neg"), _clean_sql(CLEAN_MOVIE_NEG)),
    "clean_movie_pos": (_clean("movie_pos"), _clean_sql(CLEAN_MOVIE_POS)),
    "strip_message": (
        lambda spark, sf: strip_message_parts(table(spark, sf, "documents").select("doc_id", "text")),
        _strip_sql("SELECT doc_id, text FROM documents"),
    ),
    "strip_message_turns": (
        lambda spark, sf: strip_message_parts(table(spark, sf, "conversations").select("conv_id", "turn", "role", "text"), headers=False),
        _strip_sql("SELECT conv_id, turn, role, text FROM conversations", headers=False),
    ),
    "drop_empty": (
        # The first number of each text; texts without one have an empty string.
        lambda spark, sf: drop_empty(table(spark, sf, "documents").select("doc_id", F.regexp_extract("text", "[0-9]+", 0).alias("text"))),
        "SELECT doc_id, regexp_extract(text, '[0-9]+') AS text FROM documents WHERE regexp_matches(text, '[0-9]+')",
    ),
    "src_category_filter": (
        _category_filter,
        f"SELECT doc_id, category, text FROM ({DOCUMENTS}) WHERE subset = 'train' AND category IN ({sql_list(CHOSEN)})",
    ),
    "src_category_label": (
        _category_label,
        "SELECT doc_id, lang AS category, CAST(CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 ELSE 2 END AS BIGINT) AS label "
        "FROM documents WHERE lang IN ('en', 'de', 'fr')",
    ),
    "unsup_complement": (
        _complement,
        f"SELECT doc_id, lang AS category, text FROM documents WHERE lang IN ({sql_list(LANGS)}) AND lang NOT IN ({sql_list(CHOSEN)})",
    ),
    "fold_assign": (
        lambda spark, sf: table(spark, sf, "documents").select("doc_id", fold_number("doc_id").cast("bigint").alias("fold")),
        "SELECT doc_id, CAST(floor(doc_id / 100) AS BIGINT) AS fold FROM documents",
    ),
    "docid_offsets": (
        _docid_offsets,
        f"""WITH p AS (SELECT doc_id AS row_id, split, text,
                  row_number() OVER (PARTITION BY split ORDER BY doc_id) - 1 AS position FROM ({GIVEN_SPLIT})),
            n AS (SELECT count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'test') AS n_test FROM p)
            SELECT row_id, split, CAST(position + CASE split WHEN 'train' THEN 0 WHEN 'test' THEN n_train
                   ELSE n_train + n_test END AS BIGINT) AS doc_id FROM p, n WHERE length(text) > 0""",
    ),
    "binary_flag": (
        _binary_flag,
        f"""SELECT count(DISTINCT lang) AS n_labels, count(DISTINCT lang) = 2 AS is_binary FROM documents WHERE lang IN ({sql_list(CHOSEN)})
            UNION ALL SELECT count(DISTINCT lang), count(DISTINCT lang) = 2 FROM documents""",
    ),
    "svmlight_label": (
        _svmlight_label,
        f"""SELECT doc_id, CASE WHEN l IS NULL THEN '0' ELSE CAST(l + 1 AS VARCHAR) END AS many,
                   CASE WHEN l = 0 THEN '-1' WHEN l = 1 THEN '+1' ELSE '0' END AS two
            FROM (SELECT doc_id, CASE WHEN split <> 'unsup' THEN CASE category WHEN 'en' THEN 0 WHEN 'de' THEN 1
                  WHEN 'es' THEN 2 WHEN 'fr' THEN 3 END END AS l FROM ({GIVEN_SPLIT}))
            """,
    ),
    "text_export": (
        lambda spark, sf: clean_text(table(spark, sf, "documents").select("doc_id", "text")).select(
            "doc_id", text_line("doc_id").alias("line")
        ),
        f"SELECT doc_id, concat('_*', doc_id, ' ', {CLEAN_REVIEWS}) AS line FROM documents",
    ),
}
