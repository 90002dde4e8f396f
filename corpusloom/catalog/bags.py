"""Tokens, vocabularies and sparse rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.catalog.common import (
    GIVEN_SPLIT, STOP_LIST, bag_ctes, documents, feature_text, given_split, line_sql, table, tokens_sql,
)
from corpusloom.functions.labels import category_label, svmlight_line
from corpusloom.functions.text import ENGLISH_STOP_WORDS, UNICODE_TOKEN
from corpusloom.operators import bow, vectors
from corpusloom.operators.ordering import ordered_positions
from corpusloom.session import materialize

FIT = ("train", "unsup")
ORDER = ("train",)
LABEL_ORDER = ("en", "de", "es", "fr")


def _docs(spark, sf):
    return given_split(documents(spark, sf)).select("doc_id", "category", "split", "text")


def _vocab(spark, sf, fit=FIT, order=ORDER):
    rows = bow.filter_stop_words(bow.token_rows(_docs(spark, sf), ["split"]), ENGLISH_STOP_WORDS)
    return bow.fit_vocab(rows, fit, order)


def _bow_long(spark, sf):
    return bow.transform_bow(bow.term_frequency(_docs(spark, sf)), _vocab(spark, sf))


def _bow_packed(spark, sf):
    docs = _docs(spark, sf)
    packed = bow.pack_bow(docs.select("doc_id"), _bow_long(spark, sf), colocate=True, parts=bow.parts_for(docs, bow.text_rows()))
    return packed.select("doc_id", feature_text().alias("features"))


def _bow_vectors(spark, sf):
    """ML vectors read back from the form they print in: size, word ids, counts."""
    made = vectors.term_vectors(_docs(spark, sf), _vocab(spark, sf))
    part = lambda i: F.split(F.regexp_extract(F.col("vector").cast("string"), r"^\(\d+,\[(.*)\],\[(.*)\]\)$", i), ",")
    entry = F.zip_with(part(1), part(2), lambda i, n: F.when(i != "", F.concat(i, F.lit(":"), n.cast("double").cast("long"))))
    return made.select("doc_id", F.array_join(entry, " ").alias("features"))


def _lines(spark, sf, base):
    docs = _docs(spark, sf)
    label = F.when(F.col("split") != "unsup", category_label("category", LABEL_ORDER))
    features = bow.bag_of_words(docs.withColumn("label", label), _vocab(spark, sf), carry=["label", "split"])
    return features.select("doc_id", "split", svmlight_line("label", "features", False, base).alias("line"))


def _oov(spark, sf):
    docs = _docs(spark, sf)
    test = bow.term_frequency(docs.where("split = 'test'"))
    return bow.transform_bow(test, _vocab(spark, sf, ORDER))


def _vocab_by_unicode_token(spark, sf):
    tokens = bow.token_rows(table(spark, sf, "documents"), pattern=UNICODE_TOKEN)
    return bow.fit_vocab(tokens).select("word_id", "term", "train_count")


def doc_words(spark, sf):
    """Rows of ``doc_word(doc_id, word_id, n)``, for whoever writes them, and ``words(word_id, term)``."""
    tf = materialize(bow.term_frequency(table(spark, sf, "documents")), "tf")
    words = materialize(ordered_positions(tf.select("term").distinct(), ["term"], "word_id"), "words")
    return bow.match(tf, words, "term", stored=True).select("doc_id", "word_id", F.col("tf").alias("n")), words


def doc_word_tables(spark, sf):
    """``doc_word`` and ``words``, written as given tables are."""
    doc_word, words = doc_words(spark, sf)
    return materialize(doc_word, "doc_word"), words


def _reindex(spark, sf):
    return bow.reindex_words(*doc_word_tables(spark, sf))[0]


def _zero_based(spark, sf):
    docs = table(spark, sf, "documents")
    doc_word, words = doc_word_tables(spark, sf)
    moved, _ = bow.reindex_words(doc_word, words)
    docs = docs.select("doc_id", category_label("lang", LABEL_ORDER).alias("label"))
    rows = bow.pack_bow(docs, moved.withColumnRenamed("n", "tf"), colocate=True, parts=bow.parts_for(doc_word))
    return rows.select("doc_id", svmlight_line("label", "features", False, 0).alias("line"))


_LABEL_SQL = "CASE category WHEN 'en' THEN 0 WHEN 'de' THEN 1 WHEN 'es' THEN 2 ELSE 3 END AS label"
_BAG = bag_ctes(f"SELECT doc_id, split, text, {_LABEL_SQL} FROM ({GIVEN_SPLIT})", FIT, ORDER, True)
_TF = f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, {tokens_sql()} AS term FROM documents) GROUP BY ALL"
_TOTALS = "SELECT term, sum(tf) AS c FROM tf GROUP BY term"
_REINDEX = f"""tf AS ({_TF}),
    ids AS (SELECT term, row_number() OVER (ORDER BY c DESC, term) - 1 AS word_id FROM ({_TOTALS}))"""

QUERIES = {
    "tokenize": (
        lambda spark, sf: bow.tokenize(table(spark, sf, "documents"), pattern=UNICODE_TOKEN).select(
            "doc_id", F.array_join("tokens", " ").alias("tokens")
        ),
        "SELECT doc_id, array_to_string(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}'), ' ') AS tokens FROM documents",
    ),
    "term_frequency": (lambda spark, sf: bow.term_frequency(table(spark, sf, "documents")), _TF),
    "stopword_filter": (
        lambda spark, sf: bow.filter_stop_words(bow.term_frequency(table(spark, sf, "documents")), ENGLISH_STOP_WORDS),
        f"SELECT * FROM ({_TF}) WHERE term NOT IN ({STOP_LIST})",
    ),
    "vocab_counts": (
        lambda spark, sf: bow.term_totals(bow.token_rows(_docs(spark, sf), ["split"]).where("split = 'train'"), ORDER),
        f"""SELECT term, count(*) AS train_count FROM (SELECT {tokens_sql()} AS term FROM ({GIVEN_SPLIT}) WHERE split = 'train')
            GROUP BY term""",
    ),
    "union_fit_corpus": (
        lambda spark, sf: bow.term_totals(
            bow.token_rows(_docs(spark, sf).where("split = 'train'")).unionByName(
                bow.token_rows(_docs(spark, sf).where("split = 'unsup'"))
            )
        ),
        f"""SELECT term, count(*) AS train_count FROM (
              SELECT {tokens_sql()} AS term FROM ({GIVEN_SPLIT}) WHERE split = 'train' UNION ALL
              SELECT {tokens_sql()} AS term FROM ({GIVEN_SPLIT}) WHERE split = 'unsup') GROUP BY term""",
    ),
    "vocab_order": (
        _vocab_by_unicode_token,
        f"""SELECT row_number() OVER (ORDER BY count(*) DESC, term) - 1 AS word_id, term, count(*) AS train_count
            FROM (SELECT {tokens_sql(pattern='[\\p{L}\\p{N}_]{2,}')} AS term FROM documents) GROUP BY term""",
    ),
    "vocab_fit_scope": (
        lambda spark, sf: _vocab(spark, sf).select("word_id", "term", "train_count"),
        f"WITH {_BAG} SELECT word_id, term, train_count FROM vocab",
    ),
    "bow_long": (_bow_long, f"WITH {_BAG} SELECT doc_id, word_id, tf FROM bow"),
    "oov_drop": (
        _oov,
        f"WITH {bag_ctes(GIVEN_SPLIT, ORDER, ORDER, True)} SELECT doc_id, word_id, tf FROM bow JOIN d USING (doc_id) WHERE split = 'test'",
    ),
    "bow_packed": (
        _bow_packed,
        f"""WITH {_BAG} SELECT doc_id, coalesce(f, '') AS features FROM d LEFT JOIN
            (SELECT doc_id, string_agg(concat(word_id, ':', tf), ' ' ORDER BY word_id) AS f FROM bow GROUP BY doc_id)
            USING (doc_id)""",
    ),
    "bow_vectors": (
        _bow_vectors,
        f"""WITH {_BAG} SELECT doc_id, coalesce(f, '') AS features FROM d LEFT JOIN
            (SELECT doc_id, string_agg(concat(word_id, ':', tf), ' ' ORDER BY word_id) AS f FROM bow GROUP BY doc_id)
            USING (doc_id)""",
    ),
    "svmlight_lines": (lambda spark, sf: _lines(spark, sf, 1), f"WITH {_BAG} {line_sql(False)}"),
    "reindex_words": (
        _reindex,
        f"WITH {_REINDEX} SELECT doc_id, word_id, CAST(tf AS BIGINT) AS n FROM tf JOIN ids USING (term)",
    ),
    "svmlight_zero_based": (
        _zero_based,
        f"""WITH {_REINDEX},
            f AS (SELECT doc_id, string_agg(concat(word_id, ':', tf), ' ' ORDER BY word_id) AS f
                  FROM tf JOIN ids USING (term) GROUP BY doc_id)
            SELECT doc_id, CAST(CASE lang WHEN 'en' THEN 1 WHEN 'de' THEN 2 WHEN 'es' THEN 3 WHEN 'fr' THEN 4 END AS VARCHAR)
                   || coalesce(' ' || f, '') AS line
            FROM documents LEFT JOIN f USING (doc_id)""",
    ),
}
