"""The five corpora from raw documents to output lines, on stand-ins from the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.catalog.bags import doc_word_tables
from corpusloom.catalog.common import (
    CHOSEN, CLEAN_MOVIE_NEG, CLEAN_MOVIE_POS, CLEAN_NEWSGROUPS, CLEAN_REVIEWS, DOCUMENTS, GIVEN_SPLIT, LANGS,
    bag_ctes, ceil_div, documents, feature_text, given_split, given_split_sql, line_sql, nested_split_sql, shuffle_hash, sql_list, table,
    tokens_sql,
)
from corpusloom.catalog.taxa import category_ctes, taxon_tables
from corpusloom.catalog.topics import hierarchy
from corpusloom.plans import corpora

CLASS_LIMIT = 10_000
GENERAL = ("mark_good", "en_src0")
MERGED = {"en_src1": "en_pair", "en_src2": "en_pair", "de_src3": "de_src4"}


def reviews(spark, sf, categories=LANGS):
    docs = documents(spark, sf)
    return corpora.review_corpus(docs, categories, LANGS, CLASS_LIMIT, strict=False)


def newsgroups(spark, sf):
    """Numbered as read: the table's rows ascend by id."""
    docs = documents(spark, sf, as_read=True).select("category", "subset", "text")
    return corpora.newsgroup_corpus(docs, CHOSEN, LANGS, key=None, strip=False)


def movies(spark, sf):
    """Two languages make up each of the two classes."""
    docs = documents(spark, sf)
    return corpora.movie_corpus(
        docs.select(
            F.when(F.col("category").isin("en", "fr"), 0).otherwise(1).alias("label"),
            "doc_id",
            F.floor(F.col("doc_id") / 100).cast("int").alias("fold"),
            "text",
        )
    )


def newswire_topics(spark, sf, docs):
    """Two topic lines of each document: its customer's nation is the last. Documents share the customers in turn, by number."""
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("topic"))
    customers = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    number = docs.select("doc_id", (F.col("doc_id") % customers.count()).alias("c_custkey"))
    lines = number.join(customers, "c_custkey").withColumn("line", F.explode(F.array(F.lit(1), F.lit(0))))
    of_line = lines.withColumn("c_nationkey", (F.col("c_nationkey") + 1 - F.col("line")) % 25)
    return of_line.join(nations, "c_nationkey").select("topic", "doc_id", F.struct("doc_id", "line").alias("line_no"))


def newswire(spark, sf):
    docs = given_split(documents(spark, sf)).select("doc_id", "split", "text")
    return corpora.newswire_corpus(docs, newswire_topics(spark, sf, docs), hierarchy(spark, sf))


def news(spark, sf, train_test=None):
    docs = table(spark, sf, "documents").select("doc_id")
    taxons, doc_taxon = taxon_tables(spark, sf)
    return corpora.news_corpus(
        docs, taxons, doc_taxon, *doc_word_tables(spark, sf), rarest=5, general=GENERAL, merged=MERGED, train_test=train_test
    )


def _dataset(spark, sf):
    rows = reviews(spark, sf, ("de", "en"))
    return rows.features.select("doc_id", "split", F.col("label").cast("bigint").alias("label"), feature_text().alias("features"))


def _labels(categories):
    return "CASE category " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(categories)) + " END AS label"


def _review_docs(categories):
    chosen = [c for c in LANGS if c in categories]
    sample = f"""
    SELECT doc_id, {_labels(chosen)}, {CLEAN_REVIEWS} AS text FROM ({DOCUMENTS}) WHERE category IN ({sql_list(chosen)})
    QUALIFY row_number() OVER (PARTITION BY category ORDER BY {shuffle_hash(tag='samp')}, doc_id) <= {CLASS_LIMIT}"""
    return nested_split_sql(sample, f"{shuffle_hash()}, doc_id", "doc_id, label, text")


_TRAIN = ("train_sup", "valid")
_POOL = ("train_sup", "valid", "unsup")
_ALL = ("train_sup", "valid", "unsup", "test")

_REVIEWS = bag_ctes(_review_docs(LANGS), _POOL, _POOL, True)
_REVIEWS_BINARY = bag_ctes(_review_docs(CHOSEN), _POOL, _POOL, True)

_NEWSGROUP_ROWS = f"""
SELECT row_number() OVER (ORDER BY CASE split WHEN 'train' THEN 0 WHEN 'test' THEN 1 ELSE 2 END, doc_id) - 1 AS doc_id,
       {_labels(sorted(CHOSEN))}, split, {CLEAN_NEWSGROUPS} AS text FROM ({GIVEN_SPLIT})"""
_NEWSGROUPS = bag_ctes(
    given_split_sql(f"SELECT * FROM ({_NEWSGROUP_ROWS}) WHERE length(text) > 0", "doc_id", "doc_id, label, text"),
    _TRAIN + ("unsup",), _TRAIN, True,
)

# A class and a document id make the key: the class leads the hashed text.
_MOVIE_ROWS = f"""
SELECT concat(CASE WHEN category IN ('en', 'fr') THEN 0 ELSE 1 END, ':', doc_id) AS doc_id, doc_id AS number,
       CASE WHEN category IN ('en', 'fr') THEN 0 ELSE 1 END AS label,
       CASE WHEN category IN ('en', 'fr') THEN {CLEAN_MOVIE_NEG} ELSE {CLEAN_MOVIE_POS} END AS text
FROM ({DOCUMENTS})"""
_MOVIES = bag_ctes(
    nested_split_sql(_MOVIE_ROWS, f"{shuffle_hash()}, label, number", "doc_id, label, text", sup_unsup=(1, 2)),
    _ALL, _ALL, True,
)

_NEWSWIRE_ROWS = f"""
SELECT g.doc_id, g.split, g.text, t.label FROM ({GIVEN_SPLIT}) g JOIN
  (SELECT c_custkey, dense_rank() OVER (ORDER BY r_name) - 1 AS label
   FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) t
  ON c_custkey = g.doc_id % (SELECT count(*) FROM customer)"""
_NEWSWIRE = bag_ctes(given_split_sql(_NEWSWIRE_ROWS, "doc_id", "doc_id, label, text"), _TRAIN + ("unsup",), _TRAIN, False)

_NEWS = f"""{category_ctes(3)},
counts AS (SELECT category, count(DISTINCT doc_id) AS n_docs FROM ids LEFT JOIN entries USING (category) GROUP BY 1),
gone AS (SELECT category FROM (SELECT category FROM counts ORDER BY n_docs, category LIMIT 5)
         UNION SELECT unnest(['mark_good', 'en_src0'])),
kept AS (SELECT category_id, category, CASE WHEN category IN ('en_src1', 'en_src2') THEN 'en_pair'
            WHEN category = 'de_src3' THEN 'de_src4' ELSE category END AS new_category
         FROM ids WHERE category NOT IN (SELECT category FROM gone)),
new AS (SELECT new_category, row_number() OVER (ORDER BY min(category_id)) - 1 AS new_id FROM kept GROUP BY 1),
final AS (SELECT DISTINCT doc_id, new_id FROM entries JOIN kept USING (category_id) JOIN new USING (new_category)),
single AS (SELECT doc_id, count(*) AS n, max(new_id) AS label FROM final GROUP BY doc_id),
parted AS (SELECT d.doc_id, CASE WHEN n = 1 THEN 'sup' ELSE 'unsup' END AS split, CASE WHEN n = 1 THEN label END AS label
           FROM documents d LEFT JOIN single s ON d.doc_id = s.doc_id),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, {tokens_sql()} AS term FROM documents) GROUP BY ALL),
word_ids AS (SELECT term, row_number() OVER (ORDER BY sum(tf) DESC, term) - 1 AS word_id FROM tf GROUP BY term),
bow AS (SELECT doc_id, word_id, tf FROM tf JOIN word_ids USING (term))"""

_HALVED = f"""
SELECT doc_id, label, CASE WHEN split = 'unsup' THEN split WHEN position < {ceil_div('n', 2)} THEN 'train' ELSE 'test' END AS split
FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY {shuffle_hash()}, doc_id) - 1 AS position,
             count(*) OVER (PARTITION BY split) AS n FROM parted)"""

QUERIES = {
    "review_corpus": (lambda spark, sf: reviews(spark, sf).svmlight(), f"WITH {_REVIEWS} {line_sql(False)}"),
    "review_corpus_binary": (
        lambda spark, sf: reviews(spark, sf, ("de", "en")).svmlight(),
        f"WITH {_REVIEWS_BINARY} {line_sql(True)}",
    ),
    "review_corpus_text": (
        lambda spark, sf: reviews(spark, sf).text_lines(),
        f"SELECT doc_id, split, concat('_*', doc_id, ' ', text) AS line FROM ({_review_docs(LANGS)})",
    ),
    "review_corpus_vocab": (
        lambda spark, sf: reviews(spark, sf).vocab.select("word_id", "term", "train_count"),
        f"WITH {_REVIEWS} SELECT word_id, term, train_count FROM vocab",
    ),
    "dataset_rows": (
        _dataset,
        f"""WITH {_REVIEWS_BINARY}
            SELECT doc_id, split, CAST(CASE WHEN split <> 'unsup' THEN label END AS BIGINT) AS label, coalesce(f, '') AS features
            FROM d LEFT JOIN (SELECT doc_id, string_agg(concat(word_id, ':', tf), ' ' ORDER BY word_id) AS f
                              FROM bow GROUP BY doc_id) USING (doc_id)""",
    ),
    "newsgroup_corpus": (lambda spark, sf: newsgroups(spark, sf).svmlight(), f"WITH {_NEWSGROUPS} {line_sql(True)}"),
    "movie_corpus": (
        lambda spark, sf: movies(spark, sf).svmlight().select(
            F.concat_ws(":", "class", "doc_id").alias("doc_id"), "split", "line"
        ),
        f"WITH {_MOVIES} {line_sql(True)}",
    ),
    "newswire_corpus": (lambda spark, sf: newswire(spark, sf)[0].svmlight(), f"WITH {_NEWSWIRE} {line_sql(False)}"),
    "news_corpus": (
        lambda spark, sf: news(spark, sf).svmlight(),
        f"WITH {_NEWS}, d AS (SELECT * FROM parted) {line_sql(False, 0)}",
    ),
    "news_corpus_halved": (
        lambda spark, sf: news(spark, sf, (1, 1)).svmlight(),
        f"WITH {_NEWS}, d AS ({_HALVED}) {line_sql(False, 0)}",
    ),
}
