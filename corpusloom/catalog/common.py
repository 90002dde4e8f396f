"""Stand-in views over the test tables and SQL pieces the queries share."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import ENGLISH_STOP_WORDS
from corpusloom.sources.readers import spread

Query = Callable[[SparkSession, str], DataFrame]

SEED = 1234
LANGS = ("en", "de", "es", "fr")
CHOSEN = ("de", "en")
TEST_SOURCES = ("src0", "src1", "src2", "src3")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table; documents are spread, since their text is what costs."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name == "documents" else df


def documents(spark: SparkSession, sf_dir: str, as_read: bool = False) -> DataFrame:
    """Documents with their language as category and a subset given by their source; ``as_read`` leaves them where the scan has them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet") if as_read else table(spark, sf_dir, "documents")
    subset = F.when(F.col("source").isin(list(TEST_SOURCES)), "test").otherwise("train")
    return docs.select(
        "doc_id", F.col("lang").alias("category"), subset.alias("subset"), "source", "text"
    )


def given_split(docs: DataFrame) -> DataFrame:
    """Chosen categories by subset; the rest unsupervised."""
    return docs.withColumn("split", F.when(F.col("category").isin(list(CHOSEN)), F.col("subset")).otherwise("unsup"))


def feature_text(column: str = "features") -> Column:
    """A sparse row as text: ``id:count`` pairs."""
    pairs = F.transform(column, lambda e: F.concat_ws(":", e["word_id"].cast("string"), e["tf"].cast("string")))
    return F.array_join(pairs, " ")


def sql_list(values: Sequence[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


STOP_LIST = sql_list(ENGLISH_STOP_WORDS)

DOCUMENTS = f"""
SELECT doc_id, lang AS category, source, text,
       CASE WHEN source IN ({sql_list(TEST_SOURCES)}) THEN 'test' ELSE 'train' END AS subset
FROM documents"""

GIVEN_SPLIT = f"""
SELECT *, CASE WHEN category IN ({sql_list(CHOSEN)}) THEN subset ELSE 'unsup' END AS split
FROM ({DOCUMENTS})"""


def replace_all(expr: str, steps: Sequence[tuple[str, str]]) -> str:
    for pattern, by in steps:
        expr = "regexp_replace({}, '{}', '{}', 'g')".format(expr, pattern.replace("'", "''"), by)
    return expr


KEPT = "[^a-z0-9\\-' ]"
CLEAN_NEWSGROUPS = replace_all("lower(text)", [(KEPT, " "), (" ---*", " "), (r"\s+", " ")])
CLEAN_REVIEWS = replace_all("lower(text)", [(KEPT, ""), ("--", " "), (" - ", " "), (r"\s+", " ")])
CLEAN_MOVIE_NEG = replace_all("text", [(KEPT, ""), (" - ", " "), ("--", " "), (r"\s+", " ")])
CLEAN_MOVIE_POS = replace_all("text", [(KEPT, ""), (" - ", " ")])


def shuffle_hash(key: str = "doc_id", tag: str = "shuf") -> str:
    return f"md5(concat({key}, ':{tag}:{SEED}'))"


def tokens_sql(text: str = "text", pattern: str = r"[\p{L}\p{N}_]{2,}") -> str:
    return f"unnest(regexp_extract_all(lower({text}), '{pattern}'))"


def ceil_div(total: str, parts: int) -> str:
    return f"CAST(ceil({total} / {parts}.0) AS BIGINT)"


def nested_split_sql(
    source: str, order: str, columns: str, train_test=(8, 2), sup_unsup=(1, 10), sup_valid=(8, 2)
) -> str:
    """``source`` rows with position and nested split."""
    tt, su, sv = train_test, sup_unsup, sup_valid
    return f"""
    SELECT {columns}, CASE WHEN position < n_fit THEN 'train_sup' WHEN position < n_sup THEN 'valid'
                           WHEN position < n_train THEN 'unsup' ELSE 'test' END AS split
    FROM (SELECT *, least(n_sup, {ceil_div('n_sup', sum(sv))} * {sv[0]}) AS n_fit
    FROM (SELECT *, least(n_train, {ceil_div('n_train', sum(su))} * {su[0]}) AS n_sup
    FROM (SELECT *, least(n, {ceil_div('n', sum(tt))} * {tt[0]}) AS n_train
    FROM (SELECT *, row_number() OVER (ORDER BY {order}) - 1 AS position, count(*) OVER () AS n
    FROM ({source})))))"""


def given_split_sql(source: str, order: str, columns: str, ratio=(8, 2)) -> str:
    """``source`` rows marked train are cut into train_sup and valid."""
    return f"""
    SELECT {columns}, CASE WHEN split <> 'train' THEN split
                           WHEN position < {ceil_div('n', sum(ratio))} * {ratio[0]} THEN 'train_sup' ELSE 'valid' END AS split
    FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY {order}) - 1 AS position,
                 count(*) OVER (PARTITION BY split) AS n FROM ({source}))"""


def bag_ctes(docs: str, fit: Sequence[str], order: Sequence[str], stop: bool, key: str = "doc_id") -> str:
    """CTEs d, toks, vocab, bow of documents that have text, label and split."""
    stop_filter = f"WHERE term NOT IN ({STOP_LIST})" if stop else ""
    return f"""
    d AS ({docs}),
    toks AS (SELECT {key}, split, {tokens_sql()} AS term FROM d),
    totals AS (SELECT term, count(*) FILTER (split IN ({sql_list(order)})) AS train_count
               FROM (SELECT * FROM toks WHERE split IN ({sql_list(fit)})) {stop_filter} GROUP BY term),
    vocab AS (SELECT term, train_count, row_number() OVER (ORDER BY train_count DESC, term) - 1 AS word_id FROM totals),
    bow AS (SELECT {key}, word_id, count(*) AS tf FROM toks JOIN vocab USING (term) GROUP BY ALL)"""


def line_sql(binary: bool, base: int = 1, key: str = "doc_id") -> str:
    """svmlight lines of the documents d with their rows in bow."""
    label = "CASE WHEN label = 0 THEN '-1' ELSE '+1' END" if binary else "CAST(label + 1 AS VARCHAR)"
    return f"""
    SELECT {key}, split,
           CASE WHEN split = 'unsup' THEN '0' ELSE {label} END || coalesce(' ' || f, '') AS line
    FROM d LEFT JOIN (SELECT {key}, string_agg(concat(word_id + {base}, ':', tf), ' ' ORDER BY word_id) AS f
                      FROM bow GROUP BY {key}) USING ({key})"""
