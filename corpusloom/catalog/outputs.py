"""Output files: written as a corpus writes them, read back line by line in their order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.catalog import corpora as stand_ins
from corpusloom.catalog.common import CHOSEN, documents, feature_text, line_sql, shuffle_hash, table
from corpusloom.operators import labels, sampling
from corpusloom.operators.ordering import Order, ordered_positions
from corpusloom.session import new_path
from corpusloom.sinks import writers
from corpusloom.sources import readers


def _lines(spark, path):
    """The lines of one output with their numbers."""
    return ordered_positions(readers.read_text(spark, path), ["line_no"]).select("position", F.col("text").alias("line"))


def _by_split(spark, path, files):
    parts = [_lines(spark, f"{path}/{name}").withColumn("split", F.lit(split)) for split, name in files.items()]
    return reduce(DataFrame.unionByName, parts)


def _bow_files(spark, sf):
    path = new_path(spark, "corpus")
    stand_ins.reviews(spark, sf, CHOSEN).write(path)
    return _by_split(spark, path, writers.BOW_FILES)


def _vocab_file(spark, sf):
    path = new_path(spark, "corpus")
    stand_ins.reviews(spark, sf, CHOSEN).write(path)
    return _lines(spark, f"{path}/{writers.VOCAB_FILE}")


def _dataset_files(spark, sf):
    path = new_path(spark, "corpus")
    stand_ins.reviews(spark, sf, CHOSEN).write(path)
    rows = spark.read.parquet(f"{path}/{writers.DATASET}")
    return rows.select("doc_id", "split", F.col("label").cast("bigint").alias("label"), feature_text().alias("features"))


def _text_files(spark, sf):
    path = new_path(spark, "corpus")
    stand_ins.reviews(spark, sf).write_text(path)
    return _by_split(spark, path, writers.TEXT_FILES)


def _ids_folds(spark, sf):
    path, order = new_path(spark, "ids"), Order(seed=1234)
    docs = documents(spark, sf).select("doc_id", F.floor(F.col("doc_id") / 100).cast("int").alias("fold"))
    writers.write_ids_folds(docs, f"{path}/docids", f"{path}/cvtag", order.columns())
    ids, folds = (_lines(spark, f"{path}/{name}") for name in ("docids", "cvtag"))
    return ids.join(folds.withColumnRenamed("line", "fold"), "position").withColumnRenamed("line", "doc_id")


def _bodies(spark, sf):
    path = new_path(spark, "bodies")
    writers.write_bodies(documents(spark, sf).withColumnRenamed("subset", "split"), path)
    return spark.read.parquet(path).select("doc_id", "split", "text")


def _text_lines(spark, sf):
    path = new_path(spark, "lines")
    table(spark, sf, "documents").select("text").write.text(path, compression="gzip")
    return readers.read_text(spark, path).groupBy("text").agg(F.count(F.lit(1)).alias("n"))


def _newsgroup_table(spark, sf):
    path = new_path(spark, "messages")
    documents(spark, sf).select("doc_id", "category", "subset", "text").write.parquet(path)
    return readers.read_newsgroups(spark, path, "train", CHOSEN).select("doc_id", "category", "text")


def _strict_sample(spark, sf):
    return sampling.sample_per_category(documents(spark, sf).select("doc_id", "category"), "category", 10, strict=True)


def _strict_lookup(spark, sf):
    quality = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    docs = table(spark, sf, "documents").select("doc_id", "text").join(quality, "doc_id", "left_semi")
    return labels.lookup_label(docs, quality, on_missing="error")


_NUMBERED = f"row_number() OVER (PARTITION BY split ORDER BY {shuffle_hash()}, doc_id) - 1 AS position"

QUERIES = {
    "bow_files": (
        _bow_files,
        f"WITH {stand_ins._REVIEWS_BINARY} SELECT split, {_NUMBERED}, line FROM ({line_sql(True)})",
    ),
    "vocab_file": (_vocab_file, f"WITH {stand_ins._REVIEWS_BINARY} SELECT word_id AS position, term AS line FROM vocab"),
    "dataset_files": (_dataset_files, stand_ins.QUERIES["dataset_rows"][1]),
    "text_files": (_text_files, f"SELECT split, {_NUMBERED}, line FROM ({stand_ins.QUERIES['review_corpus_text'][1]})"),
    "ids_and_folds_files": (
        _ids_folds,
        f"""SELECT row_number() OVER (ORDER BY {shuffle_hash()}, doc_id) - 1 AS position, CAST(doc_id AS VARCHAR) AS doc_id,
                   CAST(doc_id // 100 AS VARCHAR) AS fold FROM documents""",
    ),
    "body_files": (
        _bodies,
        f"SELECT doc_id, subset AS split, text FROM ({stand_ins.DOCUMENTS})",
    ),
    "read_text_lines": (
        _text_lines,
        "SELECT text, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS text FROM documents) GROUP BY text",
    ),
    "read_newsgroup_table": (
        _newsgroup_table,
        f"SELECT doc_id, category, text FROM ({stand_ins.DOCUMENTS}) WHERE subset = 'train' AND category IN ('de', 'en')",
    ),
    "sample_strict": (
        _strict_sample,
        f"""SELECT doc_id, lang AS category FROM documents
            QUALIFY row_number() OVER (PARTITION BY lang ORDER BY {shuffle_hash(tag='samp')}, doc_id) <= 10""",
    ),
    "label_lookup_strict": (_strict_lookup, "SELECT doc_id, text, quality AS label FROM documents JOIN labels USING (doc_id)"),
}
