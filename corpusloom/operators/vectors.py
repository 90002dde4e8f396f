"""Bags of words as sparse vectors of Spark ML."""

from __future__ import annotations

from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import UNICODE_TOKEN, tokens
from corpusloom.operators.bow import BROADCAST_BYTES, bag_of_counts, measured_bytes, with_counts
from corpusloom.session import materialize


def vectorizer(
    vocab: DataFrame, terms: str = "terms", vector: str = "vector", binary: bool = False, most_bytes: int = BROADCAST_BYTES
) -> CountVectorizerModel:
    """A Spark ML model whose word ids are those of ``vocab`` (``word_id`` from 0, ``term``).

    Such a model carries its vocabulary to every task, so one of more than ``most_bytes`` is an error: ``term_vectors`` and the
    packed rows of ``bow.bag_of_counts`` have no such bound.
    """
    size = measured_bytes(vocab, "term")
    if size > most_bytes:
        raise ValueError(f"a vocabulary of {size} bytes is too large for a vector model, which holds at most {most_bytes}")
    words = [r.term for r in vocab.select("word_id", "term").orderBy("word_id").toLocalIterator()]
    return CountVectorizerModel.from_vocabulary(words, inputCol=terms, outputCol=vector, binary=binary)


def term_vectors(
    docs: DataFrame,
    vocab: DataFrame,
    text: str = "text",
    pattern: str = UNICODE_TOKEN,
    vector: str = "vector",
    binary: bool = False,
    most_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``docs`` with a sparse vector of word counts, by the ids of ``vocab``; words outside it add nothing.

    Null text has an empty vector. Rows stay where they lie beside a vocabulary of at most ``most_bytes``. A larger one, which no task
    holds, meets the terms by key: rows are then written once, with their packed counts. With no words at all in ``vocab`` there is no vector space: that is an error.
    """
    if vocab.isEmpty():
        raise ValueError("the vocabulary has no words")
    if measured_bytes(vocab, "term") <= most_bytes:
        counted = docs.withColumn("_terms", F.coalesce(tokens(text, pattern), F.array().cast("array<string>")))
        return vectorizer(vocab, "_terms", vector, binary, most_bytes).transform(counted).drop("_terms")
    rows = materialize(with_counts(docs.withColumn("_row", F.monotonically_increasing_id()), text, pattern, "_counts"), "vector_rows")
    bags = bag_of_counts(rows, vocab, ("_row",), counts="_counts", broadcast_bytes=most_bytes)
    ids, counts = F.col("features.word_id"), F.col("features.tf").cast("array<double>")
    counts = F.transform(counts, lambda _: F.lit(1.0)) if binary else counts
    size = vocab.count()
    sparse = F.udf(lambda i, n: Vectors.sparse(size, i, n), VectorUDT())
    return rows.drop("_counts").join(bags.select("_row", sparse(ids, counts).alias(vector)), "_row").select(*docs.columns, vector)
