import pytest
from pyspark.sql import functions as F

from corpusloom.operators import bow, taxonomy, vectors
from corpusloom.sources.matrices import by_document
from tests.plans import plan, shuffles

COUNTS = "doc_id long, {} long, n long"


@pytest.fixture
def tables(spark):
    doc_word = spark.createDataFrame([(d, w, 1 + (d + w) % 3) for d in range(40) for w in range(d % 4)], COUNTS.format("word_id"))
    doc_taxon = spark.createDataFrame([(d, t, 1) for d in range(40) for t in range(d % 3)], COUNTS.format("taxon_id"))
    docs = spark.range(40).select(F.col("id").alias("doc_id"))
    return docs, doc_taxon, doc_word


def test_work_by_document_moves_nothing(spark, tables):
    docs, doc_taxon, doc_word = (by_document(t, n, 4) for t, n in zip(tables, ("docs", "doc_taxon", "doc_word"), strict=True))
    mapping = spark.createDataFrame([(0, 5), (1, 5)], "taxon_id long, category_id long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    rolled = taxonomy.binarise(taxonomy.roll_up(doc_taxon, mapping.hint("broadcast"), "taxon_id", "category_id"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = (
            rolled,
            taxonomy.labels_per_doc(docs, rolled),
            bow.pack_bow(docs, doc_word.withColumnRenamed("n", "tf")),
        )
        assert [shuffles(df) for df in made] == [0, 0, 0], [plan(df) for df in made]
        packed = {r.doc_id: [tuple(f) for f in r.features] for r in made[2].collect()}
        assert sum(r.n for r in rolled.collect()) == 26
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert packed == {d: [(w, 1 + (d + w) % 3) for w in range(d % 4)] for d in range(40)}


def test_buckets_hold_every_row(spark):
    rows = spark.createDataFrame([(None, 1), (None, 1), (1, 2), (1, 2), (2, 3)], "doc_id long, n long")
    assert sorted(map(repr, by_document(rows, "odd", 3).collect())) == sorted(map(repr, rows.collect()))
    assert by_document(rows.limit(0), "empty").count() == 0


DOCS = [(1, "cat dog cat the"), (2, "emu"), (3, ""), (4, None), (5, "Dog, dog")]


def test_term_vectors(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    vocab = spark.createDataFrame([(1, "dog"), (0, "cat")], "word_id long, term string")
    got = {r.doc_id: (r.vector.size, dict(zip(r.vector.indices.tolist(), r.vector.values.tolist()))) for r in vectors.term_vectors(docs, vocab).collect()}
    assert got == {1: (2, {0: 2.0, 1: 1.0}), 2: (2, {}), 3: (2, {}), 4: (2, {}), 5: (2, {1: 2.0})}
    ones = vectors.term_vectors(docs, vocab, binary=True).where("doc_id = 1").first().vector
    assert ones.toArray().tolist() == [1.0, 1.0]
    assert shuffles(vectors.term_vectors(docs, vocab)) == 0
    packed = bow.bag_of_words(docs, vocab, pattern=r"[\p{L}\p{N}_]{2,}").collect()
    assert {r.doc_id: {e.word_id: float(e.tf) for e in r.features} for r in packed} == {d: v for d, (_, v) in got.items()}


def test_vectors_have_a_bound(spark):
    vocab = spark.createDataFrame([(0, "cat")], "word_id long, term string")
    with pytest.raises(ValueError, match="too large"):
        vectors.vectorizer(vocab, most_bytes=10)
    with pytest.raises(ValueError, match="no words"):
        vectors.term_vectors(spark.createDataFrame(DOCS, "doc_id long, text string"), vocab.limit(0))


def test_vectors_beside_a_vocabulary_beyond_the_bound(spark):
    """A vocabulary that no task holds gives the vectors of one that fits, for rows of any key."""
    rows = [*DOCS, (None, "emu cat cat"), (1, "dog")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("features", F.lit(7))
    vocab = bow.fit_vocab(bow.token_rows(docs))
    for binary in (False, True):
        want = vectors.term_vectors(docs, vocab, binary=binary)
        for most in (0, 60, 130):
            got = vectors.term_vectors(docs, vocab, binary=binary, most_bytes=most)
            assert got.schema["vector"].dataType == want.schema["vector"].dataType and got.columns == want.columns
            assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
