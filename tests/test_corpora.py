"""The five corpora end to end on small inputs, and their output files."""

import re

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import bow
from corpusloom.plans import corpora
from corpusloom.sinks import writers
from corpusloom.sources import readers
from tests.plans import plan
from tests.test_sources import HIERARCHY, put


def lines(spark, path):
    """Lines of an output in file order."""
    return [r.text for r in readers.read_text(spark, str(path)).orderBy("line_no").collect()]


@pytest.fixture(scope="module")
def reviews(spark):
    rows = spark.range(300).selectExpr(
        "id AS doc_id", "element_at(array('toys', 'home', 'cars'), cast(id % 3 AS int) + 1) AS category",
        "concat('Word', id % 7, ' and the ITEM', id % 50, ' -- ok ok') AS text",
    )
    return corpora.review_corpus(rows, ["toys", "home"], class_limit=60)


def test_review_corpus(reviews):
    counts = {r.split: r["count"] for r in reviews.docs.groupBy("split").count().collect()}
    assert counts == {"train_sup": 8, "valid": 1, "unsup": 87, "test": 24}
    assert reviews.binary
    assert reviews.docs.where("split = 'unsup' AND label IS NOT NULL").count() == 0
    assert {r.label for r in reviews.docs.where("split <> 'unsup'").select("label").distinct().collect()} == {0, 1}
    terms = {r.term for r in reviews.vocab.collect()}
    assert "ok" in terms and "the" not in terms and "and" not in terms
    assert reviews.features.count() == 120


def test_review_corpus_wants_full_categories(spark):
    rows = spark.range(10).selectExpr("id AS doc_id", "'toys' AS category", "'x' AS text")
    with pytest.raises(Exception, match="too few rows"):
        corpora.review_corpus(rows, ["toys"], class_limit=11)


def test_written_corpus(spark, reviews, tmp_path):
    out = str(tmp_path / "out")
    reviews.write(out)
    reviews.write_text(out)
    order = [r.doc_id for r in reviews.features.where("split = 'test'").orderBy(*reviews.order.columns()).collect()]
    expected = {r.doc_id: r.line for r in reviews.svmlight().collect()}
    assert lines(spark, f"{out}/test/labeledBow.feat") == [expected[d] for d in order]
    assert all(l.startswith("0") for l in lines(spark, f"{out}/train/unsupBow.feat"))
    assert {l[:2] for l in lines(spark, f"{out}/train/labeledBow.feat")} <= {"-1", "+1"}
    assert lines(spark, f"{out}/vocab") == [r.term for r in reviews.vocab.orderBy("word_id").collect()]
    text = {r.doc_id: r.text for r in reviews.docs.collect()}
    assert lines(spark, f"{out}/test/test_text.txt") == [f"_*{d} {text[d]}" for d in order]
    stored = spark.read.parquet(f"{out}/{writers.DATASET}")
    assert stored.count() == 120 and stored.where("split = 'unsup' AND label IS NOT NULL").count() == 0


def test_newsgroup_corpus(spark):
    rows = [
        (0, "b", "train", "head: x\n\nFirst text\n> quoted\n\nsigned"),
        (1, "a", "train", "head: x\n\nsecond Text\n\nsigned"),
        (2, "a", "train", "no blank line"),
        (3, "a", "test", "head: x\n\nthird text\n\nsigned"),
        (4, "c", "train", "head: x\n\nother words\n\nsigned"),
        (5, "c", "test", "head: x\n\nmore words\n\nsigned"),
        (6, "z", "test", "head: x\n\nunknown group\n\nsigned"),
    ]
    messages = spark.createDataFrame(rows, "message_id long, category string, subset string, text string")
    made = corpora.newsgroup_corpus(messages, ["b", "a"], ["a", "b", "c"])
    docs = [(r.doc_id, r.label, r.split, r.text) for r in made.docs.orderBy("doc_id").collect()]
    # The message without a body is gone but keeps its number.
    assert docs == [
        (0, 1, "train_sup", "first text"),
        (1, 0, "train_sup", "second text"),
        (3, 0, "test", "third text"),
        (4, None, "unsup", "other words"),
        (5, None, "unsup", "more words"),
    ]
    vocab = [(r.term, r.train_count) for r in made.vocab.orderBy("word_id").collect()]
    assert vocab == [("text", 2), ("first", 1), ("second", 1), ("words", 0)]
    svm = {r.doc_id: r.line for r in made.svmlight().collect()}
    assert svm == {0: "+1 1:1 2:1", 1: "-1 1:1 3:1", 3: "-1 1:1", 4: "0 4:1", 5: "0 4:1"}


def test_movie_corpus_keeps_equal_ids_of_both_classes_apart(spark, tmp_path):
    rows = [(c, i, i // 10, f"film number{i} was class{c}") for c in (0, 1) for i in range(50)]
    made = corpora.movie_corpus(spark.createDataFrame(rows, "label int, doc_id long, fold int, text string"))
    counts = {r.split: r["count"] for r in made.docs.groupBy("split").count().collect()}
    assert counts == {"train_sup": 24, "valid": 3, "unsup": 53, "test": 20}
    assert made.docs.select("class", "doc_id").distinct().count() == 100
    assert made.vocab.where("term = 'film'").first().train_count == 100
    writers.write_ids_folds(made.docs, str(tmp_path / "ids"), str(tmp_path / "folds"), made.order.columns())
    ids, folds = lines(spark, tmp_path / "ids"), lines(spark, tmp_path / "folds")
    assert len(ids) == 100 and [int(i) // 10 for i in ids] == [int(f) for f in folds]
    assert ids != sorted(ids, key=int)


def test_newswire_corpus(spark, tmp_path):
    train = put(tmp_path / "train.dat.gz", ".I 11\n.W\nalpha beta\n\n.I 12\n.W\nbeta beta\n")
    test = put(tmp_path / "test.dat", ".I 13\n.W\nalpha gamma the\n")
    pool = put(tmp_path / "pool.dat", ".I 14\n.W\ndelta\n")
    docs = None
    for split, path in (("train", train), ("test", test), ("unsup", pool)):
        part = readers.read_marked_records(spark, path).withColumn("split", F.lit(split))
        docs = part if docs is None else docs.unionByName(part)
    topic_lines = readers.read_topic_lines(spark, put(tmp_path / "q", "A1 11 1\nB 12 1\nA1 12 1\nB 13 1\n"))
    hierarchy = readers.read_topic_hierarchy(spark, put(tmp_path / "h", HIERARCHY))
    made, topics = corpora.newswire_corpus(docs, topic_lines, hierarchy)
    assert {r.doc_id: (r.label, r.split) for r in made.docs.collect()} == {
        11: (0, "train_sup"), 12: (0, "train_sup"), 13: (1, "test"), 14: (None, "unsup"),
    }
    assert [(r.term, r.train_count) for r in made.vocab.orderBy("word_id").collect()] == [("beta", 3), ("alpha", 1), ("delta", 0)]
    writers.write_topics(topics, str(tmp_path / "topics"))
    assert lines(spark, tmp_path / "topics") == ["0\tA\tAnimals", "1\tB\tBoats"]
    with pytest.raises(Exception, match="no label for document: 13"):
        corpora.newswire_corpus(docs, topic_lines.where("doc_id <> 13"), hierarchy)


def taxon_inputs(spark):
    paths = ["top/news/u.s.", "top/news/washington/x", "top/features/arts", "top/news/world", "top/rare/one"]
    taxons = spark.createDataFrame(list(enumerate(paths)), "taxon_id long, path string")
    doc_taxon = spark.createDataFrame(
        [(0, 0, 1), (0, 1, 1), (1, 2, 1), (2, 0, 1), (2, 2, 1), (3, 3, 1), (4, 0, 1), (4, 3, 1), (5, 4, 1)],
        "doc_id long, taxon_id long, n int",
    )
    docs = spark.range(7).withColumnRenamed("id", "doc_id")
    doc_word = spark.createDataFrame([(d, w, w + 1) for d in range(7) for w in (0, 2)], "doc_id long, word_id long, n int")
    words = spark.createDataFrame([(0, "aa"), (1, "bb"), (2, "cc")], "word_id long, term string")
    return docs, taxons, doc_taxon, doc_word, words


def test_news_corpus(spark, tmp_path):
    made = corpora.news_corpus(*taxon_inputs(spark), rarest=1)
    marks = {r.doc_id: (r.label, r.split) for r in made.doc_splits.collect()}
    assert marks == {
        0: (0, "sup"), 1: (1, "sup"), 2: (None, "unsup"), 3: (None, "unsup"), 4: (0, "sup"), 5: (2, "sup"), 6: (None, "unsup"),
    }
    assert {r.new_id: r.new_category for r in made.categories.collect()}[0] == "news_u.s."
    assert [r.term for r in made.vocab.orderBy("word_id").collect()] == ["cc", "aa", "bb"]
    svm = {r.doc_id: r.line for r in made.svmlight().collect()}
    assert svm[0] == "1 0:3 1:1" and svm[6] == "0 0:3 1:1"
    out = tmp_path / "out"
    made.write(str(out))
    assert lines(spark, out / "unsupBow.feat")[0] == "0 0:3 1:1"
    assert not (out / "test").exists()
    texts = spark.range(7).selectExpr("id AS doc_id", "concat('t', id) AS text")
    writers.write_bodies(made.bodies(texts), str(tmp_path / "bodies"))
    assert spark.read.parquet(str(tmp_path / "bodies")).where("split = 'sup'").count() == sum(s == "sup" for _, s in marks.values())


def test_news_corpus_in_halves(spark, tmp_path):
    made = corpora.news_corpus(*taxon_inputs(spark), rarest=1, train_test=(1, 1))
    counts = {r.split: r["count"] for r in made.features.groupBy("split").count().collect()}
    labelled = made.doc_splits.where("split <> 'unsup'").count()
    assert counts["train"] == (labelled + 1) // 2 and counts.get("test", 0) == labelled // 2
    made.write(str(tmp_path / "out"))
    assert len(lines(spark, tmp_path / "out" / "train" / "labeledBow.feat")) == counts["train"]


def test_news_rows_are_dealt_by_their_number(spark):
    """Four million rows of words and a bit more ask for five tasks of a million at most, in halves or not; the session shuffles to four."""
    docs, taxons, doc_taxon, _, words = taxon_inputs(spark)
    rows = 4 * bow.TASK_ROWS + 1
    doc_word = spark.range(rows).selectExpr("id % 7 AS doc_id", "if(id < 14, id % 3, -1) AS word_id", "1 AS n")
    for train_test in (None, (1, 1)):
        made = corpora.news_corpus(docs, taxons, doc_taxon, doc_word, words, rarest=1, train_test=train_test)
        assert re.search(r"hashpartitioning\(doc_id#\d+L?, 5\), REPARTITION_BY_NUM", plan(made.features))
        assert sum(e.tf for r in made.features.collect() for e in r.features) == 14


def test_settings_are_plain_values():
    changed = corpora.with_settings(corpora.REVIEWS, seed=None)
    assert changed.seed is None and corpora.REVIEWS.seed == 1234
