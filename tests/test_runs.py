"""Standard runs from files to output directories."""

import json
import os

from pyspark.sql import functions as F

from corpusloom.catalog import standard_runs
from corpusloom.plans import corpora, runs
from corpusloom.session import new_path
from corpusloom.sources import readers
from tests.test_corpora import lines, taxon_inputs
from tests.test_sources import HIERARCHY, put


def test_review_runs(spark, tmp_path):
    manifest = {
        c: put(tmp_path / f"{c}.json.gz", "".join(json.dumps({"reviewText": f"Word {c} number{i}", "reviewerID": f"u{i}"}) + "\n" for i in range(12)))
        for c in ("toys", "home", "clothing")
    }
    out = tmp_path / "out"
    runs.review_runs(spark, manifest, str(out), {"pair": ("toys", "home")}, class_limit=10)
    test = lines(spark, out / "pair" / "test" / "test_text.txt")
    assert len(test) == 4
    # Ids number the chosen categories one after another, in the fixed order.
    for line in test:
        doc_id, text = line[2:].split(" ", 1)
        c, i = ("home", int(doc_id)) if int(doc_id) < 12 else ("toys", int(doc_id) - 12)
        assert text == f"word {c} number{i}"
    assert {l[:2] for l in lines(spark, out / "pair" / "test" / "labeledBow.feat")} <= {"-1", "+1"}


def test_newsgroup_runs(spark, tmp_path):
    rows = [(i, ("sci.med", "sci.space", "rec.autos")[i % 3], ("train", "test")[i % 2], f"a: b\n\nbody text{i}") for i in range(30)]
    spark.createDataFrame(rows, "message_id long, category string, subset string, text string").write.parquet(str(tmp_path / "t"))
    runs.newsgroup_runs(spark, str(tmp_path / "t"), str(tmp_path / "out"), {"one": ("sci.med", "sci.space")})
    sup = lines(spark, tmp_path / "out" / "one" / "train" / "train_sup_text.txt")
    valid = lines(spark, tmp_path / "out" / "one" / "valid" / "valid_sup_text.txt")
    pool = lines(spark, tmp_path / "out" / "one" / "train" / "train_unsup_text.txt")
    assert (len(sup), len(valid), len(pool)) == (8, 2, 10)
    assert all(int(l.split()[-1][4:]) % 3 == 2 for l in pool)


def test_movie_run(spark, tmp_path):
    for c in ("neg", "pos"):
        for i in range(10):
            put(tmp_path / "in" / c / f"cv{i:03d}_{i + 50}.txt", f"a {c} film {i}{i}\n")
    runs.movie_run(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert len(lines(spark, tmp_path / "out" / "docids")) == 20
    assert set(lines(spark, tmp_path / "out" / "cvtag")) == {"0"}
    vocab = lines(spark, tmp_path / "out" / "vocab")
    assert vocab[0] == "film" and "neg" in vocab


def test_newswire_run(spark, tmp_path):
    files = {
        "train": put(tmp_path / "train.gz", ".I 1\n.W\naa bb\n.I 2\n.W\nbb\n"),
        "test": [put(tmp_path / "t1", ".I 3\n.W\nbb cc\n"), put(tmp_path / "t2", ".I 4\n.W\naa\n")],
        "unsup": put(tmp_path / "u", ".I 5\n.W\ndd\n"),
    }
    topics = put(tmp_path / "q", "A 1 1\nB 2 1\nA1 3 1\nB 4 1\n")
    runs.newswire_run(spark, files, topics, put(tmp_path / "h", HIERARCHY), str(tmp_path / "out"))
    out = tmp_path / "out"
    assert lines(spark, out / "train" / "labeledBow.feat") == ["1 1:1 2:1", "2 1:1"]
    assert lines(spark, out / "test" / "labeledBow.feat") == ["1 1:1", "2 2:1"]
    assert lines(spark, out / "train" / "unsupBow.feat") == ["0 3:1"]
    assert lines(spark, out / "valid" / "labeledBow.feat") == []
    assert lines(spark, out / "vocab") == ["bb", "aa", "dd"]
    assert lines(spark, out / "test" / "test_text.txt") == ["_*3 bb cc", "_*4 aa"]
    assert lines(spark, out / "topics") == ["0\tA\tAnimals", "1\tB\tBoats"]


def test_news_run(spark, tmp_path):
    docs, *others = taxon_inputs(spark)
    tables = dict(zip(("taxons", "doc_taxon", "doc_word", "words"), others))
    tables["documents"] = docs.withColumn("text", F.concat(F.lit("t"), "doc_id"))
    for name, df in tables.items():
        df.write.parquet(str(tmp_path / "in" / name))
    runs.news_run(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "txt")).count() == 7
    assert len(lines(spark, tmp_path / "out" / "labeledBow.feat")) + len(lines(spark, tmp_path / "out" / "unsupBow.feat")) == 7


def written(spark):
    folder = os.path.dirname(new_path(spark, "t"))
    return {f"{folder}/{name}" for name in os.listdir(folder)} if os.path.isdir(folder) else set()


def test_movie_runs_leave_only_their_outputs(spark, tmp_path):
    """The driver lists no file, and the tables a run makes on its way do not stay on disk."""
    for i in range(8):
        put(tmp_path / "in" / ("neg", "pos")[i % 2] / f"cv{i:03d}_{i}.txt", f"a film {i}{i}\n")
    before = written(spark)
    runs.movie_run(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert written(spark) == before and sorted(lines(spark, tmp_path / "out" / "docids")) == [str(i) for i in range(8)]
    assert not os.path.exists(tmp_path / "out" / "_stages")


def test_news_runs_leave_only_their_outputs(spark, tmp_path):
    """Neither the tables a run makes on its way nor those that given tables are made from stay on disk."""
    docs, *others = taxon_inputs(spark)
    docs = docs.withColumn("text", F.concat(F.lit("t"), "doc_id"))
    tables, before = dict(zip(runs.NEWS_TABLES, (docs, *others), strict=True)), written(spark)
    runs.news_run(spark, tables, str(tmp_path / "out"))
    runs.news_run(spark, tables, str(tmp_path / "halves"), train_test=(1, 1))
    assert written(spark) == before
    assert spark.read.parquet(str(tmp_path / "halves" / "txt")).count() == 7
    rows = [(i, f"Some words w{i}", ("en", "de")[i % 2], "src0", 9) for i in range(8)]
    sources = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    sources.write.parquet(str(tmp_path / "sf" / "documents.parquet"))
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "sf" / "labels.parquet"))
    root = standard_runs._news_folder(spark, str(tmp_path / "sf"))
    assert written(spark) - before == {root}
    assert spark.read.parquet(f"{root}/doc_word").count() == 24 and spark.read.parquet(f"{root}/words").count() == 10


def test_spread_leaves_wide_inputs_alone(spark):
    wide = spark.range(0, 100, 1, 16)
    assert readers.spread(wide) is wide
    assert readers.spread(spark.range(0, 100, 1, 1)).rdd.getNumPartitions() == 4


def test_choices_are_known_categories():
    for choices, known in ((corpora.NEWSGROUP_CHOICES, corpora.NEWSGROUP_CATEGORIES), (corpora.REVIEW_CHOICES, corpora.REVIEW_CATEGORIES)):
        assert all(set(c) <= set(known) for c in choices.values())
    assert len(corpora.NEWSGROUP_CATEGORIES) == 20
