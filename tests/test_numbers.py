"""Numbers in input order, and outputs that appear only when complete."""

import json
import os

import pytest
from pyspark.sql import functions as F

from corpusloom.operators.corpus import assign_doc_ids, number_written, with_counters
from corpusloom.plans import corpora, runs
from corpusloom.sinks import publish, writers
from corpusloom.sources import readers
from tests.plans import shuffles
from tests.test_sources import put

PARTS = ("train", "test", "unsup")


@pytest.mark.parametrize("codegen", ["true", "false"])
def test_input_order(spark, codegen):
    spark.conf.set("spark.sql.codegen.wholeStage", codegen)
    try:
        rows = spark.range(0, 1000, 1, 7).withColumn("part", F.element_at(F.array(*map(F.lit, PARTS)), (F.hash("id") % 3 + 3).cast("int") % 3 + 1))
        assert shuffles(with_counters(rows, "part", PARTS)) == 0
        got = {r.id: r.doc_id for r in assign_doc_ids(rows, "part", PARTS).collect()}
        order = sorted((PARTS.index(r.part), r.id) for r in rows.collect())
        assert got == {i: n for n, (_, i) in enumerate(order)}
    finally:
        spark.conf.unset("spark.sql.codegen.wholeStage")


def test_input_order_of_files(spark, tmp_path):
    """Files by name, whatever their sizes; a shuffle before the write does no harm; an unknown part is an error."""
    for name, n in (("b", 3), ("a", 2000), ("c", 40)):
        put(tmp_path / "in" / f"{name}.txt", "".join(f"{name}{i}\n" for i in range(n)))
    lines = readers.read_text(spark, str(tmp_path / "in")).withColumn("part", F.when(F.col("text").endswith("7"), "test").otherwise("train"))
    counted = with_counters(lines, "part", ("train", "test"), "line_no").drop("line_no").repartition(5)
    counted.write.parquet(str(tmp_path / "t"))
    got = [r.text for r in number_written(spark.read.parquet(str(tmp_path / "t"))).orderBy("doc_id").collect()]
    every = [f"{name}{i}" for name, n in (("a", 2000), ("b", 3), ("c", 40)) for i in range(n)]
    assert got == [t for t in every if t[-1] != "7"] + [t for t in every if t[-1] == "7"]
    with pytest.raises(Exception, match="unknown part"):
        assign_doc_ids(lines, "part", ("train",), position="line_no").count()


def test_outputs_appear_when_complete(spark, tmp_path):
    out = str(tmp_path / "out")
    rows = spark.createDataFrame([(i, "ab"[i % 2], f"t{i}") for i in range(9)], "doc_id long, split string, text string")
    files = {"a": "x/a.txt", "b": "b.txt", "none": "x/none.txt"}
    with pytest.raises(RuntimeError), publish.staging(spark, out, files.values()) as staged:
        writers.write_split_lines(rows, F.col("text"), staged, files, ["doc_id"])
        raise RuntimeError("killed")
    assert os.listdir(out) == [] and publish.published(spark, out) == []
    os.makedirs(f"{out}/b.txt/left-by-a-killed-move")
    with publish.staging(spark, out, list(files.values())) as staged:
        writers.write_split_lines(rows, F.col("text"), staged, files, ["doc_id"])
    read = lambda name: [r.text for r in readers.read_text(spark, f"{out}/{name}").orderBy("line_no").collect()]
    assert read("x/a.txt") == ["t0", "t2", "t4", "t6", "t8"] and read("b.txt") == ["t1", "t3", "t5", "t7"] and read("x/none.txt") == []
    assert publish.published(spark, out) == sorted(files.values())
    with pytest.raises(FileExistsError):
        with publish.staging(spark, out, ["b.txt"]):
            pass


def test_a_run_goes_on_where_it_failed(spark, tmp_path, monkeypatch):
    manifest = {c: put(tmp_path / f"{c}.json", "".join(json.dumps({"reviewText": f"{c} text{i}", "reviewerID": "u"}) + "\n" for i in range(12))) for c in ("toys", "home")}
    out = str(tmp_path / "out")
    write_text, calls = corpora.Corpus.write_text, []

    def fails(self, path):
        raise RuntimeError("lost")

    monkeypatch.setattr(corpora.Corpus, "write_text", fails)
    with pytest.raises(RuntimeError, match="lost"):
        runs.review_runs(spark, manifest, out, {"pair": ("toys", "home")}, class_limit=10)
    assert publish.published(spark, f"{out}/pair") and os.path.isdir(f"{out}/_stages/reviews")
    monkeypatch.setattr(corpora.Corpus, "write_text", write_text)
    monkeypatch.setattr(corpora.Corpus, "write", lambda self, path: calls.append(path))
    monkeypatch.setattr(readers, "read_reviews", lambda *a: calls.append(a))
    runs.review_runs(spark, manifest, out, {"pair": ("toys", "home")}, class_limit=10)
    assert calls == [] and not os.path.exists(f"{out}/_stages")
    assert os.path.isdir(f"{out}/pair/test/test_text.txt")
