"""What keeps a task small and a lost file from passing unseen: buckets of keys, frequent fingerprints, files of shards."""

import os

import pytest
from pyspark.sql import functions as F

from corpusloom import session
from corpusloom.llm import common, mixing, ppm, simhash, warc
from tests.plans import plan


def test_keys_of_low_weights_spread_over_buckets(spark):
    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), F.lit("s").alias("source"))
    for weight in (1.0, 0.05, 1e-9):
        measured = mixing.measure(docs, F.lit(weight))
        most = measured.groupBy("_bucket").count().agg(F.max("count")).first()[0]
        assert most <= 40_000 * 0.003
        crossed = measured.groupBy("_bucket").agg(F.min("_key").alias("low"), F.max("_key").alias("high")).orderBy("_bucket").collect()
        assert all(a.high < b.low for a, b in zip(crossed, crossed[1:]))


def test_mix_of_rows_that_repeat_one_id(spark):
    rows = [(7 if i % 3 else i, "w " * (1 + i % 4), "ab"[i % 2]) for i in range(300)] + [(None, "x y", "b")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.report(docs).collect()
    assert len(got) == 350
    by_class = {}
    for r in got:
        assert by_class.setdefault((r.doc_id, r.size, r.source_size), r.taken) == r.taken


def test_frequent_fingerprints_stay_where_they_lie(spark, monkeypatch):
    texts = ["one text that very many rows share"] * 60 + [f"text number {i} of its own kind entirely {i * 7}" for i in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    expected = sorted(map(tuple, simhash.near_duplicates(docs).collect()))
    assert [component for _, _, component in expected[:60]] == [0] * 60
    for share in (1, 20, 1_000_000):
        monkeypatch.setattr(simhash, "FREQUENT", share)
        got = simhash.near_duplicates(docs)
        assert "BroadcastHashJoin" in plan(got)
        assert sorted(map(tuple, got.collect())) == expected


def test_a_lost_shard_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(ppm, "HOT_ROWS", 5)
    docs = spark.createDataFrame([(i, f"some words {i}") for i in range(20)], "doc_id long, text string")
    model = ppm.Model(docs)
    assert ppm.score(docs, model).count() == 20
    assert all(shard and all(file.startswith("file:///") for file in shard) for shard in [*model.trie_shards, *model.word_shards])
    model = ppm.Model(docs)  # of this one no worker holds a shard yet
    for shard in model.trie_shards:
        os.remove(shard[0].removeprefix("file://"))
    with pytest.raises(Exception, match="FileNotFound|No such file|not exist"):
        ppm.score(docs, model).collect()


def test_a_shared_folder_without_a_scheme(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_dir", lambda spark: str(tmp_path))
    path = common.shared_path(spark, "t")
    assert path.startswith(f"file://{tmp_path}/")
    captures = warc.write_archives(spark.createDataFrame([(1, "http://a.example/", "<p>x</p>")], "page_id long, url string, html string"))
    assert captures.first().file.startswith(f"file://{tmp_path}/")
    assert [r.payload_bytes for r in warc.read_records(captures).collect()] == [8]
