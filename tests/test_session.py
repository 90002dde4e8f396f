import os
import time

import pytest
from pyspark.sql import functions as F

from corpusloom import session


class FakeContext:
    def __init__(self, master):
        self.master = master
        self.applicationId = "app"

    def getConf(self):
        return {}


class FakeSpark:
    def __init__(self, master, folder=None):
        self.sparkContext = FakeContext(master)
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}


def test_the_configured_folder_is_used():
    assert session.shared_dir(FakeSpark("yarn", "hdfs://shared/work/")) == "hdfs://shared/work"


def test_a_cluster_without_a_folder_is_an_error():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(FakeSpark("yarn"))


def test_a_local_master_may_use_its_own(tmp_path, monkeypatch):
    monkeypatch.setattr(session, "_local_dirs", {})
    first = session.shared_dir(FakeSpark("local[2]"))
    assert first == session.shared_dir(FakeSpark("local[2]"))


def test_materialized_tables_read_back_whole(spark):
    df = spark.range(100).withColumnRenamed("id", "doc_id")
    written = session.materialize(df, "t")
    assert written.schema["doc_id"].dataType == df.schema["doc_id"].dataType
    assert written.orderBy("doc_id").collect() == df.collect()
    assert session.new_path(spark, "t") != session.new_path(spark, "t")


def test_passing_tables_go_with_their_block(spark):
    folder = f"{session.shared_dir(spark)}/corpusloom/{spark.sparkContext.applicationId}"
    session.materialize(spark.range(1), "stays")
    before, codec = sorted(os.listdir(folder)), spark.conf.get(session.PARQUET_CODEC)
    with session.passing_tables(spark):
        outer = session.materialize(spark.range(5), "t")
        with pytest.raises(RuntimeError), session.passing_tables(spark):
            session.materialize(spark.range(6), "u")
            raise RuntimeError("lost")
        assert outer.count() == 5 and len(os.listdir(folder)) == len(before) + 1
        assert session.materialize(spark.range(7), "v").count() == 7
    assert sorted(os.listdir(folder)) == before
    assert (spark.conf.get(session.PARQUET_CODEC), spark.conf.get(session.FREE_SHUFFLES)) == (codec, "false")


def test_shuffle_files_go_when_their_action_ends(spark, tmp_path):
    """For writes as for other actions; what is read again is shuffled again, to the same rows."""
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        found = disk.getAllFiles()
        return {found.apply(i).getName() for i in range(found.size())}

    def gone(kept):
        until = time.time() + 20
        while (left := {f for f in files() - kept if f.startswith("shuffle_") and f.endswith(".data")}) and time.time() < until:
            time.sleep(0.2)
        return not left

    rows, kept = spark.range(0, 1000, 1, 3).repartition(4, "id"), files()
    with session.sparing_disk(spark):
        rows.write.parquet(str(tmp_path / "t"))
        assert gone(kept)
        counted = rows.groupBy((F.col("id") % 3).alias("k")).count()
        assert sorted(counted.collect()) == sorted(counted.collect()) == [(0, 334), (1, 333), (2, 333)]
        assert gone(kept)
