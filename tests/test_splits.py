import hashlib
import math

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import sampling, splits
from corpusloom.operators.corpus import assign_doc_ids, complement_categories, label_categories
from corpusloom.operators.ordering import Order, bucket_spans, hash_buckets, ordered_positions, shuffle_key, with_position
from corpusloom.operators.sampling import sample_per_category
from corpusloom.session import materialize
from tests.plans import plan, shuffles


def sizes(df, column="split"):
    return {r[column]: r["count"] for r in df.groupBy(column).count().collect()}


def ids(spark, n):
    return spark.range(n).withColumnRenamed("id", "doc_id")


def rank(doc_id, seed, tag="shuf"):
    return hashlib.md5(f"{doc_id}:{tag}:{seed}".encode()).hexdigest(), doc_id


@pytest.mark.parametrize("seed", [None, 7])
@pytest.mark.parametrize(
    ("n", "ratio", "expected"),
    [(10, (8, 2), (8, 2)), (102, (8, 2), (88, 14)), (11, (8, 2), (11, 0)), (7, (8, 2), (7, 0)), (0, (8, 2), (0, 0))],
)
def test_ratio_sizes(spark, n, ratio, expected, seed):
    got = sizes(splits.split_ratio(ids(spark, n), ratio, ("a", "b"), Order(seed=seed)))
    assert (got.get("a", 0), got.get("b", 0)) == expected


@pytest.mark.parametrize(
    ("n", "expected"),
    [
        (60_000, {"test": 12_000, "unsup": 43_636, "train_sup": 3_496, "valid": 868}),
        (20_000, {"test": 4_000, "unsup": 14_545, "train_sup": 1_168, "valid": 287}),
    ],
)
def test_nested_sizes(spark, n, expected):
    assert sizes(splits.split_nested(ids(spark, n), order=Order(seed=1234))) == expected


def test_nested_equals_slicing(spark, partitions):
    n = 1003
    order = sorted(range(n), key=lambda d: rank(d, 5))

    def cut(rows, ratio):
        unit = math.ceil(len(rows) / sum(ratio))
        return rows[: unit * ratio[0]], rows[unit * ratio[0] :]

    train, test = cut(order, (8, 2))
    sup, unsup = cut(train, (1, 2))
    fit, valid = cut(sup, (8, 2))
    expected = {d: s for s, rows in (("train_sup", fit), ("valid", valid), ("unsup", unsup), ("test", test)) for d in rows}
    got = splits.split_nested(ids(spark, n), sup_unsup=(1, 2), order=Order(seed=5)).collect()
    assert {r.doc_id: r.split for r in got} == expected


@pytest.mark.parametrize("seed", [None, 3])
def test_fraction(spark, seed):
    got = splits.split_fraction(ids(spark, 7), (1, 1), order=Order(seed=seed))
    assert sizes(got) == {"train": 4, "test": 3}


def test_given_cuts_only_the_named_rows(spark):
    df = ids(spark, 100).withColumn("split", F.when(F.col("doc_id") < 50, "train").when(F.col("doc_id") < 70, "test"))
    got = {r.doc_id: r.split for r in splits.split_given(df).collect()}
    assert all(got[d] == ("train_sup" if d < 40 else "valid") for d in range(50))
    assert all(got[d] == "test" for d in range(50, 70)) and all(got[d] is None for d in range(70, 100))


def test_ratio_needs_a_name_per_part(spark):
    with pytest.raises(ValueError):
        splits.split_ratio(ids(spark, 3), (1, 2, 3))


@pytest.mark.parametrize("seed", [None, 9])
def test_positions(spark, partitions, seed):
    order = sorted(range(500), key=(lambda d: d) if seed is None else (lambda d: rank(d, seed)))
    got = {r.doc_id: r.position for r in with_position(ids(spark, 500), seed=seed).collect()}
    assert got == {d: i for i, d in enumerate(order)}


def test_ordered_positions_of_skewed_and_mixed_keys(spark, partitions):
    rows = [(1 if i % 3 else i, f"t{i:04d}") for i in range(900)]
    df = spark.createDataFrame(rows, "n int, term string")
    got = {r.term: r.position for r in ordered_positions(df, [F.desc("n"), F.asc("term")]).collect()}
    expected = sorted(rows, key=lambda r: (-r[0], r[1]))
    assert got == {t: i for i, (_, t) in enumerate(expected)}


def test_shuffle_key_depends_on_seed_only(spark):
    one = shuffle_key(ids(spark, 20), seed=1).collect()
    assert one == shuffle_key(ids(spark, 20).repartition(7), seed=1).orderBy("doc_id").collect()
    assert one != shuffle_key(ids(spark, 20), seed=2).collect()


def test_sample_is_exact_under_a_hot_category(spark, partitions):
    df = ids(spark, 3000).withColumn("category", F.when(F.col("doc_id") < 2900, "hot").when(F.col("doc_id") < 2990, "mid").otherwise("few"))
    got = sample_per_category(df, "category", 50, seed=3).collect()
    for name, members in (("hot", range(2900)), ("mid", range(2900, 2990)), ("few", range(2990, 3000))):
        expected = sorted(members, key=lambda d: rank(d, 3, "samp"))[:50]
        assert sorted(r.doc_id for r in got if r.category == name) == sorted(expected)


def test_strict_sample_rejects_a_small_category(spark):
    df = ids(spark, 30).withColumn("category", F.when(F.col("doc_id") < 25, "a").otherwise("b"))
    assert sample_per_category(df, "category", 5, strict=True).count() == 10
    with pytest.raises(Exception, match="too few rows in category b"):
        sample_per_category(df, "category", 6, strict=True).collect()


def test_splits_and_samples_do_not_shuffle_documents(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.range(100).selectExpr("id AS doc_id", "'a' AS category", "repeat('x', 100) AS text").write.parquet(path)
    docs = spark.read.parquet(path)
    assert shuffles(splits.split_nested(docs, order=Order(seed=1))) == 0
    assert shuffles(splits.split_nested(docs)) == 0
    assert shuffles(sample_per_category(docs, "category", 5)) == 0


def test_passes_that_find_positions_read_keys_only(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.range(100).selectExpr("id AS doc_id", "'a' AS category", "repeat('x', 100) AS text").write.parquet(path)
    spans = bucket_spans(hash_buckets(spark.read.parquet(path), Order(seed=1), ["category"]), ["category"])
    assert "ReadSchema: struct<doc_id:bigint,category:string>" in plan(spans)


def test_null_categories_are_sampled_too(spark):
    rows = spark.createDataFrame([(i, ["a", None, "b"][i % 3]) for i in range(30)], "doc_id long, category string")
    got = sample_per_category(rows, "category", 4).groupBy("category").count().collect()
    assert {r["category"]: r["count"] for r in got} == {"a": 4, None: 4, "b": 4}


def test_positions_keep_null_and_repeated_keys(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (0, "d")], "doc_id long, text string")
    got = with_position(rows).collect()
    assert sorted(r.position for r in got) == [0, 1, 2, 3]
    assert sorted(r.text for r in got) == ["a", "b", "c", "d"]
    assert {r.text: r.position for r in got}["c"] == 0


def test_numbering_keeps_rows_and_rejects_unknown_parts(spark):
    rows = spark.createDataFrame([(1, "train"), (1, "train"), (None, "test")], "key long, part string")
    assert sorted(r.doc_id for r in assign_doc_ids(rows, "part", ("train", "test"), ["key"]).collect()) == [0, 1, 2]
    for part in ("other", None):
        odd = spark.createDataFrame([(1, part)], "key long, part string")
        with pytest.raises(Exception, match="unknown part"):
            assign_doc_ids(odd, "part", ("train", "test"), ["key"])


def test_unknown_categories_are_errors(spark):
    rows = spark.createDataFrame([(1, "a")], "doc_id long, category string")
    for call in (label_categories, complement_categories):
        with pytest.raises(ValueError, match="not in the known categories: z"):
            call(rows, ["a", "z"], ["a", "b"])


def test_sample_reads_its_input_once(spark, monkeypatch):
    written = []
    monkeypatch.setattr(sampling, "materialize", lambda df, name: written.append((name, plan(df))) or materialize(df, name))
    rows = spark.createDataFrame([(i, "ab"[i % 3 == 0]) for i in range(300)], "doc_id long, category string")
    assert sampling.sample_per_category(rows, "category", 20).groupBy("category").count().collect()[0]["count"] == 20
    assert [name for name, _ in written] == ["sample_keys", "sample_buckets", "sample_cuts"]
    assert all("Scan ExistingRDD" not in p and "LocalTableScan" not in p for _, p in written[1:])
