import bz2
import gzip
import json
import zlib

import pytest

from corpusloom.operators import labels
from corpusloom.sinks import writers
from corpusloom.sources import readers, small_files

RECORDS = ".I 11\n.W\nalpha beta\ngamma\n\n.I 12\n.W\nbeta beta\n\n.I 13\n.W\n"


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(gzip.compress(text.encode()) if path.suffix == ".gz" else text.encode())
    return str(path)


@pytest.mark.parametrize("name", ["a.txt", "a.txt.gz"])
def test_text_lines_keep_their_order(spark, tmp_path, name):
    path = put(tmp_path / name, "one\ntwo\n\nthree\n")
    assert [r.text for r in readers.read_text(spark, path).orderBy("line_no").collect()] == ["one", "two", "", "three"]


def test_line_positions_across_blocks(spark, tmp_path):
    words = [f"line {i:05d}" for i in range(2000)]
    path = put(tmp_path / "big.txt", "\n".join(words))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        rows = readers.read_text(spark, path)
        assert rows.rdd.getNumPartitions() > 4
        assert [r.text for r in rows.orderBy("line_no").collect()] == words
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def reviews(*records):
    return "\n".join(json.dumps(r) for r in records) + "\n"


def test_reviews(spark, tmp_path):
    path = put(tmp_path / "r.json.gz", reviews({"reviewText": "good\nbook", "reviewerID": "u1", "overall": 5}, {"reviewerID": "u2", "reviewText": ""}))
    got = readers.read_reviews(spark, path, partitions=3).orderBy("line_no").collect()
    assert [(r.text, r.reviewer_id) for r in got] == [("good\nbook", "u1"), ("", "u2")]


@pytest.mark.parametrize("bad", ['{"reviewerID": "u"}', '{"reviewText": "x"}', '{"reviewText": '])
def test_bad_reviews_are_errors(spark, tmp_path, bad):
    path = put(tmp_path / "r.json", reviews({"reviewText": "a", "reviewerID": "b"}) + bad + "\n")
    with pytest.raises(Exception):
        readers.read_reviews(spark, path).collect()


def test_review_categories_follow_the_manifest(spark, tmp_path):
    manifest = {n: put(tmp_path / f"{n}.json.gz", reviews({"reviewText": n, "reviewerID": "u"})) for n in ("home", "toys")}
    manifest["sports"] = str(tmp_path / "absent.json.gz")
    got = readers.read_review_categories(spark, manifest, ["toys", "home"]).collect()
    assert [(r.category, r.text) for r in got] == [("home", "home"), ("toys", "toys")]
    with pytest.raises(ValueError):
        readers.read_review_categories(spark, manifest, ["cars"])


def test_movie_files(spark, tmp_path):
    put(tmp_path / "neg" / "cv013_29416.txt", "bad\nfilm\n")
    put(tmp_path / "pos" / "cv913_5.txt", "good")
    got = readers.read_movie_reviews(spark, str(tmp_path)).orderBy("label").collect()
    assert [tuple(r) for r in got] == [(0, 29416, 0, "bad\nfilm\n"), (1, 5, 9, "good")]


@pytest.mark.parametrize("name", ["t.dat", "t.dat.gz"])
@pytest.mark.parametrize("preamble", ["", "\n", "some header text\n", "2 documents .W follow\n"])
def test_marked_records(spark, tmp_path, name, preamble):
    path = put(tmp_path / name, preamble + RECORDS)
    want = [(11, "alpha beta gamma"), (12, "beta beta"), (13, "")]
    got = readers.read_marked_records(spark, path, preamble=True).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == want
    if preamble.strip():
        with pytest.raises(Exception, match="text before the first"):
            readers.read_marked_records(spark, path).collect()
    else:
        assert [tuple(r) for r in readers.read_marked_records(spark, path).orderBy("doc_id").collect()] == want


@pytest.mark.parametrize("name", ["t.dat", "t.dat.gz"])
@pytest.mark.parametrize("block", [None, 40])
def test_record_marks_inside_bodies(spark, tmp_path, name, block):
    path = put(tmp_path / name, ".I 11\r\n.W\r\nalpha fig.I beta .I 5 .W\tgamma\r\n\r\n.I 12\n.W\nsee .I x\n" * 1)
    if block:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    try:
        got = sorted(map(tuple, readers.read_marked_records(spark, path).collect()))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [(11, "alpha fig.I beta .I 5 .W gamma"), (12, "see .I x")]


@pytest.mark.parametrize("place", [0, 60])
def test_record_marks_at_line_starts_of_bodies_are_errors(spark, tmp_path, place):
    records = [f".I {i}\n.W\nalpha beta\n" for i in range(80)]
    records[place] = f".I {place}\n.W\nalpha\n.I figure\n"
    path = put(tmp_path / "t.dat", "".join(records))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        with pytest.raises(Exception, match="malformed record"):
            readers.read_marked_records(spark, path).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_malformed_records_are_errors(spark, tmp_path):
    path = put(tmp_path / "t.dat", ".I 11 no body\n.I 12\n.W\nx\n")
    with pytest.raises(Exception, match="malformed record"):
        readers.read_marked_records(spark, path).collect()


def test_marked_records_across_blocks(spark, tmp_path):
    bodies = {i: " ".join(f"w{i}x{j}" for j in range(i % 9)) for i in range(500)}
    path = put(tmp_path / "t.dat", "".join(f".I {i}\n.W\n{b}\n\n" for i, b in bodies.items()))
    for size in (97, 1000):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        try:
            rows = readers.read_marked_records(spark, path)
            assert rows.rdd.getNumPartitions() > 1
            assert {r.doc_id: r.text for r in rows.collect()} == bodies and rows.count() == 500
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_topic_lines(spark, tmp_path):
    path = put(tmp_path / "q.gz", "A1 11 1\nB 12 1\nA1 12 1\n")
    lines = readers.read_topic_lines(spark, path)
    assert [(r.topic, r.doc_id) for r in lines.orderBy("line_no").collect()] == [("A1", 11), ("B", 12), ("A1", 12)]
    assert {r.topic: r.topic_id for r in labels.encode_first_seen(lines, "topic", "line_no").collect()} == {"A1": 0, "B": 1}
    assert {r.doc_id: r.topic for r in labels.resolve_label(lines, "doc_id", "topic", "line_no").collect()} == {11: "A1", 12: "A1"}


HIERARCHY = """parent: None child: Root child-description: Root
parent: Root child: A child-description: Animals
parent: B child: A1 child-description: Wrong
parent: A child: A1 child-description: Apes and more
parent: Root child: B child-description: Boats
"""


def test_hierarchy(spark, tmp_path):
    path = put(tmp_path / "h.txt", HIERARCHY)
    got = {r.child: (r.parent, r.description) for r in readers.read_topic_hierarchy(spark, path).collect()}
    assert got == {"Root": ("None", "Root"), "A": ("Root", "Animals"), "A1": ("A", "Apes"), "B": ("Root", "Boats")}
    full = readers.read_topic_hierarchy(spark, path, full_description=True)
    assert full.where("child = 'A1'").first().description == "Apes and more"


def test_newsgroup_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "n")
    rows = [("a", "train", "x"), ("b", "test", "y"), ("b", "train", "z")]
    spark.createDataFrame(rows, "category string, subset string, text string").write.parquet(path)
    df = readers.read_newsgroups(spark, path, "train", ["b"])
    assert [r.text for r in df.collect()] == ["z"]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(subset,train)" in plan and "EqualTo(category,b)" in plan
    assert readers.read_newsgroups(spark, path).count() == 3


def test_many_movie_files_are_read_in_few_tasks(spark, tmp_path):
    docs = spark.range(0, 900, 1, 3).selectExpr("concat('cv', lpad(id, 3, '0'), '_', id) AS stem", "if(id = 5, null, concat('film ', id)) AS text")
    writers.write_files(docs, str(tmp_path / "neg"))
    twice = spark.createDataFrame([("cv007_7", "a"), ("cv007_7", "b\nc")], "stem string, text string")
    writers.write_files(twice.coalesce(1), str(tmp_path / "pos"))
    got = readers.read_movie_reviews(spark, str(tmp_path))
    assert got.rdd.getNumPartitions() <= 16
    rows = {(r.label, r.doc_id): (r.fold, r.text) for r in got.collect()}
    assert rows.pop((1, 7)) == (0, "a\nb\nc\n")
    assert rows == {(0, i): (i // 100, "\n" if i == 5 else f"film {i}\n") for i in range(900)}


def odd_folder(root):
    """Files that Spark's reader of whole texts takes, leaves out or unpacks."""
    put(root / "neg" / "cv013_29416.txt", "bad\nfilm\n")
    put(root / "neg" / "name=cv015_2.txt" / "part-0.txt", "one part")
    for hidden in ("_SUCCESS", ".cv017_4.txt", "_temporary/cv018_5.txt", ".in/cv019_6.txt", "cv020_7.txt._COPYING_", "_metadata"):
        put(root / "neg" / hidden, "hidden")
    put(root / "pos" / "cv913_5.txt", "good")
    put(root / "pos" / "cv914_6.txt", "")
    put(root / "pos" / "cv915_7.txt.gz", "packed")
    put(root / "pos" / "cv916_8.gz", "")
    (root / "pos" / "cv917_9.bz2").write_bytes(bz2.compress(b"packed, too"))
    (root / "pos" / "cv918_10.deflate").write_bytes(zlib.compress(b"and this"))
    (root / "pos" / "cv919_11.txt").write_bytes(b"\xef\xbb\xbfno \xff\xfe text\x00\r\n")
    return str(root)


def test_small_files_are_those_of_the_whole_text_reader(spark, tmp_path):
    root = odd_folder(tmp_path / "a b%20c")
    put(tmp_path / "a b%20c" / "neg" / "deeper" / "still deeper" / "cv014_1.txt", "below \u00e9")
    put(tmp_path / "a b%20c" / "neg" / "_name=x" / "cv016_3.txt", "a column")
    for paths in ([f"{root}/neg", f"{root}/pos"], [f"{root}/*"], [f"file://{tmp_path}/a*/pos"]):
        want = spark.read.text(paths, wholetext=True, recursiveFileLookup=True)
        bytes_of = lambda df: sorted(bytes(r[0]) for r in df.selectExpr("cast(value AS binary)").collect())
        got = small_files.read_whole(spark, paths)
        assert bytes_of(got) == bytes_of(want) and got.schema["value"].dataType == want.schema["value"].dataType
    put(tmp_path / "x" / "cv1_1.snappy", "x")
    with pytest.raises(Exception, match="compression"):
        small_files.read_whole(spark, [f"{tmp_path}/x"]).collect()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        small_files.read_whole(spark, [f"{root}/neg", f"{root}/absent"])
    assert small_files.read_whole(spark, [put(tmp_path / "one.txt", "a file")]).first().value == "a file"


def test_the_driver_lists_no_movie_files(spark, tmp_path):
    root = odd_folder(tmp_path)
    got = readers.read_movie_reviews(spark, root)
    assert got.inputFiles() == []
    want = [(0, 2), (0, 29416), (1, 5), (1, 7), (1, 8), (1, 9), (1, 10), (1, 11)]
    assert sorted((r.label, r.doc_id) for r in got.collect()) == want


def test_a_store_that_pyarrow_does_not_reach_is_read_by_spark(spark, tmp_path, monkeypatch):
    root = odd_folder(tmp_path)
    rows = lambda: sorted(map(repr, readers.read_movie_reviews(spark, root).collect()))
    want = rows()
    monkeypatch.setattr(small_files, "_folders", lambda *_: None)
    assert rows() == want


def test_files_of_large_folders_are_handed_on_in_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(small_files, "BATCH_ROWS", 7)
    monkeypatch.setattr(small_files, "BATCH_BYTES", 40)
    for i in range(300):
        name = f"cv{i:03d}_{i}.txt"
        put(tmp_path / "pos" / f"name={name}" / "part" if i % 2 else tmp_path / "neg" / name, f"film {i}" * (i % 5 + 1))
    got = {r.doc_id: (r.label, r.text) for r in readers.read_movie_reviews(spark, str(tmp_path)).collect()}
    assert got == {i: (i % 2, f"film {i}" * (i % 5 + 1)) for i in range(300)}
