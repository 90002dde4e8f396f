import pytest

from corpusloom.functions.labels import category_label, fold_number, svmlight_label, svmlight_line, text_line, topic_line
from corpusloom.operators import corpus, labels

LINES = [(0, "A1", 11), (1, "B", 12), (2, "A1", 12)]


@pytest.fixture
def lines(spark):
    return spark.createDataFrame(LINES, "line_no long, topic string, doc_id long")


def test_first_seen_ids(lines):
    got = {r.topic: r.topic_id for r in labels.encode_first_seen(lines, "topic", "line_no").collect()}
    assert got == {"A1": 0, "B": 1}


@pytest.mark.parametrize(("policy", "expected"), [("last", {11: "A1", 12: "A1"}), ("first", {11: "A1", 12: "B"})])
def test_resolve_label(lines, policy, expected):
    assert {r.doc_id: r.topic for r in labels.resolve_label(lines, "doc_id", "topic", "line_no", policy).collect()} == expected


def test_resolve_label_rejects_other_policies(lines):
    with pytest.raises(ValueError):
        labels.resolve_label(lines, "doc_id", "topic", "line_no", "middle")


def test_lookup_label(spark):
    docs = spark.createDataFrame([(1,), (2,)], "doc_id long")
    known = spark.createDataFrame([(1, 5)], "doc_id long, label int")
    assert sorted(map(tuple, labels.lookup_label(docs, known, on_missing="null").collect())) == [(1, 5), (2, None)]
    assert [tuple(r) for r in labels.lookup_label(docs, known, on_missing="drop").collect()] == [(1, 5)]
    with pytest.raises(Exception, match="no label for document: 2"):
        labels.lookup_label(docs, known).collect()
    with pytest.raises(ValueError):
        labels.lookup_label(docs, known, on_missing="other")


def test_remap_drops_unmapped(spark):
    df = spark.createDataFrame([(1, 0), (2, 1), (3, 9)], "doc_id long, old long")
    mapping = spark.createDataFrame([(0, 7), (1, 7)], "old long, new long")
    assert sorted((r.doc_id, r.new) for r in labels.remap(df, mapping, "old", "new").collect()) == [(1, 7), (2, 7)]


@pytest.mark.parametrize(
    ("label", "binary", "expected"),
    [(0, True, "-1"), (1, True, "+1"), (4, False, "5"), (0, False, "1"), (None, False, "0"), (None, True, "0")],
)
def test_svmlight_label(spark, label, binary, expected):
    df = spark.createDataFrame([(label,)], "label int")
    assert df.select(svmlight_label("label", binary)).first()[0] == expected


@pytest.mark.parametrize(
    ("label", "features", "binary", "base", "expected"),
    [
        (0, [(0, 3.0), (1, 2.0)], True, 1, "-1 1:3 2:2"),
        (1, [(0, 3.0), (1, 2.0)], True, 1, "+1 1:3 2:2"),
        (4, [(0, 3.0), (1, 2.0)], False, 1, "5 1:3 2:2"),
        (None, [(0, 3.0), (1, 2.0)], False, 1, "0 1:3 2:2"),
        (4, [(0, 3.0), (1, 2.0)], False, 0, "5 0:3 1:2"),
        (4, [], False, 1, "5"),
    ],
)
def test_svmlight_line(spark, label, features, binary, base, expected):
    df = spark.createDataFrame([(label, features)], "label int, features array<struct<word_id: long, tf: double>>")
    assert df.select(svmlight_line("label", "features", binary, base)).first()[0] == expected


def test_other_lines(spark):
    df = spark.createDataFrame([(3, "a b", 0, "T", "Desc")], "doc_id long, text string, topic_id long, topic string, description string")
    assert tuple(df.select(text_line("doc_id"), topic_line()).first()) == ("_*3 a b", "0\tT\tDesc")


def test_fold_number(spark):
    df = spark.createDataFrame([(13,), (913,), (100,), (99,)], "cv int")
    assert [r[0] for r in df.select(fold_number("cv")).collect()] == [0, 9, 1, 0]


def test_category_labels_follow_the_fixed_order(spark):
    df = spark.createDataFrame([("toys",), ("home",), ("other",)], "category string")
    assert [r[0] for r in df.select(category_label("category", ["home", "toys"])).collect()] == [1, 0, None]
    got = corpus.label_categories(df, ["toys", "home"], ["clothing", "home", "toys"])
    assert sorted(map(tuple, got.collect())) == [("home", 0), ("toys", 1)]


def test_complement(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",), ("z",), (None,)], "category string")
    assert [r[0] for r in corpus.complement_categories(df, ["b"], ["a", "b", "c"]).collect()] == ["a", "c"]


@pytest.mark.parametrize(("values", "expected"), [([0, 1, 1], True), ([0, 0], False), ([0, 1, 2], False), ([0, 1, None], True)])
def test_is_binary(spark, values, expected):
    assert corpus.is_binary(spark.createDataFrame([(v,) for v in values], "label int")).first()["is_binary"] is expected


def test_doc_ids_follow_parts_and_input_order(spark, partitions):
    rows = [(i, ["unsup", "test", "train"][i % 3], f"t{i}") for i in range(30)]
    df = spark.createDataFrame(rows, "row long, part string, text string")
    got = {r.row: (r.doc_id, r.text) for r in corpus.assign_doc_ids(df, "part", ("train", "test", "unsup"), ["row"]).collect()}
    expected = [r for p in ("train", "test", "unsup") for r in rows if r[1] == p]
    assert got == {r[0]: (i, r[2]) for i, r in enumerate(expected)}


def test_select_bodies(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    ids = spark.createDataFrame([(2,), (2,), (3,)], "doc_id long")
    assert [tuple(r) for r in corpus.select_bodies(docs, ids).collect()] == [(2, "b")]
