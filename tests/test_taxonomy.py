import pytest

from corpusloom.functions.taxons import cut_taxon
from corpusloom.operators import taxonomy
from corpusloom.session import materialize


@pytest.mark.parametrize(
    ("path", "depth", "expected"),
    [
        ("top/news/u.s./x", 3, "news_u.s."),
        ("top/news/u.s./x", 4, "news_u.s._x"),
        ("top/news/u.s./x", 2, "news"),
        ("top/news/u.s./x", 1, "news"),
        ("top/news", 3, "news"),
        ("top/news/u.s.", 4, "news"),
        ("top/opinion/opinion", 3, "opinion_opinion"),
    ],
)
def test_cut_taxon(spark, path, depth, expected):
    assert spark.createDataFrame([(path,)], "path string").select(cut_taxon("path", depth)).first()[0] == expected


def test_cut_taxon_errors(spark):
    with pytest.raises(ValueError):
        cut_taxon("path", 0)
    for depth in (1, 3):
        with pytest.raises(Exception, match="without a level"):
            spark.createDataFrame([("top",)], "path string").select(cut_taxon("path", depth)).collect()


PATHS = ["top/b/x", "top/opinion/opinion", "top/a/y/z", "top/opinion", "top/b/x/w"]


def test_taxon_categories_are_numbered_as_first_seen(spark):
    taxons = spark.createDataFrame(list(enumerate(PATHS)), "taxon_id long, path string")
    got = taxonomy.taxon_categories(taxons).orderBy("taxon_id").collect()
    assert [(r.category, r.category_id) for r in got] == [("b_x", 0), ("opinion", 1), ("a_y", 2), ("opinion", 1), ("b_x", 0)]


def test_roll_up_and_binarise(spark):
    counts = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 2, 5), (2, 0, 1), (2, 1, -1)], "doc_id long, old long, n int")
    mapping = spark.createDataFrame([(0, 7), (1, 7), (2, None)], "old long, new long")
    rolled = taxonomy.roll_up(counts, mapping, "old", "new")
    assert sorted(map(tuple, rolled.collect())) == [(1, 7, 3), (2, 7, 0)]
    assert [tuple(r) for r in taxonomy.binarise(rolled).collect()] == [(1, 7, 1)]


def test_counts_with_empty_sides(spark):
    entries = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "doc_id long, category_id long")
    names = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "category_id long, category string")
    per_category = taxonomy.docs_per_category(entries, names)
    assert sorted((r.category, r.n_docs) for r in per_category.collect()) == [("a", 2), ("b", 1), ("c", 0)]
    assert [r.category for r in taxonomy.rarest_categories(per_category, 2).collect()] == ["c", "b"]
    assert sorted(r.category for r in taxonomy.removal_list(per_category, 1, ["a", "x"]).collect()) == ["a", "c", "x"]
    docs = spark.createDataFrame([(1,), (2,), (3,)], "doc_id long")
    parted = taxonomy.partition_single_label(docs, entries).orderBy("doc_id").collect()
    assert [(r.doc_id, r.label, r.split) for r in parted] == [(1, None, "unsup"), (2, 0, "sup"), (3, None, "unsup")]


def test_merge_categories_with_the_fixed_names(spark):
    names = ["news_world", "features_travel", "news_washington", "opinion", "news_science", "news_u.s.", "features_arts", "news_technology"]
    categories = spark.createDataFrame(list(enumerate(names)), "category_id long, category string")
    remove = spark.createDataFrame([("news_world",)], "category string")
    got = taxonomy.merge_categories(categories, remove).orderBy("category_id").collect()
    assert [(r.new_category, r.new_id) for r in got] == [
        ("features_arts_travel", 0),
        ("news_u.s.", 1),
        ("opinion", 2),
        ("news_science_technology", 3),
        ("news_u.s.", 1),
        ("features_arts_travel", 0),
        ("news_science_technology", 3),
    ]


TREE = [("Root", "None", "Root"), ("A", "Root", "Animals"), ("A1", "A", "Apes"), ("A11", "A1", "Small"), ("B", "Root", "Boats"), ("X", "Y", "Loose")]


@pytest.fixture
def tree(spark):
    return spark.createDataFrame(TREE, "child string, parent string, description string")


def test_top_topics(tree):
    got = taxonomy.top_topics(tree).orderBy("topic_id").collect()
    assert [tuple(r) for r in got] == [(0, "A", "Animals"), (1, "B", "Boats")]


def test_rollup_tree(spark, tree):
    topics = spark.createDataFrame([(t,) for t in ("A", "A1", "A11", "B")], "topic string")
    got = {r.topic: r.top_topic for r in taxonomy.rollup_tree(topics, tree).collect()}
    assert got == {"A": "A", "A1": "A", "A11": "A", "B": "B"}


@pytest.mark.parametrize("topic", ["Root", "X", "unknown"])
def test_rollup_tree_without_a_top_topic(spark, tree, topic):
    topics = spark.createDataFrame([(topic,), ("A1",)], "topic string")
    with pytest.raises(Exception, match="no topic under the root"):
        taxonomy.rollup_tree(topics, tree).collect()
    assert {r.topic: r.top_topic for r in taxonomy.rollup_tree(topics, tree, on_missing="null").collect()} == {topic: None, "A1": "A"}
    assert [r.topic for r in taxonomy.rollup_tree(topics, tree, on_missing="drop").collect()] == ["A1"]


def test_rollup_tree_ends_on_cycles(spark):
    tree = spark.createDataFrame([("A", "Root"), ("A", "B"), ("B", "A"), ("Root", "B")], "child string, parent string")
    topics = spark.createDataFrame([("A",), ("B",)], "topic string")
    got = {r.topic: r.top_topic for r in taxonomy.rollup_tree(topics, tree).collect()}
    assert got == {"A": "A", "B": "A"}


def test_rollup_of_a_deep_chain(spark, monkeypatch):
    chain = [("n0", "Root")] + [(f"n{i}", f"n{i - 1}") for i in range(1, 12)]
    written = []
    monkeypatch.setattr(taxonomy, "materialize", lambda df, name: written.append(name) or materialize(df, name))
    topics = spark.createDataFrame([("n11",)], "topic string")
    tree = spark.createDataFrame(chain, "child string, parent string")
    assert taxonomy.rollup_tree(topics, tree).first().top_topic == "n0"
    assert written == ["edges"] + ["ancestors"] * 4


def test_tree_faults(spark):
    rows = [("A", "Root"), ("A1", "A"), ("c1", "c2"), ("c2", "c3"), ("c3", "c1"), ("b1", "c2"), ("b2", "b1"), ("s", "s"), ("o", "gone"), ("o2", "o"), ("n", None)]
    tree = spark.createDataFrame(rows, "child string, parent string")
    got = {r.node: (r.fault, r.through) for r in taxonomy.tree_faults(tree).collect()}
    assert {n: f for n, (f, _) in got.items()} == {
        "c1": "on a circle", "c2": "on a circle", "c3": "on a circle", "s": "on a circle",
        "b1": "below a circle", "b2": "below a circle", "o": "no root", "o2": "no root", "n": "no root",
    }
    assert got["o2"][1] == "gone" and got["n"][1] is None and got["s"][1] == "s"
    assert {got["b1"][1], got["b2"][1]} <= {"c1", "c2", "c3"}
    assert taxonomy.tree_faults(tree.where("child in ('A', 'A1')")).count() == 0
    assert taxonomy.tree_faults(tree.limit(0)).count() == 0


@pytest.mark.parametrize("size", [1, 2, 3, 5, 8, 9])
def test_tree_faults_of_one_circle(spark, size):
    tree = spark.createDataFrame([(f"n{i}", f"n{(i + 1) % size}") for i in range(size)], "child string, parent string")
    assert {tuple(r) for r in taxonomy.tree_faults(tree).select("node", "fault").collect()} == {(f"n{i}", "on a circle") for i in range(size)}


def test_rollup_error_names_the_circle(spark):
    tree = spark.createDataFrame([("A", "Root"), ("B", "C"), ("C", "B"), ("D", "gone")], "child string, parent string")
    for topic, why in (("B", "circle through [BC]"), ("D", "no parent of gone")):
        with pytest.raises(Exception, match=f"no topic under the root above: {topic}, .*{why}"):
            taxonomy.rollup_tree(spark.createDataFrame([(topic,)], "topic string"), tree).collect()
