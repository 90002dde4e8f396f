import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.functions.text import ENGLISH_STOP_WORDS
from corpusloom.operators import bow
from tests.plans import plan, shuffles

DOCS = [
    (1, "train_sup", "cat dog cat the"),
    (2, "valid", "dog emu"),
    (3, "unsup", "fox fox fox dog"),
    (4, "test", "cat gnu gnu fox"),
    (5, "test", ""),
    (6, "test", None),
]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, split string, text string")


def vocab_of(docs, fit=("train_sup", "valid", "unsup"), order=("train_sup", "valid")):
    rows = bow.filter_stop_words(bow.token_rows(docs, ["split"]), ENGLISH_STOP_WORDS)
    return bow.fit_vocab(rows, fit, order)


def features(df):
    return {r.doc_id: [tuple(e) for e in r.features] for r in df.collect()}


def test_vocab_order_and_scopes(docs):
    got = [(r.word_id, r.term, r.train_count) for r in vocab_of(docs).orderBy("word_id").collect()]
    assert got == [(0, "cat", 2), (1, "dog", 2), (2, "emu", 1), (3, "fox", 0)]
    everything = vocab_of(docs, None, None).orderBy("word_id").collect()
    assert [(r.term, r.train_count) for r in everything] == [("fox", 4), ("cat", 3), ("dog", 3), ("gnu", 2), ("emu", 1)]


def test_order_scope_lies_within_fit_scope(docs):
    with pytest.raises(ValueError):
        vocab_of(docs, ("train_sup",), ("valid",))


def test_same_result_under_any_partitioning(docs, partitions):
    vocab = vocab_of(docs)
    assert [r.term for r in vocab.orderBy("word_id").collect()] == ["cat", "dog", "emu", "fox"]
    assert features(bow.bag_of_words(docs, vocab)) == EXPECTED


def test_vocab_is_the_same_from_counts_and_from_tokens(docs):
    counts = bow.filter_stop_words(bow.term_frequency(docs, carry=["split"]), ENGLISH_STOP_WORDS)
    assert bow.fit_vocab(counts).orderBy("word_id").collect() == vocab_of(docs, None, None).orderBy("word_id").collect()


EXPECTED = {1: [(0, 2), (1, 1)], 2: [(1, 1), (2, 1)], 3: [(1, 1), (3, 3)], 4: [(0, 1), (3, 1)], 5: [], 6: []}


def test_bag_of_words_keeps_documents_without_terms(docs):
    assert features(bow.bag_of_words(docs, vocab_of(docs), carry=["split"])) == EXPECTED


def test_pack_equals_fused(docs):
    long = bow.transform_bow(bow.term_frequency(docs), vocab_of(docs))
    assert features(bow.pack_bow(docs.select("doc_id"), long)) == EXPECTED


@pytest.mark.parametrize("head_terms", [0, 1, 2, 100])
def test_large_vocabulary_path_gives_the_same_rows(docs, head_terms):
    small = {"broadcast_bytes": 0, "head_terms": head_terms}
    assert features(bow.bag_of_words(docs, vocab_of(docs), **small)) == EXPECTED
    long = bow.transform_bow(bow.term_frequency(docs), vocab_of(docs), **small)
    assert features(bow.pack_bow(docs.select("doc_id"), long)) == EXPECTED


def test_large_vocabulary_path_with_hot_terms(spark):
    """A term the ordering never counted, and one outside the vocabulary, hold a third of the rows each."""
    docs = spark.range(400).selectExpr(
        "id AS doc_id", "if(id < 5, 'train', if(id < 200, 'unsup', 'test')) AS split", "concat('hot w', id, if(id >= 5, ' oov', '')) AS text"
    )
    rows = bow.token_rows(docs, ["split"]).where("term <> 'oov'")
    vocab = bow.fit_vocab(rows, ["train", "unsup"], ["train"])
    plain = features(bow.bag_of_words(docs, vocab))
    assert len(plain) == 400 and all(len(f) == (2 if d < 200 else 1) for d, f in plain.items())
    for head_terms in (2, 10, 10_000):
        assert features(bow.bag_of_words(docs, vocab, broadcast_bytes=0, head_terms=head_terms)) == plain


def test_term_counts_are_kept_by_lookup_and_reindex(spark, docs):
    tf = bow.term_frequency(docs)
    total = tf.agg(F.sum("tf")).first()[0]
    assert total == sum(sum(Counter((t or "").split()).values()) for _, _, t in DOCS)
    vocab = bow.fit_vocab(bow.term_frequency(docs, carry=["split"]))
    assert bow.transform_bow(tf, vocab).agg(F.sum("tf")).first()[0] == total


def test_one_text_shuffle_from_text_to_rows(spark, docs, tmp_path):
    path = str(tmp_path / "docs")
    docs.write.parquet(path)
    stored = spark.read.parquet(path)
    rows = bow.bag_of_words(stored, vocab_of(stored), carry=["split"])
    above_vocabulary = plan(rows).split("BroadcastExchange")[0]
    assert above_vocabulary.count("Exchange") == 1 and "REPARTITION_BY_COL" in above_vocabulary
    assert "Python" not in plan(rows)
    assert shuffles(bow.term_frequency(stored)) == 1


def test_stop_words_as_a_table(spark, docs):
    words = spark.createDataFrame([("cat",), ("fox",)], "term string")
    tf = bow.term_frequency(docs)
    assert {r.term for r in bow.filter_stop_words(tf, words).collect()} == {"the", "dog", "emu", "gnu"}
    assert bow.filter_stop_words(tf, ()).count() == tf.count()


def test_reindex_words(spark):
    doc_word = spark.createDataFrame([(1, 10, 2), (1, 11, 5), (2, 12, 2)], "doc_id long, word_id long, n int")
    words = spark.createDataFrame([(10, "b"), (11, "c"), (12, "a"), (13, "z")], "word_id long, term string")
    moved, vocab = bow.reindex_words(doc_word, words)
    assert [(r.term, r.train_count) for r in vocab.orderBy("word_id").collect()] == [("c", 5), ("a", 2), ("b", 2), ("z", 0)]
    assert sorted(map(tuple, moved.collect())) == [(1, 0, 5), (1, 2, 2), (2, 1, 2)]


def test_zero_counts_are_skipped_and_repeats_are_not_merged(spark):
    docs = spark.createDataFrame([(1,)], "doc_id long")
    rows = spark.createDataFrame([(1, 3, 0), (1, 2, 4), (1, 0, 1)], "doc_id long, word_id long, tf long")
    assert features(bow.pack_bow(docs, rows)) == {1: [(0, 1), (2, 4)]}


def test_compound_key(spark):
    docs = spark.createDataFrame([(0, 7, "aa bb"), (1, 7, "bb bb")], "class int, doc_id long, text string")
    vocab = bow.fit_vocab(bow.token_rows(docs, ["class"]))
    rows = bow.bag_of_words(docs, vocab, ("class", "doc_id")).collect()
    assert {(r["class"], r.doc_id): [tuple(e) for e in r.features] for r in rows} == {(0, 7): [(0, 1), (1, 1)], (1, 7): [(0, 2)]}


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 200, 0])
@pytest.mark.parametrize("how", ["inner", "left", "left_anti"])
def test_match_is_a_join(spark, broadcast_bytes, how):
    """Hot keys, keys longer than any word, null keys and unknown keys, whatever is broadcast."""
    keys = ["hot"] * 300 + ["x" * 400] * 200 + [f"k{i}" for i in range(80)] + [None] * 5
    rows = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "i long, key string")
    table = spark.createDataFrame([("hot", 1), ("x" * 400, 2)] + [(f"k{i}", i) for i in range(0, 160, 2)], "key string, id long")
    want = sorted(map(tuple, rows.join(table, "key", how).collect()), key=repr)
    for head_terms in (0, 3, 100):
        got = bow.match(rows, table, "key", how, broadcast_bytes, head_terms)
        assert sorted(map(tuple, got.select(rows.join(table, "key", how).columns).collect()), key=repr) == want


def test_stop_words_and_word_ids_beyond_a_broadcast(spark):
    rows = spark.createDataFrame([(1, "the"), (1, "rain"), (2, "the")], "doc_id long, term string")
    stop = spark.createDataFrame([("the",), ("a",), ("the",)], "term string")
    assert [tuple(r) for r in bow.filter_stop_words(rows, stop, broadcast_bytes=0).collect()] == [(1, "rain")]
    doc_word = spark.createDataFrame([(1, 7, 5), (2, 7, 1), (2, 8, 9)], "doc_id long, word_id long, n int")
    words = spark.createDataFrame([(7, "b"), (8, "a"), (9, "c")], "word_id long, term string")
    moved, vocab = bow.reindex_words(doc_word, words, broadcast_bytes=0, head_terms=1)
    assert sorted(map(tuple, moved.collect())) == [(1, 1, 5), (2, 0, 9), (2, 1, 1)]
    assert [r.term for r in vocab.orderBy("word_id").collect()] == ["a", "b", "c"]


def test_packed_counts(spark, docs):
    """Equal to counting by explosion, written or not, for empty and null texts too."""
    packed = bow.with_counts(docs, pattern="[a-z0-9_]{2,}")
    assert {r.doc_id: [tuple(c) for c in r.counts] for r in packed.collect()} == {
        i: sorted((t, n) for t, n in Counter((text or "").split()).items()) for i, _, text in DOCS
    }
    want = sorted(map(tuple, bow.term_frequency(docs).select("doc_id", "term", "tf").collect()))
    assert sorted(map(tuple, bow.count_rows(packed).collect())) == want
    long = spark.createDataFrame([(1, " ".join(f"w{i % 700}" for i in range(20_000)))], "doc_id long, text string")
    assert {r.tf for r in bow.count_rows(bow.with_counts(long)).collect()} == {28, 29}


def test_a_corpus_is_tokenised_once(spark, docs):
    from corpusloom.operators.ordering import Order
    from corpusloom.plans import corpora

    prepared = corpora.prepare(docs.withColumn("label", F.lit(0)), corpora.REVIEWS, "docs")
    made = corpora.build(prepared, corpora.REVIEWS, Order(), True)
    for part in (made.features, made.vocab, made.docs):
        assert "regexp_extract_all" not in plan(part)
    above_vocabulary = plan(made.features).split("BroadcastExchange")[0]
    assert above_vocabulary.count("Exchange") == 1 and "text" not in above_vocabulary


def test_unmatched_keys_stay_where_they_lie(spark):
    """A third of the keys are null, a third unknown: neither is dealt by key."""
    key = F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, F.concat(F.lit("oov"), "id")).otherwise(F.concat(F.lit("k"), F.col("id") % 90))
    rows = spark.range(0, 6000, 1, 8).select("id", key.alias("key"))
    table = spark.range(90).select(F.concat(F.lit("k"), "id").alias("key"), F.col("id").alias("n"))
    got = bow.match(rows, table, "key", "left", broadcast_bytes=0, head_terms=0)
    nulls = got.where("key is null").groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in nulls) == 2000 and max(r["count"] for r in nulls) < 1000
    held = bow._may_hold(rows, table, "key", "held").where("held")
    assert held.where("key is null").count() == 0
    assert 2000 <= held.count() < 2400


def test_empty_documents_beside_a_large_vocabulary(spark):
    docs = spark.range(300).selectExpr("id AS doc_id", "if(id % 3 = 0, null, concat('ab w', id % 7)) AS text")
    vocab = bow.fit_vocab(bow.token_rows(docs))
    plain = features(bow.bag_of_words(docs, vocab))
    assert features(bow.bag_of_words(docs, vocab, broadcast_bytes=0, head_terms=1)) == plain
    assert sum(not f for f in plain.values()) == 100


def test_rows_of_terms_are_dealt_as_widely_as_the_session_shuffles(spark, docs, partitions):
    """Not into the few partitions that the bytes of their text ask for; rows of any order are moved before they are packed."""
    tf = bow.term_frequency(docs)
    assert tf.rdd.getNumPartitions() == partitions
    assert sorted(map(tuple, tf.where("doc_id = 1").collect())) == [(1, "cat", 2), (1, "dog", 1), (1, "the", 1)]
    rows = spark.createDataFrame([(1, 3, 1), (None, 2, 4), (1, 0, 1), (None, 1, 1)], "doc_id long, word_id long, tf long")
    packed = bow.pack_bow(rows.select("doc_id").distinct(), rows, colocate=True)
    assert features(packed) == {1: [(0, 1), (3, 1)], None: []}
    assert "collect_list" not in plan(packed).split("REPARTITION_BY_NUM")[-1]


def test_frequent_keys_are_as_many_as_fit(spark):
    """Of keys that hold 1, 2, 4 ... 512 rows those of most rows, down to where the broadcast is full."""
    rows = spark.range(10).selectExpr("explode(sequence(1, int(pow(2, id)))) AS i", "concat('k', id) AS key")
    for fits in range(11):
        kept = bow._frequent(rows, "key", fits * (bow.ROW_BYTES + 2), 1 << 24)
        assert {r.key for r in kept.collect()} == {f"k{i}" for i in range(10 - fits, 10)}
    assert {r.key for r in bow._frequent(rows, "key", 1 << 20, 4).collect()} == {"k8", "k9"}


def test_words_beyond_a_broadcast_meet_only_rare_terms(spark):
    """Terms of the first words, unknown ones and stop words are not written as rows; repeated and null keys are one document each."""
    text = "concat('aa aa bb oov', id, ' rare', id, if(id % 9 = 0, ' gone', ''))"
    docs = spark.range(200).selectExpr("if(id % 50 = 0, null, id div 2) AS doc_id", "'x' AS tag", f"if(id = 7, null, {text}) AS text")
    counted = bow.with_counts(docs)
    vocab = bow.fit_vocab(bow.count_rows(counted).where("term not like 'oov%' and term <> 'gone'"))
    whole = sorted(((r.doc_id or -1, r.tag, r.features) for r in bow.bag_of_counts(counted, vocab, carry=["tag"]).collect()))
    assert len(whole) == 101
    for size in (0, 110, 400):
        made = bow.bag_of_counts(counted, vocab, carry=["tag"], broadcast_bytes=size)
        assert sorted(((r.doc_id or -1, r.tag, r.features) for r in made.collect())) == whole


def test_more_rows_of_terms_make_more_tasks(spark, docs):
    """Not the session's number whatever the input is; what is counted and packed stays the same, for null and repeated keys too."""
    dealt = lambda df: int(re.search(r"hashpartitioning\(doc_id#\d+L?, (\d+)\), REPARTITION_BY_NUM", plan(df))[1])
    text = "if(id % 9 = 0, null, concat('alpha beta alpha number', id, ' group', id % 7))"
    docs = spark.range(800).selectExpr("if(id % 40 = 0, null, id div 2) AS doc_id", f"{text} AS text")
    plain = bow.term_frequency(docs)
    assert dealt(plain) == 4
    for part in (docs, docs.where("doc_id < 200")):
        terms = bow.term_frequency(part, task_rows=100)
        rows = terms.count()
        assert rows / 100 <= dealt(terms) <= rows / 50
        assert rows / 100 <= bow.parts_for(terms, task_rows=100) < rows / 100 + 1
    assert sorted(map(str, bow.term_frequency(docs, task_rows=100).collect())) == sorted(map(str, plain.collect()))
    keys, rows = docs.select("doc_id").distinct(), bow.transform_bow(plain, bow.fit_vocab(plain))
    packed = bow.pack_bow(keys, rows, colocate=True, parts=bow.parts_for(rows, task_rows=100))
    assert dealt(packed) == bow.parts_for(rows, task_rows=100) > 20
    assert features(packed) == features(bow.pack_bow(keys, rows))
    assert bow.parts_for(docs.limit(0)) == bow.parts_for(docs.limit(0), bow.text_rows()) == 1


def test_large_bags_are_dealt_by_their_terms(spark):
    docs = spark.range(300).selectExpr("id AS doc_id", "if(id % 3 = 0, null, concat('ab w', id % 7, ' v', id)) AS text")
    vocab = bow.fit_vocab(bow.token_rows(docs))
    plain = features(bow.bag_of_words(docs, vocab))
    counted = bow.with_counts(docs)
    for rows in (None, bow.text_rows()):
        made = bow.bag_of_counts(counted, vocab, broadcast_bytes=0, head_terms=1, rows=rows, task_rows=50)
        assert features(made) == plain


@pytest.mark.parametrize("how", ["inner", "left", "left_anti"])
def test_more_rows_of_rare_keys_make_more_tasks(spark, how):
    """Not the session's number whatever the input is; null, repeated, frequent and unknown keys meet what a join gives them."""
    key = "CASE WHEN id % 9 = 0 THEN null WHEN id % 5 = 0 THEN 'k1' ELSE concat('k', id div 3) END"
    rows = spark.range(900).selectExpr(f"{key} AS key", "id AS n")
    table = spark.range(0, 250).selectExpr("concat('k', id) AS key", "id AS value")
    whole = sorted(map(str, rows.join(table, "key", how).collect()))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for head_terms, task_rows, tasks in ((0, 100, 8), (20, 100, 7), (0, 1 << 20, None), (20, 50, 13)):
            got = bow.match(rows, table, "key", how, broadcast_bytes=0 if not head_terms else 1000, head_terms=head_terms, task_rows=task_rows)
            dealt = re.findall(r"hashpartitioning\(key#\d+L?, (\d+)\), REPARTITION_BY_NUM", plan(got))
            assert set(dealt) == (set() if tasks is None else {str(tasks)})
            assert sorted(map(str, got.collect())) == whole
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_rare_words_are_dealt_by_their_number(spark):
    """Four million rows of words and a bit more, none of them frequent, ask for five tasks of a million at most; the session shuffles to four."""
    rows = spark.range(4 * bow.TASK_ROWS + 1).selectExpr("id AS word_id", "1 AS n")
    words = spark.range(10).selectExpr("id * 1000 AS word_id", "'w' AS term")
    got = bow.match(rows, words, "word_id", broadcast_bytes=0, head_terms=0, stored=True)
    assert re.search(r"hashpartitioning\(word_id#\d+L?, 5\), REPARTITION_BY_NUM", plan(got))
    assert got.count() == 10
