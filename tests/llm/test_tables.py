"""Operators with SQL: archives, chat, mixing; the pipeline; and every query of the subpackage."""

import os
import random
from collections import Counter

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from corpusloom.llm import chat, mixing, warc
from corpusloom.llm.catalog import QUERIES
from tests.oracle import connect

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
has_tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def sql_rows(sql, columns, **tables):
    con = duckdb.connect()
    for name, frame in tables.items():
        con.register(name, frame.toArrow())
    return ordered(con.execute(sql), columns)


def ordered(result, columns):
    names = [d[0] for d in result.description]
    return sorted((tuple(r[names.index(c)] for c in columns) for r in result.fetchall()), key=repr)


@has_tables
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    query, sql = QUERIES[name]
    got = query(spark, SF_DIR)
    rows = sorted(map(tuple, got.collect()), key=repr)
    if sql is None:
        assert rows or name == "op4_licenses"
    else:
        assert rows == ordered(connect(SF_DIR).execute(sql), got.columns)


@has_tables
def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    before, kept = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = corpus_pipeline.materialize(stage(spark, before, SF_DIR), "stage")
        assert before.columns == list(corpus_pipeline.COLUMNS)
        kept.append(Counter(r.doc_id for r in before.select("doc_id").collect()))
    assert set(kept[2]) <= set(kept[1]) <= set(kept[0])
    assert 0 < len(kept[1]) < len(kept[0]) < docs.count()
    assert max(kept[0].values()) == max(kept[1].values()) == 1 and max(kept[2].values()) <= 3
    final = Counter(r.doc_id for r in corpus_pipeline.run(spark, SF_DIR).collect())
    assert final == kept[2]


HTML = [
    (1, "http://A.Example.com:80/x?q#f", "same"), (2, "http://a.example.com/y", "same"), (2, "http://a.example.com/y", "same"),
    (None, None, "same"), (-4, "", None), (3, "no url\r\n", ""), (None, "http://b", "zz"), (None, "http://b", "zz"),
    (5, "http://é.example/ü", "é\r\n\r\nWARC/1.1\r\n" * 50), (6, "http://c/?a/b", "x" * 300_000),
]


def test_archives(spark):
    pages = spark.createDataFrame([(*r, "clash") for r in HTML], "page_id long, url string, html string, record_type string")
    got = warc.round_trip(pages)
    assert sorted(map(tuple, got.collect()), key=repr) == sql_rows(warc.SQL, got.columns, pages=pages)
    assert warc.round_trip(pages.limit(0)).collect() == []


def test_archives_by_lookup(spark):
    rng = random.Random(1)
    pages = spark.createDataFrame([(i, f"http://{rng.choice('abc')}.example/{i % 9}", "p" * i) for i in range(300)], "page_id long, url string, html string")
    captures = warc.write_archives(pages, min_bytes=50)
    directory = warc.build_index(captures, block_lines=10)
    assert directory.count() >= 30
    wanted = spark.createDataFrame([(7, "http://a.example/7"), (290, pages.where("page_id = 290").first().url), (291, pages.where("page_id = 291").first().url)] * 2, "page_id long, url string")
    found = warc.read_records(warc.lookup(directory, wanted)).collect()
    assert {r.page_id: r.payload_bytes for r in found if r.page_id > 7} == {290: 290, 291: 291} and len(found) <= 3
    small = warc.write_archives(spark.createDataFrame([(1, "u", "aa"), (2, "u", "aa")], "page_id long, url string, html string"), min_bytes=3)
    assert [r.record_type for r in warc.read_records(small).collect()] == ["response"] * 2


def test_keys_and_ids():
    assert warc.url_key("HTTP://user@A.b.Com:8080/P?q=1#x") == "com,b,a:8080)/P?q=1"
    assert warc.url_key("http://h?x") == "h)?x" and warc.url_key(None) == "" and warc.url_key("x y") == "x y"
    for page_id in (0, 1, -1, (1 << 63) - 1, -(1 << 63), None):
        assert warc.page_of(warc.record_id(page_id)) == page_id


control = st.text(alphabet="<|\\>im_startend\n a", max_size=30)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(control | st.just("assistant"), control), max_size=5))
def test_chat_reads_back(turns):
    formatted, spans = chat.render(turns)
    assert chat.parse(formatted) == turns
    assert [chat.unescape(formatted[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_chat_folds(spark):
    events = [
        (1, 5, "delta", 2, None, "lo"), (1, 1, "open", 1, "user", None), (1, 2, "delta", 1, None, "typo"), (1, 3, "open", 2, "assistant", None),
        (1, 4, "delta", 2, None, "hel"), (1, 6, "edit", 1, None, "fixed"), (1, 7, "regenerate", 2, None, None), (1, 8, "delta", 2, None, "new"),
        (2, 1, "open", 1, None, None),
    ]
    log = spark.createDataFrame(events, "conv_id long, seq long, kind string, message long, role string, text string")
    got = {r.conv_id: chat.parse(r.formatted) for r in chat.format_log(log).collect()}
    assert got == {1: [("user", "fixed"), ("assistant", "new")], 2: [("", "")]}


def test_chat_digests(spark):
    rows = [(None, None, None, None, 1), (1, 1, "a\nb\\", None, 1), (1, 1, "a\nb\\", None, 1), (1, None, "assistant", "<\\|" * 3, 1), (1, 2, "assistant", "long " * 9000, 1), (1, 2, "user", "<|", 1)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seq int")
    got = chat.digests(table)
    assert sorted(map(tuple, got.collect()), key=repr) == sql_rows(chat.SQL, got.columns, conversations=table.drop("seq"))
    assert [r.conv_id for r in chat.digests(table.limit(0)).collect()] == [-1]


@pytest.fixture(scope="module")
def sources(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randrange(40)) + rng.choice(["", "***", " | | "]), rng.choices(["a", "b", "é", None, "z"], [50, 20, 1, 1, 30])[0], "x") for i in range(400)]
    rows += [(None, "n n", "a", None), (None, "n n", "a", None), (7, None, "b", None), (900, "", "empty", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size string")


def test_mixing(spark, sources):
    got = mixing.report(sources)
    rows = got.collect()
    assert sorted(map(tuple, rows), key=repr) == sql_rows(mixing.SQL, got.columns, documents=sources.drop("size"))
    assert any(r.target == 3.0 * r.source_size for r in rows) and all(r.taken <= 3 * r.size for r in rows)
    by_target = {}
    for r in rows:
        by_target.setdefault((r.source_size, r.target), []).append(r)
    for (_, target), members in by_target.items():
        assert abs(sum(r.taken for r in members) - target) <= max(r.size for r in members)
    mixed = mixing.mix(sources)
    assert mixed.columns == sources.columns
    want = Counter({(r.doc_id, r.size): 0 for r in rows})
    for r in rows:
        want[r.doc_id, r.size] += r.taken
    for r in mixed.collect():
        want[r.doc_id, len((r.text or "").split())] -= len((r.text or "").split())
    assert set(want.values()) == {0}


def test_mixing_keeps_columns_of_any_name(spark, sources):
    """Columns named as the mix's own and its helpers come out as they went in."""
    names = ["copies", "target", "source_size", "epochs", "_size", "_key", "_bucket", "_of", "_copy", "_row", "a.b"]
    docs = sources
    for name in names:
        docs = docs.withColumn(name, mixing.F.concat(mixing.F.lit(f"{name} "), mixing.F.coalesce("doc_id", mixing.F.lit(-9)).cast("string")))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    rows = mixed.collect()
    assert rows and all(r[name] == f"{name} {-9 if r['doc_id'] is None else r['doc_id']}" for r in rows for name in names)
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in mixing.mix(sources).collect())


def test_mixing_of_nothing(spark, sources):
    assert mixing.report(sources.limit(0)).collect() == []
    assert mixing.mix(sources.limit(0)).collect() == []
