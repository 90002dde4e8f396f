"""Ranked search against brute force over all documents and against its SQL."""

import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import lexical
from tests.llm.test_tables import sql_rows

DOCS = "doc_id long, text string, lang string, m long, block int, row string"
ITEMS = "item_id long, text string, rank int"


def terms_of(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", folded)


def brute(docs, items, k):
    bags = [(i, Counter(terms_of(t)), len(terms_of(t))) for i, t, *_ in docs]
    bags = [b for b in bags if b[2]]
    n_docs, n_terms = len(bags), sum(b[2] for b in bags)
    df = Counter(t for _, bag, _ in bags for t in bag)
    out = []
    for item, text, *_ in items:
        scored = []
        for i, bag, n in bags:
            m = 75 + (25 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 12 * m)) for t in terms_of(text) if t in bag)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -score) for rank, (score, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(12)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(400)] + ["Été", "中\u3000文", "a\x85b", "A", "x_y", "it's"]
    docs = [(i, rng.choice([" ", ", ", "\x00"]).join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 20, 21, 80]))), "en", 1, 2, "x") for i in range(300)]
    docs += [(1000 + i, "same w1 w2 text", "en", 0, 0, None) for i in range(40)] + [(None, "same w1", None, 1, 1, ""), (None, None, None, 1, 1, ""), (-3, "", "", 0, 0, ""), (-4, " .!", "", 0, 0, "")]
    docs += [(2000, "w1 " * 30_000 + " ".join(f"r{i}" for i in range(5000)), "en", 0, 0, "")]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 5, 30]))), 5) for i in range(25)]
    items += [(100, "same TEXT same", 1), (100, "same TEXT same", 1), (None, "w2 r77", 1), (101, "", 1), (102, None, 1), (103, "nowhere", 1), (104, "w1", 1)]
    return docs, items


@pytest.mark.parametrize(("docs_in_chunk", "postings", "queries"), [(2048, 1 << 18, 1000), (7, 100, 4)])
def test_search(spark, corpus, monkeypatch, docs_in_chunk, postings, queries):
    monkeypatch.setattr(lexical, "CHUNK_DOCS", docs_in_chunk)
    monkeypatch.setattr(lexical, "CHUNK_POSTINGS", postings)
    monkeypatch.setattr(lexical, "QUERIES", queries)
    docs, items = corpus
    frames = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    got = lexical.rank_items(*frames)
    found = sorted(map(tuple, got.collect()), key=repr)
    assert found == brute(docs, items, 20)
    if queries == 1000:
        no_nulls = frames[0].where("doc_id is not null"), frames[1].where("item_id is not null")
        rows = lexical.rank_items(*no_nulls)
        assert sorted(map(tuple, rows.collect()), key=repr) == sql_rows(lexical.SQL, rows.columns, documents=no_nulls[0].drop("row", "m"), benchmark=no_nulls[1].drop("rank"))


def test_index_is_stratified(spark, corpus, monkeypatch):
    """A chunk is of one normaliser and bounded; every posting is in it once, by term and rising tf."""
    monkeypatch.setattr(lexical, "CHUNK_DOCS", 10)
    docs, _ = corpus
    index = lexical.build(spark.createDataFrame(docs, DOCS))
    chunks = index.chunks.collect()
    postings = Counter()
    for c in chunks:
        terms = c.terms.split(" ")
        assert len(c.first) == len(terms) + 1 and len(c.ends) == len(c.tfs)
        for t, term in enumerate(terms):
            runs = range(c.first[t], c.first[t + 1])
            assert [c.tfs[r] for r in runs] == sorted({c.tfs[r] for r in runs})
            for r in runs:
                postings.update((c.m, term, c.tfs[r], c.ids[s]) for s in c.slots[c.ends[r - 1] if r else 0 : c.ends[r]])
    want = Counter()
    for i, text, *_ in docs:
        bag = Counter(terms_of(text))
        want.update((75 + 25 * bag.total() * index.n_docs // index.n_terms, t, n, i) for t, n in bag.items())
    assert postings == want
    assert max(len(c.ids) for c in chunks) < 40  # 40 copies of one text among the strata


def test_visits_are_pruned(spark, corpus):
    """Chunks that cannot reach the score to beat give nothing."""
    docs, _ = corpus
    index = lexical.build(spark.createDataFrame(docs, DOCS))
    block = lexical._Queries([{"row": 0, "terms": "same text", "tfs": [1, 1]}])
    directory = lexical._directory(index.chunks, block)
    df = {0: 41, 1: 40}
    assert {r.number: r.n for r in directory.selectExpr("explode(arrays_zip(number, docs)) as p").groupBy("p.number").agg({"p.docs": "sum"}).toDF("number", "n").collect()} == df
    block.weigh(index.n_docs, df)
    assert len(lexical._best_chunks(directory, block)) == 1
    block.least[0] = 1 << 60
    assert lexical._visit(index.chunks, block, 20).collect() == []


@pytest.mark.parametrize("empty", ["docs", "items", "both"])
def test_nothing_to_search(spark, corpus, empty):
    docs, items = corpus
    frames = spark.createDataFrame(docs[:50] if empty == "items" else [], DOCS), spark.createDataFrame(items if empty == "docs" else [], ITEMS)
    got = lexical.rank_items(*frames)
    assert got.collect() == [] and got.columns == ["item_id", "rank", "doc_id", "score"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=30), min_size=1, max_size=5))
def test_terms(texts):
    terms, starts = lexical.split_terms(pa.array(texts, pa.large_string()))
    assert [terms.to_pylist()[a:b] for a, b in zip(starts, starts[1:])] == [terms_of(t) for t in texts]
