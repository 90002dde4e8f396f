"""Components, SimHash and p-stable hashing against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from corpusloom.llm import pstable, simhash
from corpusloom.llm.common import connected_components
from corpusloom.llm.simhash import text_fingerprints

SCHEMA = "doc_id long, text string, fingerprint int, component_id string"  # with columns that clash with results


def components(nodes, linked):
    """Smallest member of everyone's component, by merging."""
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    path = [(i, i + 1) for i in range(100, 160)]
    star = [(7, i) for i in range(1000, 1400)]
    loose = [(rng.randrange(2000, 2200), rng.randrange(2000, 2200)) for _ in range(120)]
    edges = [*path, *star, *loose, (5, 5), (-3, 5)]
    got = connected_components(spark.createDataFrame([*edges, (None, 3)], "x long, y long"), "x", "y")
    want = components({n for e in edges if e[0] != e[1] for n in e}, edges)
    assert {r.node: r.component for r in got.collect()} == want


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "x long, y long"), "x", "y").collect() == []


def brute_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in lowered.translate(dict.fromkeys(range(9, 14), " ")).split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_across_chunks(monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 7)
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["A", "bé", "c\x0bd", "É", " x"]) for _ in range(n)) for n in (0, 1, 2, 3, 4, 30, 9, 50)]
    got = text_fingerprints(pa.array([*texts, "  \n"], pa.large_string()))
    assert got.tolist() == [brute_fingerprint(t) for t in [*texts, "  \n"]]


@pytest.fixture(scope="module")
def near_texts():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(25):
        base = [rng.choice(words) for _ in range(120)]
        for _ in range(rng.randrange(1, 7)):
            copy = list(base)
            copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    return [*texts, texts[0], None, "", "one", "one two", "ONE two"]


def test_simhash(spark, near_texts):
    rows = [(i, t, 1, "x") for i, t in enumerate(near_texts)] + [(3, near_texts[3], 1, None), (None, near_texts[5], 2, None), (None, "a text of its own that nothing is near to", 3, None)]
    fps = [brute_fingerprint(t) for _, t, *_ in rows]
    close = [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    group = components(range(len(rows)), close)
    least = {}
    for i, g in group.items():
        least[g] = min([x for x in (least.get(g), rows[i][0]) if x is not None], default=None)
    want = sorted((r[0] is None, r[0], f"{f:016x}", least[group[i]]) for i, (r, f) in enumerate(zip(rows, fps)))
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.fingerprint, r.component_id) for r in got) == want
    assert len(set(group.values())) < len(rows) - 10  # the fixture has near copies
    kept = simhash.keep_first(spark.createDataFrame(rows, SCHEMA))
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(None) == 2 and sorted(i for i in ids if i is not None) == sorted({w for *_, w in want if w is not None})
    assert kept.columns == ["doc_id", "text", "fingerprint", "component_id"]


def test_rows_that_repeat_an_id_are_decided_one_by_one(spark):
    """Different texts under one id all stay, a near copy goes alone, and a rerun keeps the same rows."""
    rng = random.Random(12)
    a, b, c, d = (" ".join(f"w{rng.randrange(300)}" for _ in range(80)) for _ in range(4))
    rows = [(1, a), (5, b), (5, c), (5, a), (5, c), (7, d), (7, a), (8, b), (9, None), (9, d)]
    for order in (rows, rows[::-1]):
        frame = spark.createDataFrame([(i, t, n % 2, None) for n, (i, t) in enumerate(order)], SCHEMA).repartition(3)
        kept = [(r.doc_id, r.text) for r in simhash.keep_first(frame).collect()]
        assert sorted(kept, key=repr) == sorted([(1, a), (5, b), (5, c), (7, d), (9, None)], key=repr)


def test_simhash_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(empty).collect() == []
    assert simhash.keep_first(empty).collect() == []


def test_large_buckets_span_their_components():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 3, dtype=np.uint64)
    members = np.unique([b ^ np.uint64(1 << int(i)) ^ np.uint64(1 << int(j)) for b in base for i, j in rng.integers(0, 60, (40, 2))])
    for verify in (simhash._large, lambda m, out: simhash._small(m[None, :], out)):
        found = []
        verify(members, found)
        edges = [(int(a), int(b)) for x, y in found for a, b in zip(x, y)]
        all_edges = [(int(a), int(b)) for i, a in enumerate(members) for b in members[:i] if (int(a) ^ int(b)).bit_count() <= 3]
        assert components(map(int, members), edges) == components(map(int, members), all_edges)
        assert len(edges) < len(members)


@pytest.mark.parametrize("cell", [pstable.CELL, 8])
def test_pstable(spark, monkeypatch, cell):
    monkeypatch.setattr(pstable, "CELL", cell)
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((40, 16))
    vectors = [c + 0.08 * rng.standard_normal(16) for c in centres for _ in range(rng.integers(1, 5))]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)] + [(500 + i, rows_[:]) for i, rows_ in enumerate([list(map(float, vectors[0]))] * 20)]
    odd = [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] + [1.0] * 15), (904, [None] + [1.0] * 15), (905, [1e-200] * 16), (906, [1e-200] * 16), (907, [2.0] * 3)]
    got = {r.vec_id: r for r in pstable.near_duplicates(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")).collect()}
    good = rows + [(905, [1.0] * 16), (906, [1.0] * 16)]
    unit = np.array([np.array(v) / np.linalg.norm(v) for _, v in good])
    close = [(good[i][0], good[j][0]) for i, j in zip(*np.nonzero(np.triu(unit @ unit.T >= 0.9, 1)))]
    group = components([i for i, _ in rows + odd], close)
    assert {i: r.component_id for i, r in got.items()} == group
    assert {i: r.n_links for i, r in got.items()} == {i: sum(i in pair for pair in close) for i in group}
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert len(close) > 200


def test_pstable_of_nothing(spark):
    assert pstable.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
