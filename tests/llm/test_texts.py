"""Operators on whole texts: language model, classifier, tokens, fingerprints, licenses."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import bpe, crf, licenses, ppm, winnow
from corpusloom.llm.catalog import byte_bpe_path

SCHEMA = "doc_id long, text string, score string, ids int"
ODD = [(None, None, "x", 1), (-5, "", None, 2), (-6, " \n\x0b ", None, 2), (-7, "Éa É", None, 3), (-7, "Éa É", None, 3)]


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(6)
    words = ["the", "The", "rain", "in", "Späin", "falls", "mainly", "plain.", "x" * 60, "中文", "😀"]
    return [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 4, 40, 200]))) + rng.choice(["", "\n", "  "]), "s", 0) for i in range(60)] + ODD


class Brute:
    """Prediction by partial matching with dictionaries."""

    def __init__(self, texts):
        self.follow = {}
        for text in texts:
            data = self.symbols(text)
            for p in range(ppm.ORDER, len(data)):
                self.follow.setdefault(bytes(data[p - ppm.ORDER : p]), Counter())[data[p]] += 1
        for order in range(ppm.ORDER, 0, -1):
            for context in [c for c in self.follow if len(c) == order]:
                for symbol in self.follow[context]:
                    self.follow.setdefault(context[1:], Counter())[symbol] += 1

    def symbols(self, text):
        return [ppm.PAD] * ppm.ORDER + list(lowered(text).encode()) + [ppm.END]

    def score(self, text):
        data, total = self.symbols(text), 0.0
        for p in range(ppm.ORDER, len(data)):
            excluded = set()
            for order in range(ppm.ORDER, -1, -1):
                live = {s: n for s, n in self.follow.get(bytes(data[p - order : p]), {}).items() if s not in excluded}
                if data[p] in live:
                    total += math.log10((live[data[p]] - 0.5) / sum(live.values()))
                    break
                if live:
                    total += math.log10(len(live) / 2 / sum(live.values()))
                    excluded |= set(live)
            else:
                total -= math.log10(ppm.ALPHABET - len(excluded))
        return total


@pytest.mark.parametrize(("shard_rows", "hot", "cell"), [(ppm.SHARD_ROWS, ppm.HOT_ROWS, ppm.CELL_TEXT), (ppm.SHARD_ROWS, 20, 2000), (50, 20, 2000)])
def test_ppm(spark, texts, monkeypatch, shard_rows, hot, cell):
    monkeypatch.setattr(ppm, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(ppm, "HOT_ROWS", hot)
    monkeypatch.setattr(ppm, "CELL_TEXT", cell)
    monkeypatch.setattr(ppm, "WORD_ROWS", shard_rows // 10)
    trained = [t for i, t, *_ in texts if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2]
    brute, counts = Brute(trained), Counter(w for t in trained for w in words_of(lowered(t)))
    tokens, kinds = sum(counts.values()) + len(trained), len(counts) + 1
    want = []
    for i, text, *_ in texts:
        words = words_of(lowered(text))
        base = sum(math.log10((n + 1) / (tokens + kinds + 1)) for n in [counts[w] for w in words] + [len(trained)])
        want.append((i is None, i, len(words) + 1, sum(counts[w] > 0 for w in words) + 1, tokens, round(base, 6), round(brute.score(text), 6)))
    got = ppm.held_out_scores(spark.createDataFrame(texts, SCHEMA)).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got) == sorted(want)
    assert {r.held_out for r in got} == {True, False}


def test_ppm_of_nothing(spark):
    assert ppm.held_out_scores(spark.createDataFrame([], SCHEMA)).collect() == []


def test_ppm_probabilities_sum_to_one():
    """After any context the probabilities of all next symbols add up to one."""
    brute = Brute(["abcab", "abd", "bca"])
    data = [ppm.PAD] * ppm.ORDER + list(b"abcabx")
    for end in range(ppm.ORDER, len(data)):
        total = 0.0
        for symbol in range(256):
            brute.symbols = lambda _, s=symbol, e=end: data[:e] + [s]
            whole = brute.score("")
            brute.symbols = lambda _, e=end: data[:e]
            total += 10 ** (whole - brute.score(""))
        assert total == pytest.approx(1)


@pytest.fixture(scope="module")
def vocab():
    return bpe.vocabulary(byte_bpe_path())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(byte_bpe_path())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "th", " ", "  ", "\n", "é", "'s", "12", "!!", "<|endoftext|>", "中", "😀", "\x85", " ", "ing", "the"]) | st.characters(codec="utf-8"), max_size=40).map("".join))
def test_bpe_is_the_librarys(vocab, library, text):
    assert vocab.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_bpe_long_words_and_new_letters(vocab, library):
    texts = ["x" * 3000, "ab" * 700, " " * 500, "წ5࢏1࢏ a࢏", "".join(map(chr, range(0x1F00, 0x2000)))]
    assert [e.tolist() for e in vocab.encode(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_bpe_speculation_fails_and_is_mended(vocab):
    words = [w.encode() for w in ("nonsensically", "antidisestablishmentarianism", "hello", "zzzzzzz", "tionthe")]
    greedy, counts = vocab.greedy(words)
    cut = np.split(greedy, np.cumsum(counts)[:-1])
    exact = [vocab.exact(w) for w in words]
    assert [list(m) for m in vocab.merge_all(words)] == exact
    assert any(list(g) != e for g, e in zip(cut, exact))
    for g, e in zip(cut, exact):
        assert (vocab.own[g].all() and vocab.compatible(g[:-1], g[1:]).all()) == (list(g) == e)


def test_bpe_in_spark(spark, texts, library):
    got = bpe.round_trip(spark.createDataFrame(texts, SCHEMA), byte_bpe_path()).collect()
    want = []
    for i, text, *_ in texts:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append((i is None, i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert sorted((r.doc_id is None, r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(want)
    broken = spark.createDataFrame([(1, [255, 120]), (2, None)], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in bpe.decode(broken, byte_bpe_path()).collect()} == {1: library.decode([255, 120]), 2: ""}


def test_bpe_forgets_words(vocab, library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_WORDS", 3)
    texts = ["one two three four", "two three five <|endoftext|>", "one two"]
    for text in texts:
        assert vocab.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_winnowing_guarantee(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(50)]
    shared = [rng.choice(words) for _ in range(winnow.K + winnow.W - 1)]
    rows = [(i, " ".join([rng.choice(words) for _ in range(rng.randrange(30))] + shared + [rng.choice(words) for _ in range(rng.randrange(30))])) for i in range(40)]
    rows += [(100, "a"), (101, "a b c d e f"), (102, ""), (103, None)]
    found = winnow.add_fingerprint(spark.createDataFrame(rows, "i long, text string"), "text", "fp").collect()
    prints = {r.i: {x.hash for x in r.fp} for r in found}
    assert all(prints[i] & prints[0] for i in range(40))
    assert (len(prints[100]), len(prints[101]), len(prints[102]), len(prints[103])) == (1, 1, 0, 0)
    # The rightmost smallest hash of every window, by brute force over the unwinnowed k-grams.
    every = winnow.add_fingerprint(spark.createDataFrame(rows, "i long, text string"), "text", "fp", w=1).collect()
    grams = {r.i: [x.hash for x in r.fp] for r in every}
    for r in found:
        g, w = grams[r.i], winnow.W
        windows = [range(j, j + w) for j in range(len(g) - w + 1)] or ([range(len(g))] if g else [])
        assert [x.position for x in r.fp] == sorted({max(p for p in win if g[p] == min(g[q] for q in win)) for win in windows})


def test_ties_go_right(spark):
    row = winnow.add_fingerprint(spark.createDataFrame([("a " * 12,)], "text string"), "text", "fp").first()
    assert [x.position for x in row.fp] == [3, 4, 5, 6, 7]


@pytest.mark.parametrize("per_bucket", [winnow.PER_BUCKET, 3])
def test_winnow_edits(spark, texts, monkeypatch, per_bucket):
    monkeypatch.setattr(winnow, "PER_BUCKET", per_bucket)
    got = winnow.edit_report(spark.createDataFrame(texts, SCHEMA)).collect()
    known = sorted((i, t or "") for i, t, *_ in texts if i is not None)
    pairs = [(i, t, known[(n + 1) % len(known)][1]) for n, (i, t) in enumerate(known)] + [(None, "", "")]
    want = [(i is None, i, len(t), hashlib.sha256((t[: len(t) - len(t) // 2] + n[: len(t) // 2]).encode()).hexdigest()) for i, t, n in pairs]
    assert sorted((r.doc_id is None, r.doc_id, r.n_chars, r.edited_sha256) for r in got) == sorted(want)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    by_text = {}
    text_of = {i: t for i, t in known}
    for r in got:
        if r.doc_id is not None:
            by_text.setdefault(text_of[r.doc_id], set()).add(r.fingerprint)
    assert all(len(f) == 1 for f in by_text.values())


def test_winnow_edits_of_little(spark):
    assert winnow.edit_report(spark.createDataFrame([], SCHEMA)).collect() == []
    alone = winnow.edit_report(spark.createDataFrame([(1, "abcd", "", 0)], SCHEMA)).first()
    assert alone.edited_sha256 == hashlib.sha256(b"abab").hexdigest()
    assert alone.near_next == 1.0


def test_forward_backward_is_enumeration():
    rng = np.random.default_rng(8)
    first, odds, trans = np.array([0, 3, 4, 8]), rng.standard_normal(8), rng.standard_normal((2, 2))
    good, expected, log_z = crf.forward_backward(odds, trans, first)
    marginal, moves, total = np.zeros(8), np.zeros((2, 2)), 0.0
    for a, b in zip(first[:-1], first[1:]):
        paths = list(product((0, 1), repeat=b - a))
        weight = np.array([np.exp(sum(odds[a + i] * s for i, s in enumerate(p)) + sum(trans[x, y] for x, y in zip(p, p[1:]))) for p in paths])
        total += np.log(weight.sum())
        for p, w in zip(paths, weight / weight.sum()):
            marginal[a:b] += w * np.array(p)
            for x, y in zip(p, p[1:]):
                moves[x, y] += w
    assert np.allclose(good, marginal) and np.allclose(expected, moves) and log_z == pytest.approx(total)


def test_quality_learns(spark):
    rng = random.Random(9)
    line = lambda junk: " ".join(rng.choice(["rain", "falls", "on", "Spain"]) + rng.choice(["***", "$$$", "|"] if junk else ["", "", ","]) for _ in range(8))
    rows = [(i, "\n".join(line(i % 3 == 0 and rng.random() < 0.9) for _ in range(rng.randrange(1, 8))), "s", 0) for i in range(400)] + ODD
    labels = [(i, int(i % 3 != 0), 0) for i in range(400)] + [(0, None, 0), (None, 1, 0), (7777, 1, 0)]
    frame, known = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = crf.quality(frame, known).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id >= 0]
    assert held and np.mean([r.predicted == (r.doc_id % 3 != 0) for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert [r.score for r in crf.quality(frame, known.limit(0)).collect()] == [0.5] * len(rows)
    assert crf.quality(frame.limit(0), known).collect() == []


def test_document_scores_by_enumeration():
    """A document's score is the logistic step on the mean marginal of its lines, by length, over all labellings."""
    rng = np.random.default_rng(4)
    model = crf.Model(rng.standard_normal(crf.N_FEATURES), rng.standard_normal((2, 2)), 1.3, -0.2)
    texts = ["a line\n\nBUY $$$ now\nthe end.", "one", "", "x y\nx y\n|", "é\n" * 5]
    got = model.scores(pa.array(texts, pa.large_string()))
    for text, score in zip(texts, got, strict=True):
        core, length, first = crf.line_features(pa.array([text], pa.large_string()))
        odds, n = crf.with_neighbours(core, first) @ model.weights, len(core)
        paths = np.array(list(product((0, 1), repeat=n)))
        weight = np.array([np.exp(p @ np.clip(odds, -30, 30) + sum(model.trans[x, y] for x, y in zip(p, p[1:]))) for p in paths])
        marginal = weight @ paths / weight.sum()
        mean = np.clip(np.average(marginal, weights=length + 1e-6), 1e-4, 1 - 1e-4)
        assert score == pytest.approx(1 / (1 + np.exp(-(1.3 * np.log(mean / (1 - mean)) - 0.2))))


def test_quality_learns_from_whole_documents(spark, monkeypatch):
    """The bound on lines leaves documents out, and cuts none."""
    rows = [(i, "\n".join(["It rained.", "$$$ !!"][i % 2] for _ in range(10 + i)), "s", 0) for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    learnt = []
    monkeypatch.setattr(crf, "train", lambda core, length, first, labels: learnt.append(np.diff(first)))
    for bound in (crf.TRAIN_LINES, 200, 1):
        monkeypatch.setattr(crf, "TRAIN_LINES", bound)
        try:
            crf.fit(spark.createDataFrame(rows, SCHEMA), labels)
        except ValueError:
            assert bound == 1
    most, some = learnt
    assert set(some) <= set(most) <= set(range(10, 50))
    assert some.sum() >= 200 > some.sum() - some.max()


def test_quality_draws_whole_samples(spark):
    """Long documents are learnt from, labels without a document take no place, and one label alone is an error."""
    line = {1: "It rained a little, and then it stopped.", 0: "### buy!! || now ## 50% $$$ !!"}
    rows = [(i, "\n".join([line[i % 2]] * (crf.SEQUENCE + 1 + i)), "s", 0) for i in range(60)]
    frame = spark.createDataFrame(rows + rows[:9], SCHEMA)
    labels = [(i, i % 2, 0) for i in range(60)]
    known = spark.createDataFrame(labels + [(10_000 + i, 1, 0) for i in range(2000)], "doc_id long, quality int, toxic int")
    texts = pa.array([t for _, t, *_ in rows], pa.large_string())
    scores = crf.fit(frame, known, train_docs=40).scores(texts)
    assert [s >= crf.THRESHOLD for s in scores] == [bool(i % 2) for i in range(60)]
    for some in (known.where("quality = 1"), known.where("doc_id >= 10000")):
        with pytest.raises(ValueError, match="both labels"):
            crf.fit(frame, some)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="aB1 .!|*é\n", max_size=30), min_size=1, max_size=6))
def test_line_features_do_not_depend_on_neighbouring_texts(texts):
    core, length, first = crf.line_features(pa.array(texts, pa.large_string()))
    for i, text in enumerate(texts):
        own, own_length, own_first = crf.line_features(pa.array([text], pa.large_string()))
        assert np.allclose(core[first[i] : first[i + 1]], own) and length[first[i] : first[i + 1]].tolist() == own_length.tolist()
        assert own_first[-1] == text.count("\n") + 1


def test_licenses(spark):
    rng = random.Random(10)
    fill = lambda n: [rng.choice(["rain", "in", "the", "License", "under"]) for _ in range(n)]
    rows, want = [], set()
    for i in range(60):
        name = rng.choice(list(licenses.TEMPLATES))
        words = licenses.TEMPLATES[name].split()
        if len(words) > 12 and i % 2:
            words[5] = "changed"  # still found: the rest covers it
        head = " ".join(fill(rng.randrange(30)))
        text = f"{head} {' '.join(words).upper() if i % 3 else ' '.join(words)} {' '.join(fill(rng.randrange(30)))}"
        rows.append((i, text, "s", 0))
        want.add((i, name))
    got = licenses.scan(spark.createDataFrame(rows + ODD, SCHEMA)).collect()
    assert want <= {(r.doc_id, r.license) for r in got}
    texts = dict((r[0], r[1]) for r in rows)
    for r in got:
        template = [w.strip(licenses.EDGES).lower() for w in licenses.TEMPLATES[r.license].split()]
        span = [w.strip(licenses.EDGES).lower() for w in texts[r.doc_id][r.span_start : r.span_end].split()]
        common = longest_common(template, span)
        assert r.matched_words == common and r.coverage == pytest.approx(common / len(template)) and r.coverage >= 0.8


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_licenses_repeat_in_a_text(spark):
    line = licenses.TEMPLATES["MIT"]
    got = licenses.scan(spark.createDataFrame([(1, f"{line} x {line}\n{line}", "s", 0)], SCHEMA)).collect()
    assert sorted((r.span_start, r.span_end) for r in got) == [(0, len(line)), (len(line) + 3, 2 * len(line) + 3), (2 * len(line) + 4, 3 * len(line) + 4)]
    with pytest.raises(ValueError, match="fewer than"):
        licenses.Index({"short": "two words"})


def plain_words(text):
    return [w.strip(licenses.EDGES).lower() for w in text.split()]


def edits(words, rng, budget):
    """The words with at most ``budget`` places left out, replaced or interrupted, and how many of them are gone."""
    put, gone, out = licenses.gap(len(words)), 0, []
    places = set(rng.sample(range(len(words)), min(budget, len(words))))
    for at, word in enumerate(words):
        kind = rng.choice(["out", "instead", "between"]) if at in places else "as is"
        if kind == "between" and 0 < at:
            n = rng.randrange(1, put + 1) if put else 0
            put -= n
            out += ["rain"] * n
        if kind in ("out", "instead"):
            gone += 1
            out += ["falls"] * (kind == "instead")
        else:
            out.append(word)
    return out, gone


def test_licenses_after_edits(spark):
    """What the docstring promises: one edit at every place, as many edits as the coverage may miss, and gaps as long as allowed."""
    rng, texts, want = random.Random(11), [], set()

    def case(name, words, least):
        want.add((len(texts), name, least))
        texts.append(" ".join(["on", "the"] * rng.randrange(4) + words + ["rain", "under"] * rng.randrange(4)))

    case("MIT", "Released under an MIT License.".split(), 4)
    case("MIT", "Released under the very permissive and widely known MIT License.".split(), 5)
    case("MIT", "Released under the q q q q q q MIT License.".split(), 5)
    case("CC-BY-NC-4.0", "Licensed under the CC BY-NC 4.0 license.".split(), 5)
    for name, template in licenses.TEMPLATES.items():
        words = template.split()
        n, needed = len(words), -(-len(words) * 8 // 10)
        for at in range(n if n > needed else 0):
            case(name, words[:at] + ["rain"] + words[at + 1 :], n - 1)
            case(name, words[:at] + words[at + 1 :], n - 1)
            case(name, words[:at] + ["rain"] * (licenses.gap(n) if at else 1) + words[at:], n)
        for _ in range(40):
            edited, gone = edits(words, rng, n - needed)
            case(name, edited, n - gone)
    case("GPL notice", [x for i, w in enumerate(licenses.TEMPLATES["GPL notice"].split()) for x in [w] + ["rain"] * (i % 3 == 2)], 41)
    rows = [(i, text, "s", 0) for i, text in enumerate(texts)]
    got = licenses.scan(spark.createDataFrame(rows, SCHEMA)).collect()
    most = {}
    for r in got:
        most[r.doc_id, r.license] = max(r.matched_words, most.get((r.doc_id, r.license), 0))
        template, span = plain_words(licenses.TEMPLATES[r.license]), plain_words(texts[r.doc_id][r.span_start : r.span_end])
        assert 0.8 * len(template) <= r.matched_words <= longest_common(template, span)
    assert [w for w in sorted(want) if most.get(w[:2], 0) < w[2]] == []


def brute_band(text, template, low, high):
    """Most template words in order with diagonals in the band, and the shortest span, cell by cell."""
    best, cells = (0, 0), {}
    for i, wanted in enumerate(template):
        for j in range(max(0, i + low), min(len(text), i + high + 1)):
            options = [cells.get((i - 1, j), (0, 0)), cells.get((i, j - 1), (0, 0)), cells.get((i - 1, j - 1), (0, 0))]
            cell = max(o if low <= b - a <= high else (0, 0) for o, (a, b) in zip(options, [(i - 1, j), (i, j - 1), (i - 1, j - 1)]))
            if text[j] == wanted:
                n, start = cells.get((i - 1, j - 1), (0, 0))
                grown = (n + 1, start if n else j)
                best = max(best, (grown[0], -(j + 1 - grown[1])))
                cell = max(cell, grown)
            cells[i, j] = cell
    return best[0], -best[1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=14), st.lists(st.integers(1, 4), min_size=1, max_size=7), st.integers(-8, 8), st.integers(0, 8))
def test_banded_alignment(text, template, low, width):
    n, start, end = licenses.align(np.array(text, np.uint64), np.array(template, np.uint64), low, low + width)
    assert (n, end - start) == brute_band(text, template, low, low + width)
    assert n <= longest_common(template, text[start:end])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=12), st.integers(1, 3))
def test_template_winnowing(hashes, w):
    """Every window holds a selected place, and that is its rightmost smallest."""
    at = licenses.winnow(np.array(hashes, np.uint64), w).tolist()
    windows = [range(i, i + w) for i in range(len(hashes) - w + 1)] or ([range(len(hashes))] if hashes else [])
    assert at == sorted({max(p for p in win if hashes[p] == min(hashes[q] for q in win)) for win in windows})


def test_licenses_of_odd_tables(spark):
    """Empty table, nulls, repeats, clashing columns and a very long text."""
    line = licenses.TEMPLATES["MIT"]
    schema = "doc_id long, text string, license string, coverage int, span_start string"
    rows = [(None, line, "x", 1, None), (None, line, "x", 1, None), (1, None, None, None, ""), (2, "", "", 0, ""), (3, "rain the license under " * 200_000 + line, "", 0, "")]
    got = licenses.scan(spark.createDataFrame(rows, schema)).collect()
    assert [r.doc_id for r in got if r.license == "MIT" and r.coverage == 1] == [None, None, 3]
    assert {r.span_end for r in got if r.doc_id == 3 and r.coverage == 1} == {len(rows[4][1])}
    assert licenses.scan(spark.createDataFrame([], schema)).collect() == []
