"""The toxicity lexicon: folding, matching against brute force, and learning."""

import random
import unicodedata
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import toxicity
from corpusloom.llm.toxicity import Matcher, folded_words

DOCS = "doc_id long, text string, lang string, score string, predicted int"
LABELS = "doc_id long, quality int, toxic int"
ODD = [(None, None, None, "x", 7), (-5, "", "en", None, 7), (-6, " \n\x0b ", "en", None, 7), (-7, "Éa É", "fr", None, 7), (-7, "Éa É", "fr", None, 7)]


@pytest.mark.parametrize("text", ["idiot", "IDIOT", "1d10t", "іdіоt", "ιdiοt", "idi0t", "!diot", "id­i​ot", "ｉｄｉｏｔ", "𝐢𝐝𝐢𝐨𝐭", "idiot###", "***idiot$$$", "l0s3r", "$tup1d", "c1own", "m0r0n!!", "tr@sh", "7rash", "pathet1c", "wor7hless", "STUPID"])
def test_folding(text):
    words = {w for x in toxicity.WORDS for w in folded_words(x)}
    assert set(folded_words(text)) & words
    assert toxicity.DEFAULT.scores([text])[0] >= 0.5


@pytest.mark.parametrize("text", ["", None, "5 to 10, 1945; 3.14", "idiotes", "a scumming thing", "the trash can", "an idiot-proof lock", "Class clown!", "keep it simple, stupid", "réeux"])
def test_clean(text):
    assert toxicity.DEFAULT.scores([text])[0] < 0.3


def test_signs_after_words_are_no_letters():
    assert folded_words("trash$$$ that@ the! end 50 a1b") == ["trash", "that", "the", "end", "aib"]
    assert folded_words("x l I") == ["x", "i", "i"]


def test_accents_matter_to_entries_that_have_some():
    matcher = Matcher([" réeu", " moron "], ())
    count = lambda text: matcher.hits(folded_words(text))
    assert count("réeux reeux réeu moron mörön") == Counter({0: 2, 1: 2})


def brute_hits(entries, exceptions, words):
    text = f" {' '.join(words)} "
    spared = [(i, i + len(e)) for e in exceptions for i in range(len(text)) if text.startswith(e, i)]
    hits = Counter()
    for k, entry in enumerate(entries):
        for i in range(len(text)):
            if text.startswith(entry, i) and not any(a <= i and i + len(entry) <= b for a, b in spared):
                hits[k] += 1
    return hits


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "ab", "abc", "b", "ba", "c", "cab"]), max_size=12))
def test_hits_are_all_occurrences(words):
    entries, phrases = [" a ", " ab", " abc ", " ba b ", " c"], ("ab a", "a ab a", "c")
    assert Matcher(entries, phrases).hits(words) == brute_hits(entries, [f" {p} " for p in phrases], words)


def learnable(n=900):
    rng = random.Random(21)
    syllables = ["ra", "to", "lim", "ver", "no", "sü", "pe", "qua", "dé"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))
    rows, labels = [], []
    for i in range(n):
        words = [w if (w := word())[:5] != "versü" else "no" for _ in range(rng.choice([20, 100, 400]))]
        toxic = i % 6 == 0
        if toxic:
            for at in range(0, len(words), 20):
                words[at] = rng.choice(["vérsü", "versü"]) + rng.choice(syllables) if i % 12 else rng.choice(["1diot", "MORON", "stupіd"])
        rows.append((i, " ".join(words) + rng.choice(["", "\n"]), "xx", None, 1))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_learns(spark):
    rows, labels = learnable()
    docs = spark.createDataFrame(rows + ODD, DOCS)
    known = spark.createDataFrame(labels + [(0, None, None), (None, 1, 0), (77_777, 1, 1)], LABELS)
    model = toxicity.fit(docs, known)
    assert any(e.startswith((" ver", " vér")) for e in model.weights)
    got = toxicity.toxicity(docs, known).collect()
    assert len(got) == len(rows) + len(ODD) and {r.held_out for r in got} == {True, False}
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id >= 0]
    assert np.mean([r.predicted == (r.doc_id % 6 == 0) for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert all(r.predicted == 0 for r in got if r.doc_id is None or r.doc_id < 0)
    again = toxicity.fit(docs.repartition(7), known.repartition(3))
    assert again == model


def test_held_out_labels_and_other_columns_teach_nothing(spark):
    rows, labels = learnable(300)
    docs, known = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)
    fold = (toxicity.remainder(toxicity.F.col("doc_id"), toxicity.FOLDS) == toxicity.HELD_OUT)
    flipped = known.withColumn("toxic", toxicity.F.when(fold, 1 - toxicity.F.col("toxic")).otherwise(toxicity.F.col("toxic")))
    assert toxicity.fit(docs, flipped) == toxicity.fit(docs, known)
    assert toxicity.fit(docs.withColumn("lang", toxicity.F.lit("other")), known) == toxicity.fit(docs, known)


def test_no_labels_and_no_documents(spark):
    rows, labels = learnable(60)
    docs, known = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)
    assert toxicity.fit(docs, known.limit(0)) == toxicity.DEFAULT
    assert toxicity.toxicity(docs.limit(0), known).collect() == []
    with pytest.raises(ValueError, match="both labels"):
        toxicity.fit(docs, known.where("toxic = 1"))


def test_very_long_text():
    clean = "quiet words " * 300_000
    scores = toxicity.DEFAULT.scores([clean, clean + "moron", "trash can " * 200_000, "moron " * 200_000])
    assert (scores >= 0.3).tolist() == [False, False, False, True]


def test_likenesses_are_single_letters():
    assert all(len(p) == 2 and p[1].isascii() and not p[0].isascii() for p in toxicity.HOMOGLYPHS.split())
    assert all(unicodedata.normalize("NFC", p) == p for p in toxicity.HOMOGLYPHS.split())
