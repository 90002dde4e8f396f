"""Toxicity from a weighted lexicon, matched by an Aho-Corasick automaton over folded text.

Folding undoes homoglyphs, digits and signs that stand for letters. Entries are whole words or beginnings of words, so
that inflected and compounded forms count too; accents matter only to entries that have some. What lies within an
exception phrase does not count. The weighted hits and their share of the text's words give the score. The lexicon is
a fixed list plus entries that labelled documents teach, whatever their language.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusloom.llm.common import remainder, slices
from corpusloom.session import materialize

TRAIN_DOCS = 10_000  # labelled documents that entries, weights and the score are learnt from, those with the smallest hashes
CANDIDATES = 1000  # entries that are weighed against each other
ENTRIES = 400  # learnt at most
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3
PREFIX = range(3, 9)  # letters of a beginning
RATE = 50  # one hit in so many words counts as a whole document's
LEAST_GAIN = 18.0  # likelihood ratio by which an entry must tell toxic documents apart that no other entry tells
NEAR_BEST = 0.98  # of entries that tell nearly as much the longest is taken
KNOWN_WEIGHT = 5.0  # of a fixed word without labelled examples
HELD_ENTRIES = 500_000  # that a task sums up before it passes them on

# Words that are toxic by themselves, and phrases in which one is not.
WORDS = (
    "idiot", "idiots", "idiotic", "moron", "morons", "moronic", "imbecile", "stupid", "dumbass", "loser", "losers", "scum", "scumbag", "trash", "worthless",
    "pathetic", "disgusting", "clown", "clowns", "dimwit", "halfwit", "bastard", "bastards", "bitch", "asshole", "retard", "retarded", "vermin",
)
EXCEPTIONS = (
    "trash can", "trash cans", "trash bag", "trash bags", "trash bin", "trash collection", "clown fish", "class clown", "circus clown", "idiot proof",
    "keep it simple stupid", "pond scum", "soap scum", "sore loser", "vermin control",
)

# Letters of other scripts that look like Latin ones, as pairs of letter and likeness.
HOMOGLYPHS = (
    "аa вb еe ёe зe иu іi їi јj кk ӏi мm нh оo рp сc тt уy хx ѕs ԁd ԛq ԝw гr пn "
    "αa βb εe ηn ιi κk νv οo ρp τt υu χx ωw σo γy "
    "ɑa ɡg ıi ſs ȷj"
)
# Digits and signs for letters, and characters that are not seen.
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i"}
UNSEEN = "\u00ad\u200b\u200c\u200d\u2060\ufeff"  # soft hyphen, zero widths, byte order mark

# An l looks like an i and a 1 like both, so folded text has i for all three.
_fold = {ord(p[0]): p[1] for p in HOMOGLYPHS.split()} | {ord(c): None for c in UNSEEN} | {ord("l"): "i"}
_plain = {}  # accented Latin letters to the letter below the accent
for _code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
    _base = unicodedata.normalize("NFD", chr(_code))[0]
    if _base.isascii() and _base.isalpha():
        _plain[_code] = "i" if _base == "l" else _base
_has_sign = re.compile(r"[0-9@$!|]")
# A sign is a letter beside letters of its word; of marks, such that a letter follows, so that those after a word are no part of it.
_sign = re.compile(r"(?<=[^\W\d_])[013457@$8](?=[013457@$8!|]{0,2}[^\W\d_])|[013457@$8!|](?=[013457@$8!|]{0,2}[^\W\d_])|(?<=[^\W\d_])[013457](?![0-9])")
_word = re.compile(r"[^\W\d_]+")


def folded_words(text: str) -> list[str]:
    """The words of a text, lower-cased, with look-alikes as the letters they stand for; accents stay."""
    text = unicodedata.normalize("NFKC", text).lower().translate(_fold)
    if _has_sign.search(text):
        text = _sign.sub(lambda m: SIGNS[m.group()], text)
    return _word.findall(text)


class Matcher:
    """An automaton over the entries (`` word`` begins a word, `` word `` is one) and the exception phrases."""

    def __init__(self, entries: Sequence[str], exceptions: Sequence[str] = EXCEPTIONS) -> None:
        self.entries, self.exceptions = list(entries), list(exceptions)
        self.automaton = ahocorasick.Automaton()
        values: dict[str, list[tuple[int, str]]] = {}
        for i, entry in enumerate(self.entries):
            values.setdefault(entry.translate(_plain), []).append((i, entry))
        for phrase in self.exceptions:
            key = f" {' '.join(folded_words(phrase))} ".translate(_plain)
            values.setdefault(key, []).append((-1, key))
        for key, value in values.items():
            self.automaton.add_word(key, (len(key), value))
        if values:
            self.automaton.make_automaton()

    def __reduce__(self):
        return Matcher, (self.entries, self.exceptions)

    def hits(self, words: Sequence[str]) -> Counter:
        """How often each entry, by number, occurs outside exception phrases."""
        if not len(self.automaton):
            return Counter()
        accented = f" {' '.join(words)} "
        text = accented if accented.isascii() else accented.translate(_plain)
        found, spared = [], []
        for end, (size, value) in self.automaton.iter(text):
            start = end + 1 - size
            for i, entry in value:
                if i < 0:
                    spared.append((start, end))
                elif entry.isascii() or accented.startswith(entry, start):
                    found.append((start, end, i))
        spared.sort()
        starts, reach = [s for s, _ in spared], list(accumulate((e for _, e in spared), max))
        within = lambda a, b: (at := bisect_right(starts, a)) and reach[at - 1] >= b
        return Counter(i for a, b, i in found if not within(a, b))


@dataclass(frozen=True)
class Model:
    """Weighted entries, exception phrases, and the logistic step from weighted hits to the score."""

    weights: Mapping[str, float]
    exceptions: Sequence[str]
    line: Sequence[float]

    def scores(self, texts: Sequence[str | None]) -> np.ndarray:
        matcher, weight = Matcher(list(self.weights), self.exceptions), np.array(list(self.weights.values()))
        mass, size = np.zeros(len(texts)), np.zeros(len(texts))
        for at, text in enumerate(texts):
            words = folded_words(text or "")
            hits = matcher.hits(words)
            mass[at], size[at] = sum(weight[i] * n for i, n in hits.items()), len(words)
        return logistic(features(mass, size) @ np.array(self.line))


def features(mass: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Share of the words, weighted; hits, weighted; and one."""
    return np.column_stack((np.log1p(RATE * mass / np.maximum(words, 1)), np.log1p(mass), np.ones(len(mass))))


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def known_entries() -> dict[str, float]:
    return {f" {' '.join(folded_words(w))} ": KNOWN_WEIGHT for w in WORDS}


#: Without labels: one fixed word in fifty words gives about even odds.
DEFAULT = Model(known_entries(), EXCEPTIONS, (2.0, 1.0, -5.4))


def _gain(toxic: np.ndarray, clean: np.ndarray, all_toxic: float, all_clean: float) -> np.ndarray:
    """Likelihood ratio (G) of telling the kinds apart, 0 where clean documents have the greater share."""
    share = all_toxic / (all_toxic + all_clean)
    cells = [(toxic, share), (clean, 1 - share)]
    with_entry, total = toxic + clean, all_toxic + all_clean
    g = np.zeros_like(toxic)
    for found, part in cells:
        rest = all_toxic - toxic if found is toxic else all_clean - clean
        g += np.where(found > 0, found * np.log(np.maximum(found, 1e-12) / np.maximum(with_entry * part, 1e-12)), 0)
        g += np.where(rest > 0, rest * np.log(np.maximum(rest, 1e-12) / np.maximum((total - with_entry) * part, 1e-12)), 0)
    return np.where(toxic * all_clean > clean * all_toxic, 2 * g, 0)


def _sample(docs: DataFrame, labels: DataFrame, folds: int, held_out: int, train_docs: int) -> DataFrame:
    """``toxic`` and ``text`` of the training rows; equal texts count once, with the label of the smallest id."""
    known = labels.where(F.col("toxic").isin(0, 1)).where(remainder(F.col("doc_id"), folds) != held_out)
    known = known.groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.col("toxic").cast("int")).alias("_toxic"))
    present = known.join(docs.select(F.col("doc_id").alias("_id")).distinct(), "_id", "left_semi")
    drawn = F.broadcast(present.orderBy(F.xxhash64("_id"), "_id").limit(train_docs))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = texts.join(drawn, F.col("doc_id") == F.col("_id")).groupBy(F.md5("text").alias("digest"))
    one = rows.agg(F.min(F.struct("_id", F.col("_toxic").alias("toxic"), "text")).alias("row")).select("row.toxic", "row.text")
    return materialize(one, "toxicity-sample")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial sums per candidate entry: of toxic and clean documents, each counting by the entry's share of its words."""
    sums: dict[str, list[float]] = {}

    def out():
        columns = [pa.array(list(sums), pa.string()), *(pa.array([v[k] for v in sums.values()], pa.float64()) for k in (0, 1))]
        sums.clear()
        return pa.RecordBatch.from_arrays(columns, ["entry", "clean", "toxic"])

    for part in slices(batches):
        for toxic, text in zip(part.column("toxic").to_pylist(), part.column("text").to_pylist(), strict=True):
            words = folded_words(text)
            own: Counter = Counter()
            for word, n in Counter(words).items():
                own[f" {word} "] += n
                for size in PREFIX:
                    if size > len(word):
                        break
                    own[f" {word[:size]}"] += n
            for entry, n in own.items():
                sums.setdefault(entry, [0.0, 0.0])[toxic] += min(1.0, RATE * n / len(words))
            if len(sums) > HELD_ENTRIES:
                yield out()
    yield out()


def _choose(toxic: np.ndarray, clean: np.ndarray, length: np.ndarray) -> list[int]:
    """Columns (entries) taken one by one, each the best at telling apart the toxic rows that those before it leave."""
    left, chosen, of_clean = np.ones(len(toxic)), [], clean.sum(axis=0)
    while len(chosen) < ENTRIES:
        gain = _gain(left @ toxic, of_clean, left.sum(), len(clean))
        if gain.max() < LEAST_GAIN:
            break
        best = int(np.where(gain >= NEAR_BEST * gain.max(), length, 0).argmax())
        chosen.append(best)
        left = left * (1 - toxic[:, best])
    return chosen


def fit(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT, train_docs: int = TRAIN_DOCS) -> Model:
    """Learn from at most ``train_docs`` documents with a label of 0 or 1, outside the held-out fold.

    They are those with the smallest hashes of all that are there, so the sample is the same on every run. A document labelled twice
    is toxic if one label says so. Candidates are counted in Spark; to the driver come the best ``CANDIDATES`` of them and their
    hits in the sample. Labels of one kind only, though there are documents, are an error; without labels the fixed words decide.
    """
    sample = _sample(docs, labels, folds, held_out, train_docs)
    n = dict(map(tuple, sample.groupBy("toxic").count().collect()))
    if len(n) < 2:
        if n and not labels.isEmpty():
            raise ValueError(f"documents of both labels are needed to learn from; there are {n} (label: documents)")
        return DEFAULT
    sums = sample.mapInArrow(_counted, "entry string, clean double, toxic double").groupBy("entry").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    # The most that an entry can tell, and then the best of those: a bounded part of the corpus's words.
    lift = F.col("toxic") * F.log((F.col("toxic") + 0.5) * n[0] / ((F.col("clean") + 0.5) * n[1]))
    best = sums.withColumn("lift", lift).where(F.col("lift") >= LEAST_GAIN / 4).orderBy(F.desc("lift"), "entry").limit(CANDIDATES)
    fixed = known_entries()
    entries = sorted({r["entry"] for r in best.select("entry").collect()} | set(fixed))
    matcher = Matcher(entries)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            size, which, count = [], [], []
            for text in part.column("text").to_pylist():
                words = folded_words(text)
                hits = matcher.hits(words)
                size.append(len(words))
                which.append(list(hits))
                count.append(list(hits.values()))
            columns = [pa.array(size, pa.int64()), pa.array(which, pa.list_(pa.int32())), pa.array(count, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([part.column("toxic"), *columns], ["toxic", "words", "which", "count"])

    rows = sample.mapInArrow(work, "toxic int, words long, which array<int>, count array<int>").toPandas()
    hits = np.zeros((len(rows), len(entries)), dtype=np.float32)
    for at, (which, count) in enumerate(zip(rows["which"], rows["count"], strict=True)):
        hits[at, which] = count
    words, label = rows["words"].to_numpy(np.float64), rows["toxic"].to_numpy()
    share = np.minimum(1, RATE * hits / np.maximum(words, 1)[:, None])
    toxic, clean = share[label == 1], share[label == 0]
    weight = np.log((toxic.sum(axis=0) + 0.5) / (len(toxic) + 1)) - np.log((clean.sum(axis=0) + 0.5) / (len(clean) + 1))
    chosen = [i for i in _choose(toxic, clean, np.array([len(e) for e in entries])) if weight[i] > 0]
    weights = fixed | {entries[i]: float(weight[i]) for i in chosen}
    own = np.array([weights.get(e, 0.0) for e in entries])
    line = _logistic_fit(features(hits @ own, words), label)
    return Model(weights, EXCEPTIONS, tuple(line.tolist()))


def _logistic_fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of most likelihood, with a small ridge, by Newton's method; halved steps keep it from overshooting."""
    line = np.zeros(x.shape[1])

    def loss(w):
        z = np.clip(x @ w, -30, 30)
        return np.logaddexp(0, z).sum() - (y * z).sum() + 0.05 * w @ w

    for _ in range(50):
        p = logistic(x @ line)
        curve = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(x.shape[1])
        step = np.linalg.solve(curve, x.T @ (p - y) + 0.1 * line)
        while loss(line - step) > loss(line) and np.abs(step).max() > 1e-9:
            step = step / 2
        line = line - step
    return line


def classify(docs: DataFrame, model: Model, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of every row with ``score`` (0 to 1) and ``predicted`` (1 if the score is at least 0.3).

    Only the text is looked at, whole. A null text is scored as an empty one.
    """
    kept = list(keep)
    schema = StructType([docs.schema[c] for c in kept]).add("score", "double").add("predicted", "integer")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text"):
            scores = model.scores(part.column("_text").to_pylist())
            found = [pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], *found], [*kept, "score", "predicted"])

    return docs.select(*kept, F.col("text").alias("_text")).mapInArrow(work, schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``held_out``, ``score``, ``predicted``; rows that repeat an id are scored each, a null id is in the fold of the empty text."""
    scored = classify(docs, fit(docs, labels))
    return scored.select("doc_id", (remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", "predicted")
