"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad; a line's features are counts of character classes of its own and of the lines beside
it. Training lines carry their document's label. Forward-backward marginals, weighted by line length, give a
document's mean, which a logistic step fitted on the same sample turns into a probability.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusloom.llm.common import remainder, slices, text_array
from corpusloom.session import materialize

TRAIN_DOCS = 4000  # labelled documents the model is fitted on, those with the smallest hashes
TRAIN_LINES = 200_000  # lines of them: a document is learnt from, whole, if those of smaller hashes have fewer
SEQUENCE = 256  # lines that a step of the fit walks through; a longer text is learnt as several sequences side by side
FOLDS = 5
THRESHOLD = 0.3
STEPS = 150

CLASSES = (
    b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\v\f", b".,;:'\"?()-", b"!", b"|",
    b"#$%&*+=<>~^@\\/_`[]{}",
)
OTHER = len(CLASSES)  # bytes of non-ASCII letters and whatever else
N_CLASSES = OTHER + 1
CORE = N_CLASSES + 7
N_FEATURES = 3 * CORE + 3

_class = np.full(256, OTHER, dtype=np.int64)
for _i, _members in enumerate(CLASSES):
    _class[list(_members)] = _i


def line_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Core features of every line, line lengths in bytes, and where each text's lines start (one more entry).

    Lines end at line feeds; an empty text is one empty line.
    """
    raw = [t.encode() for t in texts.to_pylist()]
    joined = b"\n".join(raw) + b"\n"
    lines = joined[:-1].split(b"\n")
    data = np.frombuffer(joined, dtype=np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate(([0], ends[:-1] + 1))
    length = ends - starts
    text_ends = np.cumsum([len(r) + 1 for r in raw]) - 1
    first = np.concatenate(([0], np.searchsorted(ends, text_ends) + 1))
    owner = np.repeat(np.arange(len(ends)), length + 1)
    kind = _class[data]
    counts = np.bincount(owner * N_CLASSES + kind, minlength=len(ends) * N_CLASSES).reshape(-1, N_CLASSES).astype(np.float64)
    counts[:, OTHER] -= 1  # the line feed
    space = (kind == 3) | (data == 10)
    begin = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    end = np.flatnonzero(~space & np.concatenate((space[1:], [True]))) + 1
    new_word = np.bincount(owner[begin], minlength=len(ends)).astype(np.float64)
    # A word that repeats the one before it, told by length and sum of bytes.
    total = np.concatenate(([0], np.cumsum(data, dtype=np.int64)))
    word_sum = total[end] - total[begin]
    same = (word_sum[1:] == word_sum[:-1]) & ((end - begin)[1:] == (end - begin)[:-1]) & (owner[begin][1:] == owner[begin][:-1])
    stutter = np.bincount(owner[begin][1:][same], minlength=len(ends))
    doubled = (data[1:] == data[:-1]) & (kind[1:] >= 4) & (kind[1:] < OTHER)
    pairs = np.bincount(owner[1:][doubled], minlength=len(ends))
    size = np.maximum(length, 1)[:, None]
    # A line that repeats an earlier one of its text.
    text_of = np.repeat(np.arange(len(raw)), np.diff(first))
    keys = np.fromiter(map(hash, lines), dtype=np.int64, count=len(lines)) ^ (text_of * np.int64(0x5851F42D4C957F2D))
    seen = np.ones(len(lines), dtype=bool)
    seen[np.unique(keys, return_index=True)[1]] = False
    last = np.where(length > 0, data[np.maximum(ends - 1, 0)], 10)
    core = np.column_stack((
        counts / size,
        np.log1p(length) / 5,
        pairs / size[:, 0],
        length / np.maximum(new_word, 1) / 10,
        stutter / np.maximum(new_word, 1),
        seen & (length > 0),
        np.isin(last, list(b".?")),
        length == 0,
    ))
    return core, length, first


def with_neighbours(core: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Own features, those of the lines before and after in the same text (zeros at its ends), and whether there are any."""
    before, after = np.zeros_like(core), np.zeros_like(core)
    before[1:], after[:-1] = core[:-1], core[1:]
    before[first[:-1]], after[first[1:] - 1] = 0, 0
    at_start, at_end = np.zeros(len(core)), np.zeros(len(core))
    at_start[first[:-1]], at_end[first[1:] - 1] = 1, 1
    return np.column_stack((core, before, after, at_start, at_end, np.ones(len(core))))


def forward_backward(odds: np.ndarray, trans: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginal of "good" per line, expected transitions, and the log of the partition function, over all texts.

    Texts advance side by side, line by line; the longest ones go on alone.
    """
    n_lines = np.diff(first)
    order = np.argsort(-n_lines, kind="stable")
    starts, sizes = first[:-1][order], n_lines[order]
    psi = np.stack((np.ones_like(odds), np.exp(np.clip(odds, -30, 30))), axis=1)
    move = np.exp(trans)
    alpha, beta, scale = np.empty_like(psi), np.ones_like(psi), np.empty(len(odds))
    longest = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(longest), side="left")  # texts with more than t lines
    for t in range(longest):
        at = starts[: active[t]] + t
        now = psi[at] if t == 0 else (alpha[at - 1] @ move) * psi[at]
        scale[at] = now.sum(axis=1)
        alpha[at] = now / scale[at][:, None]
    expected = np.zeros((2, 2))
    for t in range(longest - 1, 0, -1):
        at = starts[: active[t]] + t
        ahead = psi[at] * beta[at] / scale[at][:, None]
        expected += move * (alpha[at - 1].T @ ahead)
        beta[at - 1] = ahead @ move.T
    gamma = alpha * beta
    return gamma[:, 1] / gamma.sum(axis=1), expected, float(np.log(scale).sum())


@dataclass(frozen=True)
class Model:
    """Weights of features, transitions, and the logistic step from mean marginal to score."""

    weights: np.ndarray
    trans: np.ndarray
    slope: float
    shift: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        core, length, first = line_features(texts)
        good = forward_backward(with_neighbours(core, first) @ self.weights, self.trans, first)[0]
        return self.calibrated(document_means(good, length, first))

    def calibrated(self, means: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * _logit(means) + self.shift, -30, 30)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def document_means(good: np.ndarray, length: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Length-weighted mean of the marginals of each text's lines; of empty lines, the plain mean."""
    weight = length + 1e-6
    return np.add.reduceat(good * weight, first[:-1]) / np.add.reduceat(weight, first[:-1])


def train(core: np.ndarray, length: np.ndarray, first: np.ndarray, labels: np.ndarray, steps: int = STEPS) -> Model:
    """Maximum likelihood with a small ridge, by Adam over the whole sample; then the logistic step.

    A text of more than ``SEQUENCE`` lines counts as several sequences: all its lines with their neighbours' features, and all
    its transitions but those between sequences. The logistic step sees it as one.
    """
    if len(labels) == 0 or labels.min() == labels.max():
        share = (labels.sum() + 1) / (len(labels) + 2)
        return Model(np.zeros(N_FEATURES), np.zeros((2, 2)), 0.0, float(np.log(share / (1 - share))))
    x, y = with_neighbours(core, first), np.repeat(labels, np.diff(first))
    cuts = np.concatenate([np.arange(a, b, SEQUENCE) for a, b in zip(first[:-1], first[1:], strict=True)] + [first[-1:]])
    inner = np.ones(len(y), dtype=bool)
    inner[cuts[:-1]] = False
    at = np.flatnonzero(inner)
    observed = np.bincount(2 * y[at - 1] + y[at], minlength=4).reshape(2, 2)
    weights = np.zeros(N_FEATURES + 4)
    mean, square = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, steps + 1):
        good, expected, _ = forward_backward(x @ weights[:-4], weights[-4:].reshape(2, 2), cuts)
        slope = np.concatenate((x.T @ (good - y), (expected - observed).ravel())) / len(labels) + 1e-3 * weights
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        weights -= 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    good = forward_backward(x @ weights[:-4], weights[-4:].reshape(2, 2), first)[0]
    z = np.column_stack((_logit(document_means(good, length, first)), np.ones(len(labels))))
    line = np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ line, -30, 30)))
        curve = (z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2)
        line = line - np.linalg.solve(curve, z.T @ (p - labels) + 1e-2 * (line - [1.0, 0.0]))
    return Model(weights[:-4], weights[-4:].reshape(2, 2), float(line[0]), float(line[1]))


def fit(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, train_docs: int = TRAIN_DOCS) -> Model:
    """Fit on at most ``train_docs`` labelled documents outside the held-out fold (crc32 of the id modulo ``folds`` is 0).

    Of the documents with a label of 0 or 1, those with the smallest hashes are drawn, so the sample is the same on
    every run and smaller than ``train_docs`` only if there are no more, or if they have more than ``TRAIN_LINES`` lines. What
    comes to the driver are their lines' features. A document is learnt from whole, the one that reaches that bound too. One that
    is labelled twice counts with the smaller label, one with several texts with the one of the smallest hash.
    Labels that leave nothing to learn from, though there are documents, are an error; without labels or documents
    all scores are 0.5.
    """
    known = labels.where(F.col("quality").isin(0, 1)).where(remainder(F.col("doc_id"), folds) != 0)
    known = known.groupBy(F.col("doc_id").alias("_id")).agg(F.min(F.col("quality").cast("int")).alias("_quality"))
    present = known.join(docs.select(F.col("doc_id").alias("_id")).distinct(), "_id", "left_semi").withColumn("_h", F.xxhash64("_id"))
    sample = F.broadcast(present.orderBy("_h", "_id").limit(train_docs))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            core, length, first = line_features(text_array(part.column("text")))
            spans = [slice(a, b) for a, b in zip(first[:-1], first[1:], strict=True)]
            rows = [core[span].astype(np.float32).ravel() for span in spans]
            sizes = [length[span].astype(np.int64) for span in spans]
            yield pa.RecordBatch.from_arrays(
                [part.column("_id"), part.column("_quality"), pa.array(rows, pa.list_(pa.float32())), pa.array(sizes, pa.list_(pa.int64()))],
                ["id", "quality", "core", "length"],
            )

    texts = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    joined = texts.join(sample, F.col("doc_id") == F.col("_id")).groupBy("_id", "_quality", "_h")
    one = joined.agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("row")).select("_id", "_quality", "_h", "row.text")
    one = materialize(one, "quality-sample")  # at most train_docs texts
    so_far = F.sum(F.regexp_count("text", F.lit("\n")) + 1).over(Window.orderBy("_h", "_id").rowsBetween(Window.unboundedPreceding, -1))
    fits = one.select("_id", so_far.alias("before")).where(F.coalesce("before", F.lit(0)) < TRAIN_LINES)
    one = one.join(F.broadcast(fits), "_id")
    drawn = one.select("_id", "_quality", "text").mapInArrow(work, "id long, quality int, core array<float>, length array<long>").toPandas().sort_values("id")
    if drawn["quality"].nunique() < 2 and not (labels.isEmpty() or docs.isEmpty()):
        raise ValueError(f"documents of both labels are needed to learn from; {len(drawn)} documents have labels {drawn['quality'].unique()}")
    if drawn.empty:
        return train(np.empty((0, CORE)), np.empty(0), np.zeros(1, np.int64), np.empty(0, np.int64))
    core = np.concatenate(drawn["core"].to_list()).reshape(-1, CORE).astype(np.float64)
    first = np.concatenate(([0], np.cumsum([len(x) for x in drawn["length"]])))
    return train(core, np.concatenate(drawn["length"].to_list()), first, drawn["quality"].to_numpy())


def classify(docs: DataFrame, model: Model, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of every row with ``score`` (0 to 1) and ``predicted`` (1 if the score is at least 0.3).

    Only the text is looked at. A null text is scored as an empty one: one empty line.
    """
    kept = list(keep)
    schema = StructType([docs.schema[c] for c in kept]).add("score", "double").add("predicted", "integer")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text"):
            scores = model.scores(text_array(part.column("_text")))
            yield pa.RecordBatch.from_arrays(
                [*[part.column(c) for c in kept], pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32))], [*kept, "score", "predicted"]
            )

    return docs.select(*kept, F.col("text").alias("_text")).mapInArrow(work, schema)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``held_out``, ``score``, ``predicted``; a null id is held out."""
    scored = classify(docs, fit(docs, labels))
    return scored.select("doc_id", (remainder(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score", "predicted")
