"""Prediction by partial matching: a byte-context trie of the training texts gives every text its code length.

Counts of (context, next byte) for contexts of up to five bytes come from all training texts. A byte is predicted
from the longest context seen, each follower giving half a count to the escape. An escape leads to the context one
byte shorter, where the followers of the longer one are excluded. Shorter contexts count in how many longer
ones a byte followed, as if it had been counted only where it was new. Below the empty context all bytes not yet
seen are equally likely.

The trie is written as tables and cut into shards: ranges of contexts read backwards, latest byte first, so that a context lies
beside the longer ones that end in it. Texts ask in groups: every distinct n-gram and word of a group goes once to the
shard that holds it, with the texts it stands in, and sums by text come back. A task reads the one shard it answers for,
once, and tasks are as many as the texts fill: what is read grows with the texts, whatever the size of the model. N-grams
and words that make up at least 1/1,000,000 of the training texts, at most a million each, are looked up where the texts lie.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import ascii_words, remainder, shared_path, slices, text_array
from corpusloom.session import materialize

ORDER = 5
FOLDS, HELD_OUT = 7, 2
PAD, END = 0xFE, 0xFF  # bytes that UTF-8 never uses: before the start, and the end of a text
ALPHABET = 256
SHARD_ROWS = 2_000_000  # of the trie in a shard, and the rows of shorter contexts that all ranges below them share
WORD_ROWS = 2_000_000
HOT_ROWS = 1_000_000  # n-grams, and words, at most that tasks hold beside their texts
HOT_FILES = 8
SLICE = 4 << 20
GROUP = 4 << 20  # bytes of text that ask together, unless one is longer
MOST_TEXTS = 1 << 16  # in a group, whose texts are numbered in two bytes
ENTRIES = 1 << 15  # pairs of a key and a text in a row
ROWS_AT_ONCE = 16  # that are looked up together
CELL_TEXT = 8 << 20  # bytes of text whose n-grams a task answers; words of four times as much
HELD_ROWS = 1_000_000  # distinct n-grams that a task sums up before it passes them on
CONTEXT = 0x40  # tag of context rows
SEED = 42


def symbols(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All lower-cased texts in a row, each after ``ORDER`` pads and before an end; where each text's symbols start."""
    lowered = pc.ascii_lower(texts).cast(pa.large_binary())
    raw = lowered.to_pylist()
    pad, end = bytes([PAD]) * ORDER, bytes([END])
    data = np.frombuffer(b"".join([x for r in raw for x in (pad, r, end)]), dtype=np.uint8)
    sizes = np.array([len(r) + ORDER + 1 for r in raw], dtype=np.int64)
    return data, np.cumsum(sizes) - sizes + ORDER


def grams(data: np.ndarray, begin: int, end: int) -> np.ndarray:
    """The packed ``ORDER`` + 1 bytes that end at each of the places begin..end-1 (begin >= ORDER)."""
    keys = np.zeros(end - begin, dtype=np.int64)
    for back in range(ORDER, -1, -1):
        keys = (keys << 8) | data[begin - back : end - back]
    return keys


def backward_grams(data: np.ndarray, begin: int, end: int) -> np.ndarray:
    """As ``grams``, with the context's latest byte first."""
    keys = np.zeros(end - begin, dtype=np.int64)
    for back in range(1, ORDER + 1):
        keys = (keys << 8) | data[begin - back : end - back]
    return (keys << 8) | data[begin:end]


def backward(context: np.ndarray) -> np.ndarray:
    """The bytes of contexts of ``ORDER`` bytes in the opposite order."""
    out = np.zeros_like(context)
    for back in range(ORDER):
        out = (out << 8) | ((context >> 8 * back) & 0xFF)
    return out


def forward_grams(keys: np.ndarray) -> np.ndarray:
    """What ``grams`` gives, from what ``backward_grams`` gives."""
    return (backward(keys >> 8) << 8) | (keys & 0xFF)


def _sum_equal(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    all_keys, all_counts = np.concatenate(keys), np.concatenate(counts)
    unique, inverse = np.unique(all_keys, return_inverse=True)
    return unique, np.bincount(inverse, weights=all_counts, minlength=len(unique)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of n-grams and words of a task's texts; the number of texts goes to the null word's row."""
    names, texts_seen = ["gram", "word", "n"], 0
    keys, counts, held = [], [], 0
    words: list[pa.Table] = []

    def gram_rows():
        unique, n = _sum_equal(keys, counts)
        for at in range(0, len(unique), 200_000):
            part = slice(at, at + 200_000)
            yield pa.RecordBatch.from_arrays([pa.array(unique[part]), pa.nulls(len(unique[part]), pa.string()), pa.array(n[part])], names)

    def word_rows():
        total = pa.concat_tables(words).group_by("word").aggregate([("n", "sum")])
        for batch in total.select(["word", "n_sum"]).to_batches(max_chunksize=200_000):
            yield pa.RecordBatch.from_arrays([pa.nulls(len(batch), pa.int64()), batch.column(0).cast(pa.string()), batch.column(1)], names)

    for part in slices(batches, limit=SLICE):
        texts = text_array(part.column("text"))
        texts_seen += len(texts)
        data, _ = symbols(texts)
        packed = grams(data, ORDER, len(data))
        packed = packed[(packed & 0xFF) != PAD]
        packed.sort()
        at = np.flatnonzero(np.concatenate(([True], packed[1:] != packed[:-1])))
        keys.append(packed[at])
        counts.append(np.diff(np.append(at, len(packed))))
        held += len(at)
        found = pc.value_counts(ascii_words(texts)[0])
        words.append(pa.table({"word": found.field(0), "n": found.field(1)}))
        if held > HELD_ROWS:
            yield from gram_rows()
            yield from word_rows()
            keys, counts, words, held = [], [], [], 0
    if keys:
        yield from gram_rows()
        yield from word_rows()
    if texts_seen:
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.string()), pa.array([texts_seen])], names)


def trie(counts: DataFrame) -> DataFrame:
    """Rows ``key``, ``a``, ``b``, ``c`` of the trie from ``gram``, ``n`` (contexts of ``ORDER`` bytes and what follows).

    Entry of a context of j bytes: key j + 1 and the bytes; a: log count, b: log probability if nothing is excluded.
    Context: key 0x40 + j and the bytes; a, c: log of the denominator and of the escape probability in the context
    one byte shorter, this one's followers excluded; b: log of the escape probability here.
    """
    level = materialize(counts.select(F.lit(ORDER).alias("j"), F.col("gram").alias("g"), "n"), "ppm-level")
    levels = [level]
    for order in range(ORDER - 1, -1, -1):
        shorter = F.col("g").bitwiseAND(F.lit((1 << 8 * (order + 1)) - 1))
        level = materialize(level.groupBy(shorter.alias("g")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(order).alias("j"), "g", "n"), "ppm-level")
        levels.append(level)
    entries = reduce(DataFrame.unionByName, levels)
    shorter = F.expr("g & (shiftleft(1L, 8 * j) - 1)")
    parents = entries.select((F.col("j") + 1).alias("j"), F.col("g").alias("p"), F.col("n").alias("p_n"))
    joined = entries.withColumn("p", shorter).join(parents, ["j", "p"], "left")
    context = F.shiftright("g", 8)
    contexts = joined.groupBy("j", context.alias("ctx")).agg(
        F.sum("n").alias("t"), F.count(F.lit(1)).alias("d"), F.sum("p_n").alias("excluded")
    )
    contexts = materialize(contexts, "ppm-contexts")
    above = contexts.select((F.col("j") + 1).alias("j"), F.col("ctx").alias("p"), F.col("t").alias("p_t"), F.col("d").alias("p_d"))
    suffix = F.expr("if(j = 0, -1L, ctx & (shiftleft(1L, 8 * (j - 1)) - 1))")
    full = contexts.withColumn("p", suffix).join(above, ["j", "p"], "left")
    rest_d = F.coalesce(F.col("p_d") - F.col("d"), F.lit(0))
    rest = F.coalesce(F.col("p_t") - F.col("excluded"), F.lit(0))
    log = lambda value: F.when(value > 0, F.log10(value)).otherwise(F.lit(0.0))
    context_rows = full.select(
        F.expr(f"shiftleft(cast({CONTEXT} + j as bigint), 56) | ctx").alias("key"),
        log(rest).alias("a"),
        (F.log10(F.col("d") / 2) - F.log10("t")).alias("b"),
        F.when(rest_d > 0, F.log10(rest_d / 2) - log(rest)).otherwise(0.0).alias("c"),
    )
    own = contexts.select("j", "ctx", F.col("t").alias("all"))
    entry_rows = entries.withColumn("ctx", context).join(own, ["j", "ctx"]).select(
        F.expr("shiftleft(cast(j + 1 as bigint), 56) | g").alias("key"),
        F.log10(F.col("n") - 0.5).alias("a"),
        (F.log10(F.col("n") - 0.5) - F.log10("all")).alias("b"),
        F.lit(0.0).alias("c"),
    )
    return entry_rows.unionByName(context_rows)


class Trie:
    """One shard as an open hash table over arrays."""

    def __init__(self, key: np.ndarray, *values: np.ndarray) -> None:
        self.values = values
        self.bits = max(4, int(len(key) * 4 // 3).bit_length())
        self.keys = np.zeros(1 << self.bits, dtype=np.int64)
        self.rows = np.zeros(1 << self.bits, dtype=np.int32)
        left, slot = np.arange(len(key)), self._slot(key)
        while len(left):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = key[left[free]]
            won = self.keys[slot] == key[left]
            self.rows[slot[won]] = left[won]
            left, slot = left[~won], (slot[~won] + 1) & (len(self.keys) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, key: np.ndarray) -> np.ndarray:
        """Rows of the keys, -1 for those that the shard lacks."""
        row = np.full(len(key), -1, dtype=np.int64)
        slot = self._slot(key)
        at = self.keys[slot]
        hit = at == key
        row[hit] = self.rows[slot[hit]]
        left = np.flatnonzero(~hit & (at != 0))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & (len(self.keys) - 1)
            at = self.keys[slot]
            hit = at == key[left]
            row[left[hit]] = self.rows[slot[hit]]
            going = ~hit & (at != 0)
            left, slot = left[going], slot[going]
        return row

    def get(self, key: np.ndarray) -> np.ndarray:
        """The first value of the keys, 0 for those that the shard lacks."""
        row = self.find(key)
        out = np.zeros(len(key))
        out[row >= 0] = self.values[0][row[row >= 0]]
        return out

    def log_probability(self, keys: np.ndarray, unseen: float) -> np.ndarray:
        """Log10 of the probability of the last byte of every packed n-gram after those before it."""
        a, b, c = self.values
        out = np.zeros(len(keys))
        left = np.arange(len(keys))
        denominator, escape = np.zeros(len(keys)), np.zeros(len(keys))
        escaped = np.zeros(len(keys), dtype=bool)
        for order in range(ORDER, -1, -1):
            key = keys[left]
            row = self.find(((order + 1) << 56) | (key & ((1 << 8 * (order + 1)) - 1)))
            hit = row >= 0
            who, what = left[hit], row[hit]
            out[who] += np.where(escaped[who], a[what] - denominator[who], b[what])
            left, key = left[~hit], key[~hit]
            if not len(left):
                return out
            row = self.find(((CONTEXT + order) << 56) | ((key >> 8) & ((1 << 8 * order) - 1)))
            seen = row >= 0
            who, what = left[seen], row[seen]
            out[who] += np.where(escaped[who], escape[who], b[what])
            denominator[who], escape[who], escaped[who] = a[what], c[what], True
        out[left] += unseen
        return out


Files = tuple[str, ...]  # of a shard that was written; none if it has no rows


def _read(shard: Files, columns: list[str]) -> list[np.ndarray]:
    """Columns of one shard; a file that is not there is an error."""
    if not shard:
        return [np.empty(0, np.int64), *[np.empty(0)] * (len(columns) - 1)]
    files, _ = pyarrow.fs.FileSystem.from_uri(shard[0])
    places = [pyarrow.fs.FileSystem.from_uri(file)[1] for file in shard]
    arrays = []
    for name in columns:  # one by one, so that no more than one is held twice
        arrays.append(np.array(pq.read_table(places, filesystem=files, columns=[name], partitioning=None, use_threads=False).column(0)))
        pa.default_memory_pool().release_unused()
    return arrays


_held: dict[str, tuple[Files, Trie]] = {}  # per kind the one table that a worker holds


def _table(kind: str, shard: Files, columns: list[str]) -> Trie:
    if _held.get(kind, (None,))[0] != shard:
        _held.pop(kind, None)
        _held[kind] = shard, Trie(*_read(shard, columns))
    return _held[kind][1]


def _write_shards(rows: DataFrame, n_shards: int, name: str, files: int | None = None) -> list[Files]:
    """The files of every shard, one each unless a number is given: what is read later must be what was written."""
    path = shared_path(rows.sparkSession, name)
    spread = rows.repartition(files) if files else rows.repartition("shard")
    spread.write.partitionBy("shard").parquet(path)
    shards: list[list[str]] = [[] for _ in range(n_shards)]
    for file in sorted(rows.sparkSession.read.schema(rows.schema).parquet(path).inputFiles()):
        shards[int(file.rsplit("/shard=", 1)[1].partition("/")[0])].append(file)
    return [tuple(files) for files in shards]


def _placed(rows: DataFrame, bounds: np.ndarray) -> DataFrame:
    """Trie rows with the shards whose range of backward contexts theirs meets: a shorter context's may meet several."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column("key").to_numpy()
            tag = key >> 56
            of_context = tag >= CONTEXT
            order = np.where(of_context, tag - CONTEXT, tag - 1)
            low = backward(np.where(of_context, key, key >> 8) & ((1 << 8 * order) - 1))
            first = np.searchsorted(bounds, low, side="right")
            times = np.searchsorted(bounds, low | ((1 << 8 * (ORDER - order)) - 1), side="right") - first + 1
            row = np.repeat(np.arange(len(key)), times)
            shard = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            columns = [c.take(pa.array(row)) for c in batch.columns]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(shard, pa.int32())], ["key", "a", "b", "c", "shard"])

    return rows.select("key", "a", "b", "c").mapInArrow(work, "key long, a double, b double, c double, shard int")


class Model:
    """Where the shards lie, their bounds, and the few numbers that all tasks need."""

    def __init__(self, docs: DataFrame) -> None:
        """Train on all texts of ``docs`` (column ``text``)."""
        partial = materialize(docs.select("text").mapInArrow(_count, "gram long, word string, n long"), "ppm-partial")
        counts = partial.where("gram is not null").groupBy("gram").agg(F.sum("n").alias("n"))
        rows = materialize(trie(counts), "ppm-trie")
        tag, n = F.shiftrightunsigned("key", 56), F.pow(F.lit(10.0), "a") + 0.5
        whole = rows.where(tag == ORDER + 1)
        n_rows, kinds, n_symbols = rows.agg(
            F.count(F.lit(1)), F.count_if(tag == 1), F.coalesce(F.sum(F.when(tag == ORDER + 1, n)), F.lit(0.0))
        ).first()
        self.unseen = -float(np.log10(max(ALPHABET - kinds, 1)))
        pieces = max(1, -(-n_rows // SHARD_ROWS))
        context = reduce(Column.__add__, [F.shiftleft(F.shiftright("key", 8 * i + 8).bitwiseAND(F.lit(0xFF)), 8 * (ORDER - 1 - i)) for i in range(ORDER)])
        cuts = whole.select(context.cast("double").alias("at")).approxQuantile("at", [i / pieces for i in range(1, pieces)], 0.1 / pieces) if pieces > 1 else []
        self.bounds = np.unique(np.array(cuts, dtype=np.int64))
        placed = _placed(rows, self.bounds)
        self.trie_shards = _write_shards(placed, len(self.bounds) + 1, "ppm-shards")
        is_hot = n >= max(n_symbols / HOT_ROWS, 1.0) - 0.25
        self.hot = _write_shards(whole.where(is_hot).select("key", "b", F.lit(0).alias("shard")), 1, "ppm-hot", HOT_FILES)[0]
        cold = dict(placed.where((tag == ORDER + 1) & ~is_hot).groupBy("shard").agg(F.sum(n)).collect())
        self.shares = np.array([cold.get(shard, 0.0) / max(n_symbols, 1) for shard in range(len(self.trie_shards))])
        words = partial.where("word is not null").groupBy("word").agg(F.sum("n").alias("n"))
        words = materialize(words.select(F.xxhash64("word").alias("key"), "n"), "ppm-words")
        self.n_words, of_words = words.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        self.texts = partial.where("gram is null and word is null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        self.tokens = of_words + self.texts
        self.kinds = self.n_words + (self.texts > 0)
        n_shards = max(1, -(-self.n_words // WORD_ROWS))
        is_hot = F.col("n") >= max(of_words / HOT_ROWS, 1.0)
        self.hot_words = _write_shards(words.where(is_hot).withColumn("shard", F.lit(0)), 1, "ppm-hot", HOT_FILES)[0]
        self.cold_words = words.where(~is_hot).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] / max(of_words, 1)
        self.word_shards = _write_shards(words.withColumn("shard", F.pmod(F.col("key"), F.lit(n_shards)).cast("int")), n_shards, "ppm-word-shards")

    def cells(self, text_bytes: int) -> np.ndarray:
        """How many tasks answer for each shard, those of the trie before those of the words."""
        grams_asked = self.shares * text_bytes / CELL_TEXT
        words_asked = np.full(len(self.word_shards), self.cold_words * text_bytes / len(self.word_shards) / (4 * CELL_TEXT))
        return np.maximum(1, np.ceil(np.concatenate((grams_asked, words_asked)))).astype(np.int64)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Ids and texts of ``GROUP`` bytes or less, unless one text is longer."""
    ids, texts, size, held = [], [], 0, 0
    for wide in slices(batches, limit=GROUP):
        for at in range(0, len(wide), MOST_TEXTS):
            part = wide.slice(at, MOST_TEXTS)
            one = text_array(part.column("text"))
            more = pc.sum(pc.binary_length(one)).as_py()
            if texts and (size + more > GROUP or held + len(one) > MOST_TEXTS):
                yield pa.concat_arrays(ids), pa.concat_arrays(texts)
                ids, texts, size, held = [], [], 0, 0
            ids.append(part.column("doc_id").take(pa.array(np.arange(len(part)))))  # a copy: the batch need not be kept
            texts.append(one)
            size, held = size + more, held + len(one)
    if texts:
        yield pa.concat_arrays(ids), pa.concat_arrays(texts)


def _starts(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values start."""
    return np.flatnonzero(np.concatenate((np.ones(min(1, len(values)), dtype=bool), values[1:] != values[:-1])))


def _runs(values: np.ndarray) -> zip:
    """Begin and end of every run of equal values."""
    edges = np.append(_starts(values), len(values)).tolist()
    return zip(edges[:-1], edges[1:], strict=True)


def _entries(codes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of a code below 2**48 and a text, in order: codes, texts, and how often each pair occurs."""
    pairs = (codes.view(np.uint64) << np.uint64(16)) | owner.astype(np.uint64)
    pairs.sort()
    at = _starts(pairs)
    n = np.diff(np.append(at, len(pairs)))
    pairs = pairs[at]
    return (pairs >> np.uint64(16)).astype(np.int64), (pairs & np.uint64(0xFFFF)).astype(np.uint16), n


PACKED = (np.int64, np.uint32, np.uint16, np.uint32)  # distinct keys, texts per key, texts, occurrences per key and text


def _pack(keys: np.ndarray, sizes: np.ndarray, owner: np.ndarray, n: np.ndarray) -> bytes:
    """The arrays in planes of equal bytes, which compress well."""
    arrays = [np.ascontiguousarray(x, dtype=t) for x, t in zip((keys, sizes, owner, n), PACKED, strict=True)]
    raw = b"".join(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes() for x in arrays)
    return np.array([len(keys), len(owner)], dtype=np.int64).tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(part: bytes) -> list[np.ndarray]:
    n_keys, n_entries = map(int, np.frombuffer(part, np.int64, 2))
    lengths = (n_keys, n_keys, n_entries, n_entries)
    raw = pa.decompress(part[16:], decompressed_size=sum(n * np.dtype(t).itemsize for n, t in zip(lengths, PACKED, strict=True)), codec="zstd", asbytes=True)
    arrays, at = [], 0
    for n, kind in zip(lengths, PACKED, strict=True):
        width = np.dtype(kind).itemsize
        arrays.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T).view(kind).ravel())
        at += n * width
    return arrays


TEXTS, GRAMS, WORDS = 0, 1, 2  # kinds of rows: a group's texts, and what is asked and answered about them
ASKED = "cell int, base long, kind int, part binary, ids array<long>, tokens array<long>, sums array<double>, plain array<double>, known array<long>"
ANSWERED = "base long, kind int, ids array<long>, tokens array<long>, sums array<double>, plain array<double>, known array<long>"
SCORED = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_longs, _doubles = pa.list_(pa.int64()), pa.list_(pa.float64())


def _batch(rows: list[tuple], types: list[pa.DataType], schema: str) -> pa.RecordBatch:
    names = [field.split()[0] for field in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def _plus(one: np.ndarray | None, other: np.ndarray) -> np.ndarray:
    """The sum of two arrays of which one may be shorter."""
    if one is None:
        return other
    out = np.zeros(max(len(one), len(other)), dtype=other.dtype)
    out[: len(one)] += one
    out[: len(other)] += other
    return out


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` of every row of ``docs``.

    ``score`` is the model's log10 probability of the lower-cased (A-Z) text's bytes and its end. Null text is empty;
    an empty text has one token, its end. Other columns are not looked at. Groups of texts are numbered by partition, so
    ``docs`` must come in the same partitions if a lost task is run again, as tables do.
    """
    text_bytes = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    splits = model.cells(text_bytes)
    first_cell, n_cells = np.cumsum(splits) - splits, int(splits.sum())
    shard_of_cell = np.repeat(np.arange(len(splits)), splits)
    n_tries = len(model.trie_shards)

    def rows_asked(kind: int, number: int, base: int, shard: np.ndarray, codes: np.ndarray, owner: np.ndarray, n: np.ndarray, table: np.ndarray | None):
        for begin, end in _runs(shard):
            at = shard[begin] + (n_tries if kind == WORDS else 0)
            cell = int(first_cell[at] + number % splits[at])
            for i in range(begin, end, ENTRIES):
                some = slice(i, min(end, i + ENTRIES))
                starts = _starts(codes[some])
                keys = codes[some][starts]
                sizes = np.diff(np.append(starts, some.stop - i))
                yield cell, base, kind, _pack(keys if table is None else table[keys], sizes, owner[some], n[some]), None, None, None, None, None

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), _longs, _longs, _doubles, _doubles, _longs]
        base = TaskContext.get().partitionId() << 33
        hot, hot_words = _table("hot", model.hot, ["key", "b"]), _table("hot words", model.hot_words, ["key", "n"])
        for number, (ids, texts) in enumerate(_groups(batches), TaskContext.get().partitionId()):
            rows, sums = [], np.zeros(len(texts))
            data, starts = symbols(texts)
            for begin in range(ORDER, len(data), GROUP):
                end = min(len(data), begin + GROUP)
                inner = data[begin:end] != PAD
                owner = np.repeat(np.arange(len(texts)), np.diff(np.clip(np.append(starts, len(data)), begin, end)))
                codes, owner, n = _entries(backward_grams(data, begin, end)[inner], owner[inner])
                first = _starts(codes)
                sizes = np.diff(np.append(first, len(codes)))
                value = hot.get(((ORDER + 1) << 56) | forward_grams(codes[first]))
                sums += np.bincount(owner, weights=np.repeat(value, sizes) * n, minlength=len(texts))
                cold = np.repeat(value == 0, sizes)  # a logarithm below 0 if it is hot
                codes, owner, n = codes[cold], owner[cold], n[cold]
                rows += rows_asked(GRAMS, number, base, np.searchsorted(model.bounds, codes >> 8, side="right"), codes, owner, n, None)
            words, of_text = ascii_words(texts)
            coded = words.dictionary_encode()
            hashes = [xxhash.xxh64_intdigest(w, SEED) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()]
            keys = np.array(hashes, dtype=np.uint64).view(np.int64)
            shard = keys % len(model.word_shards)
            order = np.lexsort((keys, shard))
            keys, shard = keys[order], shard[order]
            rank = np.empty(len(keys), dtype=np.int64)
            rank[order] = np.arange(len(keys))
            owner = np.repeat(np.arange(len(texts)), np.diff(of_text))
            codes, owner, n = _entries(rank[coded.indices.to_numpy()], owner)
            count = hot_words.get(keys)
            plain = np.bincount(owner, weights=np.log10(count + 1)[codes] * n, minlength=len(texts))
            known = np.bincount(owner, weights=(count > 0)[codes] * n, minlength=len(texts)).astype(np.int64)
            cold = (count == 0)[codes]
            codes, owner, n = codes[cold], owner[cold], n[cold]
            rows += rows_asked(WORDS, number, base, shard[codes], codes, owner, n, keys)
            rows.append((number % n_cells, base, TEXTS, None, ids.to_pylist(), np.diff(of_text) + 1, sums, plain, known))
            base += len(texts)
            yield _batch(rows, types, ASKED)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int32(), _longs, _longs, _doubles, _doubles, _longs]
        for batch in batches:
            cell, base, kind = (batch.column(c).to_numpy() for c in ("cell", "base", "kind"))
            own = batch.filter(pa.array(kind == TEXTS))
            if len(own):
                yield own.select(["base", "kind", "ids", "tokens", "sums", "plain", "known"])
            asked = np.flatnonzero(kind != TEXTS)
            for begin, end in _runs(cell[asked]):
                shard = int(shard_of_cell[cell[asked[begin]]])
                sums: dict[int, np.ndarray] = {}
                known: dict[int, np.ndarray] = {}
                for i in range(begin, end, ROWS_AT_ONCE):
                    rows = asked[i : min(end, i + ROWS_AT_ONCE)]
                    parts = [_unpack(batch.column("part")[int(row)].as_py()) for row in rows]
                    keys = np.concatenate([part[0] for part in parts])
                    if shard < n_tries:
                        table = _table("shard", model.trie_shards[shard], ["key", "a", "b", "c"])
                        values = table.log_probability(forward_grams(keys), model.unseen)
                    else:
                        table = _table("shard", model.word_shards[shard - n_tries], ["key", "n"])
                        values = np.log10(table.get(keys) + 1)
                    at = 0
                    for row, (own_keys, sizes, owner, n) in zip(rows, parts, strict=True):
                        value = np.repeat(values[at : at + len(own_keys)], sizes)
                        sums[base[row]] = _plus(sums.get(base[row]), np.bincount(owner, weights=value * n))
                        if shard >= n_tries:
                            known[base[row]] = _plus(known.get(base[row]), np.bincount(owner, weights=(value > 0) * n).astype(np.int64))
                        at += len(own_keys)
                if shard < n_tries:
                    out = [(b, GRAMS, None, None, x, None, None) for b, x in sums.items()]
                else:
                    out = [(b, WORDS, None, None, None, x, known[b]) for b, x in sums.items()]
                yield _batch(out, types, ANSWERED)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = ids = tokens = score = plain = known = None
        whole, ends = np.log10(model.tokens + model.kinds + 1), np.log10(model.texts + 1)

        def out():
            arrays = [ids, tokens, known + (model.texts > 0), np.full(len(ids), model.tokens), plain + ends - tokens * whole, score]
            names = [field.split()[0] for field in SCORED.split(", ")]
            return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in arrays], names)

        for batch in batches:
            for i, (base, kind) in enumerate(zip(batch.column("base").to_pylist(), batch.column("kind").to_pylist(), strict=True)):
                if kind == TEXTS:
                    if current is not None:
                        yield out()
                    current, ids = base, batch.column("ids")[i].values
                    tokens, score, plain, known = (np.array(batch.column(c)[i].values) for c in ("tokens", "sums", "plain", "known"))
                    continue
                for into, name in ((score, "sums"),) if kind == GRAMS else ((plain, "plain"), (known, "known")):
                    more = batch.column(name)[i].values.to_numpy()
                    into[: len(more)] += more
        if current is not None:
            yield out()

    asked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(ask, ASKED)
    answered = asked.repartitionById(n_cells, "cell").mapInArrow(answer, ANSWERED)
    return answered.repartition("base").sortWithinPartitions("base", "kind").mapInArrow(total, SCORED)


def held_out_scores(docs: DataFrame) -> DataFrame:
    """Scores of all rows by a model of those whose crc32 of the id modulo 7 is not 2 (a null id's is 0)."""
    model = Model(docs.where(remainder(F.col("doc_id"), FOLDS) != HELD_OUT))
    return score(docs, model).withColumn("held_out", remainder(F.col("doc_id"), FOLDS) == HELD_OUT)
