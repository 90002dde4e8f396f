"""Ranked lexical search over a length-stratified index.

A document's normaliser m depends on its length alone, so documents of equal m form a stratum, and within a stratum a
term's contribution depends on its frequency tf alone: it is computed once per tf. A stratum is stored in chunks of
bounded size; a chunk's postings lie by term and rising tf. The highest tf of every term bounds what a chunk can give
a query. The chunk of the highest bound is visited first and sets the score to beat; of the others only those are
visited whose bound reaches it. Queries are served in blocks, whose terms travel with the tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import ascii_words, slices, text_array
from corpusloom.operators.ordering import ordered_positions
from corpusloom.session import materialize

TOP = 20
CHUNK_DOCS, CHUNK_POSTINGS = 2048, 1 << 18  # of a chunk, unless one document has more terms
QUERIES, QUERY_TERMS = 1000, 1_000_000  # of a block of queries, unless one query has more terms

# Bytes below 128 other than letters and digits separate terms.
_folded = np.arange(256, dtype=np.uint8)
_folded[[i for i in range(128) if not chr(i).isalnum()]] = 0x20
_folded[ord("A") : ord("Z") + 1] += 0x20


def split_terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The terms of all texts in a row, A-Z lower-cased, and where each text's terms start (one more entry)."""
    _, offsets, data = texts.buffers()
    folded = _folded[np.frombuffer(data, np.uint8)] if data else np.empty(0, np.uint8)
    return ascii_words(pa.LargeStringArray.from_buffers(len(texts), offsets, pa.py_buffer(folded)))


def _packed(lists: pa.Array, offsets: np.ndarray) -> pa.Array:
    """Terms joined by spaces, which no term holds; one row per list."""
    of_row = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), lists)
    return pc.binary_join(of_row, pa.scalar(" ", pa.large_string())).cast(pa.string())


def pack(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``id``, ``n`` (terms), ``terms`` (distinct ones, joined by spaces), ``tfs`` of every row; written once, with a ``row`` number."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            terms, starts = split_terms(text_array(part.column("text")))
            coded = terms.dictionary_encode()
            kinds = max(1, len(coded.dictionary))
            owner = np.repeat(np.arange(len(part)), np.diff(starts))
            both, tf = np.unique(owner * kinds + coded.indices.to_numpy(), return_counts=True)
            offsets = np.searchsorted(both // kinds, np.arange(len(part) + 1))
            tfs = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(tf, pa.int32()))
            names = _packed(coded.dictionary.take(pa.array(both % kinds)), offsets)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(np.diff(starts), pa.int64()), names, tfs], ["id", "n", "terms", "tfs"])

    source = rows.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    packed = materialize(source.mapInArrow(work, "id long, n long, terms string, tfs array<int>"), "lexical-terms")
    return packed.withColumn("row", F.monotonically_increasing_id())


@dataclass(frozen=True)
class Index:
    """``chunks``: ``m``, ``block``, ``ids`` of the documents, ``terms`` (joined by spaces), and postings as runs of equal tf.

    Term t has the runs ``first[t]`` to ``first[t + 1]``; run r has the frequency ``tfs[r]`` and the places in ``ids`` that
    ``slots`` holds from ``ends[r - 1]`` to ``ends[r]``. ``n_docs`` documents have terms, ``n_terms`` in all.
    """

    chunks: DataFrame
    n_docs: int
    n_terms: int


def _chunk(m: int, block: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    table = pa.Table.from_batches(parts)
    lists = pc.ascii_split_whitespace(table.column("terms").combine_chunks().cast(pa.large_string()))
    coded = lists.flatten().dictionary_encode()
    code, tf = coded.indices.to_numpy(), table.column("tfs").combine_chunks().flatten().to_numpy()
    slot = np.repeat(np.arange(len(table)), pc.list_value_length(lists).to_numpy())
    order = np.lexsort((slot, tf, code))
    code, tf, slot = code[order], tf[order], slot[order]
    start = np.flatnonzero(np.concatenate(([True], (code[1:] != code[:-1]) | (tf[1:] != tf[:-1]))))
    first = np.searchsorted(code[start], np.arange(len(coded.dictionary) + 1))
    columns = [
        pa.array([m], pa.int64()), pa.array([block], pa.int64()), _one(table.column("id").combine_chunks()),
        _packed(coded.dictionary, np.array([0, len(coded.dictionary)])),
        *[_one(pa.array(x, pa.int32())) for x in (first, tf[start], np.append(start[1:], len(code)), slot)],
    ]
    return pa.RecordBatch.from_arrays(columns, ["m", "block", "ids", "terms", "first", "tfs", "ends", "slots"])


def _one(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks from rows sorted by ``m`` and ``block``."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        m, block = batch.column("m").to_numpy(), batch.column("block").to_numpy()
        cuts = np.flatnonzero((m[1:] != m[:-1]) | (block[1:] != block[:-1])) + 1
        for begin, end in zip([0, *cuts], [*cuts, len(m)], strict=True):
            if begin == end:
                continue
            if held and now != (m[begin], block[begin]):
                yield _chunk(*now, held)
                held = []
            now = (int(m[begin]), int(block[begin]))
            held.append(batch.slice(begin, end - begin))
    if held:
        yield _chunk(*now, held)


def build(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Index:
    """Index all terms of all rows of ``docs``; rows without terms are not in it.

    The text is read once. A stratum's documents are dealt to its chunks by a hash of the row, so
    neither a common length nor copies of a document make a large chunk.
    """
    packed = pack(docs, doc_id, text)
    n_docs, n_terms = packed.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    rows = packed.where("n > 0").withColumn("m", F.expr(f"75 + (25 * n * {n_docs}L) div {max(n_terms, 1)}L"))
    strata = rows.groupBy("m").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.size("tfs")).alias("postings"))
    needed = F.ceil(F.greatest(F.col("docs") / CHUNK_DOCS, F.col("postings") / CHUNK_POSTINGS))
    strata = materialize(strata.select("m", needed.alias("blocks")), "lexical-strata")
    dealt = rows.join(strata, "m").withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")))
    sorted_rows = dealt.select("m", "block", "id", "terms", "tfs").repartition("m", "block").sortWithinPartitions("m", "block")
    schema = "m long, block long, ids array<long>, terms string, first array<int>, tfs array<int>, ends array<int>, slots array<int>"
    return Index(materialize(sorted_rows.mapInArrow(_assemble, schema), "lexical-index"), n_docs, n_terms)


class _Queries:
    """A block of queries: their distinct terms, and each query's terms by number with their repeats."""

    def __init__(self, rows: list) -> None:
        words = [r["terms"].split(" ") for r in rows]
        number: dict[str, int] = {}
        self.rows = [r["row"] for r in rows]
        self.terms = [np.array([number.setdefault(w, len(number)) for w in ws], dtype=np.int64) for ws in words]
        self.repeats = [np.array(r["tfs"], dtype=np.int64) for r in rows]
        self.vocabulary = list(number)
        self.weights: list[np.ndarray] = []
        self.least = np.zeros(len(rows), dtype=np.int64)  # the score to beat

    def weigh(self, n_docs: int, df: dict[int, int]) -> None:
        of_term = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(self.vocabulary))]
        weight = np.array(of_term, dtype=np.int64)
        self.weights = [n * weight[t] for t, n in zip(self.terms, self.repeats, strict=True)]

    def bounds(self, m: int, highest: np.ndarray) -> np.ndarray:
        """The most that each query can score in a chunk whose terms occur ``highest`` times at most (0: not at all)."""
        gives = impact(highest, m)
        return np.array([int((w * gives[t]).sum()) for t, w in zip(self.terms, self.weights, strict=True)], dtype=np.int64)

    def places(self, terms: str, value_set: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the block's terms that a chunk has, and their places among the chunk's terms."""
        own = pc.ascii_split_whitespace(pa.array([terms], pa.large_string())).flatten()
        number = pc.fill_null(pc.index_in(own, value_set=value_set), -1).to_numpy()
        place = np.flatnonzero(number >= 0)
        return number[place], place


def impact(tf: np.ndarray, m: int) -> np.ndarray:
    """What a term of weight one gives at each frequency in the stratum of m."""
    tf = tf.astype(np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def _directory(chunks: DataFrame, block: _Queries) -> DataFrame:
    """A row per chunk: its numbers of the block's ``terms``, and for each the highest tf and how many documents hold it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value_set = pa.array(block.vocabulary, pa.large_string())
        for batch in batches:
            for at in range(len(batch)):
                number, place = block.places(batch.column("terms")[at].as_py(), value_set)
                first, tfs, ends = (batch.column(c)[at].values.to_numpy() for c in ("first", "tfs", "ends"))
                begin, end = first[place], first[place + 1]
                docs = ends[end - 1] - np.where(begin > 0, ends[begin - 1], 0)
                lists = [_one(pa.array(x, pa.int32())) for x in (number, tfs[end - 1], docs)]
                yield pa.RecordBatch.from_arrays([batch.column("m").slice(at, 1), batch.column("block").slice(at, 1), *lists], ["m", "block", "number", "highest", "docs"])

    narrow = chunks.select("m", "block", "terms", "first", "tfs", "ends")
    schema = "m long, block long, number array<int>, highest array<int>, docs array<int>"
    return materialize(narrow.mapInArrow(work, schema), "lexical-directory")


def _best_chunks(directory: DataFrame, block: _Queries) -> list:
    """For every query of the block the chunk of the highest bound."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.zeros(len(block.rows), dtype=np.int64)
        where = np.zeros((len(block.rows), 2), dtype=np.int64)
        for batch in batches:
            for at in range(len(batch)):
                m, chunk = batch.column("m")[at].as_py(), batch.column("block")[at].as_py()
                highest = np.zeros(len(block.vocabulary), dtype=np.int64)
                highest[batch.column("number")[at].values.to_numpy()] = batch.column("highest")[at].values.to_numpy()
                bound = block.bounds(m, highest)
                better = bound > best
                best[better], where[better] = bound[better], (m, chunk)
        found = np.flatnonzero(best)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (found, best[found], where[found, 0], where[found, 1])], ["query", "bound", "m", "block"])

    found = directory.select("m", "block", "number", "highest").mapInArrow(work, "query long, bound long, m long, block long")
    return found.groupBy("query").agg(F.max(F.struct("bound", "m", "block")).alias("best")).select("best.m", "best.block").distinct().collect()


def _visit(chunks: DataFrame, block: _Queries, k: int) -> DataFrame:
    """``query``, ``doc_id``, ``score``: a task's k best documents of every query; chunks whose bound stays below the score to beat are left out."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value_set = pa.array(block.vocabulary, pa.large_string())
        least = block.least.copy()
        best: list[tuple] = [(np.empty(0, np.int64),) * 3] * len(block.rows)
        for batch in batches:
            for at in range(len(batch)):
                m = batch.column("m")[at].as_py()
                ids = batch.column("ids")[at].values
                number, place = block.places(batch.column("terms")[at].as_py(), value_set)
                first, tfs, ends, slots = (batch.column(c)[at].values.to_numpy() for c in ("first", "tfs", "ends", "slots"))
                highest = np.zeros(len(block.vocabulary), dtype=np.int64)
                highest[number] = tfs[first[place + 1] - 1]
                where = np.full(len(block.vocabulary), -1)
                where[number] = place
                starts = np.concatenate(([0], ends))
                gives = np.repeat(impact(tfs, m), np.diff(starts))  # once per run of equal tf
                no_id, doc_id = ids.is_null().to_numpy(zero_copy_only=False), pc.fill_null(ids, 0).to_numpy()
                bound = block.bounds(m, highest)
                for query in np.flatnonzero((bound >= least) & (bound > 0)):
                    scores = np.zeros(len(doc_id), dtype=np.int64)
                    for term, weight in zip(where[block.terms[query]], block.weights[query], strict=True):
                        if term >= 0:
                            part = slice(starts[first[term]], starts[first[term + 1]])
                            scores[slots[part]] += weight * gives[part]
                    floor = max(1, least[query])
                    if len(scores) > k:
                        floor = max(floor, np.partition(scores, -k)[-k])
                    hit = np.flatnonzero(scores >= floor)
                    best[query] = _merge(best[query], (scores[hit], no_id[hit], doc_id[hit]), k)
                    if len(best[query][0]) == k:
                        least[query] = max(least[query], best[query][0][-1])
        for query, (scores, no_id, doc_id) in enumerate(best):
            if len(scores):
                ids = pa.array(doc_id, mask=no_id.astype(bool))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), query)), ids, pa.array(scores)], ["query", "doc_id", "score"])

    return chunks.mapInArrow(work, "query long, doc_id long, score long")


def _merge(a: tuple, b: tuple, k: int) -> tuple:
    """The k best of both: highest score, then smallest id, null ids last."""
    scores, no_id, doc_id = (np.concatenate(x) for x in zip(a, b, strict=True))
    order = np.lexsort((doc_id, no_id, -scores))[:k]
    return scores[order], no_id[order], doc_id[order]


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(index: Index, queries: DataFrame, k: int = TOP, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``item_id``, ``rank``, ``doc_id``, ``score``: the k best documents of every row of ``queries``, those with a score above 0.

    Equal scores go by ascending id, null ids last. Rows that repeat an item are ranked each for itself, and so are rows that
    repeat a document. A null or empty text has no results, nor has an empty index.
    """
    packed = pack(queries, item_id, text).where("n > 0")
    placed = materialize(ordered_positions(packed, ["row"], "place"), "lexical-queries")
    total, longest = placed.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("tfs")), F.lit(1))).first()
    size = max(1, min(QUERIES, QUERY_TERMS // longest))
    results = []
    for start in range(0, total, size):
        block = _Queries(placed.where(F.col("place").between(start, start + size - 1)).orderBy("place").select("row", "terms", "tfs").collect())
        directory = _directory(index.chunks, block)
        pairs = directory.select(F.explode(F.arrays_zip("number", "docs")).alias("p")).groupBy("p.number").agg(F.sum("p.docs").alias("df"))
        block.weigh(index.n_docs, dict(map(tuple, pairs.collect())))
        wanted = _best_chunks(directory, block)
        if not wanted:
            continue
        at = F.struct("m", "block").isin([F.struct(*[F.lit(r[c]).cast("long").alias(c) for c in ("m", "block")]) for r in wanted])
        first = index.chunks.where(F.col("m").isin([r["m"] for r in wanted]) & at)
        for query, least, n in _ranked(_visit(first, block, k), k).groupBy("query").agg(F.min("score"), F.count(F.lit(1))).collect():
            block.least[query] = least if n == k else 0
        best = _ranked(_visit(index.chunks, block, k), k)
        results.append(materialize(best.withColumn("place", F.col("query") + start), "lexical-results"))
    columns = ["item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"]
    if not results:
        empty = placed.limit(0).select(F.col("id").alias("item_id"), F.lit(1).alias("rank"), F.col("id").alias("doc_id"), F.col("n").alias("score"))
        return empty.select(*columns)
    items = placed.select(F.col("id").alias("item_id"), "place")
    return reduce(DataFrame.unionByName, results).join(items, "place").select(*columns)


def rank_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The 20 best documents of every item."""
    return search(build(docs), items)


_TERMS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, {_TERMS} AS terms FROM documents
), s AS (
  SELECT count(*)::BIGINT AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d WHERE len(terms) > 0
), t AS (
  SELECT row, doc_id, 75 + (25 * len(terms)::BIGINT * n_docs) // n_terms AS m, unnest(terms) AS term FROM d, s WHERE len(terms) > 0
), p AS (
  SELECT row, doc_id, m, term, count(*)::BIGINT AS tf FROM t GROUP BY ALL
), q AS (
  SELECT item, item_id, unnest(terms) AS term FROM (SELECT row_number() OVER () AS item, item_id, {_TERMS} AS terms FROM benchmark)
), w AS (
  SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, s GROUP BY term
), r AS (
  SELECT item, item_id, row, doc_id, sum(n * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM (SELECT item, item_id, term, count(*) AS n FROM q GROUP BY ALL) JOIN w USING (term) JOIN p USING (term) GROUP BY ALL
)
SELECT item_id, rank::INT AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0) WHERE rank <= {TOP}
"""
