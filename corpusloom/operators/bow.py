"""Bag of words: term counts, frequency-ordered vocabulary, sparse rows.

A text is tokenised once: ``with_counts`` packs its terms and their counts into an array where the row lies. The
vocabulary is summed from these arrays, and one shuffle of them by document key (never of the text) serves
the lookup in a broadcast vocabulary and the packing of the sparse rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import UNICODE_TOKEN, tokens
from corpusloom.operators.ordering import ordered_positions
from corpusloom.session import materialize

BROADCAST_BYTES = 64 << 20  # a vocabulary of at most this size is broadcast whole
ROW_BYTES = 48  # room a broadcast row takes beside its term
FILTER_BITS = 16  # of a Bloom filter, for each key of a table that is no broadcast
MOST_FILTER_ROWS = 1 << 20  # of 64 bits each; the filter lets more pass if the table outgrows them
HEAD_TERMS = 1 << 24  # of a larger one, terms that hold at least one in so many rows are broadcast, the most frequent ones that fit
TASK_ROWS = 1 << 20  # rows of terms that a task counts or packs, about 0.2 GB of its memory
TERM_BYTES = 8  # of text, for each row of terms that it gives


def parts_for(df: DataFrame, rows: Column | None = None, task_rows: int = TASK_ROWS) -> int:
    """How many partitions give no task more than ``task_rows`` of the rows; ``rows`` is how many each row of ``df`` makes, one by default."""
    total = df.agg(F.count(F.lit(1)) if rows is None else F.sum(rows)).first()[0]
    return max(1, math.ceil((total or 0) / task_rows))


def text_rows(text: str = "text") -> Column:
    """About how many rows of terms a text gives, by its length alone: more than it does, unless nearly all its words are short and none comes twice."""
    return F.ceil(F.octet_length(text) / TERM_BYTES)


def by_key(df: DataFrame, keys: Sequence[str], parts: int = 1) -> DataFrame:
    """Rows of a key together, in as many partitions as the session shuffles to, or in ``parts`` if these are more.

    Left to itself Spark joins small partitions into few for all cores; what is small in bytes of text or of packed counts is
    many times that as rows of terms. The session's number is a fixed one, so that more input makes larger tasks; ``parts`` grows with it.
    """
    return df.repartition(max(parts, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


def tokenize(df: DataFrame, col: str = "text", pattern: str = UNICODE_TOKEN, name: str = "tokens") -> DataFrame:
    return df.withColumn(name, tokens(col, pattern))


def token_rows(
    docs: DataFrame, columns: Sequence[str] = ("doc_id",), text: str = "text", pattern: str = UNICODE_TOKEN
) -> DataFrame:
    """One row per token, each counting one."""
    return docs.select(*columns, F.explode(tokens(text, pattern)).alias("term"), F.lit(1).cast("bigint").alias("tf"))


def filter_stop_words(
    terms: DataFrame,
    words: Sequence[str] | DataFrame,
    column: str = "term",
    broadcast_bytes: int = BROADCAST_BYTES,
    head_terms: int = HEAD_TERMS,
) -> DataFrame:
    """Drop rows whose term is a stop word, given as a list or as a table with that column."""
    if isinstance(words, DataFrame):
        kept = match(terms, words.select(column).distinct(), column, "left_anti", broadcast_bytes, head_terms)
        return kept.select(terms.columns)
    return terms.where(~F.col(column).isin(list(words))) if words else terms


def with_counts(docs: DataFrame, text: str = "text", pattern: str = UNICODE_TOKEN, name: str = "counts") -> DataFrame:
    """Add the packed counts of a text: an array of (``term``, ``tf``), by term; empty for null text.

    Nothing is shuffled: equal tokens stand together once sorted, so a term's count is the distance between two starts.
    """
    tokens_of = F.coalesce(tokens(text, pattern), F.array().cast("array<string>"))
    columns = [F.col(c) for c in docs.columns]
    # Steps of their own: an array that lambdas read is found once per row.
    sorted_tokens = docs.select(*columns, F.sort_array(tokens_of).alias("_sorted"))
    t, s = F.col("_sorted"), F.col("_starts")
    starts = F.array_compact(F.transform(t, lambda x, i: F.when((i == 0) | (x != F.get(t, i - 1)), i)))
    counted = F.transform(s, lambda at, j: F.struct(F.get(t, at).alias("term"), (F.coalesce(F.get(s, j + 1), F.size(t)) - at).cast("bigint").alias("tf")))
    return sorted_tokens.withColumn("_starts", starts).withColumn(name, counted).drop("_sorted", "_starts")


def count_rows(docs: DataFrame, columns: Sequence[str] = ("doc_id",), counts: str = "counts") -> DataFrame:
    """One row per term of a document, from its packed counts: ``columns``, ``term``, ``tf``.

    Empty arrays are dropped after the generator: a plain ``inline`` has them filtered below it, where the filter would
    repeat whatever makes the arrays, once for each of their elements, if they are not written.
    """
    return docs.select(*columns, F.inline_outer(counts)).where(F.col("term").isNotNull())


def term_frequency(
    docs: DataFrame,
    keys: Sequence[str] = ("doc_id",),
    carry: Sequence[str] = (),
    text: str = "text",
    pattern: str = UNICODE_TOKEN,
    outer: bool = False,
    colocate: bool = True,
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """Count each term of each document; ``carry`` names document columns to keep.

    ``outer`` keeps a document without terms as one row with a null term. ``colocate=False`` is for
    documents already partitioned by their key, as a bucketed table is. Others are read once more for the length of their text,
    which says how many tasks count them.
    """
    if colocate:
        docs = by_key(docs.select(*keys, *carry, text), keys, parts_for(docs, text_rows(text), task_rows))
    explode = F.explode_outer if outer else F.explode
    terms = docs.select(*keys, *carry, explode(tokens(text, pattern)).alias("term"))
    return terms.groupBy(*keys, *carry, "term").agg(F.count(F.lit(1)).alias("tf"))


def term_totals(terms: DataFrame, order_scope: Sequence[str] | None = None, split: str = "split") -> DataFrame:
    """Total count of each term over the splits in ``order_scope``; a term of other splits alone has 0."""
    counted = F.col("tf") if order_scope is None else F.when(F.col(split).isin(list(order_scope)), F.col("tf"))
    return terms.groupBy("term").agg(F.coalesce(F.sum(counted), F.lit(0)).cast("bigint").alias("train_count"))


def number_terms(totals: DataFrame) -> DataFrame:
    """Number terms from 0 by falling count; equal counts go by term."""
    return ordered_positions(totals, [F.desc("train_count"), F.asc("term")], "word_id")


def fit_vocab(
    terms: DataFrame,
    fit_scope: Sequence[str] | None = None,
    order_scope: Sequence[str] | None = None,
    split: str = "split",
) -> DataFrame:
    """Vocabulary of the terms in the ``fit_scope`` splits, numbered by their count in ``order_scope``.

    Takes term counts or plain token rows: totals combine before they are shuffled.
    """
    if fit_scope is not None and not set(order_scope or ()) <= set(fit_scope):
        raise ValueError("the order scope must lie within the fit scope")
    if fit_scope is not None:
        terms = terms.where(F.col(split).isin(list(fit_scope)))
    return number_terms(term_totals(terms, order_scope, split))


def measured_bytes(table: DataFrame, key: str) -> int:
    """What a broadcast of the table, by this key, takes."""
    size = F.octet_length(F.col(key).cast("string")) + ROW_BYTES
    return table.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]


def _frequent(rows: DataFrame, key: str, broadcast_bytes: int, head_terms: int) -> DataFrame:
    """Keys that hold at least 1/head_terms of the rows, or fewer of them, so that together they fit a broadcast: the most frequent ones, with ``_rows``."""
    least = max(rows.count() / max(head_terms, 1), 1)
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_rows")).where((F.col("_rows") >= least) & F.lit(head_terms > 0))
    counts = materialize(counts, "frequent")
    # Bytes of the keys that hold least * 2**i rows and less than twice that, by i.
    level = F.floor(F.log2(F.col("_rows") / F.lit(least))).alias("_level")
    size = F.octet_length(F.col(key).cast("string")) + ROW_BYTES
    levels = {r["_level"]: r["_bytes"] for r in counts.groupBy(level).agg(F.sum(size).alias("_bytes")).collect()}
    lowest, room = max(levels, default=-1) + 1, broadcast_bytes
    while lowest > 0 and (room := room - levels.get(lowest - 1, 0)) >= 0:
        lowest -= 1
    return counts.where(level >= lowest).select(key, "_rows")


def _may_hold(rows: DataFrame, table: DataFrame, key: str, name: str) -> DataFrame:
    """``rows`` with whether a Bloom filter of the table's keys (one hash, a broadcast of bounded size) may hold their key; null keys are not held."""
    n = max(1, table.count())
    words = min(MOST_FILTER_ROWS, 1 << (n * FILTER_BITS // 64).bit_length())
    place = F.pmod(F.xxhash64(key), F.lit(words * 64))
    word, bit = F.shiftright(place, 6), F.call_function("shiftleft", F.lit(1).cast("bigint"), place.bitwiseAND(F.lit(63)).cast("int"))
    bits = table.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    held = F.col(key).isNotNull() & F.coalesce(F.col("_bits").bitwiseAND(bit) != 0, F.lit(False))
    return rows.join(F.broadcast(bits), word == F.col("_word"), "left").withColumn(name, held).drop("_word", "_bits")


def match(
    rows: DataFrame,
    table: DataFrame,
    key: str,
    how: str = "inner",
    broadcast_bytes: int = BROADCAST_BYTES,
    head_terms: int = HEAD_TERMS,
    stored: bool = False,
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """Join ``rows``, of which few keys may hold most, with a ``table`` of distinct keys: inner, left or left_anti.

    A table that fits is broadcast after its size is measured. Of a larger one the frequent keys are, as many as fit: no
    more than ``head_terms`` keys can each hold 1/head_terms of the rows, and they match where they lie. Null keys and those
    that a Bloom filter of the table does not hold have no match and stay where they lie, too. The others are shuffled by
    key, none of them a hot one. Their share grows with the input, so they are dealt to more partitions than the session
    shuffles to if a task would get more than ``task_rows`` of them or of the table. ``rows`` are written once, unless they are a ``stored`` table.
    """
    if measured_bytes(table, key) <= broadcast_bytes:
        return rows.join(F.broadcast(table), key, how)
    rows = rows if stored else materialize(rows, "keyed_rows")
    keyed = rows.where(F.col(key).isNotNull())
    frequent = _frequent(keyed, key, broadcast_bytes, head_terms)
    others = keyed.count() - (frequent.agg(F.sum("_rows")).first()[0] or 0)
    frequent = frequent.select(key)
    near = rows if how == "inner" else rows.join(F.broadcast(frequent), key, "left_semi")
    near = near.join(F.broadcast(table.join(F.broadcast(frequent), key)), key, how)
    rest = _may_hold(rows.join(F.broadcast(frequent), key, "left_anti"), table, key, "_held")
    far = rest.where("_held").drop("_held")
    parts = max(math.ceil(others / task_rows), parts_for(table, task_rows=task_rows))
    if parts > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        far, table = by_key(far, [key], parts), by_key(table, [key], parts)
    found = near.unionByName(far.join(table, key, how))
    if how == "inner":
        return found
    return found.unionByName(rest.where("not _held").drop("_held"), allowMissingColumns=True)


def transform_bow(
    terms: DataFrame,
    vocab: DataFrame,
    broadcast_bytes: int = BROADCAST_BYTES,
    head_terms: int = HEAD_TERMS,
) -> DataFrame:
    """Word ids for terms; terms outside the vocabulary are dropped."""
    columns = [c for c in terms.columns if c != "term"]
    return match(terms, vocab.select("term", "word_id"), "term", "inner", broadcast_bytes, head_terms).select(*columns, "word_id")


def packed(word_id: str = "word_id", tf: str = "tf") -> Column:
    """Sparse row of a document, by word id; rows without a word id or a count add nothing."""
    entry = F.struct(F.col(word_id).alias("word_id"), F.col(tf).alias("tf"))
    return F.sort_array(F.collect_list(F.when(F.col(word_id).isNotNull() & (F.col(tf) != 0), entry)))


def pack_bow(docs: DataFrame, bow: DataFrame, keys: Sequence[str] = ("doc_id",), colocate: bool = False, parts: int = 1) -> DataFrame:
    """One row per document with its sparse row; a document without words gets an empty one.

    ``colocate`` is for rows of any order: they are brought together by document before they are packed, so that no task packs
    a few rows of each of very many documents, in ``parts`` partitions at least (``parts_for``). A table in buckets by document needs no such move.
    """
    bow = by_key(bow, keys, parts) if colocate else bow
    rows = bow.groupBy(*keys).agg(packed().alias("features"))
    empty = F.array().cast(rows.schema["features"].dataType)
    return docs.join(rows, list(keys), "left").withColumn("features", F.coalesce("features", empty))


def _head(vocab: DataFrame, broadcast_bytes: int) -> Column:
    """Whether a word is one of the first ones, which fit a broadcast: ids go by falling count."""
    words, size = vocab.count(), measured_bytes(vocab, "term")
    first = words * broadcast_bytes // max(size, 1)
    while first > 0 and measured_bytes(vocab.where(F.col("word_id") < first), "term") > broadcast_bytes:
        first //= 2
    return F.col("word_id") < first


def bag_of_counts(
    docs: DataFrame,
    vocab: DataFrame,
    keys: Sequence[str] = ("doc_id",),
    carry: Sequence[str] = (),
    counts: str = "counts",
    broadcast_bytes: int = BROADCAST_BYTES,
    head_terms: int = HEAD_TERMS,
    rows: Column | None = None,
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """Packed counts to sparse rows; a document without known words gets an empty one.

    The arrays are shuffled once, by document, and meet a broadcast vocabulary there. Of one too large for that the first words are
    broadcast. Each document is written with the row of these and with its other terms, but for those that a Bloom filter of the other words does
    not hold; few are left, which meet their words by key, and then their document. There, documents are dealt to as many tasks as the terms
    ask for; ``rows`` says how many a document has if its counts are not written, since they would be made once more for their number.
    """
    vocab = vocab.select("term", "word_id")
    narrow = docs.select(*keys, *carry, counts)
    if measured_bytes(vocab, "term") <= broadcast_bytes:
        terms = narrow.repartition(*keys).select(*keys, *carry, F.inline_outer(counts))
        return terms.join(F.broadcast(vocab), "term", "left").groupBy(*keys, *carry).agg(packed().alias("features"))
    first = _head(vocab, broadcast_bytes)
    parts = parts_for(docs, F.size(counts) if rows is None else rows, task_rows)
    terms = by_key(narrow, keys, parts).select(*keys, *carry, F.inline_outer(counts))
    matched = terms.join(F.broadcast(vocab.where(first)), "term", "left")
    others = vocab.where(~first).withColumnRenamed("term", "_open")
    matched = _may_hold(matched.withColumn("_open", F.when(F.col("word_id").isNull(), F.col("term"))), others, "_open", "_held")
    rest = F.collect_list(F.when(F.col("_held"), F.struct("term", "tf"))).alias("_rest")
    bags = materialize(matched.groupBy(*keys, *carry).agg(packed().alias("features"), rest), "bags")
    rare = match(count_rows(bags, [*keys, *carry], "_rest"), vocab.where(~first), "term", "inner", broadcast_bytes, head_terms)
    names = {c: f"_of_{c}" for c in (*keys, *carry)}
    rare = rare.groupBy(*keys, *carry).agg(packed().alias("_rare")).withColumnsRenamed(names)
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(name)) for c, name in names.items()])
    # The first words' ids are the lower ones.
    whole = F.concat("features", F.coalesce("_rare", F.array().cast(bags.schema["features"].dataType)))
    return bags.join(rare, same, "left").select(*keys, *carry, whole.alias("features"))


def bag_of_words(
    docs: DataFrame,
    vocab: DataFrame,
    keys: Sequence[str] = ("doc_id",),
    carry: Sequence[str] = (),
    text: str = "text",
    pattern: str = UNICODE_TOKEN,
    broadcast_bytes: int = BROADCAST_BYTES,
    head_terms: int = HEAD_TERMS,
) -> DataFrame:
    """Text to sparse rows in one shuffle, of the packed counts. A corpus that is also fitted packs them once for both."""
    counted = with_counts(docs.select(*keys, *carry, text), text, pattern, "_counts")
    return bag_of_counts(counted, vocab, keys, carry, "_counts", broadcast_bytes, head_terms, text_rows(text))


def reindex_words(
    doc_word: DataFrame, words: DataFrame, broadcast_bytes: int = BROADCAST_BYTES, head_terms: int = HEAD_TERMS
) -> tuple[DataFrame, DataFrame]:
    """Renumber an existing document-word table by falling corpus count.

    Returns the renumbered table and the vocabulary, which keeps words that no document holds.
    """
    totals = doc_word.groupBy("word_id").agg(F.sum("n").alias("_count"))
    counted = (
        words.join(totals, "word_id", "left")
        .select(F.col("word_id").alias("old_id"), "term", F.coalesce("_count", F.lit(0)).cast("bigint").alias("train_count"))
    )
    vocab = materialize(
        ordered_positions(counted, [F.desc("train_count"), F.asc("term"), F.asc("old_id")], "word_id"), "vocab"
    )
    mapping = vocab.select(F.col("old_id").alias("word_id"), F.col("word_id").alias("_new"))
    moved = match(doc_word, mapping, "word_id", "inner", broadcast_bytes, head_terms, stored=True)
    moved = moved.select("doc_id", F.col("_new").alias("word_id"), "n")
    return moved, vocab.drop("old_id")
