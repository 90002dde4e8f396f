"""SimHash near-duplicates by ball hashing that meets in the middle.

Two fingerprints that differ in at most 3 of 64 bits differ in at most 2 bits once the right third of the
bits is left out: one of three parts holds at least one of three differences. So each distinct
fingerprint emits, for each of the three ways to leave a part out, all variants of the remaining bits within
half of that radius (the bits themselves and every single flip: 132 variants in all, instead of the 2,081
of a radius-2 ball over 64 bits, whose rows outgrow the disk at this size). Two fingerprints within the
radius meet on a variant; each meeting is verified on all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from corpusloom.llm.common import ascii_words, connected_components, slices, text_array
from corpusloom.session import materialize

SHINGLE = 3
SEED = 42
RADIUS = 3
CHUNK = 200_000  # shingles hashed at once
LOW, MID = 21, 42  # parts: bits 0-20, 21-41, 42-63
FREQUENT = 10_000  # fingerprints of more than one row in so many meet their rows by broadcast, so at most so many do
SMALL = 12  # buckets of up to so many members are verified side by side


def _bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def text_fingerprints(texts: pa.Array, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """Majority of the bits of every shingle's XXH64, repeats included; no words give zero."""
    words, starts = ascii_words(texts)
    n_words = np.diff(starts)
    n_shingles = np.where(n_words >= shingle, n_words - shingle + 1, (n_words > 0).astype(n_words.dtype))
    ones = np.zeros((len(texts), 64), dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for i in np.flatnonzero((n_words > 0) & (n_words < shingle)):
        whole = " ".join(words.slice(starts[i], n_words[i]).to_pylist())
        ones[i] = _bits(np.array([digest(whole.encode(), seed)], dtype=np.uint64))[0]
    full = np.flatnonzero(n_words >= shingle)
    owner_ends = np.cumsum(n_shingles[full])
    total = int(owner_ends[-1]) if len(full) else 0
    for begin in range(0, total, CHUNK):
        end = min(total, begin + CHUNK)
        first = int(owner_ends.searchsorted(begin, side="right"))
        last = int(owner_ends.searchsorted(end - 1, side="right"))
        owners = np.arange(first, last + 1)
        bounds = np.concatenate(([begin], owner_ends[first:last], [end]))
        counts = np.diff(bounds)
        # The k-th shingle of a document starts at its k-th word.
        skipped = starts[full[owners]] - np.concatenate(([0], owner_ends))[owners]
        at = pa.array(np.arange(begin, end) + np.repeat(skipped, counts))
        joined = pc.binary_join_element_wise(*[words.take(pc.add(at, j)) for j in range(shingle)], pa.scalar(" ", pa.large_string()))
        hashes = np.array([digest(s, seed) for s in joined.cast(pa.large_binary()).to_pylist()], dtype=np.uint64)
        ones[full[owners]] += np.add.reduceat(_bits(hashes), bounds[:-1] - begin, axis=0, dtype=np.int64)
    majority = (2 * ones > n_shingles[:, None]).astype(np.uint8)
    return np.packbits(majority, axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``fp`` (64 bits as a signed long), written once; null text is empty."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = text_fingerprints(text_array(part.column("text"))).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found)], ["doc_id", "fp"])

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return materialize(source.mapInArrow(work, "doc_id long, fp long"), "simhash")


def _balls(fp: Column) -> Column:
    """Keys of all variants: which part is left out in the top bits, below it the bits that remain."""
    low = fp.bitwiseAND(F.lit((1 << LOW) - 1))
    remaining = (
        (F.shiftrightunsigned(fp, LOW), 64 - LOW),
        (F.shiftleft(F.shiftrightunsigned(fp, MID), LOW).bitwiseOR(low), 64 - (MID - LOW)),
        (fp.bitwiseAND(F.lit((1 << MID) - 1)), MID),
    )
    return F.concat(*[_ball(bits.bitwiseOR(F.lit(tag << 60)), width) for tag, (bits, width) in enumerate(remaining)])


def _ball(key: Column, width: int) -> Column:
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i).cast("long") for i in range(width)])
    return F.transform(flips, lambda flip: key.bitwiseXOR(flip))


def _small(members: np.ndarray, links: list) -> None:
    """Spanning links of many buckets of one size; ``members`` has a bucket per row."""
    label = np.broadcast_to(np.arange(members.shape[1], dtype=np.int16), members.shape).copy()
    for j in range(1, members.shape[1]):
        for i in range(j):
            near = np.bitwise_count(members[:, i] ^ members[:, j]) <= RADIUS
            new = np.flatnonzero(near & (label[:, i] != label[:, j]))
            if len(new):
                links.append((members[new, i], members[new, j]))
                old = label[new, j][:, None]
                label[new] = np.where(label[new] == old, label[new, i][:, None], label[new])


def _large(members: np.ndarray, links: list) -> None:
    """Spanning links of one large bucket: whatever a reached member is near to is reached and done with."""
    rest = members
    while len(rest) > 1:
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            at = frontier.pop()
            near = np.bitwise_count(rest ^ at) <= RADIUS
            if near.any():
                reached = rest[near]
                links.append((np.full(len(reached), at), reached))
                frontier.extend(reached)
                rest = rest[~near]


def _verify(keys: np.ndarray, fps: np.ndarray) -> list:
    """Links within whole buckets; ``keys`` sorted."""
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(keys)])))
    links: list = []
    for size in np.unique(sizes[sizes > 1]):
        chosen = starts[sizes == size]
        if size <= SMALL:
            _small(fps[chosen[:, None] + np.arange(size)], links)
        else:
            for start in chosen:
                _large(np.unique(fps[start : start + size]), links)
    return links


def links(fps: DataFrame) -> DataFrame:
    """Links ``a``, ``b`` that join all fingerprints of ``fps`` (column ``fp``, distinct) within the radius.

    Not every pair of a dense bucket is written: within a bucket the links span what is near, which keeps
    every component whole and their number below that of the variants. Buckets arrive sorted and are
    verified as they pass; the variants of one fingerprint are distinct, so copies add nothing here.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.empty(0, np.int64), np.empty(0, np.uint64)
        kept: list = []

        def out(found):
            if not found:
                return
            a, b = (np.concatenate(x).view(np.int64) for x in zip(*found, strict=True))
            pairs = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        for batch in batches:
            keys = np.concatenate((keys, batch.column(0).to_numpy()))
            fps = np.concatenate((fps, batch.column(1).to_numpy().view(np.uint64)))
            if not len(keys):
                continue
            open_at = int(keys.searchsorted(keys[-1]))  # the last bucket may go on
            kept += _verify(keys[:open_at], fps[:open_at])
            keys, fps = keys[open_at:], fps[open_at:]
            if sum(len(a) for a, _ in kept) > 500_000:
                yield from out(kept)
                kept = []
        if len(keys):
            kept += _verify(keys, fps)
        yield from out(kept)

    # Few bytes become many rows here: spread them by number, as their size alone would not.
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    variants = fps.repartition(parts, "fp").select(F.explode(_balls(F.col("fp"))).alias("key"), "fp")
    sorted_buckets = variants.repartition("key").sortWithinPartitions("key")
    return sorted_buckets.mapInArrow(work, "a long, b long").distinct()


def _grouped(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``fp``, ``component`` (one of its fingerprints), ``component_id`` (its smallest id)."""
    prints = fingerprints(docs, doc_id, text)
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")), "simhash-distinct")
    component = connected_components(links(classes.select("fp")), "a", "b")
    joined = component.withColumnRenamed("node", "fp").join(classes, "fp")
    first = joined.groupBy("component").agg(F.min("first_id").alias("component_id"))
    linked = component.withColumnRenamed("node", "fp").join(first, "component").select("fp", "component", "component_id")
    of_class = classes.join(linked, "fp", "left").select(
        "fp", "n", F.coalesce("component", "fp").alias("component"), F.coalesce("component_id", "first_id").alias("component_id")
    )
    of_class = materialize(of_class, "simhash-classes")
    # The rows of a frequent fingerprint stay where they lie; none of the others is a hot key.
    frequent = F.col("n") > F.greatest(F.lit(classes.agg(F.sum("n")).first()[0] or 0) / FREQUENT, F.lit(1))
    common = F.broadcast(of_class.where(frequent))
    near = prints.join(common, "fp")
    rest = prints.join(F.broadcast(of_class.where(frequent).select("fp")), "fp", "left_anti").join(of_class.where(~frequent), "fp")
    return near.unionByName(rest).select("doc_id", "fp", "component", "component_id")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``fingerprint`` (16 hex digits), ``component_id``.

    Texts are lower-cased (A-Z) and cut into words at ASCII white space; a fingerprint bit is set if it is
    set in over half of the XXH64 values of the 3-word shingles, repeats included. Fewer words form one shingle,
    and no words (empty or null text) give fingerprint zero, which links like any other. Documents link
    at 3 or fewer differing bits; ``component_id`` is the smallest id reachable. Rows with equal ids are
    separate rows; null ids take part and are never the smallest (all-null components have a null id).
    Other columns are not looked at. An empty table gives no rows.
    """
    fingerprint = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return _grouped(docs, doc_id, text).select("doc_id", fingerprint, "component_id")


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component of ``docs``: that of its smallest id, and of rows that repeat the id the one of the smallest digest.

    Columns are those of ``docs``. Rows that repeat an id are decided on one by one: different texts under one id
    stay, each for its component. Rows without an id stay: nothing tells which of them a decision is about.
    """
    found = materialize(_grouped(docs, doc_id, text), "simhash-groups")
    leaving = found.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone"))
    repeated = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_id"))
    repeated = materialize(repeated, "simhash-repeats")
    own = F.col(doc_id).cast("long")
    if repeated.isEmpty():
        return docs.join(leaving.distinct().hint("shuffle_hash"), own == F.col("_gone"), "left_anti")
    gone = leaving.unionByName(repeated.select(F.col("_id").alias("_gone"))).distinct().hint("shuffle_hash")
    kept = docs.join(gone, own == F.col("_gone"), "left_anti")
    firsts = found.where("doc_id = component_id").join(repeated, F.col("doc_id") == F.col("_id"), "left_semi")
    firsts = firsts.select(F.col("doc_id").alias("_id"), F.col("fp").alias("_of"), F.col("component").alias("_component")).distinct()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            found = text_fingerprints(text_array(part.column(text))).view(np.int64)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found)], [*part.schema.names, "_fp"])

    several = docs.join(repeated, own == F.col("_id"), "left_semi")
    digest = F.struct(F.md5(F.coalesce(F.col(text), F.lit(""))), F.md5(F.to_json(F.struct(*docs.columns)))).alias("_digest")
    printed = several.mapInArrow(work, StructType([*several.schema, StructField("_fp", LongType())]))
    rows = printed.join(firsts, (own == F.col("_id")) & (F.col("_fp") == F.col("_of"))).select(*docs.columns, "_component", digest)
    rows = materialize(rows, "simhash-repeated")
    least = rows.groupBy("_component").agg(F.min("_digest").alias("_digest"))
    first = rows.join(least, ["_component", "_digest"]).dropDuplicates(["_component"])
    return kept.unionByName(first.select(*docs.columns))
