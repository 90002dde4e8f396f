"""Embedding near-duplicates by p-stable hashing: quantised random projections in several tables, then exact cosines.

Unit vectors with cosine c lie sqrt(2 - 2c) apart. A table's key joins K projections on Gaussian directions, each
shifted and cut into cells of a width; K keeps the share of unrelated vectors in a bucket small whatever the
number of vectors, and the number of tables then follows from the recall wanted right at the threshold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import connected_components
from corpusloom.session import materialize

COSINE = 0.9
WIDTH = 2.0
BUCKET = 100  # unrelated vectors that a bucket may hold
RECALL = 0.999  # of pairs right at the threshold; closer pairs are found more surely
CELL = 4096  # vectors compared in one task; larger buckets are cut into blocks, and blocks meet in pairs
SEED = 11


def collision(distance: float, width: float = WIDTH) -> float:
    """Probability that one projection puts two vectors at this distance into one cell."""
    if distance == 0:
        return 1.0
    r = width / distance
    normal = 0.5 * (1 + math.erf(-r / math.sqrt(2)))
    return 1 - 2 * normal - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def parameters(n: int, cosine: float = COSINE) -> tuple[int, int]:
    """Projections per table and tables for ``n`` vectors."""
    near, far = collision(math.sqrt(2 - 2 * cosine)), collision(math.sqrt(2))
    k = max(1, math.ceil(math.log(max(n / BUCKET, 1.0)) / -math.log(far)))
    return k, max(1, math.ceil(math.log(1 - RECALL) / math.log(1 - near**k)))


def table_keys(unit: np.ndarray, k: int, tables: int) -> np.ndarray:
    """64-bit bucket keys, a row per vector and a column per table; other dimensions have other keys."""
    rng = np.random.default_rng([SEED, unit.shape[1]])
    directions, shift = rng.standard_normal((unit.shape[1], tables * k)), rng.uniform(0, WIDTH, tables * k)
    factors, salt = rng.integers(1, 1 << 62, (tables, k)) * 2 + 1, rng.integers(0, 1 << 62, tables)
    cells = np.floor((unit @ directions + shift) / WIDTH).astype(np.int64).reshape(len(unit), tables, k)
    keys = ((cells * factors).sum(axis=2) + salt).view(np.uint64)
    keys ^= keys >> np.uint64(31)
    return (keys * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def unit_vectors(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _links(cid: np.ndarray, n: np.ndarray, salt: np.ndarray, unit: np.ndarray, table: int, cross: bool, k: int, tables: int):
    """New links of one cell: per vector how many rows it links to, and edges that span what is linked.

    A pair counts in the first table where it meets.
    """
    total = np.zeros(len(cid), dtype=np.int64)
    label = np.arange(len(cid))
    edges = []
    codes: dict[int, np.ndarray] = {}


    for begin in range(0, len(cid), 512):
        near = unit[begin : begin + 512] @ unit.T >= COSINE
        rows, others = np.nonzero(near)
        rows = rows + begin
        once = rows < others
        if cross:
            once &= salt[rows] != salt[others]
        rows, others = rows[once], others[once]
        if table and len(rows):
            members = np.unique(np.concatenate((rows, others)))
            missing = [i for i in members if i not in codes]
            if missing:
                codes.update(zip(missing, table_keys(unit[missing], k, tables)[:, :table], strict=True))
            new = np.concatenate([
                ~(np.array([codes[i] for i in a]) == np.array([codes[j] for j in b])).any(axis=1)
                for a, b in ((rows[s : s + 20_000], others[s : s + 20_000]) for s in range(0, len(rows), 20_000))
            ])
            rows, others = rows[new], others[new]
        np.add.at(total, rows, n[others])
        np.add.at(total, others, n[rows])
        while len(rows):
            a, b = label[rows], label[others]
            apart = a != b
            rows, others, a, b = rows[apart], others[apart], a[apart], b[apart]
            if not len(rows):
                break
            # One edge per label and round: the larger label moves to the smallest it meets.
            low, high = np.minimum(a, b), np.maximum(a, b)
            order = np.lexsort((low, high))
            first = order[np.concatenate(([True], high[order][1:] != high[order][:-1]))]
            edges += [(cid[rows[i]], cid[others[i]]) for i in first]
            move = np.arange(len(label))
            move[high[first]] = low[first]
            while not np.array_equal(move, move[move]):
                move = move[move]
            label = move[label]
    return total, edges


def _valid(vector: Column) -> Column:
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(good, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def near_duplicates(embeddings: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per row: ``vec_id``, ``n_links``, ``component_id``, ``kept``.

    Rows link at a cosine of at least 0.9, computed in double precision; null, empty and zero vectors and those
    with a null or non-finite component link with nothing, nor do vectors of different lengths. Equal
    vectors are compared once and counted as often as they occur. ``component_id`` is the smallest id
    reachable, the own one included; ``kept`` says that it is the own one (false for null ids). Rows that repeat
    an id are rows of their own.
    """
    rows = embeddings.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    same = rows.where(_valid(F.col("v"))).groupBy("v").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    classes = materialize(same.withColumn("cid", F.monotonically_increasing_id()), "vectors")
    k, tables = parameters(classes.count())

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            sizes = np.diff(lists.offsets.to_numpy())
            for d in np.unique(sizes):
                part = batch.filter(pa.array(sizes == d))
                flat = part.column("v").flatten().to_numpy(zero_copy_only=False)
                keys = table_keys(unit_vectors(flat.reshape(-1, d)), k, tables)
                offsets = pa.array(np.arange(len(keys) + 1, dtype=np.int32) * tables)
                keyed = pa.ListArray.from_arrays(offsets, pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("cid"), part.column("n"), part.column("v"), keyed], ["cid", "n", "v", "keys"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, current = [], None

        def out(cell, current):
            merged = pa.Table.from_batches(cell)
            d = len(merged.column("v")[0])
            flat = merged.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            cid, n, salt = (merged.column(c).to_numpy() for c in ("cid", "n", "salt"))
            cross = current[2] != current[3]
            total, edges = _links(cid, n, salt, unit_vectors(flat.reshape(-1, d)), current[0], cross, k, tables)
            has = np.flatnonzero(total)
            node = np.concatenate((cid[has], [a for a, _ in edges])).astype(np.int64)
            other = pa.array([None] * len(has) + [int(b) for _, b in edges], pa.int64())
            links = np.concatenate((total[has], np.zeros(len(edges), np.int64)))
            return pa.RecordBatch.from_arrays([pa.array(node), other, pa.array(links)], ["node", "other", "links"])

        for batch in batches:
            ids = np.stack([batch.column(c).to_numpy() for c in ("t", "key", "a", "b")], axis=1)
            cuts = np.concatenate(([0], np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1, [len(ids)]))
            for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
                if begin == end:
                    continue
                where = tuple(ids[begin].tolist())
                if where != current:
                    if sum(map(len, cell)) > 1:
                        yield out(cell, current)
                    cell, current = [], where
                cell.append(batch.slice(begin, end - begin))
        if sum(map(len, cell)) > 1:
            yield out(cell, current)

    keyed = materialize(classes.select("cid", "n", "v").mapInArrow(hashed, "cid long, n long, v array<double>, keys array<long>"), "vector-keys")
    at = keyed.select("cid", "n", "v", F.posexplode("keys").alias("t", "key"))
    large = at.groupBy("t", "key").count().where(F.col("count") > CELL)
    large = materialize(large.select("t", "key", F.ceil(F.col("count") / CELL).cast("int").alias("blocks")), "large-buckets")
    salted = at.join(large, ["t", "key"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    salted = salted.withColumn("salt", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    met = salted.withColumn("p", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = met.select("t", "key", F.least("salt", "p").alias("a"), F.greatest("salt", "p").alias("b"), "salt", "cid", "n", "v")
    order = ["t", "key", "a", "b"]
    found = cells.repartition(*order).sortWithinPartitions(*order).mapInArrow(compared, "node long, other long, links long")
    found = materialize(found, "vector-links")
    component = connected_components(found.where("other is not null"), "node", "other").withColumnRenamed("node", "cid")
    first = component.join(classes.select("cid", "first_id"), "cid").groupBy("component").agg(F.min("first_id").alias("least_id"))
    least = component.join(first, "component").select("cid", "least_id")
    links = found.where("links > 0").groupBy(F.col("node").alias("cid")).agg(F.sum("links").alias("links"))
    result = materialize(
        classes.join(links, "cid", "left")
        .join(least, "cid", "left")
        .select(
            F.col("v").alias("_v"),
            (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.coalesce("least_id", "first_id").alias("least_id"),
        ),
        "vector-classes",
    )
    component_id = F.coalesce("least_id", "vec_id")
    return rows.join(result, F.col("v") == F.col("_v"), "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        component_id.alias("component_id"),
        F.coalesce(F.col("vec_id") == component_id, F.lit(False)).alias("kept"),
    )


SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm
  FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    AND len([x FOR x IN embedding IF x <> 0]) > 0
), p AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= {COSINE}
), r AS (
  SELECT vec_id, vec_id AS c FROM embeddings
  UNION
  SELECT p.b AS vec_id, r.c FROM r JOIN p ON p.a = r.vec_id
), m AS (SELECT vec_id, min(c) AS component_id FROM r GROUP BY vec_id),
l AS (SELECT a AS vec_id, count(*) AS n FROM p GROUP BY a)
SELECT m.vec_id, coalesce(l.n, 0) AS n_links, m.component_id, m.vec_id = m.component_id AS kept
FROM m LEFT JOIN l ON l.vec_id = m.vec_id
"""
