"""What several operators share: table access, text slices inside tasks, and components of a graph."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import materialize, new_path

SLICE_BYTES = 4 << 20  # text that a task works on at once, unless one document is longer


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """An unused path in the shared folder, with its scheme: Spark's default store need not be the one that ``pyarrow.fs`` takes a bare path for."""
    place = spark._jvm.org.apache.hadoop.fs.Path(new_path(spark, name))
    whole = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()
    return re.sub("^file:/+", "file:///", whole)


def bound_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let a batch that goes to Python hold ``rows`` rows at most, for the session: whole texts are heavy."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(setting)) <= rows:
        spark.conf.set(setting, str(rows))


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's text modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into slices of about ``limit`` text bytes; a longer document is a slice of its own."""
    for batch in batches:
        ends = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).cumsum()
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(ends.searchsorted(before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
    pa.default_memory_pool().release_unused()  # the worker may live on for tasks of another kind


def text_array(column: pa.Array) -> pa.Array:
    """Texts with 64-bit offsets, null as empty; copied, as some kernels mistake the offsets of a slice."""
    import numpy as np

    copied = column.take(pa.array(np.arange(len(column))))
    return pc.fill_null(copied.cast(pa.large_string()), "")


def ascii_words(texts: pa.Array) -> tuple[pa.Array, "object"]:
    """The lower-cased words of all texts in a row, and where each text's words start (one more entry than texts)."""
    import numpy as np

    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words = lists.flatten()
    real = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    before = np.concatenate(([0], np.cumsum(real)))
    return words.filter(pa.array(real)), before[offsets]


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """Component of every node that has an edge: ``node``, ``component`` (its smallest node).

    Alternates large-star and small-star steps on (larger, smaller) edges until nothing changes, which
    takes a number of rounds that grows with the logarithm of the longest path. Each round is a written
    table, so lineage stays short and lost executors cost one round. Minima are combined before the
    shuffle; a hub with many neighbours meets its one minimum in a join whose hot side can be split.
    Edges with a null end and self-loops are ignored; no edges give no rows.
    """
    now = materialize(
        edges.where(F.col(left) != F.col(right))
        .select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
        .distinct(),
        "edges",
    )
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        after = _state(new)
        if after == state:
            break
        now, state = new, after
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
