"""Row order without a global sort: shuffle keys, dense positions, and keys found at given positions.

A seeded order sorts by the md5 of the row's key, so the leading hex digits cut the rows into even
buckets whose counts give every bucket its first position. Only the buckets that hold a wanted
position are ever ranked. An unseeded order (by the key itself) range-partitions the narrow key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import materialize

BUCKET_DIGITS = 4  # 65,536 buckets: the bucket tables stay that small whatever the corpus holds
_ROW_BITS = (1 << 33) - 1  # low bits of monotonically_increasing_id: the row within its partition

Ends = Callable[[Column], Sequence[Column]]


@dataclass(frozen=True)
class Order:
    """A total order of rows: by ``keys``, or by a seeded hash of them when ``seed`` is given."""

    keys: tuple[str, ...] = ("doc_id",)
    seed: int | None = None
    tag: str = "shuf"

    def hash(self) -> Column:
        joined = F.concat_ws(":", *[F.col(k).cast("string") for k in self.keys])
        return F.md5(F.concat(joined, F.lit(f":{self.tag}:{self.seed}")))

    def row_key(self) -> Column:
        """What rows are compared by."""
        if self.seed is None:
            return F.struct(*self.keys)
        return F.struct(self.hash().alias("_hash"), *self.keys)

    def columns(self) -> list[Column]:
        """What rows are sorted by on write."""
        return [F.col(k) for k in self.keys] if self.seed is None else [self.hash(), *map(F.col, self.keys)]


def shuffle_key(df: DataFrame, keys: Sequence[str] = ("doc_id",), seed: int = 1234, name: str = "shuffle_key") -> DataFrame:
    """Add the key that sorts rows in a seeded random order; equal seeds give equal orders."""
    return df.withColumn(name, Order(tuple(keys), seed).hash())


def ordered_positions(df: DataFrame, order: Sequence[Column | str], position: str = "position") -> DataFrame:
    """Add the 0-based position of each row in ``order``, which must leave no ties.

    Range-partitions and sorts the rows, then writes them once with their place in their partition:
    the partition bounds come from a sample, so a second evaluation could differ.
    """
    columns = df.columns
    placed = materialize(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_row", F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS))),
        "placed",
    )
    # One count per shuffle partition comes back; their running sums become one constant array.
    counts = dict(placed.groupBy("_part").agg(F.count(F.lit(1))).collect())
    sizes = [counts.get(part, 0) for part in range(max(counts, default=0) + 1)]
    starts = F.split(F.lit(",".join(map(str, accumulate(sizes, initial=0)))), ",").cast("array<bigint>")
    return placed.select(*columns, (starts[F.col("_part")] + F.col("_row")).alias(position))


def hash_buckets(df: DataFrame, order: Order, group: Sequence[str] = ()) -> DataFrame:
    """The narrow pass: keys, their hash and its bucket, without the documents' text."""
    return df.select(*dict.fromkeys([*group, *order.keys]), order.hash().alias("_hash")).withColumn(
        "_bucket", F.substring("_hash", 1, BUCKET_DIGITS)
    )


def bucket_spans(hashed: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """First position and size of every bucket, and the number of rows in all of its group."""
    counts = hashed.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*group)
    return counts.select(
        *group,
        "_bucket",
        "_n",
        (F.sum("_n").over(whole.orderBy("_bucket")) - F.col("_n")).alias("_start"),
        F.sum("_n").over(whole).alias("_total"),
    )


def with_position(
    df: DataFrame, keys: Sequence[str] = ("doc_id",), seed: int | None = None, position: str = "position"
) -> DataFrame:
    """Add each row's 0-based position: in a seeded random order, or by the keys when ``seed`` is None.

    Every row gets a position of its own: null keys come first in their order, and rows that repeat a key follow each other.
    """
    order = Order(tuple(keys), seed)
    if seed is None:
        return ordered_positions(df, [F.col(k) for k in order.keys], position)
    spans = bucket_spans(hash_buckets(df, order)).select("_bucket", "_start")
    in_bucket = Window.partitionBy("_bucket").orderBy("_hash", *order.keys)
    return (
        df.withColumn("_hash", order.hash())
        .withColumn("_bucket", F.substring("_hash", 1, BUCKET_DIGITS))
        .join(F.broadcast(spans), "_bucket")
        .withColumn(position, F.col("_start") + F.row_number().over(in_bucket) - 1)
        .drop("_hash", "_bucket", "_start")
    )


def keys_at(df: DataFrame, order: Order, ends: Ends) -> dict[int, Column]:
    """Row key at position ``ends(row count)[i]``, by i; no entry past the last row.

    Runs at once and brings back one key per requested position, so that whatever follows compares
    rows with constants instead of finding the keys again.
    """
    if order.seed is None:
        places = ordered_positions(df.select(*order.keys), [F.col(k) for k in order.keys], "_at")
        total = places.agg(F.count(F.lit(1)).alias("_total"))
        wanted = total.select(F.posexplode(F.array(*ends(F.col("_total")))).alias("_cut", "_at"))
        found = places.join(F.broadcast(wanted), "_at")
    else:
        hashed = hash_buckets(df, order)
        wanted = (
            bucket_spans(hashed)
            .select("*", F.posexplode(F.array(*ends(F.col("_total")))).alias("_cut", "_at"))
            .where((F.col("_at") >= F.col("_start")) & (F.col("_at") < F.col("_start") + F.col("_n")))
            .select("_bucket", "_cut", (F.col("_at") - F.col("_start")).alias("_rank"))
        )
        in_bucket = Window.partitionBy("_cut").orderBy("_hash", *order.keys)
        found = (
            hashed.join(F.broadcast(wanted), "_bucket")
            .withColumn("_row", F.row_number().over(in_bucket) - 1)
            .where("_row = _rank")
        )
    columns = [c for c in ("_hash", *order.keys) if c in found.columns]
    types = {f.name: f.dataType for f in found.schema}
    return {
        row["_cut"]: F.struct(*[F.lit(row[c]).cast(types[c]).alias(c) for c in columns])
        for row in found.select("_cut", *columns).collect()
    }
