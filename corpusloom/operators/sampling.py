"""Exact seeded samples per category."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.ordering import Order, bucket_spans, hash_buckets
from corpusloom.session import materialize


def sample_per_category(
    df: DataFrame,
    category: str,
    limit: int,
    seed: int = 1234,
    keys: Sequence[str] = ("doc_id",),
    strict: bool = False,
) -> DataFrame:
    """Exactly ``limit`` rows of each category without replacement, all rows of a smaller one.

    ``strict`` makes a smaller category an error. Hash-bucket counts tell in which bucket a category
    reaches the limit; ranking that one bucket gives the last key the sample takes, and the documents
    are then filtered by it where they lie. A category that holds most of the corpus never gathers
    in one task. A null category is a category of its own.
    """
    order = Order(tuple(keys), seed, "samp")
    same = F.col(category).eqNullSafe(F.col("_of"))
    of = lambda frame: frame.withColumnsRenamed({category: "_of", "_bucket": "_in"})
    # Read and hashed once, then kept as narrow rows: the input may be costly to read, and each of the two steps below reads them.
    hashed = materialize(hash_buckets(df, order, [category]), "sample_keys")
    last = (F.col("_start") < limit) & (F.col("_start") + F.col("_n") >= limit)
    reached = materialize(
        bucket_spans(hashed, [category])
        .groupBy(category)
        .agg(
            F.max("_total").alias("_total"),
            F.max(F.when(last, F.struct("_bucket", (limit - F.col("_start")).alias("_need")))).alias("_reach"),
        )
        .select(category, "_total", "_reach.*"),
        "sample_buckets",
    )
    last_keys = (
        hashed.join(of(reached.where("_bucket IS NOT NULL")), same & (F.col("_bucket") == F.col("_in"))).drop("_of", "_in", "_total")
        .withColumn("_row", F.row_number().over(Window.partitionBy(category).orderBy("_hash", *keys)))
        .where("_row = _need")
        .select(category, F.struct("_hash", *keys).alias("_cut"))
    )
    cuts = materialize(reached.select(category, "_total").join(of(last_keys), same, "left").drop("_of"), "sample_cuts")
    taken = F.col("_cut").isNull() | (order.row_key() <= F.col("_cut"))
    if strict:
        short = F.raise_error(F.concat(F.lit("too few rows in category "), F.coalesce(F.col(category).cast("string"), F.lit("null"))))
        taken = F.when(F.col("_total") < limit, short.cast("boolean")).otherwise(taken)
    return df.join(of(cuts), same).where(taken).select(df.columns)
