"""Topic labels of documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.ordering import ordered_positions
from corpusloom.session import materialize

ON_MISSING = ("error", "drop", "null")
BROADCAST_ROWS = 500_000  # so many labels with their keys are broadcast


def missing_or(value: Column, on_missing: str, what: Column, message: str) -> Column:
    if on_missing != "error":
        return value
    error = F.raise_error(F.concat(F.lit(message + ": "), what.cast("string")))
    return F.when(value.isNull(), error).otherwise(value)


def encode_first_seen(df: DataFrame, value: str, order_by: str, name: str = "topic_id") -> DataFrame:
    """Number the distinct values from 0 in the order they first appear."""
    seen = df.groupBy(value).agg(F.min(order_by).alias("_first"))
    return ordered_positions(seen, ["_first", value], name).drop("_first")


def resolve_label(df: DataFrame, doc: str, topic: str, order_by: str, policy: str = "last") -> DataFrame:
    """One topic per document: of its last line, or of its first."""
    pick = {"last": F.max_by, "first": F.min_by}.get(policy)
    if pick is None:
        raise ValueError("policy must be 'last' or 'first'")
    return df.groupBy(doc).agg(pick(topic, order_by).alias(topic))


def lookup_label(
    docs: DataFrame, labels: DataFrame, keys: Sequence[str] = ("doc_id",), label: str = "label", on_missing: str = "error"
) -> DataFrame:
    """Add each document's label; one without is an error, is dropped, or gets null.

    Labels that fit, by their number, are broadcast and the documents stay where they lie. A key labelled twice is an
    error rather than two rows.
    """
    if on_missing not in ON_MISSING:
        raise ValueError(f"on_missing must be one of {ON_MISSING}")
    twice = F.raise_error(F.concat(F.lit("more than one label for document: "), F.concat_ws(":", *keys)))
    one = F.when(F.count(F.lit(1)) > 1, twice.cast(labels.schema[label].dataType)).otherwise(F.first(label))
    side = materialize(labels.groupBy(*keys).agg(one.alias(label)), "labels")
    side = F.broadcast(side) if side.count() <= BROADCAST_ROWS else side
    joined = docs.join(side, list(keys), "inner" if on_missing == "drop" else "left")
    return joined.withColumn(label, missing_or(F.col(label), on_missing, F.concat_ws(":", *keys), "no label for document"))


def remap(df: DataFrame, mapping: DataFrame, old: str, new: str) -> DataFrame:
    """Replace ids by a mapping table ``(old, new)``; ids outside it are dropped.

    The mapping is written first, so the planner broadcasts it only if it is small.
    """
    return df.join(materialize(mapping.select(old, new), "mapping"), old)
