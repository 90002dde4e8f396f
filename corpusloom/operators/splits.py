"""Exact splits by position. The documents themselves are never shuffled: one narrow pass finds the
row key at each split boundary, and every row compares its own key with those few keys."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.ordering import Ends, Order, keys_at

NESTED_NAMES = ("train_sup", "valid", "unsup", "test")


def part_ends(total: Column, ratio: Sequence[int]) -> list[Column]:
    """End position of every part but the last, which takes the rest.

    Parts are cut in units of the total over the ratio's sum, rounded up, so the head is
    over-filled and the tail may be short or empty.
    """
    parts = sum(ratio)
    unit = F.ceil(total / parts)
    return [F.least(total, unit * end).cast("bigint") for end in list(accumulate(ratio))[:-1]]


def nested_ends(
    total: Column, train_test: Sequence[int], sup_unsup: Sequence[int], sup_valid: Sequence[int]
) -> list[Column]:
    """Ends of the supervised, validation and unsupervised parts when the head is cut three times."""
    (train,) = part_ends(total, train_test)
    (sup,) = part_ends(train, sup_unsup)
    (fit,) = part_ends(sup, sup_valid)
    return [fit, sup, train]


def split_at(
    df: DataFrame,
    order: Order,
    ends: Ends,
    names: Sequence[str],
    column: str = "split",
    within: str | None = None,
) -> DataFrame:
    """Name each row's part, given the end position of every part but the last.

    With ``within``, only the rows that ``column`` already marks so are counted and cut.
    """
    marked = F.col(column).eqNullSafe(F.lit(within)) if within is not None else F.lit(True)
    cuts = keys_at(df.where(marked), order, ends)
    part: Column = F.lit(names[-1])
    for i in reversed(range(len(names) - 1)):
        # Without a row at its end, a part takes all the rows that are left.
        part = F.when(order.row_key() < cuts[i], F.lit(names[i])).otherwise(part) if i in cuts else F.lit(names[i])
    if within is not None:
        part = F.when(marked, part).otherwise(F.col(column))
    return df.withColumn(column, part)


def split_ratio(
    df: DataFrame,
    ratio: Sequence[int] = (8, 2),
    names: Sequence[str] = ("train", "test"),
    order: Order = Order(),
    column: str = "split",
    within: str | None = None,
) -> DataFrame:
    """Parts in the given ratio; with ``within``, of the rows already marked so."""
    if len(ratio) != len(names):
        raise ValueError("need one name per part of the ratio")
    return split_at(df, order, lambda total: part_ends(total, ratio), names, column, within)


def split_nested(
    df: DataFrame,
    train_test: Sequence[int] = (8, 2),
    sup_unsup: Sequence[int] = (1, 10),
    sup_valid: Sequence[int] = (8, 2),
    order: Order = Order(),
    column: str = "split",
) -> DataFrame:
    """Train/test, then supervised/unsupervised within train, then supervised/validation."""
    return split_at(df, order, lambda total: nested_ends(total, train_test, sup_unsup, sup_valid), NESTED_NAMES, column)


def split_fraction(
    df: DataFrame,
    ratio: tuple[int, int] = (1, 1),
    names: tuple[str, str] = ("train", "test"),
    order: Order = Order(),
    column: str = "split",
) -> DataFrame:
    """First part gets its share of the rows rounded up, the second the rest."""
    head, tail = ratio
    return split_at(df, order, lambda total: [F.ceil(total * head / (head + tail)).cast("bigint")], names, column)


def split_given(
    df: DataFrame,
    ratio: Sequence[int] = (8, 2),
    within: str = "train",
    names: Sequence[str] = ("train_sup", "valid"),
    order: Order = Order(),
    column: str = "split",
) -> DataFrame:
    """Cut only the rows already marked ``within``; the other marks stay."""
    return split_ratio(df, ratio, names, order, column, within)
