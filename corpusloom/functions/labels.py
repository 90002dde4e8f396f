"""Label and output-line expressions."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

UNSUP_LABEL = "0"


def check_known(categories: Sequence[str], known: Iterable[str], where: str = "the known categories") -> None:
    """Raise if a category is not known."""
    known = set(known)
    if unknown := [c for c in categories if c not in known]:
        raise ValueError(f"not in {where}: {', '.join(unknown)}")


def category_label(category: Column | str, ordered: Sequence[str]) -> Column:
    """0-based rank of a category in a fixed order; null for a category outside it."""
    rank = F.array_position(F.array(*[F.lit(name) for name in ordered]), F.col(category) if isinstance(category, str) else category)
    return F.when(rank > 0, rank - 1).cast("int")


def fold_number(cv: Column | str) -> Column:
    """Cross-validation fold of a file's cv number."""
    return F.floor((F.col(cv) if isinstance(cv, str) else cv) / 100).cast("int")


def svmlight_label(label: Column | str, binary: bool | Column = False) -> Column:
    """Binary 0/1 as -1/+1, other labels counted from one, null (unsupervised) as 0."""
    label = F.col(label) if isinstance(label, str) else label
    flag = F.lit(binary) if isinstance(binary, bool) else binary
    two_way = F.when(label == 0, "-1").otherwise("+1")
    return F.when(label.isNull(), UNSUP_LABEL).when(flag, two_way).otherwise((label + 1).cast("string"))


def svmlight_line(label: Column | str, features: Column | str = "features", binary: bool | Column = False, index_base: int = 1) -> Column:
    """``label id:count ...``; a document without features is its label alone."""
    entries = F.transform(
        features,
        lambda e: F.concat_ws(":", (e["word_id"] + index_base).cast("string"), e["tf"].cast("bigint").cast("string")),
    )
    return F.concat_ws(" ", svmlight_label(label, binary), entries)


def text_line(doc_id: Column | str, text: Column | str = "text") -> Column:
    return F.concat(F.lit("_*"), F.col(doc_id) if isinstance(doc_id, str) else doc_id, F.lit(" "), text)


def topic_line(topic_id: str = "topic_id", topic: str = "topic", description: str = "description") -> Column:
    return F.concat_ws("\t", F.col(topic_id).cast("string"), topic, description)
