"""Category names cut from taxon paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Category names that stand for another.
ALIASES = {"opinion_opinion": "opinion"}


def cut_taxon(path: Column | str, depth: int = 3) -> Column:
    """Category of a path such as ``top/a/b``: its levels below the first, joined up to ``depth``.

    A path shorter than ``depth`` gives its second level alone.
    """
    if depth < 1:
        raise ValueError("depth must be at least 1")
    levels = F.split(path, "/")
    no_level = F.raise_error(F.concat(F.lit("taxon path without a level: "), path)).cast("string")
    category = F.element_at(levels, 2)
    if depth > 1:
        joined = F.array_join(F.slice(levels, 2, depth - 1), "_")
        category = F.when(F.size(levels) >= depth, joined).otherwise(category)
    return F.when(F.size(levels) < 2, no_level).otherwise(category)


def apply_aliases(category: Column, aliases: dict[str, str] | None = None) -> Column:
    for name, target in (ALIASES if aliases is None else aliases).items():
        category = F.when(category == name, target).otherwise(category)
    return category
