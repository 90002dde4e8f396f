"""Category taxonomies: cut, merge and remove categories, and roll topics up a tree."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.taxons import apply_aliases, cut_taxon
from corpusloom.operators.labels import encode_first_seen, missing_or
from corpusloom.operators.ordering import ordered_positions
from corpusloom.session import materialize

# Categories too general to label by, and how many of the rarest go with them.
GENERAL_CATEGORIES = (
    "news",
    "news_front page",
    "classifieds_job market",
    "news_business",
    "news_education",
    "news_world",
)
RAREST = 13

# Categories that merge into one.
MERGED_CATEGORIES = {
    "news_science": "news_science_technology",
    "news_technology": "news_science_technology",
    "news_u.s.": "news_u.s.",
    "news_washington": "news_u.s.",
    "news_new york and region": "news_u.s.",
    "features_arts": "features_arts_travel",
    "features_travel": "features_arts_travel",
}


def taxon_categories(taxons: DataFrame, depth: int = 3, aliases: Mapping[str, str] | None = None) -> DataFrame:
    """``(taxon_id, category, category_id)``: each taxon's category, numbered in taxon order."""
    cut = taxons.select("taxon_id", apply_aliases(cut_taxon("path", depth), aliases).alias("category"))
    ids = encode_first_seen(cut, "category", "taxon_id", "category_id")
    return materialize(cut.join(ids, "category").select("taxon_id", "category", "category_id"), "taxon_categories")


def roll_up(doc_taxon: DataFrame, mapping: DataFrame, old: str, new: str) -> DataFrame:
    """Sum document counts over the ids that map to the same new id; unmapped ids are dropped."""
    mapped = doc_taxon.join(mapping.where(F.col(new).isNotNull()).select(old, new), old)
    return mapped.groupBy("doc_id", new).agg(F.sum("n").cast("bigint").alias("n"))


def binarise(counts: DataFrame) -> DataFrame:
    """Entries that are not zero become one; zeros go."""
    return counts.where(F.col("n") != 0).withColumn("n", F.lit(1).cast("bigint"))


def docs_per_category(doc_category: DataFrame, categories: DataFrame, category: str = "category_id") -> DataFrame:
    """Number of documents of each category, 0 for one without any."""
    counts = doc_category.groupBy(category).agg(F.count(F.lit(1)).alias("_n"))
    return categories.join(counts, category, "left").select(
        *categories.columns, F.coalesce("_n", F.lit(0)).alias("n_docs")
    )


def labels_per_doc(docs: DataFrame, doc_category: DataFrame, category: str = "category_id") -> DataFrame:
    """Number of categories of each document, 0 for one without any, and the category if it is one."""
    counts = doc_category.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"), F.max(category).alias("_only"))
    joined = docs.join(counts, "doc_id", "left")
    return joined.select(
        *docs.columns,
        F.coalesce("_n", F.lit(0)).alias("n_labels"),
        F.when(F.col("_n") == 1, F.col("_only")).alias("label"),
    )


def partition_single_label(docs: DataFrame, doc_category: DataFrame, category: str = "category_id") -> DataFrame:
    """Mark documents of exactly one category ``sup`` with it as label, all others ``unsup``."""
    counted = labels_per_doc(docs, doc_category, category)
    return counted.withColumn("split", F.when(F.col("n_labels") == 1, "sup").otherwise("unsup")).drop("n_labels")


def rarest_categories(counts: DataFrame, k: int = RAREST, category: str = "category") -> DataFrame:
    return counts.orderBy("n_docs", category).limit(k)


def removal_list(
    counts: DataFrame, k: int = RAREST, named: Sequence[str] = GENERAL_CATEGORIES, category: str = "category"
) -> DataFrame:
    """Categories to remove: the rarest and the named ones."""
    fixed = counts.sparkSession.createDataFrame([(n,) for n in named], f"{category} string")
    return rarest_categories(counts, k, category).select(category).union(fixed).distinct()


def merge_categories(
    categories: DataFrame, remove: DataFrame, merged: Mapping[str, str] | None = None
) -> DataFrame:
    """``(category_id, category, new_category, new_id)`` for the categories that stay.

    New ids follow the old ids' order, without the removed categories.
    """
    name = F.col("category")
    for old, new in (MERGED_CATEGORIES if merged is None else merged).items():
        name = F.when(F.col("category") == old, new).otherwise(name)
    kept = categories.join(remove.select("category"), "category", "left_anti").withColumn("new_category", name)
    ids = encode_first_seen(kept, "new_category", "category_id", "new_id")
    return materialize(
        kept.join(ids, "new_category").select("category_id", "category", "new_category", "new_id"), "merged_categories"
    )


def top_topics(hierarchy: DataFrame, root: str = "Root") -> DataFrame:
    """``(topic_id, topic, description)`` of the root's children, numbered by name."""
    top = hierarchy.where(F.col("parent") == root).select(F.col("child").alias("topic"), "description")
    return ordered_positions(top, ["topic"], "topic_id").select("topic_id", "topic", "description")


def _climb(hierarchy: DataFrame, root: str) -> DataFrame:
    """Where each node's parents lead: ``node``, ``up``, ``end``.

    ``end`` is "root" (``up`` is the ancestor directly under it), "missing" (``up`` is the ancestor that has no parent) or null
    (the parents go in a circle, and ``up`` lies on it). Pointers to ancestors double their reach in every round, each round a written table.
    """
    # One parent per child and none for the root.
    edges = materialize(
        hierarchy.where(F.col("child") != root).groupBy("child").agg(F.max("parent").alias("parent")), "edges"
    )
    known = edges.select(F.col("child").alias("parent"), F.lit(True).alias("known"))
    top = F.col("parent") == root
    end = F.when(top, "root").when(F.col("known").isNull(), "missing")
    up = edges.join(known, "parent", "left").select(
        F.col("child").alias("node"), F.when(top, F.col("child")).otherwise(F.col("parent")).alias("up"), end.alias("end")
    )
    # Circles never end: no path is longer than there are nodes.
    for _ in range(max(edges.count() - 1, 0).bit_length()):
        if up.where("end is null").isEmpty():
            break
        hop = up.select(F.col("node").alias("up"), F.col("up").alias("further"), F.col("end").alias("then_end"))
        moved = up.where("end is null").join(hop, "up").select("node", F.col("further").alias("up"), F.col("then_end").alias("end"))
        up = materialize(up.where("end is not null").unionByName(moved), "ancestors")
    return up


def rollup_tree(
    topics: DataFrame, hierarchy: DataFrame, topic: str = "topic", root: str = "Root", on_missing: str = "error"
) -> DataFrame:
    """Add each topic's ancestor directly under the root as ``top_topic``.

    A tree of any depth takes a number of rounds that is the logarithm of its depth. A topic outside the tree, or the root
    itself, is an error, is dropped, or gets null; so is one whose parents go in a circle. The error names a topic of the
    circle, or the ancestor without a parent.
    """
    reached = _climb(hierarchy, root).withColumnsRenamed({"node": topic, "up": "_up", "end": "_end"})
    reached = reached.select(topic, "_up", F.coalesce("_end", F.lit("circle")).alias("_end"))
    if on_missing == "drop":
        return topics.join(reached.where("_end = 'root'"), topic).withColumnRenamed("_up", "top_topic").drop("_end")
    why = F.when(F.col("_end") == "circle", F.concat(F.lit(", its parents go in a circle through "), "_up"))
    why = why.when(F.col("_end") == "missing", F.concat(F.lit(", no parent of "), F.coalesce("_up", F.lit("it"))))
    what = F.concat(F.col(topic).cast("string"), F.coalesce(why, F.lit("")))
    found = missing_or(F.when(F.col("_end") == "root", F.col("_up")), on_missing, what, "no topic under the root above")
    return topics.join(reached, topic, "left").withColumn("top_topic", found).drop("_up", "_end")


def tree_faults(hierarchy: DataFrame, root: str = "Root") -> DataFrame:
    """Nodes of a hierarchy that do not lead to the root: ``node``, ``fault``, ``through``.

    The fault is "on a circle", "below a circle" (``through`` is the node of the circle that the parents' path comes to after as many steps as the
    doubled pointers reach) or "no root" (``through`` is the ancestor that has no parent). A node with several parents has the last by name.
    """
    ends = materialize(_climb(hierarchy, root).where("end is null or end = 'missing'"), "faults")
    circling = ends.where("end is null")
    # A pointer that reaches further than the longest path lies on a circle, and every node of a circle has such a pointer to it.
    circles = circling.select(F.col("up").alias("node"), F.lit("on a circle").alias("_on")).distinct()
    on = circling.join(circles, "node", "left").select("node", F.coalesce("_on", F.lit("below a circle")).alias("fault"), F.col("up").alias("through"))
    return on.unionByName(ends.where("end = 'missing'").select("node", F.lit("no root").alias("fault"), F.col("up").alias("through")))
