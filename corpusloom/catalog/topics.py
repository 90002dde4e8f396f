"""Topic labels and the topic tree: customers under nations under regions, and event types of users."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.catalog.common import table
from corpusloom.functions.labels import topic_line
from corpusloom.operators import labels, taxonomy


def hierarchy(spark, sf):
    """``(child, parent, description)``: customer, nation, region, Root."""
    region = table(spark, sf, "region")
    nation = table(spark, sf, "nation")
    customer = table(spark, sf, "customer")
    nation_of = nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    region_of = region.select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    return (
        region.select(F.col("r_name").alias("child"), F.lit("Root").alias("parent"), F.lower("r_name").alias("description"))
        .unionByName(
            nation.join(region_of, "n_regionkey").select(
                F.col("n_name").alias("child"), F.col("r_name").alias("parent"), F.lower("n_name").alias("description")
            )
        )
        .unionByName(
            customer.join(nation_of, "c_nationkey").select(
                F.col("c_name").alias("child"), F.col("n_name").alias("parent"), F.col("c_mktsegment").alias("description")
            )
        )
    )


HIERARCHY = """
SELECT r_name AS child, 'Root' AS parent, lower(r_name) AS description FROM region
UNION ALL SELECT n_name, r_name, lower(n_name) FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT c_name, n_name, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey"""

ROLLUP = f"""
WITH RECURSIVE h AS ({HIERARCHY}),
walk(topic, top_topic) AS (
    SELECT child, child FROM h WHERE parent = 'Root'
    UNION ALL SELECT h.child, walk.top_topic FROM h JOIN walk ON h.parent = walk.topic)"""


def _topic_rollup(spark, sf):
    """Top-level topic of every order, whose topic is its customer."""
    docs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), "o_custkey")
    names = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("topic"))
    rolled = taxonomy.rollup_tree(names.select("topic"), hierarchy(spark, sf))
    return docs.join(names, "o_custkey").join(rolled, "topic").select("doc_id", "topic", "top_topic")


def _tree_topics(spark, sf):
    """Top-level topic of every node; the root has none."""
    tree = hierarchy(spark, sf)
    nodes = tree.select(F.col("child").alias("topic")).union(tree.select("parent")).distinct()
    return taxonomy.rollup_tree(nodes, tree, on_missing="null")


def _tree_faults(spark, sf):
    """Customers under other customers: 3 to 12 go in circles, a tenth hangs below them, 1 and 2 have no parent."""
    number = F.col("c_custkey")
    parent = F.when(number <= 2, F.lit("nobody")).when(number <= 12, F.when(number % 5 == 2, number - 4).otherwise(number + 1).cast("string"))
    parent = parent.when(number % 10 == 0, F.lit("7")).when(number % 10 == 1, (number - 1).cast("string")).when(number % 10 == 2, F.lit("1")).otherwise("Root")
    customers = table(spark, sf, "customer").select(number.cast("string").alias("child"), parent.alias("parent"))
    return taxonomy.tree_faults(customers).select("node", "fault")


_FAULTS = """
WITH RECURSIVE h AS (
    SELECT CAST(c_custkey AS VARCHAR) AS child,
           CASE WHEN c_custkey <= 2 THEN 'nobody'
                WHEN c_custkey <= 12 THEN CAST(CASE c_custkey % 5 WHEN 2 THEN c_custkey - 4 ELSE c_custkey + 1 END AS VARCHAR)
                WHEN c_custkey % 10 = 0 THEN '7' WHEN c_custkey % 10 = 1 THEN CAST(c_custkey - 1 AS VARCHAR)
                WHEN c_custkey % 10 = 2 THEN '1' ELSE 'Root' END AS parent
    FROM customer),
walk(node, up) AS (
    SELECT child, parent FROM h
    UNION SELECT walk.node, h.parent FROM walk JOIN h ON h.child = walk.up),
ends AS (SELECT node, bool_or(up = 'Root') AS rooted, bool_or(up = 'nobody') AS lost, bool_or(up = node) AS circling FROM walk GROUP BY node)
SELECT node, CASE WHEN circling THEN 'on a circle' WHEN lost THEN 'no root' ELSE 'below a circle' END AS fault
FROM ends WHERE NOT rooted"""


def _topic_remap(spark, sf):
    docs = table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_nationkey").alias("topic_id"))
    mapping = table(spark, sf, "nation").select(F.col("n_nationkey").alias("topic_id"), F.col("n_regionkey").alias("top_id"))
    mapped = labels.remap(docs, mapping, "topic_id", "top_id")
    return mapped.select("doc_id", F.col("topic_id").cast("bigint"), F.col("top_id").cast("bigint"))


def _label_lookup(spark, sf):
    quality = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("bigint").alias("label"))
    docs = table(spark, sf, "documents").select("doc_id")
    return labels.lookup_label(docs, quality, on_missing="null")


def _events(spark, sf):
    return table(spark, sf, "events").select(
        F.col("event_type").alias("topic"), F.col("user_id").cast("bigint").alias("doc_id"), F.col("event_id").alias("line_no")
    )


def _topics(spark, sf):
    return taxonomy.top_topics(hierarchy(spark, sf))


_TOP = """SELECT row_number() OVER (ORDER BY r_name) - 1 AS topic_id, r_name AS topic, lower(r_name) AS description FROM region"""

QUERIES = {
    "label_lookup": (
        _label_lookup,
        "SELECT doc_id, CAST(quality AS BIGINT) AS label FROM documents LEFT JOIN labels USING (doc_id)",
    ),
    "label_lookup_drop": (
        lambda spark, sf: labels.lookup_label(
            table(spark, sf, "documents").select("doc_id"),
            table(spark, sf, "labels").select("doc_id", F.col("toxic").cast("bigint").alias("label")),
            on_missing="drop",
        ),
        "SELECT doc_id, CAST(toxic AS BIGINT) AS label FROM documents JOIN labels USING (doc_id)",
    ),
    "topic_remap": (
        _topic_remap,
        """SELECT c_custkey AS doc_id, CAST(c_nationkey AS BIGINT) AS topic_id, CAST(n_regionkey AS BIGINT) AS top_id
           FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    ),
    "first_seen_ids": (
        lambda spark, sf: labels.encode_first_seen(_events(spark, sf), "topic", "line_no"),
        """SELECT event_type AS topic, row_number() OVER (ORDER BY min(event_id)) - 1 AS topic_id
           FROM events GROUP BY event_type""",
    ),
    "last_wins_label": (
        lambda spark, sf: labels.resolve_label(_events(spark, sf), "doc_id", "topic", "line_no"),
        "SELECT CAST(user_id AS BIGINT) AS doc_id, arg_max(event_type, event_id) AS topic FROM events GROUP BY user_id",
    ),
    "first_wins_label": (
        lambda spark, sf: labels.resolve_label(_events(spark, sf), "doc_id", "topic", "line_no", "first"),
        "SELECT CAST(user_id AS BIGINT) AS doc_id, arg_min(event_type, event_id) AS topic FROM events GROUP BY user_id",
    ),
    "top_topics": (lambda spark, sf: _topics(spark, sf).select("topic_id", "topic"), f"SELECT topic_id, topic FROM ({_TOP})"),
    "topic_descriptions": (_topics, _TOP),
    "topic_export": (
        lambda spark, sf: _topics(spark, sf).select("topic_id", topic_line().alias("line")),
        f"SELECT topic_id, concat(topic_id, chr(9), topic, chr(9), description) AS line FROM ({_TOP})",
    ),
    "topic_rollup": (
        _topic_rollup,
        f"""{ROLLUP} SELECT o_orderkey AS doc_id, topic, top_topic
            FROM orders JOIN customer ON o_custkey = c_custkey JOIN walk ON c_name = topic""",
    ),
    "topic_rollup_tree": (
        _tree_topics,
        f"{ROLLUP} SELECT topic, top_topic FROM walk UNION ALL SELECT 'Root', NULL",
    ),
    "tree_faults": (_tree_faults, _FAULTS),
}
