"""Readers, over files that Spark writes from the test tables in each corpus layout."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.catalog.common import CLEAN_REVIEWS, LANGS, documents, table
from corpusloom.catalog.topics import HIERARCHY, hierarchy
from corpusloom.functions.text import clean_text
from corpusloom.session import new_path
from corpusloom.sources import readers


def _reviews(spark, sf):
    root = new_path(spark, "reviews")
    docs = documents(spark, sf).select(
        "category", F.col("text").alias("reviewText"), F.col("doc_id").cast("string").alias("reviewerID"), F.lit(5).alias("overall")
    )
    docs.write.partitionBy("category").json(root, compression="gzip")
    manifest = {name: f"{root}/category={name}" for name in LANGS}
    rows = readers.read_review_categories(spark, manifest, ("fr", "en"))
    return rows.select("category", "reviewer_id", "text")


def _marked(spark, sf):
    path = new_path(spark, "marked")
    docs = clean_text(table(spark, sf, "documents").select("doc_id", "text"))
    # Bodies hold the record mark within a line.
    body = F.concat(F.lit("fig.I 7 and .I 8 .W "), F.regexp_replace("text", " ", "\n"))
    record = F.concat(F.lit(".I "), "doc_id", F.lit("\n.W\n"), body, F.lit("\n"))
    docs.select(record.alias("value")).write.text(path, compression="gzip")
    return readers.read_marked_records(spark, path)


def _topic_lines(spark, sf):
    path = new_path(spark, "topic-lines")
    events = table(spark, sf, "events").repartitionByRange(4, "event_id").sortWithinPartitions("event_id")
    events.select(F.concat_ws(" ", "event_type", "user_id", F.lit("1")).alias("value")).write.text(path)
    lines = readers.read_topic_lines(spark, path)
    last = F.max_by("topic", "line_no").alias("last_topic")
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), last)


def _hierarchy(spark, sf):
    path = new_path(spark, "hierarchy")
    line = F.concat(
        F.lit("parent: "), F.regexp_replace("parent", " ", "_"), F.lit(" child: "), F.regexp_replace("child", " ", "_"),
        F.lit(" child-description: "), "description",
    )
    hierarchy(spark, sf).select(line.alias("value")).write.text(path)
    return readers.read_topic_hierarchy(spark, path)


QUERIES = {
    "read_reviews": (
        _reviews,
        "SELECT lang AS category, CAST(doc_id AS VARCHAR) AS reviewer_id, text FROM documents WHERE lang IN ('fr', 'en')",
    ),
    "read_marked_records": (
        _marked,
        f"SELECT doc_id, trim(concat('fig.I 7 and .I 8 .W ', {CLEAN_REVIEWS})) AS text FROM documents",
    ),
    "read_topic_lines": (
        _topic_lines,
        """SELECT CAST(user_id AS BIGINT) AS doc_id, count(*) AS n_lines, arg_max(event_type, event_id) AS last_topic
           FROM events GROUP BY user_id""",
    ),
    "read_topic_hierarchy": (
        _hierarchy,
        """SELECT replace(child, ' ', '_') AS child, replace(parent, ' ', '_') AS parent,
                  regexp_extract(description, '^[^ ]*') AS description
           FROM (""" + HIERARCHY + ")",
    ),
}
