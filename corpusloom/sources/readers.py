"""Corpus layouts: plain text, JSON reviews, one-document files, record-marked tokens, topic files.

Gzip files are read by their extension. Gzip is not splittable, so readers of large files take
``partitions`` to spread the rows before the work on them starts.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.labels import check_known, fold_number
from corpusloom.sources import small_files

# How record-marked files start a record and its body.
RECORD_START = "\n.I "
RECORD = r"(?s)\A(?:\.I )?[ \t]*(\d+)\s+\.W(?:\s(.*))?\z"

# Required fields of a review record.
REVIEW_FIELDS = {"reviewText": "text", "reviewerID": "reviewer_id"}

# Name of a one-document file (or of a folder with its one part), and the label of the directory it lies in.
MOVIE_FILE = r"/(neg|pos)/(?:name=)?cv(\d+)_(\d+)\.[^/]*(?:/[^/]*)?$"
MOVIE_LABELS = {"neg": 0, "pos": 1}


def line_position() -> Column:
    """Where a line stands in its input: orderable, and stable for unchanged files."""
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )


def spread(df: DataFrame) -> DataFrame:
    """Give every core a share of an input that comes in fewer parts, as gzip files and Parquet files of
    one row group do. An input of as many parts as cores is left as it is, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _spread(df: DataFrame, partitions: int | None) -> DataFrame:
    return df.repartition(partitions) if partitions else df


def read_text(spark: SparkSession, path: str | Sequence[str], partitions: int | None = None) -> DataFrame:
    """``(line_no, text)`` of plain or gzip text files."""
    lines = spark.read.text(path if isinstance(path, str) else list(path))
    return _spread(lines.select(line_position().alias("line_no"), F.col("value").alias("text")), partitions)


def read_reviews(spark: SparkSession, path: str | Sequence[str], partitions: int | None = None) -> DataFrame:
    """``(line_no, text, reviewer_id)`` of JSON lines; a record that is malformed or lacks a field is an error."""
    schema = ", ".join(f"{name} string" for name in REVIEW_FIELDS)
    raw = spark.read.schema(schema).json(path if isinstance(path, str) else list(path), mode="FAILFAST")
    fields = [
        F.when(F.col(source).isNull(), F.raise_error(F.lit(f"review without {source}"))).otherwise(F.col(source)).alias(name)
        for source, name in REVIEW_FIELDS.items()
    ]
    return _spread(raw.select(line_position().alias("line_no"), *fields), partitions)


def read_review_categories(
    spark: SparkSession, manifest: Mapping[str, str], categories: Sequence[str], partitions: int | None = None
) -> DataFrame:
    """Reviews of the chosen categories, in the manifest's order; other files are not opened."""
    check_known(categories, manifest, "the manifest")
    chosen = [(name, path) for name, path in manifest.items() if name in categories]
    if not chosen:
        raise ValueError("no category is chosen")
    parts = [read_reviews(spark, path, partitions).withColumn("category", F.lit(name)) for name, path in chosen]
    return reduce(DataFrame.unionByName, parts)


def read_movie_reviews(spark: SparkSession, root: str) -> DataFrame:
    """``(label, doc_id, fold, text)`` of ``<neg|pos>/cv<number>_<doc id>.txt`` files, one document each.

    A folder of such a name that holds one part file is a document, too, as Spark writes it partitioned by ``name``. Tasks list and
    read the files, a few tasks per core.
    """
    files = small_files.read_whole(spark, [f"{root.rstrip('/')}/{name}" for name in MOVIE_LABELS])
    path = F.col("file_path")
    return files.select(
        F.when(F.regexp_extract(path, MOVIE_FILE, 1) == "neg", MOVIE_LABELS["neg"]).otherwise(MOVIE_LABELS["pos"]).alias("label"),
        F.regexp_extract(path, MOVIE_FILE, 3).cast("bigint").alias("doc_id"),
        fold_number(F.regexp_extract(path, MOVIE_FILE, 2).cast("int")).alias("fold"),
        F.col("value").alias("text"),
    )


def read_marked_records(
    spark: SparkSession, path: str | Sequence[str], partitions: int | None = None, preamble: bool = False
) -> DataFrame:
    """``(doc_id, text)`` of ``.I <id> .W <tokens>`` records.

    A record starts at a line's start; ``.I `` within a line belongs to the body. Whatever is neither a record
    nor blank (text before a file's first record, or a line in a body that starts with ``.I ``) is an error,
    wherever in the file it stands: no text is dropped. ``preamble`` says that files may have text before
    their first record; it is then left out, which takes a pass more to find each file's first piece.
    """
    raw = spark.read.text(path if isinstance(path, str) else list(path), lineSep=RECORD_START)
    raw = raw.select("value", line_position().alias("_at")).withColumn("_file", F.col("_at.file"))
    if preamble:
        first = raw.groupBy("_file").agg(F.min("_at").alias("_first"))
        raw = raw.join(first, "_file").where((F.col("_at") != F.col("_first")) | F.col("value").rlike(RECORD))
    spaces = lambda col: F.trim(F.translate(col, "\n\r\t", "   "))
    malformed = F.raise_error(F.concat(F.lit("malformed record, or text before the first one: "), F.substring("value", 1, 40)))
    doc_id = F.when(~F.col("value").rlike(RECORD), malformed).otherwise(F.regexp_extract("value", RECORD, 1)).cast("bigint")
    body = spaces(F.regexp_extract("value", RECORD, 2))
    return _spread(raw.where(spaces(F.col("value")) != "").select(doc_id.alias("doc_id"), body.alias("text")), partitions)


def read_topic_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """``(line_no, topic, doc_id)`` of ``<topic> <doc id> ...`` lines."""
    parts = F.split("text", " ")
    return read_text(spark, path).where(F.length("text") > 0).select(
        "line_no", F.element_at(parts, 1).alias("topic"), F.element_at(parts, 2).cast("bigint").alias("doc_id")
    )


def read_topic_hierarchy(spark: SparkSession, path: str, full_description: bool = False) -> DataFrame:
    """``(child, parent, description)`` of hierarchy lines; a child's last line wins.

    The description is its first word unless ``full_description`` asks for the rest of the line.
    """
    fields = F.split("text", r"\s+")
    description = F.element_at(fields, 6)
    if full_description:
        description = F.array_join(F.slice(fields, F.lit(6), F.size(fields)), " ")
    lines = read_text(spark, path).where(F.length("text") > 0).select(
        "line_no",
        F.element_at(fields, 2).alias("parent"),
        F.element_at(fields, 4).alias("child"),
        description.alias("description"),
    )
    last = lines.groupBy("child").agg(F.max_by(F.struct("parent", "description"), "line_no").alias("_last"))
    return last.select("child", "_last.parent", "_last.description")


def read_newsgroups(
    spark: SparkSession, path: str, subset: str = "all", categories: Sequence[str] | None = None
) -> DataFrame:
    """Rows of a ``(category, subset, text)`` table; both filters reach the Parquet scan."""
    table = spark.read.parquet(path)
    if subset != "all":
        table = table.where(F.col("subset") == subset)
    return table if categories is None else table.where(F.col("category").isin(list(categories)))
