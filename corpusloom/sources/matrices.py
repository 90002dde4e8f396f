"""Matrix tables of a corpus, laid out so that work by document moves no row."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from corpusloom.session import new_path


def by_document(rows: DataFrame, name: str, buckets: int | None = None, key: str = "doc_id", path: str | None = None) -> DataFrame:
    """Write ``rows`` once as a table in ``buckets`` by ``key``, each bucket one sorted file, and read it back.

    Sums, distinct counts and packed rows by document of such a table need no shuffle, nor do joins by document of two tables of
    equally many buckets and one key type. ``buckets`` is by default the session's number of shuffle partitions. The files lie in
    ``path``, a folder of the shared one by default. The name in the catalog is a new one; whoever owns the folder drops the table with it.
    """
    spark = rows.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}_{uuid.uuid4().hex}"
    writer = rows.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key)
    writer.option("path", path or new_path(spark, name)).saveAsTable(table)
    return spark.table(table)
