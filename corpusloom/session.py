"""Session helpers: a local session for tests, and tables written to the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from corpusloom.sinks import publish

_local_dirs: dict[str, str] = {}
_block: ContextVar[str] = ContextVar("block", default="")

# Settings of Spark that save disk.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
PARQUET_CODEC = "spark.sql.parquet.compression.codec"


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("corpusloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")  # text is heavy per byte
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder for tables that cut lineage.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master may go without,
    since there the driver's temporary folder is the one every task sees.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = context.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="corpusloom-")
    return _local_dirs[app]


def new_path(spark: SparkSession, name: str) -> str:
    """An unused path in the application's part of the shared folder."""
    return f"{shared_dir(spark)}/corpusloom/{spark.sparkContext.applicationId}/{_block.get()}{name}-{uuid.uuid4().hex}"


@contextmanager
def sparing_disk(spark: SparkSession) -> Iterator[None]:
    """Within the block the shuffle files of an action go when it ends, and Parquet is written with zstd unless the session names a codec.

    Left to itself Spark keeps shuffle files until the driver happens to collect its garbage.
    """
    before = {k: spark.conf.get(k, None) for k in (FREE_SHUFFLES, PARQUET_CODEC)}
    spark.conf.set(FREE_SHUFFLES, "true")
    if before[PARQUET_CODEC] in (None, "snappy"):
        spark.conf.set(PARQUET_CODEC, "zstd")
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[None]:
    """Tables that are written within the block go when it ends, and it spares disk: for work whose results are written to paths from outside it."""
    folder = f"{_block.get()}passing-{uuid.uuid4().hex}/"
    path = f"{shared_dir(spark)}/corpusloom/{spark.sparkContext.applicationId}/{folder}"
    token = _block.set(folder)
    try:
        with sparing_disk(spark):
            yield
    finally:
        _block.reset(token)
        publish.delete(spark, path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Later passes prune columns on the written table, survive lost executors, and the planner sees
    the table's true size, so it broadcasts only what lies under its threshold. Each application has
    its own folder, which may go once the application and the DataFrames it made are done.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
