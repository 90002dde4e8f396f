"""Small files, listed and read by tasks: the driver holds none of their names, however many there are."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

if TYPE_CHECKING:
    import pyarrow as pa

TASKS_PER_CORE = 4  # that list and read small files
BATCH_ROWS, BATCH_BYTES = 10_000, 4 << 20  # that a task hands on at once

_ENTRY = "store string, path string, folder boolean"


def read_whole(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``(file_path, value)`` of every file below the folders ``paths``, a row with its whole text, as Spark's reader of whole texts finds them.

    Names with a leading dot or underscore and empty files are left out. A folder is listed by one task, as a stream if it is a local one; what lies
    in its folders by as many as there are, and files are read by a few tasks per core. Spark's reader, whose driver lists every file, only reads what
    pyarrow does not reach, and reports paths that are not there.
    """
    parts = TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    folders = _folders(spark, paths)
    if folders is None:
        files = spark.read.text(list(paths), wholetext=True, recursiveFileLookup=True)
        return files.select("_metadata.file_path", "value").coalesce(parts)
    listed = spark.createDataFrame(folders, _ENTRY).mapInArrow(_lister(False), _ENTRY)
    # Dealt by their names, so that a task that runs again gets the same ones.
    listed = listed.repartition(parts, "path").mapInArrow(_lister(True), _ENTRY)
    read = listed.repartition(parts, "path").mapInArrow(_reader(), "file_path string, value binary")
    return read.select("file_path", F.col("value").cast("string").alias("value"))


def _folders(spark: SparkSession, paths: Sequence[str]) -> list[tuple[str, str, bool]] | None:
    """The folders that these names or patterns stand for, with the store that tasks open them in (none for local ones); None if Spark has to read them."""
    import pyarrow.fs

    found = []
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        matched = list(place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place) or [])
        if not matched or not all(status.isDirectory() for status in matched):
            return None
        for uri in (status.getPath().toUri() for status in matched):
            if uri.getScheme() == "file":
                found.append(("", uri.getPath(), True))
                continue
            try:
                store, inner = pyarrow.fs.FileSystem.from_uri(uri.toString())
                if store.get_file_info(inner).type != pyarrow.fs.FileType.Directory:
                    return None
            except Exception:  # a store that pyarrow does not know, or may not enter
                return None
            found.append((uri.toString(), inner, True))
    return found


def _lister(deep: bool) -> Callable[[Iterator["pa.RecordBatch"]], Iterator["pa.RecordBatch"]]:
    """Folders give what lies in them, or every file below them if ``deep``; files stay. Tasks get this function whole."""
    most = BATCH_ROWS

    def entries(store, folder):
        import os

        import pyarrow.fs

        if store:
            inside = pyarrow.fs.FileSystem.from_uri(store)[0].get_file_info(pyarrow.fs.FileSelector(folder))
            found = ((i.path, i.base_name, i.type == pyarrow.fs.FileType.Directory) for i in inside)
        else:
            found = ((e.path, e.name, e.is_dir()) for e in os.scandir(folder))
        for path, name, is_folder in found:
            if not (name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")):
                yield store, path, is_folder

    def below(row):
        waiting = [row]
        while waiting:
            for entry in entries(*waiting.pop()[:2]):
                if deep and entry[2]:
                    waiting.append(entry)
                else:
                    yield entry

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("store", pa.string()), ("path", pa.string()), ("folder", pa.bool_())])
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        rows = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                for entry in below(row) if row[2] else [row]:
                    rows.append(entry)
                    if len(rows) == most:
                        yield made(rows)
                        rows = []
        if rows:
            yield made(rows)

    return run


def _reader() -> Callable[[Iterator["pa.RecordBatch"]], Iterator["pa.RecordBatch"]]:
    """Files give their bytes, unpacked as their extension says. Tasks get this function whole."""
    most_rows, most_bytes = BATCH_ROWS, BATCH_BYTES

    def unpacked(path, data):
        import bz2
        import gzip
        import zlib

        import pyarrow as pa

        for extension, unpack in ((".gz", gzip.decompress), (".bz2", bz2.decompress), (".deflate", zlib.decompress)):
            if path.endswith(extension):
                return unpack(data)
        if path.endswith(".zst"):
            return pa.CompressedInputStream(pa.BufferReader(data), "zstd").read()
        if path.endswith((".lz4", ".snappy")):
            raise ValueError(f"a small file of a compression that is not read: {path}")
        return data

    def run(batches):
        import pyarrow as pa
        import pyarrow.fs

        schema = pa.schema([("file_path", pa.string()), ("value", pa.binary())])
        stores = {}
        paths, values, size = [], [], 0
        for batch in batches:
            for store, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if store:
                    if store not in stores:
                        stores[store] = pyarrow.fs.FileSystem.from_uri(store)[0]
                    with stores[store].open_input_stream(path, compression=None) as file:
                        data = file.read()
                else:
                    with open(path, "rb") as file:
                        data = file.read()
                if not data:
                    continue
                paths.append(path)
                values.append(unpacked(path, data))
                size += len(values[-1])
                if size >= most_bytes or len(paths) == most_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(values, pa.binary())], schema=schema)
                    paths, values, size = [], [], 0
        if paths:
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(values, pa.binary())], schema=schema)

    return run
