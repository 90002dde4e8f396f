"""Outputs that appear whole or not at all: written aside, moved into place, listed in a manifest when complete."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import SparkSession

MANIFEST = "_MANIFEST"  # readers skip names with an underscore


def _path(spark: SparkSession, path: str):
    """The path and its file system, whatever store it is in."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    files, place = _path(spark, path)
    return files.exists(place)


def move(spark: SparkSession, source: str, target: str) -> None:
    """Rename a folder; a source that nothing was written to becomes an empty folder."""
    files, place = _path(spark, target)
    files.mkdirs(place.getParent())
    if not exists(spark, source):
        files.mkdirs(place)
    elif not files.rename(_path(spark, source)[1], place):
        raise OSError(f"cannot move {source} to {target}")


def delete(spark: SparkSession, path: str) -> None:
    files, place = _path(spark, path)
    files.delete(place, True)


def published(spark: SparkSession, path: str) -> list[str]:
    """Names of the complete outputs of a folder."""
    files, place = _path(spark, f"{path.rstrip('/')}/{MANIFEST}")
    if not files.exists(place):
        return []
    text = spark._jvm.org.apache.commons.io.IOUtils.toString(files.open(place), "UTF-8")
    return json.loads(text)


def _list_in_manifest(spark: SparkSession, path: str, names: Sequence[str]) -> None:
    known = sorted({*published(spark, path), *names})
    fresh = f"{path}/{MANIFEST}-{uuid.uuid4().hex}"
    files, place = _path(spark, fresh)
    out = files.create(place)
    out.write(bytearray(json.dumps(known).encode()))
    out.close()
    last = _path(spark, f"{path}/{MANIFEST}")[1]
    files.delete(last, False)
    files.rename(place, last)


@contextmanager
def staging(spark: SparkSession, path: str, names: Sequence[str]) -> Iterator[str]:
    """A folder to write the outputs ``names`` to; they are moved to ``path`` and listed there once the block is done.

    A run that fails or is killed before leaves nothing but a folder that readers skip. An output that is there
    and listed already is an error; one that is not listed is what a killed move left, and goes.
    """
    path = path.rstrip("/")
    done = set(published(spark, path)) & set(names)
    if done:
        raise FileExistsError(f"{path} holds {sorted(done)} already")
    staged = f"{path}/_staged-{uuid.uuid4().hex}"
    try:
        yield staged
        for name in names:
            delete(spark, f"{path}/{name}")
            move(spark, f"{staged}/{name}", f"{path}/{name}")
        _list_in_manifest(spark, path, names)
    finally:
        delete(spark, staged)
