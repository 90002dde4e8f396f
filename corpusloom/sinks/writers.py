"""Output files. Each name is a directory of Spark part files whose order is the output's order."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Mapping, Sequence

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.labels import svmlight_line, text_line, topic_line
from corpusloom.sinks import publish

# Where each split's bag of words and text go.
BOW_FILES = {
    "train_sup": "train/labeledBow.feat",
    "unsup": "train/unsupBow.feat",
    "valid": "valid/labeledBow.feat",
    "test": "test/labeledBow.feat",
}
TEXT_FILES = {
    "train_sup": "train/train_sup_text.txt",
    "unsup": "train/train_unsup_text.txt",
    "valid": "valid/valid_sup_text.txt",
    "test": "test/test_text.txt",
}
VOCAB_FILE = "vocab"
DATASET = "dataset.parquet"


def _write_lines(df: DataFrame, line: Column, path: str, order: Sequence[Column | str]) -> None:
    df.orderBy(*order).select(line.alias("value")).write.text(path)


def write_files(df: DataFrame, path: str, stem: str = "stem", text: str = "text") -> None:
    """A file ``<stem>.<part>.txt`` per document, its text and a line break, in one folder; a null text is an empty one.

    Files are opened where the rows lie. Rows of one stem in a part are the lines of one file, those of other parts have files of their own.
    """
    import pyarrow as pa
    import pyarrow.fs

    place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    folder = place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).makeQualified(place).toString()
    folder = folder.replace("file:/", "file:///", 1) if not folder.startswith("file://") else folder

    def write(batches: Iterator["pa.RecordBatch"]) -> Iterator["pa.RecordBatch"]:
        store, root = pyarrow.fs.FileSystem.from_uri(folder)
        store.create_dir(root)
        part, written, last, out = TaskContext.get().partitionId(), 0, None, None
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if out is None or name != last:
                    if out is not None:
                        out.close()
                    out, last, written = store.open_output_stream(f"{root}/{name}.{part}.txt"), name, written + 1
                out.write(f"{value or ''}\n".encode())
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_pydict({"files": [written]}, pa.schema([("files", pa.int64())]))

    df.select(stem, text).sortWithinPartitions(stem).mapInArrow(write, "files long").agg(F.sum("files")).collect()


def write_split_lines(df: DataFrame, line: Column, path: str, files: Mapping[str, str], order: Sequence[Column | str]) -> None:
    """Lines of each split to the name that ``files`` gives it, in one pass: one range partitioning, one write.

    A split without rows is an empty output.
    """
    spark, aside = df.sparkSession, f"{path}/_lines-{uuid.uuid4().hex}"
    named = df.where(F.col("split").isin(list(files)))
    placed = named.repartitionByRange("split", *order).sortWithinPartitions("split", *order)
    placed.select("split", line.alias("value")).write.partitionBy("split").text(aside)
    for split, name in files.items():
        publish.move(spark, f"{aside}/split={split}", f"{path}/{name}")
    publish.delete(spark, aside)


def write_svmlight(
    df: DataFrame, path: str, binary: bool = False, index_base: int = 1, order: Sequence[Column | str] = ("doc_id",)
) -> None:
    _write_lines(df, svmlight_line("label", "features", binary, index_base), path, order)


def write_vocab(vocab: DataFrame, path: str) -> None:
    """One term per line; a term's line number is its word id."""
    _write_lines(vocab, F.col("term"), path, ["word_id"])


def write_doc_text(df: DataFrame, path: str, order: Sequence[Column | str] = ("doc_id",)) -> None:
    _write_lines(df, text_line("doc_id", "text"), path, order)


def write_ids_folds(
    df: DataFrame, ids_path: str, folds_path: str, order: Sequence[Column | str] = ("doc_id",)
) -> None:
    """Document ids and fold numbers, line by line in the same order."""
    _write_lines(df, F.col("doc_id").cast("string"), ids_path, order)
    _write_lines(df, F.col("fold").cast("string"), folds_path, order)


def write_topics(topics: DataFrame, path: str) -> None:
    _write_lines(topics, topic_line(), path, ["topic_id"])


def write_bodies(docs: DataFrame, path: str) -> None:
    """Document bodies by split, as ``(doc_id, text)`` rows rather than one file each."""
    docs.select("doc_id", "text", "split").write.partitionBy("split").parquet(path)


def write_dataset(features: DataFrame, path: str) -> None:
    """The dataset as Parquet, one directory per split; unsupervised rows carry no label."""
    label = F.when(F.col("split") != "unsup", F.col("label"))
    features.withColumn("label", label).write.partitionBy("split").parquet(path)
