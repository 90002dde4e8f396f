"""Standard runs: from the files of a corpus to its output directory."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.labels import check_known
from corpusloom.operators.corpus import number_written, select_categories, with_counters
from corpusloom.operators.taxonomy import top_topics
from corpusloom.plans import corpora
from corpusloom.session import passing_tables
from corpusloom.sinks import publish, writers
from corpusloom.sources import matrices, readers

# Names of the extra output files.
IDS_FILE = "docids"
FOLDS_FILE = "cvtag"
TOPICS_FILE = "topics"
BODIES = "txt"


class Stages:
    """Tables that a run writes on its way, in a folder of its output; a run that starts again reads those that are complete."""

    def __init__(self, spark: SparkSession, out: str) -> None:
        self.spark, self.out = spark, out.rstrip("/")
        self.folder = f"{self.out}/_stages"

    def table(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        path = f"{self.folder}/{name}"
        if not publish.exists(self.spark, f"{path}/_SUCCESS"):
            make().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def missing(self, path: str, names: Iterable[str]) -> bool:
        """Whether the folder lacks one of these outputs."""
        return not set(names) <= set(publish.published(self.spark, path))

    def output(self, path: str, names: Iterable[str], write: Callable[[str], None]) -> None:
        """Write outputs that are not there yet."""
        if self.missing(path, names):
            write(path)

    def corpus(self, path: str, make: Callable[[], corpora.Corpus]) -> None:
        """The files of a corpus, which is made only if some are missing."""
        bow, texts = [writers.DATASET, *writers.BOW_FILES.values(), writers.VOCAB_FILE], writers.TEXT_FILES.values()
        if self.missing(path, [*bow, *texts]):
            made = make()
            self.output(path, bow, made.write)
            self.output(path, texts, made.write_text)

    def done(self) -> None:
        publish.delete(self.spark, self.folder)


def newsgroup_runs(
    spark: SparkSession,
    table: str,
    out: str,
    choices: Mapping[str, Sequence[str]] = corpora.NEWSGROUP_CHOICES,
    key: Sequence[str] | None = ("message_id",),
    **options: object,
) -> None:
    """One corpus per category choice from a ``(message_id, category, subset, text)`` table; choices that are complete are left alone.

    Messages are numbered by ``key``, or in the order they are read if that is None.
    """
    messages = readers.read_newsgroups(spark, table)
    messages = messages if key is None else readers.spread(messages)
    stages = Stages(spark, out)
    for name, categories in choices.items():
        stages.corpus(f"{out}/{name}", lambda: corpora.newsgroup_corpus(messages, categories, key=key, **options))  # noqa: B023


def review_runs(
    spark: SparkSession,
    manifest: Mapping[str, str],
    out: str,
    choices: Mapping[str, Sequence[str]] = corpora.REVIEW_CHOICES,
    class_limit: int = 10_000,
    strict: bool = True,
) -> None:
    """One corpus per category choice from JSON-lines files; only the chosen categories are read, each file once.

    All choices are checked against the manifest and the known categories before anything is read or written. Reviews are numbered by
    file and line within each category, without moving them. A run that starts again goes on from the reviews it has
    read and the choices it has written.
    """
    for categories in choices.values():
        check_known(categories, corpora.REVIEW_CATEGORIES)
        check_known(categories, manifest, "the manifest")
    known = [c for c in corpora.REVIEW_CATEGORIES if c in manifest]
    chosen = [c for c in known if any(c in categories for categories in choices.values())]
    stages = Stages(spark, out)

    def read() -> DataFrame:
        # The lines of a category are its own counter's, so their numbers hold for every choice.
        rows = readers.read_review_categories(spark, {c: manifest[c] for c in chosen}, chosen)
        return with_counters(rows, "category", chosen, "line_no").drop("line_no")

    everything = stages.table("reviews", read)
    for name, categories in choices.items():
        wanted = select_categories(everything, categories)
        stages.corpus(f"{out}/{name}", lambda: corpora.review_corpus(number_written(wanted), categories, known, class_limit, strict=strict))  # noqa: B023
    stages.done()


def movie_run(spark: SparkSession, root: str, out: str) -> None:
    """The movie corpus from one-document files, which are read once, into a table of few large files. Tables written on the way go when the run ends."""
    stages = Stages(spark, out)

    def write_ids(path: str) -> None:
        with publish.staging(spark, path, [IDS_FILE, FOLDS_FILE]) as staged:
            writers.write_ids_folds(reviews.withColumn("class", F.col("label")), f"{staged}/{IDS_FILE}", f"{staged}/{FOLDS_FILE}", corpora.MOVIE_ORDER.columns())

    with passing_tables(spark):
        reviews = stages.table("movies", lambda: readers.read_movie_reviews(spark, root))
        stages.corpus(out, lambda: corpora.movie_corpus(reviews))
        stages.output(out, [IDS_FILE, FOLDS_FILE], write_ids)
    stages.done()


def newswire_run(
    spark: SparkSession, files: Mapping[str, str | Sequence[str]], topic_lines: str, hierarchy: str, out: str
) -> None:
    """``files`` names the token files of each of train, test and unsup."""
    stages = Stages(spark, out)

    def read() -> DataFrame:
        parts = [readers.spread(readers.read_marked_records(spark, path)).withColumn("split", F.lit(split)) for split, path in files.items()]
        return reduce(DataFrame.unionByName, parts)

    docs = stages.table("documents", read)
    tree = stages.table("hierarchy", lambda: readers.read_topic_hierarchy(spark, hierarchy))
    stages.corpus(out, lambda: corpora.newswire_corpus(docs, readers.read_topic_lines(spark, topic_lines), tree)[0])

    def write_topics(path: str) -> None:
        with publish.staging(spark, path, [TOPICS_FILE]) as staged:
            writers.write_topics(top_topics(tree), f"{staged}/{TOPICS_FILE}")

    stages.output(out, [TOPICS_FILE], write_topics)
    stages.done()


NEWS_TABLES = ("documents", "taxons", "doc_taxon", "doc_word", "words")


def news_tables(spark: SparkSession, folder: str, buckets: int | None = None) -> dict[str, DataFrame]:
    """The Parquet tables of a folder, those by document (but for the text) written once in buckets, for any number of runs."""
    found = {name: spark.read.parquet(f"{folder.rstrip('/')}/{name}") for name in NEWS_TABLES}
    return found | {name: matrices.by_document(found[name], name, buckets) for name in ("doc_taxon", "doc_word")}


def news_run(
    spark: SparkSession, tables: str | Mapping[str, DataFrame], out: str, train_test: tuple[int, int] | None = None, **options: object
) -> None:
    """``tables`` is a folder of the Parquet tables documents, taxons, doc_taxon, doc_word and words, or these tables by name.

    Several runs over the same tables read them best from ``news_tables``. ``options`` go to ``news_corpus``. Tables written on the way go
    when the run ends.
    """
    given = tables if isinstance(tables, Mapping) else {n: spark.read.parquet(f"{tables.rstrip('/')}/{n}") for n in NEWS_TABLES}
    docs, *others = (given[name] for name in NEWS_TABLES)
    with passing_tables(spark):
        made = corpora.news_corpus(docs, *others, train_test=train_test, **options)
        made.write(out)
        with publish.staging(spark, out, [BODIES]) as staged:
            writers.write_bodies(made.bodies(docs.select("doc_id", "text")), f"{staged}/{BODIES}")
