"""Mixing sources to target weights: whole epochs first, then an Efraimidis-Spirakis sample of each source.

A document's key is an exponential variate over its quality weight; the smallest keys of a source are taken
until its words reach the target. Prefix sums need no sort of a whole source: keys fall into buckets,
bucket totals locate the one bucket that holds the cut, and only that bucket is ranked. Documents then
compare their own key with one row of constants per source, so a hot source stays spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.ordering import ordered_positions
from corpusloom.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "[#$%&*|!+=<>~^]"
WEIGHTS = (1, 2, 3)  # of the sources in code point order, repeating
MOST_EPOCHS = 3
PER_OCTAVE = 256  # buckets for each doubling of the key
LEAST_KEY = 2.0**-60  # below every key: the smallest is 2^-53
SEED = 7


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def text_weight(text: Column) -> Column:
    """A quality weight in [0.05, 1]: falls with the share of symbols that prose does without; null and empty texts have 1."""
    whole = F.coalesce(text, F.lit(""))
    symbols = F.length(whole) - F.length(F.regexp_replace(whole, SYMBOLS, ""))
    return F.greatest(F.lit(0.05), F.lit(1.0) - F.lit(5.0) * symbols / F.greatest(F.length(whole), F.lit(1)))


def measure(
    docs: DataFrame, weight: Column | None = None, doc_id: str = "doc_id", text: str = "text", seed: int = SEED
) -> DataFrame:
    """``docs`` with ``_size`` (words), ``_key`` (exponential variate over weight), ``_bucket``.

    A bucket is a stretch of the key's logarithm. An exponential variate of any rate, or of rates that differ by row, has at most
    ln 2 / (256 e), 0.1 percent, of its values in one of them, so no weights crowd the rows of a source into few buckets.

    Weights lie in (0, 1]; a null or smaller one counts as 1e-9 and so comes last.
    """
    weight = text_weight(F.col(text)) if weight is None else weight
    digits = F.substring(F.md5(F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(seed)).cast("binary")), 1, 13)
    uniform = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)
    key = -F.log(uniform) / F.greatest(F.coalesce(weight, F.lit(1e-9)), F.lit(1e-9))
    bucket = F.floor(PER_OCTAVE * F.log2(F.greatest(F.col("_key"), F.lit(LEAST_KEY)) / LEAST_KEY)).cast("int")
    return docs.withColumns({"_size": word_count(F.col(text)), "_key": key}).withColumn("_bucket", bucket)


def targets(sizes: DataFrame) -> DataFrame:
    """``source``, ``source_size``, ``target`` from one row per source (``source``, ``source_size``).

    Sources in code point order (null last) weigh 1, 2, 3, repeating, and share all words. A target stops at 3 times
    its source; the excess goes to the others by weight until none is above. The common level is found by
    rounds over the table of sources, of which two sums come to the driver.
    """
    placed = ordered_positions(sizes, [F.col("source").asc_nulls_last()], "_place")
    weights = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("_place") % len(WEIGHTS) + 1).cast("int"))
    weighted = materialize(placed.withColumn("_weight", weights.cast("long")), "source-weights")
    cap = F.col("source_size") * MOST_EPOCHS
    total, rest = weighted.agg(F.sum("source_size"), F.sum("_weight")).first()
    level, capped = (total / rest if rest else 0.0), 0
    while total:
        over = cap.cast("double") < F.lit(level) * F.col("_weight")
        n, gone, rest = weighted.agg(
            F.count_if(over), F.coalesce(F.sum(F.when(over, cap)), F.lit(0)), F.sum(F.when(over, 0).otherwise(F.col("_weight")))
        ).first()
        if n == capped:
            break
        capped, level = n, (total - gone) / rest
    return weighted.select("source", "source_size", F.least(cap.cast("double"), F.lit(level) * F.col("_weight")).alias("target"))


def _tie(doc_id: str) -> Column:
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63)))


def plan(measured: DataFrame, doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """One row per source: its target, whole epochs, and the last key of the fractional selection."""
    rows = measured.select(F.col(source).alias("source"), "_size", "_key", "_bucket", _tie(doc_id).alias("_tie"))
    buckets = materialize(rows.groupBy("source", "_bucket").agg(F.sum("_size").alias("_words")), "mix-buckets")
    wanted = targets(buckets.groupBy("source").agg(F.sum("_words").alias("source_size")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    wanted = wanted.withColumn("epochs", epochs).withColumn("_rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    wanted = materialize(wanted.withColumnRenamed("source", "_of"), "mix-targets")
    same = F.col("source").eqNullSafe(F.col("_of"))
    start = F.sum("_words").over(Window.partitionBy("source").orderBy("_bucket")) - F.col("_words")
    # The cut lies in the last bucket that starts at or below the rest.
    cuts = (
        buckets.withColumn("_start", start)
        .join(wanted, same)
        .where("_start <= _rest")
        .groupBy("_of")
        .agg(F.max_by(F.struct("_bucket", "_start", "_rest"), "_bucket").alias("_cut"))
        .select("_of", "_cut.*")
    )
    cuts = materialize(cuts.withColumnRenamed("_bucket", "_cut_bucket"), "mix-cuts")
    # Rows that repeat an id share a key: those of one size, too, are one step of the order, however many they are.
    ranked = rows.join(cuts, same & (F.col("_bucket") == F.col("_cut_bucket")))
    ranked = ranked.groupBy("_of", "_start", "_rest", "_key", "_tie", "_size").agg(F.sum("_size").alias("_words"))
    order = Window.partitionBy("_of").orderBy("_key", "_tie", "_size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = (
        ranked.withColumn("_before", F.col("_start") + F.sum("_words").over(order) - F.col("_words"))
        .where(2 * F.col("_before") + F.col("_size") <= 2 * F.col("_rest"))
        .groupBy("_of")
        .agg(F.max(F.struct("_key", "_tie", "_size")).alias("_last"))
    )
    cut = cuts.select(F.col("_of").alias("_c"), "_cut_bucket")
    end = last.select(F.col("_of").alias("_l"), "_last")
    joined = wanted.join(cut, F.col("_of").eqNullSafe(F.col("_c")), "left")
    joined = joined.join(end, F.col("_of").eqNullSafe(F.col("_l")), "left").drop("_c", "_l", "_rest")
    return materialize(joined, "mix-plan")


def apply(measured: DataFrame, planned: DataFrame, doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """``measured`` with ``source_size``, ``target`` and ``copies`` (how often the mix takes the row)."""
    own = F.struct(F.col("_key"), _tie(doc_id).alias("_tie"), F.col("_size"))
    taken = (F.col("_bucket") < F.col("_cut_bucket")) | ((F.col("_bucket") == F.col("_cut_bucket")) & (own <= F.col("_last")))
    joined = measured.join(planned, F.col(source).eqNullSafe(F.col("_of")))
    copies = F.col("epochs") + F.coalesce(taken, F.lit(False)).cast("long")
    return joined.withColumn("copies", copies).drop("_of", "epochs", "_cut_bucket", "_last", "_key", "_bucket")


def report(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``size``, ``source_size``, ``target``, ``taken`` (words, repeats counted).

    Null text has size 0; a null source is a source of its own, the last. Rows with equal ids and sizes share a key
    and follow each other; null ids share one key and come by size. No rows give no rows.
    """
    narrow = materialize(measure(docs).select("doc_id", "source", "_size", "_key", "_bucket"), "mix-sizes")
    mixed = apply(narrow, plan(narrow))
    return mixed.select(
        "doc_id", F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * F.col("copies")).alias("taken")
    )


def mix(docs: DataFrame) -> DataFrame:
    """The rows of the mix, columns as in ``docs``, each as often as the mix takes it.

    A row travels in one struct, so its columns may have any names.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    measured = measure(docs.select(row, "doc_id", "source", "text"))
    narrow = materialize(measured.select("doc_id", "source", "_size", "_key", "_bucket"), "mix-sizes")
    mixed = apply(measured, plan(narrow)).where("copies > 0")
    repeated = mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return repeated.select("_row.*")


SQL = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size
  FROM documents
), k AS (
  SELECT doc_id, source, size,
    greatest(0.05, 1.0::DOUBLE - 5.0::DOUBLE * (length(t) - length(regexp_replace(t, '{SYMBOLS}', '', 'g'))) / greatest(length(t), 1)) AS w,
    (('0x' || substr(md5(concat(coalesce(doc_id::VARCHAR, ''), ':{SEED}')), 1, 13))::BIGINT::DOUBLE + 0.5) / {1 << 52}::DOUBLE AS u
  FROM d
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM d GROUP BY source
), r AS (
  SELECT *, 3.0 * source_size / weight AS ratio,
    sum(source_size) OVER () AS total,
    sum(3 * source_size) OVER (ORDER BY 3.0 * source_size / weight, source ROWS UNBOUNDED PRECEDING) - 3 * source_size AS capped,
    sum(weight) OVER () - sum(weight) OVER (ORDER BY 3.0 * source_size / weight, source ROWS UNBOUNDED PRECEDING) + weight AS open
  FROM s
), l AS (
  SELECT max((total - capped)::DOUBLE / open::DOUBLE) FILTER (WHERE ratio >= (total - capped)::DOUBLE / open::DOUBLE) AS level FROM r
), p AS (
  SELECT source, source_size, least((3 * source_size)::DOUBLE, level * weight) AS target,
    CASE WHEN source_size > 0 THEN floor(least((3 * source_size)::DOUBLE, level * weight) / source_size)::BIGINT ELSE 0 END AS epochs
  FROM s, l
), o AS (
  SELECT k.doc_id, k.size, p.source_size, p.target, p.epochs,
    coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY -ln(u) / w, doc_id, size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM k JOIN p ON k.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  (size * (epochs + CASE WHEN 2 * before + size <= 2 * (target - epochs * source_size) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM o
"""
