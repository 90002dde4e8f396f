"""Document fingerprints by winnowing, with built-in functions only.

Words are hashed, every k words in a row give a k-gram hash, and of every window of w such hashes the smallest is
selected, the rightmost of equals, with its position. Texts that share k + w - 1 words in a row share a
selected hash. Hashes use 61 bits; the 3 lowest hold a hash's place in its window, so that one minimum of
plain longs finds hash and position at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 5
W = 4  # at most 8
SPACE = " \t\n\x0b\f\r"
PLACES = 7  # low bits: the place in a window
PER_BUCKET = 500  # documents that are put in order together
MOST_BUCKETS = 1 << 16
STEP = 256


def add_fingerprint(df: DataFrame, text: str, name: str, k: int = K, w: int = W) -> DataFrame:
    """Add ``name``: array of (``position``, ``hash``), positions counted in words.

    Words are lower-cased and split at ASCII white space. Fewer than k words are one k-gram, fewer than w k-grams
    one window; null and empty texts have an empty fingerprint.
    """
    words, grams, least = f"_{name}_words", f"_{name}_grams", f"_{name}_least"
    trimmed = F.btrim(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(SPACE))
    split = F.when(F.length(trimmed) > 0, F.split(trimmed, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>"))
    df = df.withColumn(words, F.transform(split, lambda word: F.xxhash64(word)))
    x, n = F.col(words), F.size(words)
    clear = F.lit(~PLACES)
    # Arrays are read several times inside each lambda, which keeps the optimizer from inlining what makes them.
    gram = F.transform(
        F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*[F.get(x, i + j) for j in range(k)]).bitwiseAND(clear)
    )
    whole = F.transform(F.slice(x, 1, F.least(n, F.lit(1))), lambda _: F.xxhash64(x).bitwiseAND(clear))
    df = df.withColumn(grams, F.when(n >= k, gram).otherwise(whole))
    g, m = F.col(grams), F.size(grams)
    in_window = lambda j: [F.get(g, j + o).bitwiseOR(F.lit(w - 1 - o)) for o in range(w)]
    windows = F.transform(F.sequence(F.lit(0), m - w), lambda j: F.least(*in_window(j)) if w > 1 else in_window(j)[0])
    single = F.array(F.array_min(F.transform(g, lambda h, i: h.bitwiseOR((F.lit(w - 1) - i).cast("long")))))
    df = df.withColumn(least, F.when(m >= w, windows).when(m > 0, single).otherwise(F.array().cast("array<bigint>")))
    s = F.col(least)
    place = lambda v, j: j + (w - 1) - v.bitwiseAND(F.lit(PLACES)).cast("int")
    selected = F.transform(s, lambda v, j: F.struct(place(v, j).alias("position"), v.bitwiseAND(clear).alias("hash")))
    df = df.withColumn(name, selected)
    new = F.filter(F.col(name), lambda v, j: (j == 0) | (v["position"] != F.get(F.col(name), j - 1)["position"]))
    return df.withColumn(name, new).drop(words, grams, least)


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two fingerprints' hashes; two empty ones are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union).cast("double")


def digest(hashes: Column) -> Column:
    return F.md5(F.array_join(hashes.cast("array<string>"), " ").cast("binary"))


def _bucket(doc_id: Column, bounds: list[float]) -> Column:
    """How many bounds lie at or below the id, looked up in two steps."""
    if not bounds:
        return F.lit(0)
    constant = lambda values: F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")
    value = doc_id.cast("double")
    below = lambda array: F.size(F.filter(array, lambda b: b <= value))
    coarse = below(constant(bounds[STEP - 1 :: STEP])) if len(bounds) >= STEP else F.lit(0)
    return coarse * STEP + below(F.slice(constant(bounds), coarse * STEP + 1, STEP))


def _with_next(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text``, ``fp`` and the next document's ``next_text``, ``next_fp``.

    Ids are cut into ranges of about 500 documents by approximate quantiles; the first document of each
    range also visits the range before it, so order is found within ranges and texts are shuffled once.
    What comes to the driver is one id per range, of which there are 65,536 at most.
    """
    spark = docs.sparkSession
    known = docs.where("doc_id is not null")
    n = min(MOST_BUCKETS, -(-known.count() // PER_BUCKET))
    bounds = sorted(set(known.approxQuantile("doc_id", [i / n for i in range(1, n)], 1 / (4 * n)))) if n > 1 else []
    placed = known.withColumn("_bucket", _bucket(F.col("doc_id"), bounds)).withColumn("_guest", F.lit(0))
    firsts = sorted(tuple(r) for r in placed.groupBy("_bucket").agg(F.min("doc_id")).collect())
    visits = [(first, firsts[i - 1][0]) for i, (_, first) in enumerate(firsts)]
    visiting = F.broadcast(spark.createDataFrame(visits, "doc_id long, _bucket int"))
    guests = known.join(visiting, "doc_id").select("doc_id", "text", "_bucket", F.lit(1).alias("_guest"))
    rows = placed.unionByName(guests).repartition("_bucket")
    rows = add_fingerprint(rows, "text", "fp")
    order = Window.partitionBy("_bucket").orderBy("_guest", "doc_id", "text")
    rows = rows.select(
        "doc_id", "text", "fp", "_guest", F.lead("text").over(order).alias("next_text"), F.lead("fp").over(order).alias("next_fp")
    ).where("_guest = 0")
    alone = add_fingerprint(docs.where("doc_id is null"), "text", "fp")
    alone = alone.select("doc_id", "text", "fp", F.col("text").alias("next_text"), F.col("fp").alias("next_fp"))
    return rows.drop("_guest").unionByName(alone)


def edit_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, whose second half is the start of the next document.

    One row per row of ``docs``; null text is empty. Rows that repeat an id follow each other by text; a row
    without an id is its own next document, as is the only row of a table. Other columns are not looked at.
    """
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = _with_next(plain).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    kept = F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half)
    rows = rows.withColumn("edited", F.concat(kept, F.substring(F.col("next_text"), F.lit(1), half)))
    rows = add_fingerprint(rows, "edited", "edited_fp")
    for name in ("fp", "edited_fp", "next_fp"):
        rows = rows.withColumn(name, F.col(f"{name}.hash"))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        digest(F.col("fp")).alias("fingerprint"),
        digest(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
