"""Merkle manifest of a dataset: a tree of documents per language, a tree of their roots, and a proof for every row.

A leaf's rank among its language's leaves is cut into digits. The digits are grouped away one after the other, lowest
first, within blocks of ``BLOCK`` consecutive ranks: what a digit's group holds becomes a nested struct with the
hashes of its levels. The roots of the blocks are the leaves of the next layer, as often as a tree has several
blocks, so no row grows with the table. On the way back a block gets the path above it by a union and a grouping, and
a last transform and explode emit the proofs of its leaves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.ordering import ordered_positions
from corpusloom.session import materialize

DIGIT = 5  # bits of a digit of the rank
BLOCK = 1 << 2 * DIGIT  # leaves below one row, two digits
TAMPERED = 7
PATH = "array<struct<sibling: string, left: boolean>>"
ROW = (1 << 33) - 1  # low bits of monotonically_increasing_id: the row within its partition


def field(value: Column) -> Column:
    """Byte count, ``:`` and value as text; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def _height(leaves: Column) -> Column:
    """Levels above the leaves of a tree: the bits of the last rank."""
    return F.when(leaves > 1, F.length(F.bin(leaves - 1))).otherwise(0)


def _levels(hashes: Column, height: Column) -> Column:
    """``hashes`` and ``height`` levels above them: two neighbours make a node, and so does a last one alone."""

    def above(below: Column) -> Column:
        halves = F.sequence(F.lit(0), F.shiftright(F.size(below) - 1, 1))
        return F.transform(halves, lambda i: F.sha2(F.concat(F.get(below, 2 * i), F.coalesce(F.get(below, 2 * i + 1), F.lit(""))), 256))

    steps = F.slice(F.sequence(F.lit(0), height), 2, height)
    return F.aggregate(steps, F.array(hashes), lambda levels, _: F.concat(levels, F.array(above(F.element_at(levels, -1)))))


def _path(levels: Column, place: Column) -> Column:
    """Siblings of the node at ``place`` of the lowest level, level by level; the root of ``levels`` has none."""

    def sibling(level: Column, height: Column) -> Column:
        at = F.call_function("shiftright", place, height)
        return F.struct(F.get(level, at.bitwiseXOR(F.lit(1))).alias("sibling"), (at % 2 == 1).alias("left"))

    return F.transform(F.slice(levels, F.lit(1), F.size(levels) - 1), sibling)


def _nest(rows: DataFrame, carry: list[str]) -> DataFrame:
    """A row per block of ``rows`` (``tree``, ``rank``, ``n`` leaves of the tree, ``hash``, and ``carry``)."""
    digits = {
        "d0": F.col("rank").bitwiseAND(F.lit((1 << DIGIT) - 1)).cast("int"),
        "d1": F.shiftright("rank", DIGIT).bitwiseAND(F.lit((1 << DIGIT) - 1)).cast("int"),
        "block": F.shiftright("rank", 2 * DIGIT),
    }
    dealt = rows.withColumns(digits).repartition("tree", "block")
    height = _height(F.col("n")).cast("int")
    low = F.least(height, F.lit(DIGIT))
    high = F.least(height - low, F.lit(DIGIT))
    members = F.sort_array(F.collect_list(F.struct("d0", "hash", *carry)))
    lowest = dealt.groupBy("tree", "n", "block", "d1").agg(members.alias("members"))
    lowest = lowest.withColumn("levels", _levels(F.col("members.hash"), low))
    groups = lowest.groupBy("tree", "n", "block").agg(F.sort_array(F.collect_list(F.struct("d1", "levels", "members"))).alias("groups"))
    tops = F.transform("groups", lambda g: F.element_at(g["levels"], -1)[0])
    return groups.withColumn("levels", _levels(tops, high)).withColumn("hash", F.element_at("levels", -1)[0])


def rollup(rows: DataFrame, carry: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """Layers of blocks, each written, and the roots (``tree``, ``hash``) of ``rows``; see ``_nest``."""
    layers = []
    while True:
        layers.append(materialize(_nest(rows, [] if layers else carry), "merkle-blocks"))
        tops = layers[-1].select("tree", F.col("block").alias("rank"), F.ceil(F.col("n") / BLOCK).alias("n"), "hash")
        if layers[-1].where(F.col("n") > BLOCK).isEmpty():
            return layers, tops.select("tree", "hash")
        rows = tops


def unroll(layers: list[DataFrame], roots: DataFrame, carry: list[str]) -> DataFrame:
    """``tree``, ``hash``, ``carry``, ``path`` and ``subroot`` of every leaf, from the paths of the ``roots`` (``tree``, ``path``, ``subroot``)."""
    above = roots.select("tree", F.lit(0).cast("long").alias("block"), "path", "subroot")
    for layer in reversed(layers):
        own = [] if layer is not layers[0] else ["hash", *carry]
        blocks = layer.select("tree", "block", F.struct("groups", "levels").alias("nested"))
        both = blocks.unionByName(above, allowMissingColumns=True).groupBy("tree", "block")
        whole = both.agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("nested", "path", "subroot")])

        def leaves(group: Column) -> Column:
            outer = _path(F.col("nested.levels"), group["d1"])
            return F.transform(
                group["members"],
                lambda m: F.struct(
                    (F.shiftleft(F.col("block"), 2 * DIGIT) + F.shiftleft(group["d1"], DIGIT) + m["d0"]).alias("rank"),
                    F.concat(_path(group["levels"], m["d0"]), outer, F.col("path")).alias("path"),
                    *[m[c].alias(c) for c in own],
                ),
            )

        emitted = whole.select("tree", "subroot", F.explode(F.flatten(F.transform("nested.groups", leaves))).alias("leaf"))
        above = emitted.select("tree", "subroot", "leaf.*")
        if not own:
            above = above.withColumnRenamed("rank", "block")
    return above.drop("rank")


def ranked(leaves: DataFrame) -> DataFrame:
    """``leaves`` (``tree``, ``doc_id``, ``hash``, ...) with ``rank`` in the tree and the tree's size ``n``.

    Ranges of the order balance the tasks whatever a tree holds: rows that repeat an id, and even the whole document, are told
    apart by a number of their own.
    """
    order = ["tree", "doc_id", "hash", "row"]
    placed = materialize(
        leaves.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id().bitwiseAND(F.lit(ROW))}),
        "merkle-order",
    )
    # A row per tree and range; a range's rows of a tree stand in a row, so their places follow from its first.
    runs = placed.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("size"), F.min("at").alias("first"))
    of_tree = Window.partitionBy("tree")
    starts = runs.select(
        F.col("tree").alias("_tree"),
        F.col("part").alias("_part"),
        (F.sum("size").over(of_tree.orderBy("part")) - F.col("size") - F.col("first")).alias("shift"),
        F.sum("size").over(of_tree).alias("n"),
    )
    starts = materialize(starts, "merkle-starts")
    joined = placed.join(starts, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("part") == F.col("_part")))
    return joined.withColumn("rank", F.col("at") + F.col("shift")).drop("_tree", "_part", "part", "at", "shift", "row")


def fold(hash: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path give."""

    def step(node: Column, at: Column) -> Column:
        other = F.coalesce(at["sibling"], F.lit(""))
        return F.sha2(F.when(at["left"], F.concat(other, node)).otherwise(F.concat(node, other)), 256)

    return F.aggregate(path, hash, step)


def manifest(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root``, ``verified``.

    Leaves of a language (null is one, the first) ascend by id, null ids first, rows that repeat an id by hash; equal rows have a leaf each. A row whose id's
    crc32 is divisible by 7 is checked after tampering, which adds 1 to ``n_chars``; null ids and null ``n_chars`` stay. The proof's digest
    is that of all siblings, the empty text's if there are none. Other columns are not looked at. No rows give no rows.
    """
    own = [F.col(c) for c in ("doc_id", "source", "lang")]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0
    leaves = docs.select(
        F.col("lang").alias("tree"),
        "doc_id",
        leaf_hash(*own, F.col("n_chars"), F.col("text")).alias("hash"),
        F.when(tampered & F.col("n_chars").isNotNull(), leaf_hash(*own, F.col("n_chars") + 1, F.col("text"))).alias("other"),
    )
    leaves = materialize(leaves, "merkle-leaves").withColumn("row", F.monotonically_increasing_id())
    layers, subroots = rollup(ranked(leaves), ["doc_id", "other"])
    subroots = materialize(subroots.withColumnRenamed("tree", "lang").withColumnRenamed("hash", "subroot"), "merkle-subroots")
    placed = ordered_positions(subroots, [F.col("lang").asc_nulls_first()], "rank")
    whole = F.lit(0).alias("tree")
    top, root = rollup(placed.select(whole, "rank", F.lit(subroots.count()).cast("long").alias("n"), F.col("subroot").alias("hash"), "lang"), ["lang"])
    found = root.first()
    start = root.select("tree", F.array().cast(PATH).alias("path"), F.col("hash").alias("subroot"))
    paths = unroll(top, start, ["lang"]).select(F.col("lang").alias("tree"), "path", F.col("hash").alias("subroot"))
    proofs = unroll(layers, paths, ["doc_id", "other"])
    folded = fold(F.coalesce("other", "hash"), F.col("path"))
    siblings = F.transform(F.filter("path", lambda p: p["sibling"].isNotNull()), lambda p: p["sibling"])
    result = proofs.select(
        "doc_id",
        F.col("hash").alias("leaf"),
        "subroot",
        F.lit(found["hash"] if found else None).cast("string").alias("root"),
        F.sha2(F.array_join(siblings, ""), 256).alias("proof_sha256"),
        folded.alias("folded_root"),
    )
    return result.withColumn("verified", F.col("folded_root") == F.col("root"))


_CRC = """list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))"""


def _field_sql(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}::VARCHAR, '-')"


def _leaf_sql(n_chars: str) -> str:
    return f"sha256(concat({', '.join(map(_field_sql, ('doc_id', 'source', 'lang', n_chars, 'text')))}))"


SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, lang, {_leaf_sql('n_chars')} AS leaf,
    CASE WHEN doc_id IS NOT NULL AND n_chars IS NOT NULL AND xor({_CRC}, 4294967295) % {TAMPERED} = 0 THEN {_leaf_sql('(n_chars + 1)')} END AS other
  FROM documents
), placed AS (
  SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, count(*) OVER (PARTITION BY lang) AS n,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
  FROM leaves
), nodes AS (
  SELECT tree, 0 AS level, pos, n, leaf AS hash FROM placed
  UNION ALL
  SELECT tree, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(hash, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY tree, level, pos // 2, n
), subroots AS (
  SELECT tree, hash, count(*) OVER () AS n FROM nodes WHERE n = 1
), tops AS (
  SELECT 0 AS level, tree AS pos, n, hash FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(hash, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY level, pos // 2, n
), below AS (
  SELECT p.tree, p.pos, string_agg(s.hash, '' ORDER BY s.level) AS siblings
  FROM placed p JOIN nodes s ON s.tree = p.tree AND s.n > 1 AND s.pos = xor(p.pos >> s.level, 1) GROUP BY ALL
), above AS (
  SELECT r.tree, string_agg(s.hash, '' ORDER BY s.level) AS siblings
  FROM subroots r JOIN tops s ON s.n > 1 AND s.pos = xor(r.tree >> s.level, 1) GROUP BY ALL
), climbing AS (
  SELECT tree, pos AS leaf_pos, 0 AS level, pos, n, coalesce(other, leaf) AS hash FROM placed
  UNION ALL
  SELECT c.tree, leaf_pos, c.level + 1, c.pos // 2, (c.n + 1) // 2,
    sha256(CASE WHEN c.pos % 2 = 1 THEN s.hash || c.hash ELSE c.hash || coalesce(s.hash, '') END)
  FROM climbing c LEFT JOIN nodes s ON s.tree = c.tree AND s.level = c.level AND s.pos = xor(c.pos, 1) WHERE c.n > 1
), folding AS (
  SELECT c.tree, leaf_pos, 0 AS level, c.tree AS pos, r.n, c.hash FROM climbing c JOIN subroots r ON r.tree = c.tree WHERE c.n = 1
  UNION ALL
  SELECT f.tree, leaf_pos, f.level + 1, f.pos // 2, (f.n + 1) // 2,
    sha256(CASE WHEN f.pos % 2 = 1 THEN s.hash || f.hash ELSE f.hash || coalesce(s.hash, '') END)
  FROM folding f LEFT JOIN tops s ON s.level = f.level AND s.pos = xor(f.pos, 1) WHERE f.n > 1
)
SELECT p.doc_id, p.leaf, r.hash AS subroot, t.hash AS root, sha256(concat(b.siblings, a.siblings)) AS proof_sha256,
  f.hash AS folded_root, f.hash = t.hash AS verified
FROM placed p
JOIN subroots r ON r.tree = p.tree
JOIN folding f ON f.tree = p.tree AND f.leaf_pos = p.pos AND f.n = 1
JOIN (SELECT hash FROM tops WHERE n = 1) t ON true
LEFT JOIN below b ON b.tree = p.tree AND b.pos = p.pos
LEFT JOIN above a ON a.tree = p.tree
"""
