"""Taxon categories. Each document has the path ``top/<language>/<source>``, and one more for each of
its positive labels, so that documents of one, several and no categories occur."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.catalog.common import table
from corpusloom.functions.taxons import cut_taxon
from corpusloom.operators import corpus, taxonomy
from corpusloom.operators.ordering import ordered_positions
from corpusloom.session import materialize

REMOVE = ("en_src0", "de_src1", "mark_good")
MERGE = {"en_src1": "en_merged", "en_src2": "en_merged", "fr_src3": "fr_src4"}


def doc_paths(spark, sf):
    documents = table(spark, sf, "documents")
    marks = table(spark, sf, "labels")
    return (
        documents.select("doc_id", F.concat(F.lit("top/"), "lang", F.lit("/"), "source").alias("path"))
        .unionByName(marks.where("quality = 1").select("doc_id", F.lit("top/mark/good").alias("path")))
        .unionByName(marks.where("toxic = 1").select("doc_id", F.lit("top/mark/toxic/strong").alias("path")))
    )


def taxon_tables(spark, sf):
    """``taxons(taxon_id, path)`` in path order, and ``doc_taxon(doc_id, taxon_id, n)``."""
    paths = doc_paths(spark, sf)
    taxons = materialize(ordered_positions(paths.select("path").distinct(), ["path"], "taxon_id"), "taxons")
    doc_taxon = paths.join(taxons, "path").select("doc_id", "taxon_id", F.lit(1).alias("n"))
    return taxons.select("taxon_id", "path"), doc_taxon


def _rolled(spark, sf):
    taxons, doc_taxon = taxon_tables(spark, sf)
    categories = taxonomy.taxon_categories(taxons, 2)
    return categories, taxonomy.roll_up(doc_taxon, categories, "taxon_id", "category_id")


def _deep(spark, sf):
    """Categories at depth 3 and each document's entries in them."""
    taxons, doc_taxon = taxon_tables(spark, sf)
    categories = taxonomy.taxon_categories(taxons, 3)
    entries = taxonomy.binarise(taxonomy.roll_up(doc_taxon, categories, "taxon_id", "category_id"))
    return categories.select("category_id", "category").distinct(), entries


def _per_category(spark, sf):
    names, entries = _deep(spark, sf)
    return taxonomy.docs_per_category(entries, names)


def _marks(spark, sf):
    marks = table(spark, sf, "labels")
    return (
        marks.where("quality = 1").select("doc_id", F.lit(0).cast("bigint").alias("category_id"))
        .unionByName(marks.where("toxic = 1").select("doc_id", F.lit(1).cast("bigint").alias("category_id")))
    )


def _documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id")


def _partition(spark, sf):
    return taxonomy.partition_single_label(_documents(spark, sf), _marks(spark, sf))


def _merge(spark, sf):
    names, _ = _deep(spark, sf)
    remove = names.where(F.col("category").isin(list(REMOVE)))
    return taxonomy.merge_categories(names, remove, MERGE)


def _cut(spark, sf):
    taxons, _ = taxon_tables(spark, sf)
    return taxons.select("path", *[cut_taxon("path", d).alias(f"depth_{d}") for d in (1, 2, 3, 4)])


def _bodies(spark, sf):
    ids = _partition(spark, sf).where("split = 'sup'")
    return corpus.select_bodies(table(spark, sf, "documents").select("doc_id", "text"), ids)


PATHS = """
SELECT doc_id, 'top/' || lang || '/' || source AS path FROM documents
UNION ALL SELECT doc_id, 'top/mark/good' FROM labels WHERE quality = 1
UNION ALL SELECT doc_id, 'top/mark/toxic/strong' FROM labels WHERE toxic = 1"""

TAXA = f"""paths AS ({PATHS}),
taxons AS (SELECT path, row_number() OVER (ORDER BY path) - 1 AS taxon_id FROM (SELECT DISTINCT path FROM paths))"""


def _category(depth):
    p = "string_split(path, '/')"
    if depth == 1:
        return f"{p}[2]"
    return f"CASE WHEN len({p}) >= {depth} THEN array_to_string({p}[2:{depth}], '_') ELSE {p}[2] END"


def category_ctes(depth):
    """CTEs cats(taxon_id, category, category_id) and entries(doc_id, category_id, category, n)."""
    return f"""{TAXA},
    named AS (SELECT taxon_id, path, {_category(depth)} AS category FROM taxons),
    ids AS (SELECT category, row_number() OVER (ORDER BY min(taxon_id)) - 1 AS category_id FROM named GROUP BY category),
    cats AS (SELECT taxon_id, path, category, category_id FROM named JOIN ids USING (category)),
    entries AS (SELECT doc_id, category_id, any_value(category) AS category, count(*) AS n
                FROM paths JOIN cats USING (path) GROUP BY doc_id, category_id)"""


_PER_CATEGORY = f"""WITH {category_ctes(3)}
SELECT category_id, category, count(DISTINCT doc_id) AS n_docs FROM ids LEFT JOIN entries USING (category_id, category)
GROUP BY ALL"""

_MARKS = """SELECT doc_id, coalesce(quality, 0) + coalesce(toxic, 0) AS n_labels,
       CASE WHEN quality + toxic = 1 THEN CASE WHEN quality = 1 THEN 0 ELSE 1 END END AS label
FROM documents LEFT JOIN labels USING (doc_id)"""

QUERIES = {
    "taxon_cut": (
        _cut,
        f"WITH {TAXA} SELECT path, " + ", ".join(f"{_category(d)} AS depth_{d}" for d in (1, 2, 3, 4)) + " FROM taxons",
    ),
    "taxon_map": (
        lambda spark, sf: taxonomy.taxon_categories(taxon_tables(spark, sf)[0], 3),
        f"WITH {category_ctes(3)} SELECT taxon_id, category, category_id FROM cats",
    ),
    "taxon_rollup": (
        lambda spark, sf: _rolled(spark, sf)[1],
        f"WITH {category_ctes(2)} SELECT doc_id, category_id, n FROM entries",
    ),
    "taxon_binary": (
        lambda spark, sf: taxonomy.binarise(_rolled(spark, sf)[1]),
        f"WITH {category_ctes(2)} SELECT doc_id, category_id, CAST(1 AS BIGINT) AS n FROM entries WHERE n <> 0",
    ),
    "docs_per_category": (_per_category, _PER_CATEGORY),
    "bottom_k_categories": (
        lambda spark, sf: taxonomy.rarest_categories(_per_category(spark, sf)),
        f"SELECT * FROM ({_PER_CATEGORY}) ORDER BY n_docs, category LIMIT 13",
    ),
    "category_removal": (
        lambda spark, sf: taxonomy.removal_list(_per_category(spark, sf), named=REMOVE),
        f"""SELECT category FROM (SELECT category FROM ({_PER_CATEGORY}) ORDER BY n_docs, category LIMIT 13)
            UNION SELECT unnest(['en_src0', 'de_src1', 'mark_good'])""",
    ),
    "category_merge": (
        _merge,
        f"""WITH {category_ctes(3)},
            kept AS (SELECT category_id, category, CASE WHEN category IN ('en_src1', 'en_src2') THEN 'en_merged'
                       WHEN category = 'fr_src3' THEN 'fr_src4' ELSE category END AS new_category
                     FROM ids WHERE category NOT IN ('en_src0', 'de_src1', 'mark_good')),
            new AS (SELECT new_category, row_number() OVER (ORDER BY min(category_id)) - 1 AS new_id FROM kept GROUP BY 1)
            SELECT category_id, category, new_category, new_id FROM kept JOIN new USING (new_category)""",
    ),
    "labels_per_doc": (
        lambda spark, sf: taxonomy.labels_per_doc(_documents(spark, sf), _marks(spark, sf)).select("doc_id", "n_labels"),
        f"SELECT doc_id, CAST(n_labels AS BIGINT) AS n_labels FROM ({_MARKS})",
    ),
    "single_label_partition": (
        lambda spark, sf: _partition(spark, sf).select("doc_id", "split"),
        f"SELECT doc_id, CASE WHEN n_labels = 1 THEN 'sup' ELSE 'unsup' END AS split FROM ({_MARKS})",
    ),
    "single_label_value": (
        lambda spark, sf: _partition(spark, sf).where("split = 'sup'").select("doc_id", "label"),
        f"SELECT doc_id, CAST(label AS BIGINT) AS label FROM ({_MARKS}) WHERE n_labels = 1",
    ),
    "body_semi_join": (_bodies, f"SELECT doc_id, text FROM documents WHERE doc_id IN (SELECT doc_id FROM ({_MARKS}) WHERE n_labels = 1)"),
}
