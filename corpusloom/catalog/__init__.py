"""Registered queries over the test tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from corpusloom.catalog import bags, corpora, files, ordering, outputs, standard_runs, taxa, texts, topics

MODULES = (texts, ordering, bags, topics, taxa, corpora, files, outputs, standard_runs)


def queries() -> dict:
    return {name: query for module in MODULES for name, (query, _) in module.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for module in MODULES for name, (_, sql) in module.QUERIES.items() if sql is not None}
