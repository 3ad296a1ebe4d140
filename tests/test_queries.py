"""Queries against their SQL on the smallest tables, and the shape of the registry."""

from __future__ import annotations

import os

import duckdb
import pytest

from parlance.plans import registry

#: One or two queries of every module; the others run against their SQL in the driver's gate.
NAMES = (
    "tokenize_terms", "coarse_category", "classify_constraint", "classify_kind", "parse_price", "first_attribute",
    "weighted_postings", "popularity_prior", "bm25_topk", "intent_card", "customer_reply", "constraint_score",
    "parse_openings", "parse_replies", "state_turns", "price_partition", "choose_question", "composite_rollup",
    "apportion_scenarios", "popularity_summary", "normalize_recommendations", "llm_permutation", "perturb_heavy",
)


def _plain(value):
    if value is None or isinstance(value, float) and value != value:
        return "-"
    return repr(float(value)) if isinstance(value, float) else str(value)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for f in os.listdir(small):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{small}/{f}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, small, duck, name):
    df = registry.QUERIES[name](spark, small)
    found = duck.sql(registry.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(found.columns)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(found.columns, found.fetchall())


def test_sql_has_queries():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["query", "doc", "score", "rank"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
