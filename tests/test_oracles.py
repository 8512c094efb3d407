"""Registered queries against their SQL on the small tables; FULL_ORACLES=1 runs all of them."""

import datetime
import os

import duckdb
import pytest

from nodeloom.plans import catalog

QUICK = "b01_validate b05_ghosts b06_simple_graph b06_simple_digraph b16_merge_external b25_sanitized_nodes g01_god_nodes g07_surprise_scores g14_graph_diff g22_cohesion g25_diagnose g29_lessons q08_seeds q13_bfs q16_text_budget q17_query_graph q23_shortest_path g34_token_reduction q27_affected d12_verified_pairs d13_components i01_changes i04_file_hash i10_rebuilt_edges x09_imported_calls s03_paper_signals t01_debounced k02_cypher p3_found".split()
NAMES = sorted(catalog.SQL) if os.environ.get("FULL_ORACLES") else QUICK


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return str(v) if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in cols) for r in df.collect()]
    cur = duck.execute(catalog.SQL[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    want = [tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_every_query_is_registered_with_its_sql():
    assert set(catalog.SQL) <= set(catalog.QUERIES)
