"""Catalog queries against their SQL twins in DuckDB.

A selection by default; every query with ``--all-queries``.
"""

import math

import duckdb
import pytest

from plumbline import catalog
from plumbline.catalog.twin import TABLES

SELECTION = {
    "column_profile", "column_profile_messy", "quantiles", "histogram_fixed", "top_values_long", "column_score", "pii_content",
    "drilldown", "compare_profiles", "nway_deltas", "trends", "merge_profiles_by_name", "generate_gx", "soda_load",
    "jsonschema_load", "issue_digest", "gx_in_set", "jsonschema_enum", "distinct_estimate", "quantiles_estimate", "structure_scan", "scan_csv_quoted", "scan_many", "batch_pii", "select_paths_json", "scan_json", "sql_derived", "profile_stream", "profile_stream_full", "gx_in_set_long", "schema_tree", "potential_pii_name", "batch_compare", "batch_merge", "merge_sketched", "correlation_matrix", "correlation_pairwise", "generate_soda", "base_stats", "numeric_moments", "infer_types", "text_lengths", "histogram",
}


def pytest_generate_tests(metafunc):
    if "name" in metafunc.fixturenames:
        every = metafunc.config.getoption("--all-queries")
        metafunc.parametrize("name", sorted(n for n in catalog.queries() if every or n in SELECTION))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def canonical(columns, rows):
    def cell(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(v + 0.0)
        return str(v)

    order = sorted(columns)
    at = [columns.index(c) for c in order]
    return order, sorted(tuple(cell(r[i]) for i in at) for r in rows)


def test_query(spark, sf, duck, name):
    df = catalog.queries()[name](spark, sf)
    got = canonical(df.columns, df.collect())
    twin = catalog.oracle_sql().get(name)
    if twin is None:
        assert got[1]
        return
    result = duck.execute(twin)
    assert got == canonical([d[0] for d in result.description], result.fetchall())


def test_every_query_has_a_twin():
    assert set(catalog.queries()) == set(catalog.oracle_sql())
