import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from plumbline import session  # noqa: E402

SF = "/root/testdata/sf0.001"


def pytest_addoption(parser):
    parser.addoption("--all-queries", action="store_true", help="check every catalog query against DuckDB")


@pytest.fixture(scope="session")
def spark():
    s = session.build_session(
        "tests", "local[4]",
        **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"},
    )
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


def rows(df, *columns):
    """Rows as sorted tuples."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)


def by_column(df):
    return {r["column"]: r for r in df.collect()}
