"""Queries over the given tables, each with its SQL twin."""

from plumbline.catalog import twin


def _load() -> None:
    from plumbline.catalog import (  # noqa: F401  registering is what importing them does
        columns,
        comparing,
        nested,
        ruling,
        statements,
    )


def queries():
    _load()
    return dict(twin.QUERIES)


def oracle_sql():
    _load()
    return dict(twin.TWINS)
