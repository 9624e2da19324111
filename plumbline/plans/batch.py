"""Profiles of a batch of datasets: side by side, merged, or compared with a baseline."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from plumbline import session
from plumbline.operators import compare, merge
from plumbline.plans.profile import ALL_PARTS, SUMMARY, profile


@dataclass(frozen=True)
class MergeResult:
    schema_check: DataFrame
    merged: DataFrame | None


@dataclass(frozen=True)
class CompareResult:
    deltas: DataFrame
    trends: DataFrame


def batch_profile(df: DataFrame, dataset: str, columns: list[str] | None = None, parts=ALL_PARTS) -> DataFrame:
    """Every dataset profiled in one job grouped by dataset and column."""
    return profile(df, columns, by=dataset, parts=parts)


def batch_merge(profiles: DataFrame, dataset: str, order: str, baseline: str, forced: bool = False,
                sketched: DataFrame | None = None) -> MergeResult:
    """Check that the schemas agree, then merge; nothing is merged when they do not, unless forced.

    With the ``sketched`` columns of the datasets, distinct count and median of all rows are estimated too.
    """
    datasets = profiles.select(dataset).distinct().limit(2).count()
    if datasets < 2:
        raise ValueError("merging needs at least two datasets")
    check = compare.batch_schema_check(profiles, dataset, baseline)
    agreed = check.select("all_compatible").head()[0]
    merged = merge.merge_by_name(profiles, order, sketched) if agreed or forced else None
    return MergeResult(check, merged)


def batch_compare(profiles: DataFrame, dataset: str, baseline: str, max_columns: int) -> CompareResult:
    """Deltas of every dataset from the baseline, then the trend of each column."""
    deltas = session.materialize(compare.nway_deltas(profiles, dataset, baseline, max_columns), "deltas")
    return CompareResult(deltas, compare.trends(deltas))


__all__ = ["batch_compare", "batch_merge", "batch_profile", "CompareResult", "MergeResult", "SUMMARY"]
