"""The column profile of a table, or of many tables in one job."""

from __future__ import annotations

from collections.abc import Collection, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline import session
from plumbline.functions.pii import name_hint
from plumbline.operators import personal_data, quality, stats
from plumbline.operators.rules_gen import MAX_SET
from plumbline.operators.frequency import FrequencyTable, frequency

ALL_PARTS = frozenset({"moments", "quantiles", "histogram", "top", "samples", "pii"})
#: What comparisons, merges and rules need.
SUMMARY = frozenset({"moments"})
RULES = frozenset({"moments", "top"})


def _packed(rows: DataFrame, keys: list[str], order: str, fields: Sequence[str], name: str) -> DataFrame:
    """A few ordered rows per column (top values, bins, samples) as one array."""
    entry = F.struct(order, *fields)
    listed = F.transform(
        F.array_sort(F.collect_list(entry)),
        lambda e: e[fields[0]] if len(fields) == 1 else F.struct(*[e[f].alias(f) for f in fields]),
    )
    return rows.groupBy(*keys).agg(listed.alias(name))


def profile(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    by: str | None = None,
    row_order: str | None = None,
    parts: Collection[str] = ALL_PARTS,
) -> DataFrame:
    """One row per column (and per value of ``by``), written to the shared folder.

    ``parts`` leaves out work a caller does not need. ``row_order`` names a column giving
    the order of rows, for the sample values and the personal-data check; without it the
    scan order counts.
    """
    parts = set(parts)
    source, order = df, row_order
    if parts & {"samples"} and order is None:
        source = df.withColumn("_row", F.monotonically_increasing_id())
        order = "_row"
    names = list(columns) if columns is not None else [c for c in df.columns if c != by]
    ft = frequency(source, names, by, order if "samples" in parts else None, materialized=True)
    return finished(ft, parts, df)


def finished(ft: FrequencyTable, parts: Collection[str] = ALL_PARTS, source: DataFrame | None = None) -> DataFrame:
    """The whole profile of a frequency table, written to the shared folder."""
    out = profile_frequencies(ft, parts, source)
    if "pii" not in parts:
        # like the check of contents, the name counts where there are cells
        out = out.withColumn("pii_type", F.when(F.col("total_valid") > 0, name_hint(F.col("column"))))
    return session.materialize(quality.with_quality(out, "pii_type"), "profile")


def profile_frequencies(ft: FrequencyTable, parts: Collection[str], source: DataFrame | None = None) -> DataFrame:
    """The profile rows of a frequency table, before quality is judged."""
    keys, bound = ft.keys, ft.max_profiles
    # value sets of rules hold more values than a report shows
    top_size = max(MAX_SET, stats.TOP_VALUES)
    base = session.materialize(stats.base_stats(ft), "base")
    extras: dict[str, DataFrame] = {}
    if set(parts) & {"moments", "quantiles", "histogram"}:
        sliced = session.materialize(stats.slices(ft, base), "slices")
        if "moments" in parts:
            extras["moments"] = stats.moments(ft, base, sliced).select(
                *keys, "variance", "std_dev", "skewness", "kurtosis")
        if "quantiles" in parts:
            extras["quantiles"] = stats.quantiles_wide(ft, base, sliced).drop("column")
        if "histogram" in parts:
            bins = stats.histogram(ft, base, sliced)
            extras["histogram"] = _packed(bins, keys, "bin", ["start", "end", "n"], "histogram")
    if "top" in parts:
        top = stats.top_values(ft, base, source, top_size)
        extras["top_values"] = _packed(top, keys, "position", ["value", "n", "percentage"], "top_values")
    if "samples" in parts:
        extras["samples"] = _packed(stats.sample_values(ft, source), keys, "position", ["value"], "sample_values")
    if "pii" in parts:
        extras["pii"] = personal_data.detect_values(ft).select(*keys, "pii_type")
    out = base
    for table in session.materialize_all(extras).values():
        out = out.join(session.bounded(table, bound), keys, "left")
    return out


def table_profile(df: DataFrame, column_profile: DataFrame) -> DataFrame:
    """One row about the whole table: rows, columns, duplicate rows, issues, health score."""
    repeated = stats.duplicate_rows(df)
    cells = F.sum("count")
    facts = column_profile.agg(
        F.count(F.lit(1)).cast("int").alias("columns"),
        F.coalesce(F.round(F.sum(F.col("count") - F.col("missing")) / F.nullif(cells, F.lit(0)) * 100, 1), F.lit(0.0)).alias("health"),
    )
    found = quality.duplicate_issue(F.col("duplicate_rows"), F.col("duplicate_pct"))
    return repeated.withColumns({
        "total_columns": facts.select("columns").scalar(),
        "health_score": facts.select("health").scalar(),
        "duplicate_issues": F.array_compact(F.array(found)),
    })
