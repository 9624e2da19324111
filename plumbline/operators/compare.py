"""Differences between column-profile tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline import session
from plumbline.functions.numeric import percent_change, share

# Smallest difference that counts, stable band, volatile share, change worth reporting.
SAME, STABLE, VOLATILE, SIGNIFICANT_PCT = 0.0001, 0.01, 0.5, 5.0
METRICS = ("mean", "std_dev", "missing_pct", "distinct", "min", "max")
LOWER_IS_BETTER = ("std_dev", "missing_pct", "null_rate")
STATUS_ORDER = ("removed", "added", "modified", "unchanged")


def _direction(delta: Column, lower_is_better: bool) -> Column:
    up, down = ("degraded", "improved") if lower_is_better else ("improved", "degraded")
    return (
        F.when(delta.isNull(), "na").when(F.abs(delta) < SAME, "unchanged").when(delta > 0, up).otherwise(down)
    )


def _side(profile: DataFrame, tag: str) -> DataFrame:
    pct = share(F.col("missing"), F.col("count")) * 100
    return profile.select(
        "column", F.lit(True).alias(f"in_{tag}"), F.col("inferred_type").alias(f"type_{tag}"),
        pct.alias(f"missing_pct_{tag}"), F.col("distinct").cast("double").alias(f"distinct_{tag}"),
        *[F.col(m).alias(f"{m}_{tag}") for m in ("mean", "std_dev", "min", "max")],
    )


def compare_profiles(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row per column of either profile: status, types, and both values, delta, percentage
    and direction of every metric."""
    joined = _side(a, "a").join(_side(b, "b"), "column", "full")
    both = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
    out: dict[str, Column] = {}
    for m in METRICS:
        left, right = F.col(f"{m}_a"), F.col(f"{m}_b")
        some = both & (left.isNotNull() | right.isNotNull())
        delta = right - left
        out[f"{m}_delta"] = F.when(both, delta)
        out[f"{m}_pct"] = F.when(both, percent_change(left, right))
        out[f"{m}_direction"] = F.when(some, _direction(delta, m in LOWER_IS_BETTER))
    changed = F.col("type_a") != F.col("type_b")
    moved = changed
    for m in ("mean", "std_dev", "missing_pct", "distinct"):
        moved = moved | F.coalesce(out[f"{m}_direction"] != "unchanged", F.lit(False))
    status = (
        F.when(F.col("in_b").isNull(), "removed").when(F.col("in_a").isNull(), "added")
        .when(moved, "modified").otherwise("unchanged")
    )
    return joined.select(
        "column", status.alias("status"), "type_a", "type_b",
        F.coalesce(changed, F.lit(False)).alias("type_changed"),
        *[c for m in METRICS for c in (
            F.col(f"{m}_a"), F.col(f"{m}_b"), *[out[f"{m}_{p}"].alias(f"{m}_{p}") for p in ("delta", "pct", "direction")]
        )],
    )


def compare_summary(comparison: DataFrame) -> DataFrame:
    return comparison.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("added", "removed", "modified", "unchanged")],
    )


def sort_comparison(comparison: DataFrame) -> DataFrame:
    rank = F.array_position(F.array(*[F.lit(s) for s in STATUS_ORDER]), F.col("status"))
    return comparison.orderBy(rank, "column")


def filter_comparison(comparison: DataFrame, status: str | None = None, part: str | None = None) -> DataFrame:
    out = comparison
    if status:
        out = out.filter(F.col("status") == status)
    if part:
        out = out.filter(F.contains(F.lower("column"), F.lit(part.lower())))
    return out


def comparison_report(comparison: DataFrame) -> DataFrame:
    """The columns of the printed comparison."""
    return comparison.select(
        "column", "status", "type_a", "type_b", "missing_pct_a", "missing_pct_b", "mean_a", "mean_b"
    )


# --- schemas -----------------------------------------------------------------

def columns_added(a: DataFrame, b: DataFrame) -> DataFrame:
    return b.select("column").join(a.select("column"), "column", "left_anti")


def columns_removed(a: DataFrame, b: DataFrame) -> DataFrame:
    return columns_added(b, a)


def columns_all(profiles: DataFrame, dataset: str, dataset_order: str) -> DataFrame:
    """Every column name once, ordered by where it is first seen."""
    seen = F.min(F.struct(F.col(dataset_order).alias("first_dataset"), F.col("ordinal").alias("first_ordinal")))
    return profiles.groupBy("column").agg(seen.alias("at")).select("column", "at.*")


def schema_signature(profile: DataFrame, keys: list[str]) -> DataFrame:
    """Lower-cased ``name:type`` list in sorted order, and its digest."""
    entry = F.concat_ws(":", F.lower("column"), F.lower("inferred_type"))
    return profile.groupBy(*keys).agg(
        F.array_join(F.array_sort(F.collect_list(entry)), "|").alias("signature")
    ).withColumn("digest", F.sha2("signature", 256))


def schema_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row per difference: added, removed or type_changed."""
    left = a.select("column", F.col("inferred_type").alias("from_type"))
    right = b.select("column", F.col("inferred_type").alias("to_type"))
    change = (
        F.when(F.col("from_type").isNull(), "added").when(F.col("to_type").isNull(), "removed")
        .when(F.col("from_type") != F.col("to_type"), "type_changed")
    )
    return left.join(right, "column", "full").withColumn("change", change).filter(F.col("change").isNotNull())


def batch_schema_check(profiles: DataFrame, dataset: str, baseline: str) -> DataFrame:
    """Differences of every dataset from the baseline, and whether all are compatible."""
    base = profiles.filter(F.col(dataset) == baseline).select("column", F.col("inferred_type").alias("base_type"))
    found = profiles.select(dataset, "column", "inferred_type")
    matched = found.join(base, "column", "left").groupBy(dataset).agg(
        F.count_if(F.col("base_type").isNull()).alias("added"),
        F.count_if(F.col("base_type").isNotNull()).alias("_shared"),
        F.count_if(F.col("base_type") != F.col("inferred_type")).alias("type_changes"),
    )
    width = base.agg(F.count(F.lit(1))).scalar()
    per = matched.select(
        dataset, "added", (width - F.col("_shared")).alias("removed"), "type_changes",
    ).withColumn("compatible", (F.col("added") == 0) & (F.col("removed") == 0) & (F.col("type_changes") == 0))
    return per.withColumn("all_compatible", per.agg(F.bool_and("compatible")).scalar())


# --- many datasets against a baseline ----------------------------------------

def _metrics(profile: DataFrame) -> DataFrame:
    return profile.withColumn("null_rate", share(F.col("missing"), F.col("count"), 0.0)).withColumn(
        "distinct", F.col("distinct").cast("double")
    )


NWAY_METRICS = {"row_count": "count", "null_rate": "null_rate", "distinct": "distinct", "mean": "mean",
                "std_dev": "std_dev"}


def nway_deltas(profiles: DataFrame, dataset: str, baseline: str, max_columns: int) -> DataFrame:
    """Each column of each other dataset against the baseline.

    ``presence`` tells shared, added and removed columns apart; for the shared ones every
    metric has baseline, current, delta and percentage. The baseline has at most
    ``max_columns`` rows.
    """
    metrics = _metrics(profiles)
    base = metrics.filter(F.col(dataset) == baseline).select(
        "column", F.col("inferred_type").alias("baseline_type"),
        *[F.col(c).cast("double").alias(f"{m}_baseline") for m, c in NWAY_METRICS.items()],
    )
    others = metrics.filter(F.col(dataset) != baseline).select(
        dataset, "column", F.col("inferred_type").alias("current_type"),
        *[F.col(c).cast("double").alias(f"{m}_current") for m, c in NWAY_METRICS.items()],
    )
    present = others.join(session.bounded(base, max_columns), "column", "left")
    # names a dataset lacks, from its list of column names
    known = base.agg(F.collect_set("column")).scalar()
    lacking = others.groupBy(dataset).agg(F.collect_set("column").alias("_names")).select(
        dataset, F.explode(F.array_except(known, F.col("_names"))).alias("column")
    )
    absent = lacking.join(session.bounded(base, max_columns), "column")
    joined = present.unionByName(absent, allowMissingColumns=True)
    presence = (
        F.when(F.col("baseline_type").isNull(), "added").when(F.col("current_type").isNull(), "removed")
        .otherwise("shared")
    )
    parts = []
    for m in NWAY_METRICS:
        left, right = F.col(f"{m}_baseline"), F.col(f"{m}_current")
        parts += [left, right, (right - left).alias(f"{m}_delta"), percent_change(left, right).alias(f"{m}_pct")]
    return joined.select(
        dataset, "column", presence.alias("presence"), "baseline_type", "current_type",
        F.coalesce(F.col("baseline_type") != F.col("current_type"), F.lit(False)).alias("type_changed"), *parts,
    )


def trends(deltas: DataFrame) -> DataFrame:
    """Direction of null rate, distinct count and mean of each shared column over all datasets."""
    shared = deltas.filter(F.col("presence") == "shared")
    tall = shared.select(
        "column",
        F.explode(F.array(*[
            F.struct(F.lit(m).alias("metric"), F.col(f"{m}_baseline").alias("baseline"), F.col(f"{m}_delta").alias("delta"))
            for m in ("null_rate", "distinct", "mean")
        ])).alias("at"),
    ).select("column", "at.*").filter(F.col("delta").isNotNull())
    change = F.when(F.col("baseline") == 0, F.col("delta")).otherwise(F.col("delta") / F.abs("baseline"))
    grouped = tall.withColumn("change", change).groupBy("column", "metric").agg(
        F.max("baseline").alias("baseline"),
        F.count(F.lit(1)).alias("datasets"),
        F.bool_and(F.abs("change") < STABLE).alias("all_stable"),
        F.count_if(F.col("change") > STABLE).alias("up"),
        F.count_if(F.col("change") < -STABLE).alias("down"),
        F.avg("change").alias("avg_change"),
    )
    mixed = share(F.least("up", "down"), F.col("up") + F.col("down"), 0.0)
    better = F.when(F.col("metric") == "null_rate", F.col("avg_change") < 0).otherwise(F.col("avg_change") > 0)
    direction = (
        F.when(F.col("all_stable"), "stable").when(mixed > VOLATILE, "volatile")
        .when(F.abs("avg_change") < STABLE, "stable").when(better, "improving").otherwise("degrading")
    )
    return grouped.select("column", "metric", "baseline", "datasets", "avg_change", direction.alias("direction"))


def _pct(metric: str) -> Column:
    return F.coalesce(F.abs(f"{metric}_pct"), F.lit(0.0))


def nway_summary(deltas: DataFrame, dataset: str) -> DataFrame:
    shared = F.col("presence") == "shared"
    big = (_pct("null_rate") > SIGNIFICANT_PCT) | (_pct("distinct") > SIGNIFICANT_PCT) | (_pct("mean") > SIGNIFICANT_PCT)
    return deltas.agg(
        F.count_distinct(dataset).alias("files_compared"),
        F.count_distinct(F.when(shared, F.col("column"))).alias("columns_tracked"),
        F.count_if(shared & big).alias("significant_changes"),
        F.count_if(F.col("presence") == "added").alias("added_columns"),
        F.count_if(F.col("presence") == "removed").alias("removed_columns"),
        F.count_if(shared & F.col("type_changed")).alias("type_changes"),
    )


def change_scores(deltas: DataFrame) -> DataFrame:
    """Shared columns with a score of how much they changed."""
    score = (
        F.when(F.col("type_changed"), 100.0).otherwise(0.0)
        + _pct("null_rate") + _pct("distinct") + _pct("mean") + _pct("std_dev")
    )
    return deltas.filter(F.col("presence") == "shared").withColumn("change_score", score)


def sort_most_changed(deltas: DataFrame, dataset: str) -> DataFrame:
    return change_scores(deltas).orderBy(F.desc("change_score"), dataset, "column")


def rank_changed_columns(deltas: DataFrame, by: str = "most_changed", part: str | None = None) -> DataFrame:
    """Columns over all datasets by total change of null rate and distinct count, by name or by type."""
    shared = deltas.filter(F.col("presence") == "shared")
    if part:
        shared = shared.filter(F.contains(F.lower("column"), F.lit(part.lower())))
    ranked = shared.groupBy("column").agg(
        F.max("baseline_type").alias("type"), F.sum(_pct("null_rate") + _pct("distinct")).alias("total_change")
    )
    order = {"most_changed": [F.desc("total_change"), "column"], "column_name": ["column"], "type": ["type", "column"]}
    return ranked.orderBy(*order[by])
