"""Merging the profiles of many datasets into one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators import sketches
from plumbline.operators.stats import TOP_VALUES


def _merged(profiles: DataFrame, group: list[str], order: str) -> DataFrame:
    weight = F.when(F.col("num_count") > 0, F.col("num_count")).otherwise(0)
    # the type carrying most rows, the earlier dataset winning a tie
    types = profiles.groupBy(*group, "inferred_type").agg(
        F.sum("count").alias("rows"), F.min(order).alias("first_seen")
    )
    best = types.groupBy(*group).agg(
        F.max_by("inferred_type", F.struct("rows", (-F.col("first_seen")).alias("earliest"))).alias("inferred_type")
    )
    numeric = F.col("num_count") > 0

    def weighted(c: str) -> Column:
        return F.sum(F.when(numeric, F.col(c) * F.col("num_count")))

    sums = profiles.groupBy(*group).agg(
        F.min_by("column", order).alias("name"),
        F.sum("count").alias("count"), F.sum("missing").alias("missing"),
        F.least(F.sum("distinct"), F.sum("count")).alias("distinct"),
        F.sum(weight).cast("bigint").alias("num_count"),
        weighted("mean").alias("_mean"), weighted("median").alias("_median"),
        weighted("variance").alias("_within"),
        F.sum(F.when(numeric, F.col("sum"))).alias("sum"),
        F.min(F.when(numeric, F.col("min"))).alias("min"), F.max(F.when(numeric, F.col("max"))).alias("max"),
    )
    n = F.col("num_count")
    means = sums.withColumn("mean", F.when(n > 0, F.col("_mean") / n))
    # second look at the means of the datasets for the spread between them
    between = (
        profiles.filter(numeric).select(*group, F.col("num_count").alias("w"), F.col("mean").alias("m"))
        .join(means.select(*group, "mean"), group)
        .groupBy(*group).agg(F.sum(F.col("w") * F.pow(F.col("m") - F.col("mean"), 2)).alias("_between"))
    )
    variance = F.when(n > 0, (F.col("_within") + F.col("_between")) / n)
    return (
        means.join(between, group, "left").join(best, group)
        .withColumn("variance", variance).withColumn("std_dev", F.sqrt("variance"))
        .withColumn("median", F.when(n > 0, F.col("_median") / n))
        .drop("_mean", "_median", "_within", "_between")
    )


def merge_by_name(profiles: DataFrame, order: str, sketched: DataFrame | None = None) -> DataFrame:
    """Merged statistics per column name; ``order`` numbers the datasets.

    Sums of distinct counts and weighted medians are what profiles alone allow. With the ``sketched`` columns of the same datasets
    (``sketches.sketches``) the estimates of both over all rows stand beside them, with their bounds.
    """
    merged = _merged(profiles, ["column"], order).drop("name")
    return merged if sketched is None else merged.join(sketches.united(sketched), "column", "left")


def merge_by_position(profiles: DataFrame, order: str) -> DataFrame:
    """The same for columns at the same position, named and limited as in the first dataset."""
    widths = profiles.groupBy(order).agg(F.max("ordinal").alias("last"))
    kept = profiles.filter(F.col("ordinal") <= widths.agg(F.min_by("last", order)).scalar())
    return _merged(kept, ["ordinal"], order).withColumnRenamed("name", "column")


def merge_top_values(top: DataFrame, size: int = TOP_VALUES) -> DataFrame:
    """Top values of several datasets added up by value and ranked again."""
    total = top.groupBy("column", "value").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    return total.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= size)


def sort_merged(merged: DataFrame, by: str = "column", descending: bool = False) -> DataFrame:
    keys = {
        "column": F.col("column"), "count": F.col("count"), "distinct": F.col("distinct"),
        "type": F.col("inferred_type"), "missing_pct": F.col("missing") / F.col("count"),
        "mean": F.coalesce("mean", F.lit(float("-inf"))),
    }
    key = keys[by]
    return merged.orderBy(key.desc() if descending else key.asc(), "column")
