"""Sketches that are stored beside a profile and united when profiles are merged.

Counts of distinct values and medians do not add up: the same value may be in several datasets, and a median of medians is not
the median of all. A sketch of a column is a few kilobytes, however many rows it has seen, and those of several datasets unite
to what one sketch of all rows would tell.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.frequency import cell_table

#: Buckets of the distinct counts (as a power of two), and the share the count may be off: three standard errors.
LG_BUCKETS, DISTINCT_ERROR = 14, 3 * 1.04 / 2**7
#: Size of the quantile sketch, and the share of all numbers a quantile's rank may be off; the sketch keeps 0.4 % nearly always.
QUANTILE_SIZE, RANK_ERROR = 800, 0.01


def sketches(df: DataFrame, columns: Sequence[str] | None = None, by: str | None = None) -> DataFrame:
    """Per column (and value of ``by``): ``distinct_sketch``, ``quantile_sketch`` and how many ``numbers`` it holds.

    Sketches grow where the rows are, and only they are shuffled. Columns without valid cells have no row.
    """
    ft = cell_table(df, columns, by)
    return ft.valid.groupBy(*ft.labelled).agg(
        F.hll_sketch_agg(F.coalesce("value", "digest"), F.lit(LG_BUCKETS)).alias("distinct_sketch"),
        F.kll_sketch_agg_double("num", F.lit(QUANTILE_SIZE)).alias("quantile_sketch"),
        F.count("num").alias("numbers"),
    )


def united(parts: DataFrame, group: Sequence[str] = ("column",)) -> DataFrame:
    """Distinct values and median of all datasets together, each with its bounds.

    The median is null where there are no numbers. It is one of the numbers, not a mean of two.
    """
    def quantile(rank: float) -> Column:
        return F.when(F.col("numbers") > 0, F.kll_sketch_get_quantile_double("quantile_sketch", F.lit(rank)))

    whole = parts.groupBy(*group).agg(
        F.hll_sketch_estimate(F.hll_union_agg("distinct_sketch")).alias("distinct_estimate"),
        F.kll_merge_agg_double("quantile_sketch", F.lit(QUANTILE_SIZE)).alias("quantile_sketch"),
        F.sum("numbers").alias("numbers"),
    )
    slack = F.greatest(F.ceil(F.col("distinct_estimate") * DISTINCT_ERROR), F.lit(1))
    return whole.select(
        *group, "distinct_estimate",
        F.greatest(F.col("distinct_estimate") - slack, F.lit(0)).alias("distinct_low"), (F.col("distinct_estimate") + slack).alias("distinct_high"),
        quantile(0.5).alias("median_estimate"), quantile(0.5 - RANK_ERROR).alias("median_low"), quantile(0.5 + RANK_ERROR).alias("median_high"),
    )
