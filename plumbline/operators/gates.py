"""Pass/fail gates: the offending columns, none when the gate holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.numeric import share


def gate_missing(profile: DataFrame, max_pct: float) -> DataFrame:
    pct = share(F.col("missing"), F.col("count"), 0.0) * 100
    return profile.select("column", pct.alias("missing_pct")).filter(F.col("missing_pct") > max_pct)


def gate_duplicates(profile: DataFrame) -> DataFrame:
    return profile.filter((F.col("count") > 0) & (F.col("distinct") < F.col("count"))).select(
        "column", "distinct", F.col("count").alias("rows")
    )
