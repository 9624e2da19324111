"""SQL over a loaded table; results can be profiled in turn."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import flatten
from plumbline.plans.profile import ALL_PARTS, profile


def sql_query(spark: SparkSession, statement: str, **tables: DataFrame) -> DataFrame:
    """Any statement over registered views, or over the given DataFrames by name."""
    return spark.sql(statement, **tables)


def sql_sample(df: DataFrame, key: str, rows: int, seed: int = 0) -> DataFrame:
    """A repeatable sample of ``rows`` rows: those with the smallest hash of the key."""
    rank = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    return df.orderBy(rank, key).limit(rows)


def profile_query(spark: SparkSession, statement: str, parts=ALL_PARTS, row_order: str | None = None,
                  **tables: DataFrame) -> DataFrame:
    return profile(sql_query(spark, statement, **tables), parts=parts, row_order=row_order)


def profile_paths(df: DataFrame, paths: list[str], json_column: str | None = None, parts=ALL_PARTS) -> DataFrame:
    """Profile only chosen paths of nested columns or of JSON texts."""
    return profile(flatten.select_paths(df, paths, json_column), parts=parts)
