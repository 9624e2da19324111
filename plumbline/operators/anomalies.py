"""Row-level findings: outliers, missing cells, rows to look at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline import session
from plumbline.functions import text
from plumbline.operators.frequency import text_of

# Deviations that make an outlier, values needed to judge, page size.
DEVIATIONS, VALUES_NEEDED, PAGE_SIZE = 3.0, 10, 50


def number_rows(df: DataFrame, name: str = "row_number") -> DataFrame:
    """Add the 1-based position of each row in scan order.

    Positions inside a partition are known locally; only the row count of each
    partition is exchanged, never the rows.
    """
    spread_id = F.monotonically_increasing_id()
    placed = df.withColumn("_id", spread_id).withColumn("_part", F.shiftright("_id", 33))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    upto = F.sum("_size").over(Window.orderBy("_part"))
    starts = sizes.select("_part", (upto - F.col("_size")).alias("_start"))
    within = F.col("_id") - F.shiftleft(F.col("_part"), 33)
    parts = df.rdd.getNumPartitions()
    return placed.join(session.bounded(starts, parts, session.NARROW_BROADCAST_ROWS), "_part").select(
        *df.columns, (F.col("_start") + within + 1).alias(name)
    )


def read_numbered(spark, path: str, name: str = "row_number") -> DataFrame:
    """A Parquet table with 1-based row positions taken from the files, files in name order."""
    meta = spark.read.parquet(path).select("*", "_metadata.file_path", "_metadata.row_index")
    sizes = meta.groupBy("file_path").agg((F.max("row_index") + 1).alias("_size"))
    upto = F.sum("_size").over(Window.orderBy("file_path"))
    starts = sizes.select("file_path", (upto - F.col("_size")).alias("_start"))
    out = meta.join(session.bounded(starts, len(spark.read.parquet(path).inputFiles())), "file_path")
    return out.withColumn(name, F.col("_start") + F.col("row_index") + 1).drop("file_path", "row_index", "_start")


def spread_facts(df: DataFrame, columns: list[str]) -> DataFrame:
    """mean, sample deviation and count of each number column, one row per column."""
    wide = df.agg(
        *[f(text.finite(df[text.quoted(c)].cast("double"))).alias(f"{tag}_{i}")
          for i, c in enumerate(columns)
          for tag, f in (("mean", F.avg), ("std", F.stddev_samp), ("n", F.count))]
    )
    stacked = [F.lit(len(columns))]
    for i, c in enumerate(columns):
        stacked += [F.lit(c), F.col(f"mean_{i}"), F.col(f"std_{i}"), F.col(f"n_{i}")]
    return wide.select(F.stack(*stacked).alias("column", "mean", "std_dev", "n"))


def outliers(df: DataFrame, key: str, columns: list[str], cap: int | None = None) -> DataFrame:
    """Cells more than three deviations from their column's mean.

    One row per column is joined back to the cells, so the rows never move. All are listed
    unless a ``cap`` per column (by key) is asked for.
    """
    stacked = [F.lit(len(columns))]
    for c in columns:
        stacked += [F.lit(c), text.finite(df[text.quoted(c)].cast("double"))]
    cells = df.select(key, F.stack(*stacked).alias("column", "value"))
    facts = spread_facts(df, columns).filter((F.col("n") > VALUES_NEEDED) & (F.col("std_dev") > 0))
    far = (
        cells.join(session.bounded(facts, len(columns)), "column")
        .filter(F.abs(F.col("value") - F.col("mean")) > DEVIATIONS * F.col("std_dev"))
        .select("column", key, "value")
    )
    return first_rows(far, key, cap)


def missing_rows(df: DataFrame, key: str, columns: list[str], cap: int | None = None) -> DataFrame:
    """Keys of rows whose cell is missing, per column."""
    stacked = [F.lit(len(columns))]
    for c in columns:
        stacked += [F.lit(c), text.missing_predicate(text_of(df[text.quoted(c)], df.schema[c].dataType))]
    cells = df.select(key, F.stack(*stacked).alias("column", "gone")).filter("gone")
    return first_rows(cells.select("column", key), key, cap)


def first_rows(found: DataFrame, key: str, cap: int | None) -> DataFrame:
    if cap is None:
        return found
    order = Window.partitionBy("column").orderBy(key)
    return found.withColumn("_nth", F.row_number().over(order)).filter(F.col("_nth") <= cap).drop("_nth")


def fetch_rows(df: DataFrame, key: str, wanted: DataFrame, at_most: int) -> DataFrame:
    """Full rows for a set of keys holding at most ``at_most`` entries."""
    return df.join(session.bounded(wanted.select(key).distinct(), at_most), key, "left_semi")


def drilldown(df: DataFrame, key: str, found: DataFrame, column: str, page: int = 1,
              page_size: int = PAGE_SIZE) -> DataFrame:
    """One page of full rows behind a finding, with the rows affected and the number of pages.

    ``found`` lists findings as ``(column, key)``. Only the keys of the findings before
    the end of the page are ranked.
    """
    hits = found.filter(F.col("column") == column).select(key).distinct()
    total = hits.agg(F.count(F.lit(1))).scalar()
    last = page * page_size
    top = hits.orderBy(key).limit(last)
    ranked = top.withColumn("position", F.row_number().over(Window.orderBy(key)))
    shown = ranked.filter(F.col("position") > last - page_size)
    shown = shown.withColumn("total_affected", total).withColumn(
        "total_pages", F.ceil(F.col("total_affected") / page_size)
    )
    return df.join(session.bounded(shown, page_size), key)


def anomaly_rows(df: DataFrame, key: str, found: DataFrame, column: str) -> DataFrame:
    """Every full row behind the findings of one column, for export."""
    return df.join(found.filter(F.col("column") == column).select(key).distinct(), key, "left_semi")
