"""Pearson correlation between number columns."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline import session
from plumbline.functions import text
from plumbline.functions.numeric import clamp
from plumbline.functions.text import finite

#: Columns are paired block by block; a task holds the sums of one pair of blocks.
BLOCK_COLUMNS = 256
ROWS_AT_ONCE = 2048
#: A variance below this share of the mean square around the column's mean is rounding, not spread.
ROUNDING = 1e-12
SUMS = ("n", "x", "y", "xx", "yy", "xy")


def _pair_sums(df: DataFrame, columns: list[str], block: int = BLOCK_COLUMNS) -> DataFrame:
    """One row per pair i < j: complete cases, and sums, squares and products of both columns over them.

    Numbers are taken from their column's mean, so that large values with a small spread keep their digits. Every task turns
    its rows into one matrix product per batch and hands on one row per pair, however many rows it has read.
    """
    numbers = session.spread(df.select(*[finite(df[text.quoted(c)].cast("double")).alias(f"x{i}") for i, c in enumerate(columns)]))
    means = numbers.agg(*[F.avg(c).alias(c) for c in numbers.columns]).first()
    centred = numbers.select(*[(F.col(c) - F.lit(means[c] or 0.0)).alias(c) for c in numbers.columns])
    blocks = [list(range(k, min(k + block, len(columns)))) for k in range(0, len(columns), block)]
    scans = [_one_scan(centred, left, right) for k, left in enumerate(blocks) for right in blocks[k:]]
    return reduce(DataFrame.unionByName, scans).groupBy("i", "j").agg(*[F.sum(s).alias(s) for s in SUMS])


def _one_scan(centred: DataFrame, left: list[int], right: list[int]) -> DataFrame:
    """The sums of each task for the pairs between two blocks of columns, of which only these are read."""
    wanted = list(dict.fromkeys([*left, *right]))
    pairs = np.array([(a, b) for a, i in enumerate(left) for b, j in enumerate(right) if i < j], np.int64).reshape(-1, 2)
    at = [wanted.index(j) for j in right]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(SUMS), len(left), len(right)))
        for batch in (b.slice(at_row, ROWS_AT_ONCE) for b in batches for at_row in range(0, b.num_rows, ROWS_AT_ONCE)):
            values = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns])
            there = ~np.isnan(values)
            values[~there] = 0.0
            x, y, in_x, in_y = values[:, :len(left)], values[:, at], there[:, :len(left)].astype(float), there[:, at].astype(float)
            for k, (a, b) in enumerate(((in_x, in_y), (x, in_y), (in_x, y), (x * x, in_y), (in_x, y * y), (x, y))):
                total[k] += a.T @ b
        picked = total[:, pairs[:, 0], pairs[:, 1]]
        columns = [pa.array(np.array(left, np.int32)[pairs[:, 0]]), pa.array(np.array(right, np.int32)[pairs[:, 1]])]
        yield pa.record_batch(columns + [pa.array(p) for p in picked], names=["i", "j", *SUMS])

    schema = "i int, j int, " + ", ".join(f"{s} double" for s in SUMS)
    # a row without numbers sees to it that an empty table has its pairs too
    nothing = centred.sparkSession.range(1).select(*[F.lit(None).cast("double").alias(f"x{i}") for i in wanted])
    return centred.select(*[f"x{i}" for i in wanted]).unionByName(nothing).mapInArrow(run, schema)


def pairwise(df: DataFrame, columns: list[str]) -> DataFrame:
    """(col_x, col_y, n, r) for each pair of columns over the rows where both hold a number.

    A column whose numbers in those rows are equal (to a millionth of their distance from the column's mean) gives r = 0.
    An empty table gives n = 0 and r = 0; fewer than two columns give no pairs.
    """
    if len(columns) < 2:
        return df.sparkSession.createDataFrame([], "col_x string, col_y string, n bigint, r double")
    names = F.array(*[F.lit(c) for c in columns])
    n, x, y = F.col("n"), F.col("x"), F.col("y")
    # n is 0 for pairs without complete cases; they are never looked at further
    vx, vy = F.col("xx") - x * x / F.nullif(n, F.lit(0.0)), F.col("yy") - y * y / F.nullif(n, F.lit(0.0))
    spread = (n >= 2) & (vx > F.col("xx") * ROUNDING) & (vy > F.col("yy") * ROUNDING)
    r = F.when(spread, (F.col("xy") - x * y / F.nullif(n, F.lit(0.0))) / (F.sqrt(vx) * F.sqrt(vy))).otherwise(0.0)
    return _pair_sums(df, columns).select(
        F.element_at(names, F.col("i") + 1).alias("col_x"),
        F.element_at(names, F.col("j") + 1).alias("col_y"),
        F.col("n").cast("bigint").alias("n"), clamp(r, -1.0, 1.0).alias("r"),
    )


def matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """The full square of correlations as (col_x, col_y, r), ones on the diagonal."""
    half = pairwise(df, columns).select("col_x", "col_y", "r")
    turned = half.select(F.col("col_y").alias("col_x"), F.col("col_x").alias("col_y"), "r")
    ones = half.sparkSession.createDataFrame([(c, c, 1.0) for c in columns], "col_x string, col_y string, r double")
    return half.unionByName(turned).unionByName(ones)
