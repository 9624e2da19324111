"""Completeness, uniqueness, issues, scores and badges on a column-profile table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import pii
from plumbline.functions.numeric import clamp, fixed, share

ISSUE_TYPE = "struct<id:string,message:string,severity:string>"


def issue(ident: Column, message: Column, severity: Column | str) -> Column:
    severity = F.lit(severity) if isinstance(severity, str) else severity
    return F.struct(ident.alias("id"), message.alias("message"), severity.alias("severity")).cast(ISSUE_TYPE)


def completeness(count: Column, missing: Column) -> Column:
    """Share of cells that hold something; an empty column counts as complete."""
    return share(count - missing, count, 1.0)


def uniqueness(count: Column, missing: Column, distinct: Column) -> Column:
    """Distinct values per valid cell; 1 when there is no valid cell."""
    return share(distinct, count - missing, 1.0)


def completeness_issue(column: Column, c: Column) -> Column:
    pct = fixed(c * 100, 1)
    return (
        F.when(c < 0.5, issue(F.concat(column, F.lit("_completeness_critical")),
                              F.concat(F.lit("Critical: Only "), pct, F.lit("% of values are present")), "error"))
        .when(c < 0.9, issue(F.concat(column, F.lit("_completeness_warning")),
                             F.concat(F.lit("Completeness is "), pct, F.lit("% (below 90% threshold)")), "warning"))
        .when(c < 1.0, issue(F.concat(column, F.lit("_completeness_info")),
                             F.concat(F.lit("Completeness is "), pct, F.lit("%")), "info"))
    )


def constant_issue(column: Column, u: Column) -> Column:
    return F.when(
        (u > 0) & (u <= 0.02),
        issue(F.concat(column, F.lit("_constant_column")),
              F.lit("Column has only one unique value (constant)"), "warning"),
    )


def cardinality_issue(column: Column, u: Column, inferred: Column) -> Column:
    return F.when(
        (inferred == "String") & (u > 0.9),
        issue(F.concat(column, F.lit("_high_cardinality")),
              F.concat(F.lit("High cardinality: "), fixed(u * 100, 1),
                       F.lit("% unique values (potential identifier or free text)")), "info"),
    )


def pii_issue(column: Column, kind: Column) -> Column:
    return F.when(
        kind.isNotNull(),
        issue(F.concat(column, F.lit("_pii_"), F.replace(kind, F.lit(" "), F.lit("_"))),
              F.concat(F.lit("Potential PII detected: "), kind), pii.severity_of(kind)),
    )


def duplicate_issue(count: Column, pct: Column) -> Column:
    severity = F.when(pct > 10, "error").when(pct > 1, "warning").otherwise("info")
    return F.when(
        count > 0,
        issue(F.lit("duplicate_rows"),
              F.concat(count.cast("string"), F.lit(" duplicate rows detected ("), fixed(pct, 2),
                       F.lit("% of total)")), severity),
    )


def column_score(c: Column, u: Column, inferred: Column, issues: Column) -> Column:
    """Weighted score between 0 and 1, lowered by every issue."""
    # Weights of the score and the price of an issue.
    penalty = F.aggregate(
        issues, F.lit(0.0),
        lambda acc, i: acc + F.when(i["severity"] == "error", 0.3).when(i["severity"] == "warning", 0.15).otherwise(0.05),
    )
    distinctness = F.when((inferred != "String") | (u < 0.9), u * 0.2).otherwise(0.2)
    return clamp(c * 0.4 + distinctness + 0.4 - penalty, 0.0, 1.0)


def with_quality(profile: DataFrame, kind: str | None = None) -> DataFrame:
    """Add ``completeness``, ``uniqueness``, ``issues`` and ``score`` to a column-profile table.

    ``kind`` names a column holding the detected kind of personal data; without it the
    hint in the column name is used.
    """
    name = F.col("column")
    pii_kind = F.col(kind) if kind else pii.name_hint(name)
    c, u, t = F.col("completeness"), F.col("uniqueness"), F.col("inferred_type")
    found = F.array(completeness_issue(name, c), constant_issue(name, u), cardinality_issue(name, u, t),
                    pii_issue(name, pii_kind))
    return (
        profile.withColumn("completeness", completeness(F.col("count"), F.col("missing")))
        .withColumn("uniqueness", uniqueness(F.col("count"), F.col("missing"), F.col("distinct")))
        .withColumn("issues", F.filter(found, lambda i: i.isNotNull()))
        .withColumn("score", column_score(c, u, t, F.col("issues")))
    )


def issue_table(profile: DataFrame, keys: list[str]) -> DataFrame:
    return profile.select(*keys, "column", F.explode("issues").alias("issue")).select(*keys, "column", "issue.*")


def health_score(profile: DataFrame, keys: list[str]) -> DataFrame:
    """Share of cells that hold something over the whole table, with its colour band."""
    pct = share(F.sum(F.col("count") - F.col("missing")), F.sum("count"), 0.0) * 100
    out = profile.groupBy(*keys).agg(F.round(pct, 1).alias("health_score"), pct.alias("_raw"))
    return out.withColumn(
        "band", F.when(F.col("_raw") < 70, "red").when(F.col("_raw") < 90, "amber").otherwise("green")
    ).drop("_raw")


def missing_badge(profile: DataFrame) -> DataFrame:
    """Badge shown beside a column and the class used in reports."""
    pct = share(F.col("missing"), F.col("count"), 0.0) * 100
    return profile.withColumn("missing_pct", pct).withColumns(
        {
            "badge": F.when(pct < 10, "excellent").when(pct <= 25, "warning").otherwise("critical"),
            "report_class": F.when(pct < 5, "good").when(pct < 20, "warning").otherwise("bad"),
        }
    )


def pii_summary(profile: DataFrame, kind: str) -> DataFrame:
    """Columns holding personal data with their severity and rows, and whether any is an error."""
    found = profile.filter(F.col(kind).isNotNull()).select(
        "column", F.col(kind).alias("pii_type"), pii.severity_of(F.col(kind)).alias("severity"),
        F.col("total_valid").alias("rows"),
    )
    everything = Window.partitionBy()
    return found.withColumn("critical", F.bool_or(F.col("severity") == "error").over(everything))
