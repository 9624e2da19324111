"""Reports and orderings of a column-profile table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.numeric import fixed, grouped, share
from plumbline.functions.pii import is_personal_name
from plumbline.operators.stats import TOP_VALUES

# Preview size and the size that is called large.
PREVIEW_ROWS, LARGE_RESULT = 1000, 100_000
NUMBERS = ("min", "max", "mean", "median", "std_dev", "variance", "skewness", "kurtosis", "sum",
           "p25", "p75", "p90", "p95", "p99")


def report_rows(profile: DataFrame) -> DataFrame:
    """Statistics and quality of each column as reports print them: six decimals, uniqueness at most 1."""
    valid = F.col("count") - F.col("missing")
    return profile.select(
        "ordinal", "column", "count", "missing", "distinct", "inferred_type", "min_length", "max_length",
        *[F.round(c, 6).alias(c) for c in NUMBERS if c in profile.columns],
        F.round(share(valid, F.col("count"), 0.0), 6).alias("completeness"),
        F.round(F.least(share(F.col("distinct"), valid, 0.0), F.lit(1.0)), 6).alias("uniqueness"),
        is_personal_name(F.col("column")).alias("potential_pii"),
    )


def _shown(rows: DataFrame) -> DataFrame:
    """The first of the top values; profiles hold more, for rules."""
    return rows.withColumn("top_values", F.slice("top_values", 1, TOP_VALUES)) if "top_values" in rows.columns else rows


def report_json(profile: DataFrame) -> DataFrame:
    """One JSON object per column."""
    rows = report_rows(profile)
    numeric = F.struct(*[F.col(c) for c in NUMBERS if c in rows.columns])
    extra = [c for c in ("top_values", "histogram", "notes") if c in profile.columns]
    if extra:
        rows = _shown(rows.join(profile.select("ordinal", *extra), "ordinal"))
    body = F.struct(
        F.col("column").alias("name"),
        F.struct("count", "missing", "distinct", F.col("inferred_type").alias("inferredType"),
                 F.col("min_length").alias("minLength"), F.col("max_length").alias("maxLength"),
                 F.when(F.col("min").isNotNull(), numeric).alias("numeric"),
                 *[F.col(c) for c in extra if c != "notes"]).alias("stats"),
        F.struct("completeness", "uniqueness", F.col("potential_pii").alias("isPotentialPII")).alias("quality"),
        *[F.col("notes") for _ in range("notes" in extra)],
    )
    return rows.select("ordinal", "column", F.to_json(body).alias("text"))


def report_document(profile: DataFrame, file_name: str, file_size: int = 0, seconds: float = 0.0) -> DataFrame:
    """The whole JSON report as one text: what was read, how many rows and columns, and every column in order."""
    def six(c: Column) -> Column:
        return F.round(c, 6)

    rows = _shown(report_rows(profile).join(
        profile.select("ordinal", *[c for c in ("top_values", "histogram", "notes", "unique_count") if c in profile.columns]), "ordinal"))
    named = {"std_dev": "stdDev"}
    stats_ = [F.col("count"), F.col("missing"), F.col("distinct"), F.col("inferred_type").alias("inferredType"),
              F.col("min_length").alias("minLength"), F.col("max_length").alias("maxLength"),
              F.when(F.col("min").isNotNull(), F.struct(*[F.col(c).alias(named.get(c, c)) for c in NUMBERS if c in rows.columns])).alias("numeric")]
    if "top_values" in rows.columns:
        top = F.transform("top_values", lambda t: F.struct(t["value"].alias("value"), t["n"].alias("count"), six(t["percentage"]).alias("percentage")))
        stats_.append(F.when(F.size("top_values") > 0, F.struct(top.alias("topValues"), F.col("unique_count").alias("uniqueCount"))).alias("categorical"))
    if "histogram" in rows.columns:
        bins = F.transform("histogram", lambda b: F.struct(six(b["start"]).alias("start"), six(b["end"]).alias("end"), b["n"].alias("count")))
        first, last = F.col("histogram")[0], F.element_at("histogram", -1)
        stats_.append(F.when(F.size("histogram") > 0, F.struct(
            bins.alias("bins"), six(first["start"]).alias("min"), six(last["end"]).alias("max"),
            six(first["end"] - first["start"]).alias("binWidth"))).alias("histogram"))
    body = [F.col("column").alias("name"), F.struct(*stats_).alias("stats"),
            F.struct("completeness", "uniqueness", F.col("potential_pii").alias("isPotentialPII")).alias("quality")]
    if "notes" in rows.columns:
        body.append(F.when(F.size("notes") > 0, F.col("notes")).alias("notes"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", F.struct(*body).alias("body")))), lambda e: e["body"])
    whole = rows.agg(F.max("count").alias("rows"), F.count(F.lit(1)).alias("n"), listed.alias("columns"))
    meta = F.struct(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("generatedAt"), F.lit(file_name).alias("fileName"),
                    F.lit(file_size).alias("fileSize"), F.lit(round(seconds * 1000)).alias("processingTimeMs"))
    summary = F.struct(F.coalesce("rows", F.lit(0)).alias("totalRows"), F.col("n").alias("totalColumns"))
    return whole.select(F.to_json(F.struct(meta.alias("meta"), summary.alias("summary"), "columns")).alias("text"))


def report_csv(profile: DataFrame) -> DataFrame:
    """The thirteen columns of the CSV report."""
    names = {
        "Column": "column", "Type": "inferred_type", "Count": "count", "Missing": "missing", "Distinct": "distinct",
        "Mean": "mean", "Median": "median", "Min": "min", "Max": "max", "StdDev": "std_dev", "Variance": "variance",
        "Skewness": "skewness", "Kurtosis": "kurtosis",
    }
    return profile.orderBy("ordinal").select(*[F.col(c).alias(n) for n, c in names.items()])


def report_markdown(profile: DataFrame, title: str) -> DataFrame:
    """The report as lines ``(nth, line)``: title, summary, one line per column."""
    def shown(c: str) -> Column:
        return F.coalesce(grouped(F.col(c)), F.lit("-"))

    pct = share(F.col("missing"), F.col("count"), 0.0) * 100
    rows = profile.select(
        (F.col("ordinal") + 100).alias("nth"),
        F.format_string(
            "| **%s** | `%s` | %s | %s%% | %s | %s | %s |", "column", "inferred_type", grouped(F.col("count"), 0),
            fixed(pct, 1), grouped(F.col("distinct"), 0), shown("mean"), shown("median"),
        ).alias("line"),
    )
    facts = profile.agg(
        F.max("count").alias("rows"), F.count(F.lit(1)).alias("columns"),
        (share(F.sum(F.col("count") - F.col("missing")), F.sum("count"), 0.0) * 100).alias("score"),
    )
    head = facts.select(F.posexplode(F.array(
        F.lit(f"# Profile: {title}"), F.lit("| Metric | Value |"), F.lit("| :--- | :--- |"),
        F.concat(F.lit("| **Total Rows** | "), grouped(F.col("rows"), 0), F.lit(" |")),
        F.concat(F.lit("| **Total Columns** | "), F.col("columns").cast("string"), F.lit(" |")),
        F.concat(F.lit("| **Health Score** | "), fixed(F.col("score"), 1), F.lit("% |")),
        F.lit("| Column | Type | Count | Missing % | Distinct | Mean | Median |"),
        F.lit("| :--- | :--- | :--- | :--- | :--- | :--- | :--- |"),
    )).alias("nth", "line"))
    return head.unionByName(rows)


def _signals(profile: DataFrame, outliers: str) -> DataFrame:
    pct = share(F.col("missing"), F.col("count"), 0.0) * 100
    return profile.withColumns({
        "_pct": pct,
        "_pii": F.exists("issues", lambda i: F.contains(i["id"], F.lit("_pii_"))),
        "_out": F.coalesce(F.col(outliers) > 0, F.lit(False)),
    })


def issue_digest(profile: DataFrame, outliers: str = "outlier_rows", shown: int | None = None) -> DataFrame:
    """The columns most in need of attention, with a score and a rank; all of them, or the first ``shown``.

    ``profile`` carries ``issues`` and a column counting outlying rows.
    """
    s = _signals(profile, outliers)

    def points(flag: Column, worth: int) -> Column:
        return F.when(flag, worth).otherwise(0)

    score = (
        points(F.col("_pii"), 10) + points(F.col("_pct") > 10, 8) + points(F.col("_out"), 5)
        + points(F.col("_pct") > 0, 2)
    )
    tags = F.array_join(F.array_compact(F.array(
        F.when(F.col("_pii"), "PII"), F.when(F.col("_pct") > 10, "Missing"), F.when(F.col("_out"), "Outliers"))), ", ")
    ranked = s.withColumn("issue_score", score).withColumn(
        "rank", F.row_number().over(Window.orderBy(F.desc("issue_score"), "column"))
    )
    if shown is not None:
        ranked = ranked.filter(F.col("rank") <= shown)
    return ranked.select(
        "rank", "column", "inferred_type", "issue_score", F.round("_pct", 1).alias("missing_pct"),
        F.round(share(F.col("distinct"), F.col("count"), 0.0) * 100, 1).alias("distinct_pct"),
        F.when(tags == "", "-").otherwise(tags).alias("issue_tags"),
    )


def digest_warnings(profile: DataFrame, outliers: str = "outlier_rows", shown: int | None = None) -> DataFrame:
    """All warnings by severity, or the first ``shown`` and how many ``more`` there are."""
    s = _signals(profile, outliers)
    pct = F.concat(fixed(F.col("_pct"), 1), F.lit("% missing values"))

    def warning(flag: Column, message: Column, severity: int) -> Column:
        return F.when(flag, F.struct(message.alias("message"), F.lit(severity).alias("severity")))

    found = F.array_compact(F.array(
        warning(F.col("_pii"), F.lit("Potential PII detected"), 10),
        warning(F.col("_pct") > 10, pct, 8),
        warning(F.col("_out"), F.concat(F.col(outliers).cast("string"), F.lit(" outlier(s) detected")), 5),
        warning((F.col("_pct") > 0) & (F.col("_pct") <= 10), pct, 3),
    ))
    tall = s.select("ordinal", "column", F.explode(found).alias("w")).select("ordinal", "column", "w.*")
    ranked = tall.withColumn(
        "rank", F.row_number().over(Window.orderBy(F.desc("severity"), "ordinal"))
    )
    if shown is None:
        ranked = ranked.withColumn("more", F.lit(0).cast("bigint"))
    else:
        left = F.greatest(F.count(F.lit(1)).over(Window.partitionBy()) - shown, F.lit(0))
        ranked = ranked.withColumn("more", left).filter(F.col("rank") <= shown)
    return ranked.select("rank", "column", "message", "severity", "more")


def sort_profile(profile: DataFrame, by: str = "column", descending: bool = False) -> DataFrame:
    """By name, type, missing share or any statistic."""
    keys = {"missing_pct": F.col("missing") / F.col("count"), "type": F.col("inferred_type")}
    key = keys.get(by, F.col(by))
    return profile.orderBy(key.desc() if descending else key.asc(), "column")


def filter_columns(profile: DataFrame, part: str) -> DataFrame:
    return profile.filter(F.contains(F.lower("column"), F.lit(part.lower())))


def numeric_columns(profile: DataFrame) -> DataFrame:
    return profile.filter(F.col("inferred_type").isin("Integer", "Numeric"))


def preview(df: DataFrame, order: list[str], rows: int = PREVIEW_ROWS) -> DataFrame:
    """The first rows of a result, whether it was cut, and whether it is large."""
    facts = df.agg(F.count(F.lit(1)))
    total = facts.scalar()
    return df.orderBy(*order).limit(rows).withColumns(
        {"truncated": total > rows, "large_result": total >= LARGE_RESULT}
    )


def write_rows_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """Rows to CSV: quoted where needed, null as an empty cell."""
    df.select(*(columns or df.columns)).write.csv(path, header=True, quote='"', escape='"', nullValue="", emptyValue="")
