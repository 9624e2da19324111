"""Rule files to rule tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.rules_eval import GX_SUPPORTED

# How a check line is written.
COMPARE_LINE = r"^([a-zA-Z0-9_]+)(?:\(([^)]+)\))?\s*([<>=!]+)\s*(-?\d+(?:\.\d+)?)$"
BETWEEN_LINE = r"^([a-zA-Z0-9_]+)(?:\(([^)]+)\))?\s*between\s*(-?\d+(?:\.\d+)?)\s*and\s*(-?\d+(?:\.\d+)?)$"

_SUITE = """
struct<expectation_suite_name: string,
       expectations: array<struct<expectation_type: string, kwargs: variant>>>
"""


def gx_rules(suites: DataFrame, text: str = "text", keys: list[str] | None = None) -> DataFrame:
    """Suite texts, one per row, to rule rows; a text that is no suite gives one ``format_error`` row."""
    keys = keys or []
    parsed = suites.withColumn("_s", F.from_json(text, _SUITE))
    has = F.col("_s.expectation_suite_name").isNotNull() & F.col("_s.expectations").isNotNull()
    whole = has & F.forall(
        F.col("_s.expectations"),
        lambda e: e["expectation_type"].isNotNull() & e["kwargs"].isNotNull()
        & F.schema_of_variant(e["kwargs"]).startswith("OBJECT"),
    )
    rules = parsed.filter(F.coalesce(whole, F.lit(False))).select(*keys, F.explode("_s.expectations").alias("e"))

    def arg(name: str, kind: str) -> Column:
        return F.try_variant_get(F.col("e.kwargs"), f"$.{name}", kind)

    good = rules.select(
        *keys, F.col("e.expectation_type").alias("rule_type"), arg("column", "string").alias("column"),
        arg("min_value", "double").alias("min_value"), arg("max_value", "double").alias("max_value"),
        arg("mostly", "double").alias("mostly"), arg("type_", "string").alias("type_"),
        arg("value", "double").alias("value"), arg("value_set", "array<string>").alias("value_set"),
        F.col("e.expectation_type").isin(*GX_SUPPORTED).alias("supported"),
        F.lit(None).cast("string").alias("error"),
    )
    bad = parsed.filter(~F.coalesce(whole, F.lit(False))).select(*keys, F.lit("format_error").alias("error"))
    return good.unionByName(bad, allowMissingColumns=True)


def soda_rules(lines: DataFrame, line: str = "line", keys: list[str] | None = None) -> DataFrame:
    """Check lines to check rows; what cannot be decided from a profile is marked with a reason.

    ``lines`` holds one list entry per row, without its leading dash; an entry with a
    trailing colon carries thresholds of its own.
    """
    keys = keys or []
    raw = F.col(line)
    compare = [F.regexp_extract(raw, COMPARE_LINE, i) for i in (1, 2, 3, 4)]
    between = [F.regexp_extract(raw, BETWEEN_LINE, i) for i in (1, 2, 3, 4)]
    is_compare, is_between = raw.rlike(COMPARE_LINE), raw.rlike(BETWEEN_LINE)
    is_object = raw.endswith(":")
    inside = F.trim(F.regexp_extract(raw, r"\(([^)]+)\)", 1))
    head = F.regexp_extract(raw, r"^([a-zA-Z0-9_]+)", 1)
    lowered = F.lower(raw)
    reason = (
        F.when(is_object, "Complex threshold objects not yet supported")
        .when(is_compare | is_between, F.lit(None).cast("string"))
        .when(F.contains(lowered, F.lit("sql")), "Cannot validate: requires database execution")
        .when(F.contains(lowered, F.lit("freshness")), "Cannot validate: requires timestamp comparison")
        .otherwise("Complex SodaCL syntax not yet supported")
    )

    def pick(when_object: Column | None, i: int) -> Column:
        c = F.when(is_compare, compare[i]).when(is_between, between[i])
        return F.nullif(F.when(is_object, when_object).otherwise(c) if when_object is not None else c, F.lit(""))

    return lines.select(
        *keys, pick(head, 0).alias("metric"), pick(inside, 1).alias("column"),
        F.when(is_object, F.lit(None)).when(is_compare, compare[2]).when(is_between, "between").alias("operator"),
        F.when(is_compare, compare[3]).when(is_between, between[2]).try_cast("double").alias("threshold"),
        F.when(is_between, between[3]).try_cast("double").alias("threshold_high"),
        (~is_object & (is_compare | is_between)).alias("supported"),
        reason.alias("reason"), raw.alias("raw"),
    )


def soda_lines(files: DataFrame, text: str = "text", keys: list[str] | None = None) -> DataFrame:
    """Check files, one per row, to the entries of their ``checks for`` lists."""
    keys = keys or []
    heading = r"^(checks for [^:]*):\s*$"
    entry = r"^\s*- "
    step = F.aggregate(
        F.split(text, r"\r?\n"),
        F.struct(F.lit("").alias("open"), F.array().cast("array<struct<table:string,line:string>>").alias("found")),
        lambda acc, l: F.struct(
            F.when(l.rlike(heading), F.regexp_extract(l, heading, 1)).when(l.rlike(r"^\S"), "")
            .otherwise(acc["open"]).alias("open"),
            F.when(
                (acc["open"] != "") & l.rlike(entry),
                F.concat(acc["found"], F.array(F.struct(
                    acc["open"].alias("table"), F.trim(F.regexp_replace(l, entry, "")).alias("line")))),
            ).otherwise(acc["found"]).alias("found"),
        ),
    )
    return files.select(*keys, F.explode(step["found"]).alias("c")).select(
        *keys, F.regexp_replace("c.table", "^checks for ", "").alias("table"), F.col("c.line").alias("line")
    )


def json_schema_rules(schemas: DataFrame, text: str = "text", keys: list[str] | None = None) -> DataFrame:
    """Record schemas, one per row, to constraint rows; the schema of an array stands for its items."""
    keys = keys or []
    root = F.try_parse_json(text)
    items = F.try_variant_get(root, "$.items", "variant")
    is_array = F.try_variant_get(root, "$.type", "string") == "array"
    row = F.when(F.coalesce(is_array, F.lit(False)) & items.isNotNull(), items).otherwise(root)
    based = schemas.select(*keys, row.alias("row"))
    required = based.select(
        *keys, F.explode(F.try_variant_get("row", "$.required", "array<string>")).alias("column")
    ).withColumn("rule_type", F.lit("required"))
    properties = based.select(*keys, F.explode(F.try_variant_get("row", "$.properties", "map<string,variant>")).alias("column", "p"))

    def arg(path: str, kind: str) -> Column:
        return F.try_variant_get(F.col("p"), path, kind)

    constraints = properties.select(
        *keys, "column",
        F.explode(F.array(
            F.struct(F.lit("type").alias("rule_type"),
                     F.coalesce(arg("$.type", "array<string>"),
                                F.when(arg("$.type", "string").isNotNull(), F.array(arg("$.type", "string")))).alias("types"),
                     F.lit(None).cast("double").alias("bound"), F.lit(None).cast("array<string>").alias("allowed")),
            *[F.struct(F.lit(k).alias("rule_type"), F.lit(None).cast("array<string>").alias("types"),
                       arg(f"$.{k}", "double").alias("bound"), F.lit(None).cast("array<string>").alias("allowed"))
              for k in ("minimum", "maximum")],
            F.struct(F.lit("enum").alias("rule_type"), F.lit(None).cast("array<string>").alias("types"),
                     F.lit(None).cast("double").alias("bound"), arg("$.enum", "array<string>").alias("allowed")),
        )).alias("r"),
    ).select(*keys, "column", "r.*").filter(
        F.col("types").isNotNull() | F.col("bound").isNotNull() | F.col("allowed").isNotNull()
    )
    return constraints.unionByName(required, allowMissingColumns=True)


def read_rule_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Rule files as ``(file, text)`` rows."""
    return spark.read.text(paths, wholetext=True).select(
        F.col("_metadata.file_name").alias("file"), F.col("value").alias("text")
    )
