"""Rules that a profiled table satisfies, written from its column profiles."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.numeric import lower_bound, plain, share, upper_bound

# Suite type of an inferred type, values of a boolean column, largest value set,
# share of distinct values from which a column is called unique, values needed for a mean rule.
GX_TYPE_OF = {"Integer": "INTEGER", "Numeric": "FLOAT", "String": "STRING", "Boolean": "BOOLEAN", "Date": "DATE"}
BOOLEAN_SET = ("true", "false", "true", "false", "True", "False", "1", "0", "1", "0")
MAX_SET, UNIQUE_SHARE, MEAN_NEEDS = 20, 0.999, 10
# Check type and schema type of an inferred type.
SODA_TYPE_OF = {"Integer": "integer", "Numeric": "decimal", "String": "text", "Boolean": "boolean", "Date": "date"}
SCHEMA_TYPE_OF = {"Integer": "integer", "Numeric": "number", "String": "string", "Boolean": "boolean",
                  "Date": "string", "Null": "null"}


@dataclass(frozen=True)
class SuiteOptions:
    suite_name: str = "generated_suite"
    tolerance: float = 0.1
    types: bool = True
    nulls: bool = True
    ranges: bool = True
    uniqueness: bool = True
    min_completeness: float = 0.5


def _mapped(c: Column, table: dict[str, str]) -> Column:
    return F.coalesce(*[F.when(c == k, F.lit(v)) for k, v in table.items()])


def all_held(tops: Column, valid: Column) -> Column:
    """Whether the top values of a profile are all values of the column."""
    return F.aggregate(tops, F.lit(0).cast("bigint"), lambda s, t: s + t["n"]) >= valid


def _gx(name: str, **args: Column) -> Column:
    slots = {
        "min_value": "double", "max_value": "double", "mostly": "double", "type_": "string", "value": "double",
        "value_set": "array<string>",
    }
    return F.struct(
        F.lit(name).alias("rule_type"),
        *[args.get(k, F.lit(None)).cast(t).alias(k) for k, t in slots.items()],
    )


def generate_gx(profile: DataFrame, options: SuiteOptions = SuiteOptions()) -> DataFrame:
    """Suite rules as rows: column rules in column order, then the two table rules."""
    t = options.tolerance
    count, missing, distinct = F.col("count"), F.col("missing"), F.col("distinct")
    inferred, valid = F.col("inferred_type"), F.col("count") - F.col("missing")
    numeric = F.col("num_count") > 0
    null_rate = share(missing, count, 0.0)
    tops = F.transform(F.col("top_values"), lambda v: v["value"])

    def within(c: str) -> dict[str, Column]:
        return {"min_value": F.round(lower_bound(F.col(c), t), 6), "max_value": F.round(upper_bound(F.col(c), t), 6)}

    gx_type = _mapped(inferred, GX_TYPE_OF)
    candidates = [
        _gx("expect_column_to_exist"),
        F.when(F.lit(options.types) & gx_type.isNotNull(), _gx("expect_column_values_to_be_of_type", type_=gx_type)),
        F.when(
            F.lit(options.nulls) & (share(valid, count, 0.0) >= options.min_completeness),
            _gx("expect_column_values_to_not_be_null",
                mostly=F.greatest(F.lit(0.0), F.round(1 - null_rate * (1 + t), 4))),
        ),
        F.when(
            F.lit(options.ranges) & numeric,
            _gx("expect_column_values_to_be_between", mostly=F.lit(1.0),
                min_value=within("min")["min_value"], max_value=within("max")["max_value"]),
        ),
        F.when(
            F.lit(options.ranges) & numeric & (count >= MEAN_NEEDS),
            _gx("expect_column_mean_to_be_between", **within("mean")),
        ),
        F.when(
            F.lit(options.uniqueness) & (valid > 0) & (distinct >= valid * UNIQUE_SHARE),
            _gx("expect_column_values_to_be_unique"),
        ),
        F.when(
            inferred == "Boolean",
            _gx("expect_column_values_to_be_in_set", value_set=F.array(*[F.lit(v) for v in BOOLEAN_SET])),
        ),
        F.when(
            (inferred == "String") & (F.col("unique_count") <= MAX_SET) & (valid > 0) & all_held(F.col("top_values"), valid),
            _gx("expect_column_distinct_values_to_be_in_set", value_set=tops),
        ),
    ]
    columns = (
        profile.filter(inferred != "Null")
        .select("ordinal", "column", F.posexplode(F.filter(F.array(*candidates), lambda r: r.isNotNull())).alias("nth", "r"))
        .select("ordinal", "nth", "column", "r.*")
    )
    rows = F.col("rows")
    facts = profile.agg(F.max("count").alias("rows"), F.count(F.lit(1)).alias("columns"))
    table = facts.select(
        F.array(
            F.when(rows > 0, _gx("expect_table_row_count_to_be_between",
                                 min_value=F.floor(rows * (1 - t)), max_value=F.ceil(rows * (1 + t)))),
            _gx("expect_table_column_count_to_equal", value=F.col("columns")),
        ).alias("rules"), "columns",
    ).select(
        F.col("columns").cast("int").alias("ordinal"),
        F.posexplode(F.filter("rules", lambda r: r.isNotNull())).alias("nth", "r"),
    ).select("ordinal", "nth", F.lit(None).cast("string").alias("column"), "r.*")
    return columns.unionByName(table)


def gx_summary(rules: DataFrame) -> DataFrame:
    """Number of rules of each type."""
    return rules.groupBy("rule_type").agg(F.count(F.lit(1)).alias("rules"))


def gx_coverage(profile: DataFrame) -> DataFrame:
    """Columns that get rules and columns that are skipped."""
    skipped = F.col("inferred_type") == "Null"
    return profile.agg(
        F.count_if(~skipped).alias("columns_included"),
        F.array_sort(F.collect_list(F.when(skipped, F.col("column")))).alias("columns_skipped"),
    )


def gx_json(rules: DataFrame, options: SuiteOptions = SuiteOptions(), source: str = "") -> DataFrame:
    """The suite as one JSON text."""
    fields = ("column", "type_", "min_value", "max_value", "mostly", "value", "value_set")
    entry = F.struct(
        F.col("rule_type").alias("expectation_type"), F.struct(*[F.col(c) for c in fields]).alias("kwargs")
    )
    ordered = F.transform(
        F.array_sort(F.collect_list(F.struct("ordinal", "nth", entry.alias("e")))), lambda x: x["e"]
    )
    suite = F.struct(
        F.lit(options.suite_name).alias("expectation_suite_name"),
        F.struct(F.lit(source).alias("source_file"), F.lit(options.tolerance).alias("tolerance")).alias("meta"),
        F.col("expectations"),
    )
    return rules.agg(ordered.alias("expectations")).select(F.to_json(suite).alias("text"))


def _short_number(c: Column) -> Column:
    """At most four decimals; small values in scientific form."""
    trimmed = F.regexp_replace(F.regexp_replace(F.format_string("%.4f", F.round(c, 4)), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    small = F.regexp_replace(F.format_string("%.4e", c), r"e([+-])0*([0-9])", "e$1$2")
    return F.when(F.abs(c) < 0.01, small).otherwise(trimmed)


def generate_soda(profile: DataFrame, table: str, tolerance_pct: float = 10.0, warnings: bool = True) -> DataFrame:
    """Check entries as rows ``(ordinal, nth, column, line, thresholds)``."""
    t = tolerance_pct / 100
    name, count, missing = F.col("column"), F.col("count"), F.col("missing")
    valid, numeric = F.col("count") - F.col("missing"), F.col("num_count") > 0
    low, high, mean = F.col("min"), F.col("max"), F.col("mean")

    def check(line: Column, extra: Column | None = None) -> Column:
        return F.struct(line.alias("line"), (F.lit(None).cast("string") if extra is None else extra).alias("thresholds"))

    def call(metric: str, tail: Column | str) -> Column:
        return F.concat(F.lit(metric + "("), name, F.lit(")"), F.lit(tail) if isinstance(tail, str) else tail)

    def band(width: float) -> Column:
        return F.concat(_short_number(mean * (1 - width)), F.lit(" and "), _short_number(mean * (1 + width)))

    floor_ = F.when(low >= 0, low * (1 - t)).otherwise(low * (1 + t))
    ceiling = F.when(high >= 0, high * (1 + t)).otherwise(high * (1 - t))
    allowed = F.ceil(share(missing, count, 0.0) * 100 * (1 + t) + 1)
    soda_type = _mapped(F.col("inferred_type"), SODA_TYPE_OF)
    if warnings:
        average = check(call("avg", ":"), F.concat(
            F.lit("fail: when not between "), band(t), F.lit("\nwarn: when not between "), band(t / 2)))
    else:
        average = check(call("avg", F.concat(F.lit(" between "), band(t))))
    candidates = [
        F.when(missing == 0, check(call("missing_count", " = 0")))
        .otherwise(check(call("missing_percent", F.concat(F.lit(" < "), allowed.cast("string"))))),
        F.when((valid > 0) & (F.col("distinct") >= valid * UNIQUE_SHARE), check(call("duplicate_count", " = 0"))),
        F.when(numeric, check(call("min", F.concat(F.lit(" >= "), _short_number(floor_))))),
        F.when(numeric, check(call("max", F.concat(F.lit(" <= "), _short_number(ceiling))))),
        F.when(numeric, average),
        F.when(soda_type.isNotNull(), check(F.lit("schema:"), F.concat(
            F.lit("warn:\n  when wrong column type:\n    "), name, F.lit(": "), soda_type))),
    ]
    columns = profile.select(
        "ordinal", "column", F.posexplode(F.filter(F.array(*candidates), lambda c: c.isNotNull())).alias("nth", "c")
    ).select("ordinal", "nth", "column", "c.*")
    whole = profile.select(
        F.lit(-1).alias("ordinal"), F.lit(0).alias("nth"), F.lit(None).cast("string").alias("column"),
        F.lit("row_count > 0").alias("line"), F.lit(None).cast("string").alias("thresholds"),
    ).distinct()
    return whole.unionByName(columns).withColumn("table", F.lit(table))


def soda_yaml(checks: DataFrame) -> DataFrame:
    """The check file as one text."""
    deeper = F.concat(F.lit("      "), F.replace("thresholds", F.lit("\n"), F.lit("\n      ")))
    entry = F.concat(F.lit("  - "), F.col("line"), F.coalesce(F.concat(F.lit("\n"), deeper), F.lit("")))
    packed = checks.groupBy("table").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "nth", entry.alias("e")))), lambda x: x["e"]).alias("entries")
    )
    return packed.select("table", F.concat(
        F.lit("checks for "), F.col("table"), F.lit(":\n"), F.array_join("entries", "\n"), F.lit("\n")).alias("text"))


def generate_jsonschema(profile: DataFrame) -> DataFrame:
    """One row per property of the record schema."""
    inferred = F.col("inferred_type")
    numeric, textual = F.col("num_count") > 0, inferred == "String"
    return profile.select(
        "ordinal", "column", F.coalesce(_mapped(inferred, SCHEMA_TYPE_OF), F.lit("string")).alias("type"),
        F.when(inferred == "Date", "date").alias("format"),
        F.when(numeric, F.col("min")).alias("minimum"), F.when(numeric, F.col("max")).alias("maximum"),
        F.when(textual, F.col("min_length")).alias("minLength"), F.when(textual, F.col("max_length")).alias("maxLength"),
        (F.col("missing") == 0).alias("required"),
    )


def jsonschema_json(properties: DataFrame, title: str, ident: str = "generated-schema") -> DataFrame:
    """The record schema as one JSON text."""
    body = F.struct("type", "format", "minimum", "maximum", "minLength", "maxLength")
    packed = properties.agg(
        F.array_sort(F.collect_list(F.struct("ordinal", "column", body.alias("p"), "required"))).alias("all")
    )
    schema = F.struct(
        F.lit("https://json-schema.org/draft/2020-12/schema").alias("$schema"), F.lit(ident).alias("$id"),
        F.lit(title).alias("title"), F.lit("object").alias("type"),
        F.map_from_entries(F.transform("all", lambda x: F.struct(x["column"], x["p"]))).alias("properties"),
        F.transform(F.filter("all", lambda x: x["required"]), lambda x: x["column"]).alias("required"),
    )
    return packed.select(F.to_json(schema).alias("text"))
