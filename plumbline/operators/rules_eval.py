"""Checking rules against a column-profile table.

A rule set is a table; rules meet the profile by column name in one join and are
decided by column expressions. Results have the columns ``rule_type, column, status,
observed, expected, reason, raw``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline import session
from plumbline.functions.numeric import fixed, grouped, plain, share
from plumbline.operators.frequency import LONG_TEXT, FrequencyTable, digest_of
from plumbline.operators.rules_gen import all_held
from plumbline.operators.stats import restore_long_texts

RESULT = ("rule_type", "column", "status", "observed", "expected", "reason", "raw")

GX_SCHEMA = (
    "rule_type string, column string, min_value double, max_value double, mostly double, "
    "type_ string, value double, value_set array<string>"
)
SODA_SCHEMA = (
    "metric string, column string, operator string, threshold double, threshold_high double, "
    "supported boolean, reason string, raw string"
)
JSON_SCHEMA = (
    "rule_type string, column string, types array<string>, bound double, allowed array<string>"
)

# Suite rule names that can be decided from a profile.
GX_SUPPORTED = (
    "expect_column_to_exist", "expect_column_values_to_not_be_null", "expect_column_values_to_be_of_type",
    "expect_column_values_to_be_between", "expect_column_values_to_be_unique",
    "expect_column_mean_to_be_between", "expect_column_distinct_values_to_be_in_set",
    "expect_column_values_to_be_in_set", "expect_table_row_count_to_be_between",
    "expect_table_column_count_to_equal",
)
# Inferred types accepted for a declared type.
GX_TYPES = {
    "INTEGER": ["Integer"], "FLOAT": ["Numeric", "Integer"], "STRING": ["String"],
    "BOOLEAN": ["Boolean"], "DATE": ["Date"], "DATETIME": ["DateTime"],
}
SCHEMA_TYPES = {
    "string": ["string", "date", "datetime"], "integer": ["integer"],
    "number": ["integer", "float", "numeric"], "boolean": ["boolean"], "null": ["empty", "null"],
}
# Share of distinct values from which a column passes as unique.
UNIQUE_SHARE = 0.95


def with_table_facts(profile: DataFrame) -> DataFrame:
    """Add the rows and columns of the table to each of its column rows."""
    facts = profile.agg(F.max("count").alias("r"), F.count(F.lit(1)).alias("c"))
    return profile.withColumns(
        {"table_rows": facts.select("r").scalar(), "table_columns": facts.select("c").scalar()}
    )


NOT_ALL_HELD = "The profile does not hold all distinct values"


def _against(rules: DataFrame, profile: DataFrame, max_columns: int) -> DataFrame:
    """Each rule with the profile row of its column (null where there is none) and the table facts."""
    facts = profile.agg(F.max("count").alias("r"), F.count(F.lit(1)).alias("c"))
    known = profile.select(
        "column", F.lit(True).alias("found"), "count", "missing", "distinct", "inferred_type",
        "num_count", "min", "max", "mean", "std_dev",
        *(["top_values"] if "top_values" in profile.columns else [
            F.lit(None).cast("array<struct<value:string,n:bigint,percentage:double>>").alias("top_values")]),
    )
    joined = rules.join(session.bounded(known, max_columns), "column", "left")
    return joined.withColumns(
        {"table_rows": facts.select("r").scalar(), "table_columns": facts.select("c").scalar()}
    )


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _outcome(ok: Column, observed: Column | None = None, expected: Column | None = None,
             reason: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        F.when(ok, "pass").otherwise("fail").alias("status"),
        (none if observed is None else observed).alias("observed"),
        (none if expected is None else expected).alias("expected"),
        (none if reason is None else reason).alias("reason"),
    )


def _skipped(reason: str | Column) -> Column:
    none = F.lit(None).cast("string")
    why = F.lit(reason) if isinstance(reason, str) else reason
    return F.struct(F.lit("skipped").alias("status"), none.alias("observed"), none.alias("expected"),
                    why.alias("reason"))


def _failed(reason: str, observed: str | None = None) -> Column:
    return F.struct(
        F.lit("fail").alias("status"), F.lit(observed).cast("string").alias("observed"),
        F.lit(None).cast("string").alias("expected"), F.lit(reason).alias("reason"),
    )


def _num(c: Column, digits: int = 2) -> Column:
    return F.coalesce(grouped(c, digits), F.lit("N/A"))


def _listed(values: Column, shown: int, more: bool) -> Column:
    head = F.array_join(F.slice(values, 1, shown), ", ")
    return F.concat(head, F.when(F.size(values) > shown, "...").otherwise("")) if more else head


def _decided(rules: DataFrame, outcome: Column, raw: Column | None = None) -> DataFrame:
    return rules.select(
        "rule_type", "column", outcome.alias("_o"), (F.lit(None).cast("string") if raw is None else raw).alias("raw")
    ).select("rule_type", "column", "_o.status", "_o.observed", "_o.expected", "_o.reason", "raw")


def _outside(rules: DataFrame, allowed: str, values: DataFrame | FrequencyTable) -> DataFrame:
    """The rules with ``unknown``: the most frequent values of their column (three at most) that ``allowed`` does not hold.

    ``values`` is a frequency table, or has one row per column and value, with ``n``. Long texts are compared by their
    digests where ``values`` holds these; a frequency table also gives their texts back, for the few that are shown.
    """
    table = values if isinstance(values, FrequencyTable) else None
    values = table.valid if table else values
    digest = F.col("digest") if "digest" in values.columns else F.lit(None).cast("string")

    def fits(v: Column, d: Column) -> Column:
        numbers = F.transform(F.col(allowed), lambda x: x.try_cast("double"))
        told = F.transform(F.filter(allowed, lambda x: F.octet_length(x) > LONG_TEXT), digest_of)
        return F.when(d.isNotNull(), F.array_contains(told, d)).otherwise(
            F.array_contains(allowed, v) | F.coalesce(F.array_contains(numbers, v.try_cast("double")), F.lit(False)))

    sets = rules.filter(F.col(allowed).isNotNull() & F.col("column").isNotNull()).select("column", allowed).distinct()
    own = ["ordinal"] if table else []
    seen = values.select("column", *own, "value", digest.alias("digest"), "n")
    strange = seen.join(session.bounded(sets, sets.count()), "column").filter(~fits(F.col("value"), F.col("digest")))
    shown = F.coalesce("value", "digest")
    order = Window.partitionBy("column", allowed).orderBy(F.desc("n"), shown)
    first = strange.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= 3)
    if table and table.columns.of_kind("text", "container"):
        first = restore_long_texts(table, first, None, 3 * max(1, len(table.columns.names)))
    lists = first.groupBy("column", allowed).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("nth", shown.alias("v")))), lambda e: e["v"]).alias("unknown"))
    known = rules.join(lists, ["column", allowed], "left")
    return known.withColumn("unknown", F.coalesce("unknown", F.array().cast("array<string>")))


def evaluate_gx(rules: DataFrame, profile: DataFrame, max_columns: int, values: DataFrame | FrequencyTable | None = None) -> DataFrame:
    """Decide suite rules (table of ``GX_SCHEMA``).

    Value sets are checked against all ``values`` (a frequency table), or without them against the
    top values that the profile holds; where those are not all values and none is outside, the rule is skipped.
    """
    r = _against(rules if values is None else _outside(rules, "value_set", values), profile, max_columns)
    lo, hi = F.col("min_value"), F.col("max_value")
    found = F.col("found").isNotNull()
    valid = F.col("count") - F.col("missing")
    complete = share(valid, F.col("count"), 0.0)
    mostly = F.coalesce("mostly", F.lit(1.0))
    numeric = F.col("num_count") > 0
    tops = F.transform(F.col("top_values"), lambda t: t["value"])
    accepted = F.coalesce(
        *[F.when(F.col("type_") == k, F.array(*[F.lit(x) for x in v])) for k, v in GX_TYPES.items()],
        F.array().cast("array<string>"),
    )
    unknown = F.array_except(tops, F.col("value_set")) if values is None else F.col("unknown")
    in_set = F.size(unknown) == 0
    undecided = F.lit(values is None) & in_set & ~all_held(F.col("top_values"), valid)
    unique = (valid > 0) & (F.col("distinct") >= valid * UNIQUE_SHARE)

    def is_rule(name: str) -> Column:
        return F.col("rule_type") == name

    seen_unique = _text(_num(F.col("distinct"), 0), " distinct / ", _num(valid, 0), " values")
    outcome = (
        F.when(~F.col("rule_type").isin(*GX_SUPPORTED), _skipped("Cannot validate: requires raw data evaluation"))
        .when(is_rule("expect_table_row_count_to_be_between"), _outcome(
            (F.col("table_rows") >= lo) & (F.col("table_rows") <= hi),
            _text(_num(F.col("table_rows"), 0), " rows"), _text(_num(lo, 0), " - ", _num(hi, 0), " rows")))
        .when(is_rule("expect_table_column_count_to_equal"), _outcome(
            F.col("table_columns") == F.col("value"),
            _text(F.col("table_columns").cast("string"), " columns"), _text(plain(F.col("value")), " columns")))
        .when(F.col("column").isNull(), _skipped("No column specified in expectation"))
        .when(is_rule("expect_column_to_exist") & found, _outcome(F.lit(True), F.lit("Column exists")))
        .when(is_rule("expect_column_to_exist"), _failed("Column not found in profile", "Column not found"))
        .when(~found, _failed("Column not found in profile"))
        .when(is_rule("expect_column_values_to_not_be_null"), _outcome(
            complete >= mostly, _text(fixed(complete * 100, 1), "% non-null"),
            _text(">= ", fixed(mostly * 100, 1), "% non-null")))
        .when(is_rule("expect_column_values_to_be_of_type"), _outcome(
            F.array_contains(accepted, F.col("inferred_type")), F.col("inferred_type"), F.col("type_")))
        .when(is_rule("expect_column_values_to_be_between") & ~numeric, _skipped("Column is not numeric"))
        .when(is_rule("expect_column_values_to_be_between"), _outcome(
            (F.col("min") >= lo) & (F.col("max") <= hi),
            _text("min=", _num(F.col("min")), ", max=", _num(F.col("max"))),
            _text("min>=", _num(lo), ", max<=", _num(hi))))
        .when(is_rule("expect_column_mean_to_be_between") & ~numeric,
              _skipped("Column is not numeric or has no mean"))
        .when(is_rule("expect_column_mean_to_be_between"), _outcome(
            (F.col("mean") >= lo) & (F.col("mean") <= hi), _text("mean=", _num(F.col("mean"))),
            _text(_num(lo), " <= mean <= ", _num(hi))))
        .when(is_rule("expect_column_values_to_be_unique"), _outcome(
            unique, seen_unique, F.when(~unique, "All values unique")))
        .when(tops.isNull(), _skipped("No categorical statistics available"))
        .when(undecided, _skipped(NOT_ALL_HELD))
        .otherwise(_outcome(
            in_set,
            F.when(in_set, _text("Top values: ", _listed(tops, 5, True)))
            .otherwise(_text("Top values: ", _listed(tops, 5, False))),
            _text("Values in set: ", _listed(F.col("value_set"), 5, True))))
    )
    return _decided(r, outcome)


def soda_metric(metric: Column) -> Column:
    """Value of a named metric from the joined profile row; null when unavailable."""
    repeated = F.col("count") - F.col("distinct")
    values = {
        "missing_count": F.col("missing"), "missing_percent": F.col("missing") / F.col("count") * 100,
        "duplicate_count": repeated, "duplicate_percent": repeated / F.col("count") * 100,
        "min": F.col("min"), "max": F.col("max"), "avg": F.col("mean"), "mean": F.col("mean"),
        "stddev": F.col("std_dev"),
    }
    return F.coalesce(*[F.when(metric == k, v.cast("double")) for k, v in values.items()])


def soda_operator(value: Column, operator: Column, low: Column, high: Column) -> Column:
    """Apply a named comparison; unknown ones never hold."""
    return (
        F.when(operator == "between", (value >= low) & (value <= high))
        .when(operator.isin("=", "=="), value == low).when(operator == ">", value > low)
        .when(operator == "<", value < low).when(operator == ">=", value >= low)
        .when(operator == "<=", value <= low).when(operator == "!=", value != low)
        .otherwise(F.lit(False))
    )


def evaluate_soda(checks: DataFrame, profile: DataFrame, max_columns: int) -> DataFrame:
    """Decide check lines (table of ``SODA_SCHEMA``)."""
    r = _against(checks.withColumnRenamed("reason", "why"), profile, max_columns)
    r = r.withColumn("rule_type", F.coalesce("metric", F.lit("unknown")))
    op, low, high = F.col("operator"), F.col("threshold"), F.col("threshold_high")
    value = F.when(F.col("column").isNull(), F.col("table_rows").cast("double")).otherwise(soda_metric(F.col("metric")))
    expected = F.when(op == "between", _text("between ", plain(low), " and ", plain(high))).otherwise(
        _text(op, " ", plain(low))
    )
    shown = F.when(F.contains("metric", F.lit("percent")), _text(fixed(value, 2), "%")).otherwise(grouped(value, 3))
    decided = _outcome(soda_operator(value, op, low, high), shown, expected)
    outcome = (
        F.when(~F.col("supported"), _skipped(F.col("why")))
        .when(F.col("column").isNull() & (F.col("metric") == "row_count"),
              _outcome(soda_operator(value, op, low, high), F.col("table_rows").cast("string"), expected))
        .when(F.col("column").isNull(), _skipped("Unsupported table-level check"))
        .when(F.col("found").isNull(), _failed("Column not found in profile"))
        .when(value.isNull(), _skipped(_text("Metric ", F.col("metric"), " not available in profile")))
        .otherwise(decided)
    )
    return _decided(r, outcome, F.col("raw"))


def evaluate_json_schema(rules: DataFrame, profile: DataFrame, max_columns: int, values: DataFrame | FrequencyTable | None = None) -> DataFrame:
    """Decide constraints of a record schema (table of ``JSON_SCHEMA``).

    Constraints on absent columns give no result, except ``required``. ``values`` as for suites.
    """
    r = _against(rules if values is None else _outside(rules, "allowed", values), profile, max_columns)
    found, numeric = F.col("found").isNotNull(), F.col("num_count") > 0
    kind, bound = F.col("rule_type"), F.col("bound")
    seen = F.lower("inferred_type")
    accepted = F.flatten(F.transform(
        F.col("types"),
        lambda t: F.coalesce(
            *[F.when(t == k, F.array(*[F.lit(x) for x in v])) for k, v in SCHEMA_TYPES.items()],
            F.array().cast("array<string>"),
        ),
    ))
    wanted = F.array_join("types", " or ")
    type_ok = F.array_contains(accepted, seen)
    tops = F.transform(F.col("top_values"), lambda t: t["value"])
    as_numbers = F.transform(F.col("allowed"), lambda x: x.try_cast("double"))
    unknown = F.col("unknown") if values is not None else F.filter(
        tops,
        lambda v: ~F.array_contains(F.col("allowed"), v)
        & ~F.coalesce(F.array_contains(as_numbers, v.try_cast("double")), F.lit(False)),
    )
    one_of = _text("One of: ", F.array_join("allowed", ", "))
    none_unknown = F.size(unknown) == 0
    undecided = F.lit(values is None) & none_unknown & ~all_held(F.col("top_values"), F.col("count") - F.col("missing"))
    above, below = F.col("min") >= bound, F.col("max") <= bound
    outcome = (
        F.when((kind == "required") & found, _outcome(F.lit(True), F.lit("present"), F.lit("present")))
        .when(kind == "required", F.struct(
            F.lit("fail").alias("status"), F.lit("missing").alias("observed"), F.lit("present").alias("expected"),
            F.lit("Required column not found").alias("reason")))
        .when(kind == "type", _outcome(
            type_ok, seen, wanted, F.when(~type_ok, _text("Type mismatch: Observed ", seen, ", expected ", wanted))))
        .when(kind == "minimum", _outcome(
            above, plain(F.col("min")), _text(">= ", plain(bound)),
            F.when(~above, _text("Observed min (", plain(F.col("min")), ") is less than schema minimum"))))
        .when(kind == "maximum", _outcome(
            below, plain(F.col("max")), _text("<= ", plain(bound)),
            F.when(~below, _text("Observed max (", plain(F.col("max")), ") is greater than schema maximum"))))
        .when(undecided, _skipped(NOT_ALL_HELD))
        .otherwise(_outcome(
            none_unknown, F.when(~none_unknown, _text("Found: ", F.array_join(F.slice(unknown, 1, 3), ", "), "...")),
            one_of, F.when(~none_unknown, "Column contains values not in enum list")))
    )
    applies = (
        (kind == "required") | (found & (kind == "type")) | (found & numeric & kind.isin("minimum", "maximum"))
        | (found & (kind == "enum") & tops.isNotNull())
    )
    return _decided(r.filter(applies), outcome)


def rule_summary(results: DataFrame, keys: list[str]) -> DataFrame:
    return results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "pass").alias("passed"),
        F.count_if(F.col("status") == "fail").alias("failed"),
        F.count_if(F.col("status") == "skipped").alias("skipped"),
    )


def values_in_set(values: DataFrame, allowed: DataFrame) -> DataFrame:
    """Observed ``(column, value)`` pairs outside the allowed pairs."""
    return values.select("column", "value").distinct().join(allowed, ["column", "value"], "left_anti")
