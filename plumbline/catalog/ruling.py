"""Rules: evaluated, loaded, generated; gates and reports.

Rule sets are derived from the tables themselves, so that the rows of both sides grow
with the data that is given.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline import session
from plumbline.catalog.twin import (
    MESSY, MESSY_COLUMNS, clean_sql, derived, missing_sql, profile_sql, query, rr, rr_sql, table, top_sql,
)
from plumbline.functions import text
from plumbline.operators import gates, quality, reports, rules_eval, rules_gen, rules_load, stats
from plumbline.operators.frequency import frequency
from plumbline.plans.profile import RULES, SUMMARY, profile

ME = profile_sql(f"({MESSY})", MESSY_COLUMNS)
METHOD = {"p_partkey": "int", "p_name": "text", "p_brand": "text", "p_type": "text", "p_size": "int", "p_retailprice": "real"}
PA = profile_sql("part", METHOD)
WIDTH = len(MESSY_COLUMNS)


def messy_profile(spark, sf, parts=RULES):
    return profile(derived(spark, sf, MESSY), parts=parts)


def messy_base(spark, sf):
    """Counts only; enough for rules that ask for no spread and no top values."""
    base = stats.base_stats(frequency(derived(spark, sf, MESSY)))
    return base.withColumn("std_dev", F.lit(None).cast("double"))


def _gx(spark, rows):
    blank = {"column": None, "min_value": None, "max_value": None, "mostly": None, "type_": None, "value": None, "value_set": None}
    full = [{**blank, **r} for r in rows]
    names = [c.split()[0] for c in rules_eval.GX_SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in full], rules_eval.GX_SCHEMA)


def _gx_query(name, rows, sql, columns=("rule_type", "column", "status", "observed", "expected", "reason"), tops=False):
    @query(name, f"WITH {ME}{', ' + top_sql() if tops else ''} {sql}")
    def run(spark, sf):
        p = messy_profile(spark, sf, {"moments", "top"}) if tops else messy_base(spark, sf)
        values = frequency(derived(spark, sf, MESSY)) if tops else None
        return rules_eval.evaluate_gx(_gx(spark, rows), p, WIDTH, values).select(*columns)


def _n(x, d=2):
    """A number with separators and at most d decimals, in SQL."""
    if d == 0:
        return f"format('{{:,}}', CAST({x} AS BIGINT))"
    return f"regexp_replace(regexp_replace(format('{{:,.{d}f}}', round({x}, {d})), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '')"


NO = "CAST(NULL AS VARCHAR)"

_gx_query("gx_row_count_between", [
    {"rule_type": "expect_table_row_count_to_be_between", "min_value": 100.0, "max_value": 1e9},
    {"rule_type": "expect_table_row_count_to_be_between", "min_value": 2.0, "max_value": 5.0},
], f"""SELECT 'expect_table_row_count_to_be_between' AS rule_type, {NO} AS "column", CASE WHEN n >= lo AND n <= hi THEN 'pass' ELSE 'fail' END AS status,
 format('{{:,}}', n) || ' rows' AS observed, format('{{:,}}', lo) || ' - ' || format('{{:,}}', hi) || ' rows' AS expected, {NO} AS reason
 FROM (SELECT count(*) AS n FROM events), (VALUES (100, 1000000000), (2, 5)) v(lo, hi)""")

_gx_query("gx_column_count_equal", [
    {"rule_type": "expect_table_column_count_to_equal", "value": 8.0}, {"rule_type": "expect_table_column_count_to_equal", "value": 3.0},
], f"""SELECT 'expect_table_column_count_to_equal' AS rule_type, {NO} AS "column", CASE WHEN n = want THEN 'pass' ELSE 'fail' END AS status,
 n || ' columns' AS observed, want || ' columns' AS expected, {NO} AS reason FROM (SELECT count(*) AS n FROM base), (VALUES (8), (3)) v(want)""")

_gx_query("gx_column_exists", [{"rule_type": "expect_column_to_exist", "column": c} for c in ("amount", "absent")]
          + [{"rule_type": "expect_column_to_exist"}],
          f"""SELECT 'expect_column_to_exist' AS rule_type, want AS "column", CASE WHEN want IS NULL THEN 'skipped' WHEN col IS NULL THEN 'fail' ELSE 'pass' END AS status,
 CASE WHEN want IS NULL THEN NULL WHEN col IS NULL THEN 'Column not found' ELSE 'Column exists' END AS observed, {NO} AS expected,
 CASE WHEN want IS NULL THEN 'No column specified in expectation' WHEN col IS NULL THEN 'Column not found in profile' END AS reason
 FROM (VALUES ('amount'), ('absent'), (NULL)) v(want) LEFT JOIN base ON col = want""")

COMPLETE = "CASE WHEN count > 0 THEN (count - missing) / CAST(count AS DOUBLE) ELSE 0 END"
_gx_query("gx_not_null", [{"rule_type": "expect_column_values_to_not_be_null", "column": c, "mostly": m}
                          for c, m in (("amount", 0.5), ("amount", None), ("event_id", None), ("nothing", 0.1))],
          f"""SELECT 'expect_column_values_to_not_be_null' AS rule_type, want AS "column", CASE WHEN {COMPLETE} >= coalesce(mostly, 1) THEN 'pass' ELSE 'fail' END AS status,
 format('{{:.1f}}', round({COMPLETE} * 100, 1)) || '% non-null' AS observed, '>= ' || format('{{:.1f}}', coalesce(mostly, 1.0) * 100) || '% non-null' AS expected, {NO} AS reason
 FROM (VALUES ('amount', 0.5::DOUBLE), ('amount', NULL), ('event_id', NULL), ('nothing', 0.1)) v(want, mostly) JOIN base ON col = want""")

TYPE_RULES = [("event_id", "INTEGER"), ("user_text", "FLOAT"), ("padded", "STRING"), ("flag_text", "BOOLEAN"), ("day_text", "DATE"),
              ("day_text", "DATETIME"), ("amount", "INTEGER"), ("nothing", "BLOB")]
_gx_query("gx_type", [{"rule_type": "expect_column_values_to_be_of_type", "column": c, "type_": t} for c, t in TYPE_RULES],
          f"""SELECT 'expect_column_values_to_be_of_type' AS rule_type, want AS "column", CASE WHEN (t = 'INTEGER' AND inferred_type = 'Integer')
 OR (t = 'FLOAT' AND inferred_type IN ('Numeric', 'Integer')) OR (t = 'STRING' AND inferred_type = 'String') OR (t = 'BOOLEAN' AND inferred_type = 'Boolean')
 OR (t = 'DATE' AND inferred_type = 'Date') THEN 'pass' ELSE 'fail' END AS status, inferred_type AS observed, t AS expected, {NO} AS reason
 FROM (VALUES {', '.join(f"('{c}', '{t}')" for c, t in TYPE_RULES)}) v(want, t) JOIN base ON col = want""")

RANGES = [("amount", 0.0, 1000.0), ("event_id", 5.0, 99.0), ("padded", 0.0, 1.0)]
_gx_query("gx_values_between", [{"rule_type": "expect_column_values_to_be_between", "column": c, "min_value": a, "max_value": b} for c, a, b in RANGES],
          f"""SELECT 'expect_column_values_to_be_between' AS rule_type, want AS "column", CASE WHEN num_count = 0 THEN 'skipped' WHEN min >= lo AND max <= hi THEN 'pass' ELSE 'fail' END AS status,
 CASE WHEN num_count > 0 THEN 'min=' || {_n('min')} || ', max=' || {_n('max')} END AS observed,
 CASE WHEN num_count > 0 THEN 'min>=' || {_n('lo')} || ', max<=' || {_n('hi')} END AS expected, CASE WHEN num_count = 0 THEN 'Column is not numeric' END AS reason
 FROM (VALUES {', '.join(f"('{c}', {a}::DOUBLE, {b}::DOUBLE)" for c, a, b in RANGES)}) v(want, lo, hi) JOIN base ON col = want""")

_gx_query("gx_mean_between", [{"rule_type": "expect_column_mean_to_be_between", "column": c, "min_value": a, "max_value": b} for c, a, b in RANGES],
          f"""SELECT 'expect_column_mean_to_be_between' AS rule_type, want AS "column", CASE WHEN num_count = 0 THEN 'skipped' WHEN mean >= lo AND mean <= hi THEN 'pass' ELSE 'fail' END AS status,
 CASE WHEN num_count > 0 THEN 'mean=' || {_n('mean')} END AS observed, CASE WHEN num_count > 0 THEN {_n('lo')} || ' <= mean <= ' || {_n('hi')} END AS expected,
 CASE WHEN num_count = 0 THEN 'Column is not numeric or has no mean' END AS reason
 FROM (VALUES {', '.join(f"('{c}', {a}::DOUBLE, {b}::DOUBLE)" for c, a, b in RANGES)}) v(want, lo, hi) JOIN base ON col = want""")

_gx_query("gx_unique", [{"rule_type": "expect_column_values_to_be_unique", "column": c} for c in MESSY_COLUMNS],
          f"""SELECT 'expect_column_values_to_be_unique' AS rule_type, col AS "column", CASE WHEN total_valid > 0 AND "distinct" >= total_valid * 0.95 THEN 'pass' ELSE 'fail' END AS status,
 {_n('"distinct"', 0)} || ' distinct / ' || {_n('total_valid', 0)} || ' values' AS observed,
 CASE WHEN NOT (total_valid > 0 AND "distinct" >= total_valid * 0.95) THEN 'All values unique' END AS expected, {NO} AS reason FROM base""")

SETS = [("expect_column_values_to_be_in_set", "padded", ["click", "view", "error", "signup", "purchase", "other"]),
        ("expect_column_distinct_values_to_be_in_set", "flag_text", ["TRUE"]), ("expect_column_values_to_be_in_set", "user_text", [str(i) for i in range(1, 400)])]


def _set_literal(v):
    return "[" + ", ".join(f"'{x}'" for x in v) + "]"


_gx_query("gx_in_set", [{"rule_type": r, "column": c, "value_set": s} for r, c, s in SETS],
          f""", tl AS (SELECT col, list(value ORDER BY position) AS vs FROM tops GROUP BY col), j AS (SELECT rule, want, ws, vs, (SELECT count(*) FROM counted k WHERE k.col = want AND NOT list_contains(ws, k.value)) = 0 AS ok
 FROM (VALUES {', '.join(f"('{r}', '{c}', {_set_literal(s)})" for r, c, s in SETS)}) v(rule, want, ws) JOIN tl ON col = want)
SELECT rule AS rule_type, want AS "column", CASE WHEN ok THEN 'pass' ELSE 'fail' END AS status,
 'Top values: ' || array_to_string(vs[1:5], ', ') || CASE WHEN ok AND len(vs) > 5 THEN '...' ELSE '' END AS observed,
 'Values in set: ' || array_to_string(ws[1:5], ', ') || CASE WHEN len(ws) > 5 THEN '...' ELSE '' END AS expected, {NO} AS reason FROM j""".replace(" , tl", " tl"), tops=True)

#: texts of some 300 bytes that differ at their end only
LABELS = "SELECT doc_id, concat(repeat('the label of a document in the language ', 8), lang) AS label FROM documents"
LABEL = "the label of a document in the language " * 8


@query("gx_in_set_long", f"""WITH l AS ({LABELS}), r AS (SELECT unnest([1, 2]) AS nth, unnest([['en', 'de', 'fr', 'es'], ['en', 'de', 'xx']]) AS langs),
 s AS (SELECT nth, list_transform(langs, lambda x: '{LABEL}' || x) AS allowed FROM r),
 o AS (SELECT nth, count(*) AS n FROM s, l WHERE NOT list_contains(allowed, label) GROUP BY nth),
 u AS (SELECT nth, label, count(*) AS n FROM s, l WHERE NOT list_contains(allowed, label) GROUP BY ALL),
 f AS (SELECT nth, string_agg(label, ', ' ORDER BY n DESC, label) AS found FROM (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY nth ORDER BY n DESC, label) <= 3) GROUP BY nth)
SELECT nth, kind, CASE WHEN n IS NULL THEN 'pass' ELSE 'fail' END AS status, CASE WHEN kind = 'enum' AND n IS NOT NULL THEN 'Found: ' || found || '...' END AS found
FROM s LEFT JOIN o USING (nth) LEFT JOIN f USING (nth), (SELECT unnest(['set', 'enum']) AS kind)""")
def gx_in_set_long(spark, sf):
    labels = derived(spark, sf, LABELS)
    p, values = profile(labels, ["label"], parts=RULES), frequency(labels, ["label"], materialized=True)
    out = None
    for nth, langs in ((1, ("en", "de", "fr", "es")), (2, ("en", "de", "xx"))):
        allowed = [LABEL + x for x in langs]
        gx = rules_eval.evaluate_gx(_gx(spark, [{"rule_type": "expect_column_values_to_be_in_set", "column": "label", "value_set": allowed}]), p, 2, values)
        enum = rules_eval.evaluate_json_schema(_json_schema(spark, [("enum", "label", None, None, allowed)]), p, 2, values)
        both = gx.select(F.lit("set").alias("kind"), "status", F.lit(None).cast("string").alias("found")).union(enum.select(F.lit("enum"), "status", "observed"))
        both = both.select(F.lit(nth).alias("nth"), "kind", "status", "found")
        out = both if out is None else out.union(both)
    return out


_gx_query("gx_unsupported", [{"rule_type": r, "column": "amount"} for r in ("expect_column_stdev_to_be_between", "expect_column_values_to_match_regex")],
          f"""SELECT rule AS rule_type, 'amount' AS "column", 'skipped' AS status, {NO} AS observed, {NO} AS expected, 'Cannot validate: requires raw data evaluation' AS reason
 FROM (VALUES ('expect_column_stdev_to_be_between'), ('expect_column_values_to_match_regex')) v(rule), (SELECT count(*) AS n FROM base) WHERE n > 0""")


#: customers in five groups
GROUPS = "(SELECT c_custkey, c_name, CAST(floor(c_nationkey / 5) AS INT) AS c_group FROM customer) AS grouped"


# --- check lines --------------------------------------------------------------------

def soda_of(spark, lines):
    return rules_load.soda_rules(spark.createDataFrame([(x,) for x in lines], "line string"))


METRICS = ["missing_count", "missing_percent", "duplicate_count", "duplicate_percent", "min", "max", "avg", "mean", "stddev"]
SODA_VALUE = """CASE m WHEN 'missing_count' THEN missing WHEN 'missing_percent' THEN missing * 100.0 / count WHEN 'duplicate_count' THEN count - "distinct"
 WHEN 'duplicate_percent' THEN (count - "distinct") * 100.0 / count WHEN 'min' THEN min WHEN 'max' THEN max WHEN 'avg' THEN mean WHEN 'mean' THEN mean WHEN 'stddev' THEN std_dev END"""


@query("soda_row_count", f"""WITH t AS (SELECT count(*) AS n FROM events) SELECT 'row_count' AS rule_type, CASE WHEN n > 0 THEN 'pass' ELSE 'fail' END AS status,
 CAST(n AS VARCHAR) AS observed, '> 0' AS expected, 'row_count > 0' AS raw FROM t UNION ALL
 SELECT 'row_count', CASE WHEN n BETWEEN 5 AND 20 THEN 'pass' ELSE 'fail' END, CAST(n AS VARCHAR), 'between 5 and 20', 'row_count between 5 and 20' FROM t""")
def soda_row_count(spark, sf):
    checks = soda_of(spark, ["row_count > 0", "row_count between 5 and 20"])
    return rules_eval.evaluate_soda(checks, messy_base(spark, sf), WIDTH).select("rule_type", "status", "observed", "expected", "raw")


@query("soda_metric", f"""WITH {ME}, v AS (SELECT col, m, CAST({SODA_VALUE} AS DOUBLE) AS x FROM prof, (SELECT unnest({_set_literal(METRICS)}) AS m))
SELECT m AS rule_type, col AS "column", CASE WHEN x IS NULL THEN 'skipped' WHEN x >= 10 THEN 'pass' ELSE 'fail' END AS status,
 CASE WHEN x IS NULL THEN 'Metric ' || m || ' not available in profile' END AS reason, m || '(' || col || ') >= 10' AS raw FROM v""")
def soda_metric(spark, sf):
    checks = soda_of(spark, [f"{m}({c}) >= 10" for m in METRICS for c in MESSY_COLUMNS])
    return rules_eval.evaluate_soda(checks, messy_profile(spark, sf, SUMMARY), WIDTH).select("rule_type", "column", "status", "reason", "raw")


OPS = {"=": "x = 1980", "==": "x = 1980", ">": "x > 1980", "<": "x < 1980", ">=": "x >= 1980", "<=": "x <= 1980", "!=": "x <> 1980"}


@query("soda_operator", f"""WITH {ME}, v AS (SELECT missing AS x FROM base WHERE col = 'amount') """ + " UNION ALL ".join(
    f"SELECT 'missing_count(amount) {o} 1980' AS raw, CASE WHEN {c} THEN 'pass' ELSE 'fail' END AS status FROM v" for o, c in OPS.items())
    + " UNION ALL SELECT 'missing_count(amount) between 10 and 5000', CASE WHEN x BETWEEN 10 AND 5000 THEN 'pass' ELSE 'fail' END FROM v")
def soda_operator(spark, sf):
    checks = soda_of(spark, [f"missing_count(amount) {o} 1980" for o in OPS] + ["missing_count(amount) between 10 and 5000"])
    return rules_eval.evaluate_soda(checks, messy_base(spark, sf), WIDTH).select("raw", "status")


#: a check line per customer
LINES = f"""SELECT c_custkey AS k, CASE WHEN c_group = 0 THEN concat('row_count > ', CAST(c_custkey AS STRING))
 WHEN c_group = 1 THEN concat('min(', c_name, ') >= -', CAST(c_custkey AS STRING), '.5')
 WHEN c_group = 2 THEN concat('avg(', c_name, ') between ', CAST(c_custkey AS STRING), ' and 99')
 WHEN c_group = 3 THEN concat('freshness(', c_name, ') < 1d') ELSE concat('failed rows from SQL ', c_name) END AS line FROM {GROUPS}"""


@query("soda_load", f"""WITH l AS ({LINES}), p AS (SELECT k, line, regexp_matches(line, '{rules_load.COMPARE_LINE}') AS c, regexp_matches(line, '{rules_load.BETWEEN_LINE}') AS b FROM l)
SELECT k, line AS raw, CASE WHEN c THEN regexp_extract(line, '{rules_load.COMPARE_LINE}', 1) WHEN b THEN regexp_extract(line, '{rules_load.BETWEEN_LINE}', 1) END AS metric,
 CASE WHEN c THEN nullif(regexp_extract(line, '{rules_load.COMPARE_LINE}', 2), '') WHEN b THEN nullif(regexp_extract(line, '{rules_load.BETWEEN_LINE}', 2), '') END AS "column",
 CASE WHEN c THEN regexp_extract(line, '{rules_load.COMPARE_LINE}', 3) WHEN b THEN 'between' END AS operator,
 CAST(CASE WHEN c THEN regexp_extract(line, '{rules_load.COMPARE_LINE}', 4) WHEN b THEN regexp_extract(line, '{rules_load.BETWEEN_LINE}', 3) END AS DOUBLE) AS threshold,
 CAST(CASE WHEN b THEN regexp_extract(line, '{rules_load.BETWEEN_LINE}', 4) END AS DOUBLE) AS threshold_high, c OR b AS supported,
 CASE WHEN c OR b THEN NULL WHEN contains(lower(line), 'sql') THEN 'Cannot validate: requires database execution' ELSE 'Cannot validate: requires timestamp comparison' END AS reason FROM p""")
def soda_load(spark, sf):
    lines = derived(spark, sf, LINES)
    files = lines.withColumn("text", F.concat(F.lit("checks for customer:\n  # a note\n  - "), F.col("line"), F.lit("\n")))
    entries = rules_load.soda_lines(files, "text", ["k"])
    return rules_load.soda_rules(entries, "line", ["k"])


# --- record schemas -------------------------------------------------------------------

def _json_schema(spark, rows):
    return spark.createDataFrame(rows, rules_eval.JSON_SCHEMA)


def _js_query(name, rows, sql, tops=False):
    @query(name, f"WITH {ME}{', ' + top_sql() if tops else ''} {sql}")
    def run(spark, sf):
        p = messy_profile(spark, sf, {"moments", "top"}) if tops else messy_base(spark, sf)
        values = frequency(derived(spark, sf, MESSY)) if tops else None
        return rules_eval.evaluate_json_schema(_json_schema(spark, rows), p, WIDTH, values).select("rule_type", "column", "status", "observed", "expected", "reason")


_js_query("jsonschema_required", [("required", c, None, None, None) for c in ("event_id", "absent")],
          """SELECT 'required' AS rule_type, want AS "column", CASE WHEN col IS NULL THEN 'fail' ELSE 'pass' END AS status, CASE WHEN col IS NULL THEN 'missing' ELSE 'present' END AS observed,
 'present' AS expected, CASE WHEN col IS NULL THEN 'Required column not found' END AS reason FROM (VALUES ('event_id'), ('absent')) v(want) LEFT JOIN base ON col = want""")

JS_TYPES = [("event_id", ["integer"]), ("amount", ["integer", "number"]), ("padded", ["number"]), ("day_text", ["string"]), ("flag_text", ["boolean", "null"]), ("nothing", ["null"]), ("absent", ["string"])]
_js_query("jsonschema_type", [("type", c, t, None, None) for c, t in JS_TYPES],
          f""", j AS (SELECT want, types, lower(inferred_type) AS seen, len(list_filter(types, lambda t: (t = 'string' AND lower(inferred_type) IN ('string', 'date', 'datetime')) OR (t = 'integer' AND inferred_type = 'Integer')
 OR (t = 'number' AND inferred_type IN ('Integer', 'Numeric')) OR (t = 'boolean' AND inferred_type = 'Boolean') OR (t = 'null' AND inferred_type = 'Null'))) > 0 AS ok
 FROM (VALUES {', '.join(f"('{c}', {_set_literal(t)})" for c, t in JS_TYPES)}) v(want, types) JOIN base ON col = want)
SELECT 'type' AS rule_type, want AS "column", CASE WHEN ok THEN 'pass' ELSE 'fail' END AS status, seen AS observed, array_to_string(types, ' or ') AS expected,
 CASE WHEN NOT ok THEN 'Type mismatch: Observed ' || seen || ', expected ' || array_to_string(types, ' or ') END AS reason FROM j""".replace(" , j", " j"))

for _kind, _c, _op, _bounds in (("minimum", "min", ">=", (0, 5)), ("maximum", "max", "<=", (5, 1000000000))):
    _js_query(f"jsonschema_{_kind}", [(_kind, c, None, float(b), None) for b in _bounds for c in ("event_id", "padded")],
              f"""SELECT '{_kind}' AS rule_type, col AS "column", CASE WHEN {_c} {_op} b THEN 'pass' ELSE 'fail' END AS status, CAST(CAST({_c} AS BIGINT) AS VARCHAR) AS observed, '{_op} ' || b AS expected,
 CASE WHEN NOT {_c} {_op} b THEN 'Observed {_c} (' || CAST({_c} AS BIGINT) || ') is {'less' if _c == 'min' else 'greater'} than schema {_kind}' END AS reason
 FROM base, (VALUES ({_bounds[0]}), ({_bounds[1]})) v(b) WHERE col = 'event_id'""")

ENUMS = [("padded", ["click", "view"]), ("flag_text", ["TRUE", "f"]), ("user_text", [str(i) for i in range(1, 400)])]
_js_query("jsonschema_enum", [("enum", c, None, None, s) for c, s in ENUMS],
          f""", tl AS (SELECT col, list(value ORDER BY position) AS vs FROM tops GROUP BY col), j AS (SELECT want, ws, coalesce((SELECT list(value ORDER BY n DESC, value) FROM counted k WHERE k.col = want AND NOT list_contains(ws, k.value)), []) AS unknown
 FROM (VALUES {', '.join(f"('{c}', {_set_literal(s)})" for c, s in ENUMS)}) v(want, ws) JOIN tl ON col = want)
SELECT 'enum' AS rule_type, want AS "column", CASE WHEN len(unknown) = 0 THEN 'pass' ELSE 'fail' END AS status, CASE WHEN len(unknown) > 0 THEN 'Found: ' || array_to_string(unknown[1:3], ', ') || '...' END AS observed,
 'One of: ' || array_to_string(ws, ', ') AS expected, CASE WHEN len(unknown) > 0 THEN 'Column contains values not in enum list' END AS reason FROM j""".replace(" , tl", " tl"), tops=True)

#: a record schema per customer
SCHEMAS = f"""SELECT c_custkey AS k, concat('{{"type": "array", "items": {{"required": ["', c_name, '"], "properties": {{"', c_name,
 '": {{"type": ["integer", "null"], "minimum": ', CAST(c_group AS STRING), '}}, "kind": {{"type": "string", "enum": ["a", "', c_name, '"]}}}}}}}}') AS text FROM {GROUPS}"""


@query("jsonschema_load", f"""SELECT c_custkey AS k, 'required' AS rule_type, c_name AS "column", NULL::VARCHAR AS types, NULL::DOUBLE AS bound, NULL::VARCHAR AS allowed FROM {GROUPS}
 UNION ALL SELECT c_custkey, 'type', c_name, 'integer,null', NULL, NULL FROM {GROUPS} UNION ALL SELECT c_custkey, 'minimum', c_name, NULL, c_group, NULL FROM {GROUPS}
 UNION ALL SELECT c_custkey, 'type', 'kind', 'string', NULL, NULL FROM {GROUPS} UNION ALL SELECT c_custkey, 'enum', 'kind', NULL, NULL, 'a,' || c_name FROM {GROUPS}""")
def jsonschema_load(spark, sf):
    rules = rules_load.json_schema_rules(derived(spark, sf, SCHEMAS), "text", ["k"])
    return rules.select("k", "rule_type", "column", F.array_join("types", ",").alias("types"), "bound", F.array_join("allowed", ",").alias("allowed"))


#: a suite per customer, those of group 4 without a name
SUITES = f"""SELECT c_custkey AS k, concat('{{', CASE WHEN c_group = 4 THEN '' ELSE concat('"expectation_suite_name": "', c_name, '", ') END,
 '"expectations": [{{"expectation_type": "expect_column_values_to_be_between", "kwargs": {{"column": "', c_name, '", "min_value": ', CAST(c_group AS STRING),
 ', "max_value": 9.5}}}}, {{"expectation_type": "expect_something_else", "kwargs": {{"value_set": ["x", 1]}}}}]}}') AS text FROM {GROUPS}"""


@query("gx_load", f"""SELECT c_custkey AS k, 'expect_column_values_to_be_between' AS rule_type, c_name AS "column", CAST(c_group AS DOUBLE) AS min_value, CAST(9.5 AS DOUBLE) AS max_value,
 NULL::VARCHAR AS value_set, true AS supported, NULL::VARCHAR AS error FROM {GROUPS} WHERE c_group <> 4
 UNION ALL SELECT c_custkey, 'expect_something_else', NULL, NULL, NULL, 'x,1', false, NULL FROM {GROUPS} WHERE c_group <> 4
 UNION ALL SELECT c_custkey, NULL, NULL, NULL, NULL, NULL, NULL, 'format_error' FROM {GROUPS} WHERE c_group = 4""")
def gx_load(spark, sf):
    r = rules_load.gx_rules(derived(spark, sf, SUITES), "text", ["k"])
    return r.select("k", "rule_type", "column", "min_value", "max_value", F.array_join("value_set", ",").alias("value_set"), "supported", "error")


# --- generated rules ----------------------------------------------------------------

PART_TYPES = "CASE inferred_type WHEN 'Integer' THEN 'INTEGER' WHEN 'Numeric' THEN 'FLOAT' WHEN 'String' THEN 'STRING' WHEN 'Boolean' THEN 'BOOLEAN' WHEN 'Date' THEN 'DATE' END"


def _generated_sql(cte):
    def one(rule, where, **kw):
        slots = {"min_value": "NULL::DOUBLE", "max_value": "NULL::DOUBLE", "mostly": "NULL::DOUBLE", "type_": "NULL::VARCHAR", "value": "NULL::DOUBLE", "value_set": "NULL::VARCHAR"}
        slots.update(kw)
        return f"SELECT '{rule}' AS rule_type, col AS \"column\", {', '.join(f'{v} AS {k}' for k, v in slots.items())} FROM prof LEFT JOIN tl USING (col) WHERE inferred_type <> 'Null' AND {where}"
    valid = "(count - missing)"
    parts = [
        one("expect_column_to_exist", "true"),
        one("expect_column_values_to_be_of_type", "true", type_=PART_TYPES),
        one("expect_column_values_to_not_be_null", f"{valid} / CAST(count AS DOUBLE) >= 0.5", mostly="greatest(0, round(1 - missing / CAST(count AS DOUBLE) * 1.1::DOUBLE, 4))"),
        one("expect_column_values_to_be_between", "num_count > 0", min_value="round(min - abs(min) * 0.1::DOUBLE, 6)", max_value="round(max + abs(max) * 0.1::DOUBLE, 6)", mostly="1.0::DOUBLE"),
        one("expect_column_mean_to_be_between", "num_count > 0 AND count >= 10", min_value="round(mean - abs(mean) * 0.1::DOUBLE, 4)", max_value="round(mean + abs(mean) * 0.1::DOUBLE, 4)"),
        one("expect_column_values_to_be_unique", f'{valid} > 0 AND "distinct" >= {valid} * 0.999::DOUBLE'),
        one("expect_column_values_to_be_in_set", "inferred_type = 'Boolean'", value_set="'" + ",".join(rules_gen.BOOLEAN_SET) + "'"),
        one("expect_column_distinct_values_to_be_in_set", f"inferred_type = 'String' AND \"distinct\" <= 20 AND {valid} > 0", value_set="vs"),
        """SELECT 'expect_table_row_count_to_be_between', NULL, floor(max(count) * 0.9::DOUBLE)::DOUBLE, ceil(max(count) * 1.1::DOUBLE)::DOUBLE, NULL, NULL, NULL, NULL FROM prof""",
        """SELECT 'expect_table_column_count_to_equal', NULL, NULL, NULL, NULL, NULL, count(*)::DOUBLE, NULL FROM prof""",
    ]
    return f"WITH {cte}, {top_sql(size=20)}, tl AS (SELECT col, string_agg(value, ',' ORDER BY position) AS vs FROM tops GROUP BY col), gen AS ({' UNION ALL '.join(parts)})"


@query("generate_gx", f"{_generated_sql(ME)} SELECT * FROM gen")
def generate_gx(spark, sf):
    g = rules_gen.generate_gx(messy_profile(spark, sf))
    mean = F.col("rule_type") == "expect_column_mean_to_be_between"
    return g.select("rule_type", "column", *[F.when(mean, F.round(c, 4)).otherwise(F.col(c)).alias(c) for c in ("min_value", "max_value")],
                    "mostly", "type_", "value", F.array_join("value_set", ",").alias("value_set"))


@query("gx_summary", f"{_generated_sql(ME)} SELECT rule_type, count(*) AS rules FROM gen GROUP BY rule_type")
def gx_summary(spark, sf):
    return rules_gen.gx_summary(rules_gen.generate_gx(messy_profile(spark, sf)))


@query("gx_coverage", f"""WITH {ME} SELECT count(*) FILTER (WHERE inferred_type <> 'Null') AS columns_included,
 string_agg(col, ',' ORDER BY col) FILTER (WHERE inferred_type = 'Null') AS columns_skipped FROM base""")
def gx_coverage(spark, sf):
    c = rules_gen.gx_coverage(messy_base(spark, sf))
    return c.select("columns_included", F.array_join("columns_skipped", ",").alias("columns_skipped"))


@query("gx_round_trip", """SELECT count(DISTINCT p_partkey) > 0 AS some, 0::BIGINT AS failed FROM part""")
def gx_round_trip(spark, sf):
    """Rules generated from a table hold on that table."""
    p = profile(table(spark, sf, "part"), parts=RULES)
    rules = rules_gen.generate_gx(p).drop("ordinal", "nth")
    results = rules_eval.evaluate_gx(rules, p, len(METHOD))
    return rules_eval.rule_summary(results, []).select((F.col("total") > 0).alias("some"), "failed")


SODA_SHORT = "regexp_replace(regexp_replace(format('{{:.4f}}', round({x}, 4)), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '')"


def _soda_band(width):
    return f"{SODA_SHORT.format(x=f'mean * (1 - {width}::DOUBLE)')} || ' and ' || {SODA_SHORT.format(x=f'mean * (1 + {width}::DOUBLE)')}"


@query("generate_soda", f"""WITH {PA}, l AS (SELECT 'row_count > 0' AS line, {NO} AS thresholds UNION ALL
 SELECT 'missing_count(' || col || ') = 0', {NO} FROM prof WHERE missing = 0 UNION ALL
 SELECT 'missing_percent(' || col || ') < ' || CAST(ceil(missing * 100.0 / count * 1.1::DOUBLE + 1) AS BIGINT), {NO} FROM prof WHERE missing > 0 UNION ALL
 SELECT 'duplicate_count(' || col || ') = 0', {NO} FROM prof WHERE total_valid > 0 AND "distinct" >= total_valid * 0.999::DOUBLE UNION ALL
 SELECT 'min(' || col || ') >= ' || CASE WHEN min = 0 THEN '0.0000e+0' ELSE {SODA_SHORT.format(x='min * (CASE WHEN min >= 0 THEN 0.9 ELSE 1.1 END)::DOUBLE')} END, {NO} FROM prof WHERE num_count > 0 UNION ALL
 SELECT 'max(' || col || ') <= ' || {SODA_SHORT.format(x='max * (CASE WHEN max >= 0 THEN 1.1 ELSE 0.9 END)::DOUBLE')}, {NO} FROM prof WHERE num_count > 0 UNION ALL
 SELECT 'avg(' || col || '):', 'fail: when not between ' || {_soda_band(0.1)} || chr(10) || 'warn: when not between ' || {_soda_band(0.05)} FROM prof WHERE num_count > 0 UNION ALL
 SELECT 'schema:', 'warn:' || chr(10) || '  when wrong column type:' || chr(10) || '    ' || col || ': ' || CASE inferred_type WHEN 'Integer' THEN 'integer' WHEN 'Numeric' THEN 'decimal' WHEN 'String' THEN 'text'
  WHEN 'Boolean' THEN 'boolean' ELSE 'date' END FROM prof WHERE inferred_type <> 'Null')
SELECT line, thresholds, count(*) AS n FROM l GROUP BY ALL""")
def generate_soda(spark, sf):
    g = rules_gen.generate_soda(profile(table(spark, sf, "part"), parts=SUMMARY), "part")
    return g.groupBy("line", "thresholds").agg(F.count(F.lit(1)).alias("n"))


@query("generate_jsonschema", f"""WITH {ME} SELECT col AS "column", CASE inferred_type WHEN 'Integer' THEN 'integer' WHEN 'Numeric' THEN 'number' WHEN 'Boolean' THEN 'boolean' WHEN 'Null' THEN 'null' ELSE 'string' END AS type,
 CASE WHEN inferred_type = 'Date' THEN 'date' END AS format, CASE WHEN num_count > 0 THEN min END AS minimum, CASE WHEN num_count > 0 THEN max END AS maximum,
 CASE WHEN inferred_type = 'String' THEN min_length END AS "minLength", CASE WHEN inferred_type = 'String' THEN max_length END AS "maxLength", missing = 0 AS required FROM base""")
def generate_jsonschema(spark, sf):
    return rules_gen.generate_jsonschema(messy_base(spark, sf)).drop("ordinal")


@query("rule_summary", f"""WITH {ME}, r AS (SELECT CASE WHEN total_valid > 0 AND "distinct" >= total_valid * 0.95 THEN 'pass' ELSE 'fail' END AS status FROM base
 UNION ALL SELECT CASE WHEN num_count = 0 THEN 'skipped' WHEN min >= 0 AND max <= 1000 THEN 'pass' ELSE 'fail' END FROM base)
SELECT count(*) AS total, count(*) FILTER (WHERE status = 'pass') AS passed, count(*) FILTER (WHERE status = 'fail') AS failed, count(*) FILTER (WHERE status = 'skipped') AS skipped FROM r""")
def rule_summary(spark, sf):
    rows = [{"rule_type": "expect_column_values_to_be_unique", "column": c} for c in MESSY_COLUMNS]
    rows += [{"rule_type": "expect_column_values_to_be_between", "column": c, "min_value": 0.0, "max_value": 1000.0} for c in MESSY_COLUMNS]
    return rules_eval.rule_summary(rules_eval.evaluate_gx(_gx(spark, rows), messy_base(spark, sf), WIDTH), [])


@query("rules_join_profile", f"""WITH {ME}, w AS (SELECT DISTINCT concat(event_type, '_text') AS want FROM events UNION SELECT 'user_text')
SELECT want AS "column", CASE WHEN col IS NULL THEN 'fail' WHEN missing = 0 THEN 'pass' ELSE 'fail' END AS status, CASE WHEN col IS NULL THEN 'Column not found in profile' END AS reason
FROM w LEFT JOIN base ON col = want""")
def rules_join_profile(spark, sf):
    names = table(spark, sf, "events").select(F.concat("event_type", F.lit("_text")).alias("c")).union(
        spark.createDataFrame([("user_text",)], "c string")).distinct()
    checks = rules_load.soda_rules(names.select(F.concat(F.lit("missing_count("), "c", F.lit(") = 0")).alias("line")))
    return rules_eval.evaluate_soda(checks, messy_base(spark, sf), WIDTH).select("column", "status", "reason")


# --- gates and reports ------------------------------------------------------------------

@query("gate_missing", f"""WITH {ME} SELECT col AS "column", round(missing * 100.0 / count, 6) AS missing_pct FROM base WHERE missing * 100.0 / count > 25""")
def gate_missing(spark, sf):
    return gates.gate_missing(messy_base(spark, sf), 25.0).withColumn("missing_pct", F.round("missing_pct", 6))


@query("gate_duplicates", f"""WITH {ME} SELECT col AS "column", "distinct", count AS rows FROM base WHERE "distinct" < count""")
def gate_duplicates(spark, sf):
    return gates.gate_duplicates(messy_base(spark, sf))


REPORTED = ("min", "max", "mean", "median", "std_dev", "skewness", "p99")


@query("profile_report_json", f"""WITH {PA} SELECT col AS name, count, inferred_type AS "inferredType", {', '.join(f'round({c}, 4) AS {c}' for c in REPORTED)},
 round(completeness, 6) AS completeness, round(least(uniqueness, 1), 6) AS uniqueness, regexp_matches(col, 'name|type_email') AS potential_pii FROM prof""")
def profile_report_json(spark, sf):
    texts = reports.report_json(profile(table(spark, sf, "part"), parts={"moments", "quantiles"}))
    shape = ("struct<name:string,stats:struct<count:bigint,inferredType:string,numeric:struct<" + ",".join(f"{c}:double" for c in REPORTED)
             + ">>,quality:struct<completeness:double,uniqueness:double,isPotentialPII:boolean>>")
    r = texts.select(F.from_json("text", shape).alias("r"))
    return r.select("r.name", "r.stats.count", "r.stats.inferredType", *[F.round(f"r.stats.numeric.{c}", 4).alias(c) for c in REPORTED],
                    "r.quality.completeness", "r.quality.uniqueness", F.col("r.quality.isPotentialPII").alias("potential_pii"))


@query("profile_report_document", f"""WITH {PA}, {top_sql()}, h AS (SELECT ordinal, (max - min) / least(greatest(ceil(log2(num_count) + 1), 5), 50) AS w FROM base WHERE num_count > 0 AND max > min)
SELECT 'part' AS file, (SELECT count(*) FROM part) AS rows, (SELECT count(*) FROM base) AS columns, p.col AS name, p.count, round(median, 4) AS median, round(h.w, 4) AS bin_width,
 CASE WHEN h.w IS NOT NULL THEN round(p.min, 4) END AS low, (SELECT string_agg(value, '|' ORDER BY position) FROM tops t WHERE t.ordinal = p.ordinal) AS top_values FROM prof p LEFT JOIN h USING (ordinal)""")
def profile_report_document(spark, sf):
    whole = reports.report_document(profile(table(spark, sf, "part")), "part")
    shape = ("struct<meta:struct<fileName:string>,summary:struct<totalRows:bigint,totalColumns:bigint>,columns:array<struct<name:string,stats:struct<count:bigint,"
             "numeric:struct<median:double>,categorical:struct<topValues:array<struct<value:string>>>,histogram:struct<min:double,binWidth:double>>>>>")
    r = whole.select(F.from_json("text", shape).alias("r")).select("r.*").select(
        F.col("meta.fileName").alias("file"), F.col("summary.totalRows").alias("rows"), F.col("summary.totalColumns").alias("columns"), F.explode("columns").alias("c"))
    return r.select("file", "rows", "columns", "c.name", "c.stats.count", F.round("c.stats.numeric.median", 4).alias("median"),
                    F.round("c.stats.histogram.binWidth", 4).alias("bin_width"), F.round("c.stats.histogram.min", 4).alias("low"),
                    F.array_join(F.col("c.stats.categorical.topValues.value"), "|").alias("top_values"))


@query("profile_report_csv", f"""WITH {PA} SELECT col AS "Column", inferred_type AS "Type", count AS "Count", missing AS "Missing", "distinct" AS "Distinct",
 {', '.join(f'{rr_sql(c)} AS "{n}"' for n, c in (('Mean', 'mean'), ('Median', 'median'), ('Min', 'min'), ('Max', 'max'), ('StdDev', 'std_dev'), ('Variance', 'variance'), ('Skewness', 'skewness'), ('Kurtosis', 'kurtosis')))} FROM prof""")
def profile_report_csv(spark, sf):
    r = reports.report_csv(profile(table(spark, sf, "part"), parts={"moments", "quantiles"}))
    return r.select("Column", "Type", "Count", "Missing", "Distinct", *[rr(c).alias(c) for c in r.columns[5:]])


@query("profile_report_markdown", f"""WITH {PA}, f AS (SELECT max(count) AS n, count(*) AS c, sum(count - missing) * 100.0 / sum(count) AS s FROM base)
SELECT '# Profile: part' AS line, 0 AS nth UNION ALL SELECT '| Metric | Value |', 1 UNION ALL SELECT '| :--- | :--- |', 2 UNION ALL
SELECT '| **Total Rows** | ' || format('{{:,}}', n) || ' |', 3 FROM f UNION ALL SELECT '| **Total Columns** | ' || c || ' |', 4 FROM f UNION ALL
SELECT '| **Health Score** | ' || format('{{:.1f}}', s) || '% |', 5 FROM f UNION ALL SELECT '| Column | Type | Count | Missing % | Distinct | Mean | Median |', 6 UNION ALL
SELECT '| :--- | :--- | :--- | :--- | :--- | :--- | :--- |', 7 UNION ALL
SELECT '| **' || col || '** | `' || inferred_type || '` | ' || format('{{:,}}', count) || ' | ' || format('{{:.1f}}', missing * 100.0 / count) || '% | ' || format('{{:,}}', "distinct") || ' | '
 || coalesce({_n('mean')}, '-') || ' | ' || coalesce({_n('median')}, '-') || ' |', 100 + ordinal FROM prof""")
def profile_report_markdown(spark, sf):
    return reports.report_markdown(profile(table(spark, sf, "part"), parts={"moments", "quantiles"}), "part")


def digest_input(spark, sf):
    from plumbline.operators import anomalies

    df = derived(spark, sf, MESSY)
    base = quality.with_quality(stats.base_stats(frequency(df)))
    far = anomalies.outliers(df, "event_id", ["event_id", "amount"]).groupBy("column").agg(F.count(F.lit(1)).alias("outlier_rows"))
    return base.join(session.bounded(far, WIDTH), "column", "left")


DIGEST = f"""{ME}, far AS (SELECT count(*) AS outs FROM cells c JOIN prof p ON p.ordinal = c.ordinal WHERE c.col = 'amount' AND abs(c.num - p.mean) > 3 * p.std_dev),
 sig AS (SELECT p.ordinal, p.col, inferred_type, missing * 100.0 / count AS pct, "distinct" * 100.0 / count AS dp, CASE WHEN p.col = 'amount' THEN outs ELSE 0 END AS outs FROM prof p, far)"""


@query("issue_digest", f"""WITH {DIGEST}, s AS (SELECT *, CASE WHEN pct > 10 THEN 8 ELSE 0 END + CASE WHEN outs > 0 THEN 5 ELSE 0 END + CASE WHEN pct > 0 THEN 2 ELSE 0 END AS score FROM sig)
SELECT CAST(row_number() OVER (ORDER BY score DESC, col) AS INTEGER) AS rank, col AS "column", inferred_type, CAST(score AS INTEGER) AS issue_score, round(pct, 1) AS missing_pct, round(dp, 1) AS distinct_pct,
 CASE WHEN pct > 10 AND outs > 0 THEN 'Missing, Outliers' WHEN pct > 10 THEN 'Missing' WHEN outs > 0 THEN 'Outliers' ELSE '-' END AS issue_tags FROM s""")
def issue_digest(spark, sf):
    return reports.issue_digest(digest_input(spark, sf))


@query("digest_warnings", f"""WITH {DIGEST}, w AS (SELECT ordinal, col, format('{{:.1f}}', round(pct, 1)) || '% missing values' AS message, 8 AS severity FROM sig WHERE pct > 10
 UNION ALL SELECT ordinal, col, outs || ' outlier(s) detected', 5 FROM sig WHERE outs > 0
 UNION ALL SELECT ordinal, col, format('{{:.1f}}', round(pct, 1)) || '% missing values', 3 FROM sig WHERE pct > 0 AND pct <= 10)
SELECT CAST(row_number() OVER (ORDER BY severity DESC, ordinal) AS INTEGER) AS rank, col AS "column", message, severity, 0::BIGINT AS more FROM w""")
def digest_warnings(spark, sf):
    return reports.digest_warnings(digest_input(spark, sf))
