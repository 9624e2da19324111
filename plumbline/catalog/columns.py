"""Column statistics, quality and personal data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from plumbline import session
from plumbline.catalog.twin import (
    LINEITEM, MESSY, MESSY_COLUMNS, cells_sql, clean_sql, derived, is_boolean_sql, is_date_sql, is_integer_sql,
    is_numeric_sql, missing_sql, profile_sql, query, rr, rr_sql, table, top_sql,
)
from plumbline.functions import pii, text
from plumbline.functions.pii import CONTENT_PATTERNS, NAME_HINTS, REPORT_NAME_FRAGMENTS, SEVERITY
from plumbline.operators import anomalies, correlation, personal_data, quality, stats
from plumbline.operators.frequency import cell_table, frequency
from plumbline.plans.profile import profile, table_profile

MESSY_SRC = f"({MESSY}) AS messy"
LI = profile_sql("lineitem", LINEITEM)
ME = profile_sql(MESSY_SRC, MESSY_COLUMNS)
LI_NUMBERS = [c for c, k in LINEITEM.items() if k in ("int", "real")]


def messy(spark, sf):
    return derived(spark, sf, MESSY)


def li_base(spark, sf, columns=None):
    ft = cell_table(table(spark, sf, "lineitem"), columns)
    return ft, session.materialize(stats.base_stats(ft), "base")


# --- flagship ------------------------------------------------------------------

@query("column_profile", f"""WITH {LI} SELECT ordinal, col AS "column", inferred_type, count, missing, "distinct",
 min_length, max_length, {rr_sql('min')} AS min, {rr_sql('max')} AS max, {rr_sql('mean')} AS mean,
 {rr_sql('sum')} AS sum, {rr_sql('std_dev')} AS std_dev, {rr_sql('skewness')} AS skewness,
 {rr_sql('kurtosis')} AS kurtosis, {rr_sql('median')} AS median, {rr_sql('p95')} AS p95,
 round(completeness, 6) AS completeness, round(uniqueness, 6) AS uniqueness FROM prof""")
def column_profile(spark, sf):
    p = profile(table(spark, sf, "lineitem"), parts={"moments", "quantiles", "histogram", "top"})
    return p.select(
        "ordinal", "column", "inferred_type", "count", "missing", "distinct", "min_length", "max_length",
        *[rr(c).alias(c) for c in ("min", "max", "mean", "sum", "std_dev", "skewness", "kurtosis", "median", "p95")],
        F.round("completeness", 6).alias("completeness"), F.round("uniqueness", 6).alias("uniqueness"),
    )


@query("column_profile_messy", f"""WITH {ME} SELECT ordinal, col AS "column", inferred_type, count, missing, "distinct",
 total_valid, integer_count, numeric_count, boolean_count, date_count, min_length, max_length,
 {rr_sql('mean')} AS mean, {rr_sql('std_dev')} AS std_dev, {rr_sql('median')} AS median, {rr_sql('p25')} AS p25,
 {rr_sql('p75')} AS p75, {rr_sql('p90')} AS p90, {rr_sql('p95')} AS p95, {rr_sql('p99')} AS p99 FROM prof""")
def column_profile_messy(spark, sf):
    p = profile(messy(spark, sf), row_order="event_id")
    return p.select(
        "ordinal", "column", "inferred_type", "count", "missing", "distinct", "total_valid", "integer_count",
        "numeric_count", "boolean_count", "date_count", "min_length", "max_length",
        *[rr(c).alias(c) for c in ("mean", "std_dev", "median", "p25", "p75", "p90", "p95", "p99")],
    )


DUP_SRC = "SELECT o_orderstatus, o_orderpriority, year(o_orderdate) AS y FROM orders"


@query("table_profile", f"""WITH d AS ({DUP_SRC}), g AS (SELECT count(*) AS n FROM d GROUP BY o_orderstatus, o_orderpriority, y),
 t AS (SELECT sum(n)::BIGINT AS total_rows, sum(n - 1)::BIGINT AS duplicate_rows FROM g)
SELECT total_rows, 3 AS total_columns, duplicate_rows, round(duplicate_rows * 100.0 / total_rows, 6) AS duplicate_pct,
 'duplicate_rows' AS issue_id, CASE WHEN duplicate_rows * 100.0 / total_rows > 10 THEN 'error'
 WHEN duplicate_rows * 100.0 / total_rows > 1 THEN 'warning' ELSE 'info' END AS issue_severity, 100.0::DOUBLE AS health_score FROM t""")
def table_profile_query(spark, sf):
    df = derived(spark, sf, DUP_SRC)
    p = stats.base_stats(frequency(df))
    t = table_profile(df, p)
    return t.select("total_rows", "total_columns", "duplicate_rows", F.round("duplicate_pct", 6).alias("duplicate_pct"),
                    F.col("duplicate_issues")[0]["id"].alias("issue_id"),
                    F.col("duplicate_issues")[0]["severity"].alias("issue_severity"), "health_score")


# --- cell predicates -------------------------------------------------------------

@query("missing_predicate", f"""WITH m AS ({MESSY}), r AS (SELECT event_id, unnest([user_text, flag_text, padded]) AS v FROM m)
SELECT count(*) AS cells, count(*) FILTER (WHERE {missing_sql(clean_sql('v'))}) AS missing FROM r""")
def missing_predicate(spark, sf):
    v = messy(spark, sf).select(F.explode(F.array("user_text", "flag_text", "padded")).alias("v"))
    return v.agg(F.count(F.lit(1)).alias("cells"), F.count_if(text.missing_predicate(F.col("v"))).alias("missing"))


def _predicate_query(name, predicate, sql):
    columns = ("user_text", "mostly_number", "flag_text", "day_text", "padded")
    listed = ", ".join(f"'{c}'" for c in columns)

    @query(name, f"""WITH m AS ({MESSY}), r AS (SELECT unnest([{listed}]) AS "column", unnest([{', '.join(columns)}]) AS v FROM m)
SELECT "column", count(*) FILTER (WHERE {sql(clean_sql('v'))}) AS hits FROM r GROUP BY ALL""")
    def run(spark, sf):
        stacked = [F.lit(len(columns))]
        for c in columns:
            stacked += [F.lit(c), F.col(c)]
        tall = messy(spark, sf).select(F.stack(*stacked).alias("column", "v"))
        return tall.groupBy("column").agg(F.count_if(predicate(text.clean(F.col("v")))).alias("hits"))


_predicate_query("is_integer_text", text.is_integer_text, is_integer_sql)
_predicate_query("is_numeric_text", text.is_numeric_text, is_numeric_sql)
_predicate_query("is_boolean_text", text.is_boolean_text, is_boolean_sql)
_predicate_query("is_date_text", text.is_date_text, is_date_sql)


# --- aggregations ------------------------------------------------------------------

@query("base_stats", f"""WITH {ME} SELECT col AS "column", count, missing, total_valid FROM base""")
def base_stats(spark, sf):
    return stats.base_stats(cell_table(messy(spark, sf))).select("column", "count", "missing", "total_valid")


@query("infer_types", f"""WITH {ME} SELECT col AS "column", inferred_type, integer_count, numeric_count, boolean_count,
 date_count, inferred_type = 'String' AND numeric_count > 0.5 * total_valid AS mostly_numeric FROM base""")
def infer_types(spark, sf):
    return stats.base_stats(cell_table(messy(spark, sf))).select(
        "column", "inferred_type", "integer_count", "numeric_count", "boolean_count", "date_count",
        (F.size("notes") > 0).alias("mostly_numeric"))


@query("distinct_estimate", f"""WITH {ME} SELECT col AS "column", "distinct" AS exact, true AS close FROM base WHERE total_valid > 0""")
def distinct_estimate(spark, sf):
    df = messy(spark, sf)
    guessed = stats.distinct_estimate(df, list(MESSY_COLUMNS)).withColumnRenamed("distinct", "guess")
    exact = stats.base_stats(frequency(df)).select("column", F.col("distinct").alias("exact"))
    return guessed.join(session.bounded(exact, len(MESSY_COLUMNS)), "column").select(
        "column", "exact", (F.abs(F.col("guess") - F.col("exact")) <= F.greatest(F.col("exact") * 0.06, F.lit(1))).alias("close"))


@query("distinct_exact", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS "distinct" FROM lineitem""" for c in LINEITEM))
def distinct_exact(spark, sf):
    return stats.distinct_exact(table(spark, sf, "lineitem"), list(LINEITEM))


@query("numeric_moments", f"""WITH {LI} SELECT col AS "column", {', '.join(f'{rr_sql(c)} AS {c}' for c in
 ('min', 'max', 'mean', 'sum', 'variance', 'std_dev', 'skewness', 'kurtosis'))}, num_count FROM prof WHERE num_count > 0""")
def numeric_moments(spark, sf):
    ft, base = li_base(spark, sf, LI_NUMBERS)
    return stats.moments(ft, base).select(
        "column", *[rr(c).alias(c) for c in ("min", "max", "mean", "sum", "variance", "std_dev", "skewness", "kurtosis")],
        "num_count")


@query("numeric_moments_pop", f"""WITH {LI} SELECT col AS "column", {rr_sql('std_dev_pop')} AS std_dev_pop,
 {rr_sql('variance_pop')} AS variance_pop FROM prof WHERE num_count > 0""")
def numeric_moments_pop(spark, sf):
    ft, base = li_base(spark, sf, LI_NUMBERS)
    return stats.moments(ft, base).select(
        "column", rr("std_dev_pop").alias("std_dev_pop"), rr("variance_pop").alias("variance_pop"))


@query("quantiles", f"""WITH {LI} SELECT col AS "column", {', '.join(f'{rr_sql(c)} AS {c}' for c in stats.QUANTILES)}
 FROM prof WHERE num_count > 0""")
def quantiles(spark, sf):
    ft, base = li_base(spark, sf, LI_NUMBERS)
    return stats.quantiles_wide(ft, base).select("column", *[rr(c).alias(c) for c in stats.QUANTILES])


@query("quantiles_estimate", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", '{q}' AS quantile, true AS close FROM (SELECT quantile_cont({c}, 0.5) AS m FROM lineitem) WHERE m IS NOT NULL"""
    for c in LI_NUMBERS for q in stats.QUANTILES))
def quantiles_estimate(spark, sf):
    """Whether each estimate has about the rank it stands for."""
    df = table(spark, sf, "lineitem")
    guessed = stats.quantiles_estimate(df, LI_NUMBERS)
    asked = F.explode(F.array(*[F.struct(F.lit(k).alias("quantile"), F.lit(q).alias("q"), F.col(k).cast("double").alias("guess")) for k, q in stats.QUANTILES.items()]))
    sought = guessed.select("column", asked.alias("a")).select("column", "a.*")
    stacked = F.stack(F.lit(len(LI_NUMBERS)), *[x for c in LI_NUMBERS for x in (F.lit(c), df[c].cast("double"))])
    cells = df.select(stacked.alias("column", "num"))
    ranks = cells.join(session.bounded(sought, len(LI_NUMBERS) * len(stats.QUANTILES)), "column").groupBy("column", "quantile", "q").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("num") < F.col("guess")).alias("under"), F.count_if(F.col("num") <= F.col("guess")).alias("upto"))
    slack = F.greatest(F.col("n") * 0.001, F.lit(1.0))
    return ranks.select("column", "quantile", ((F.col("under") <= F.col("q") * F.col("n") + slack) & (F.col("upto") >= F.col("q") * F.col("n") - slack)).alias("close"))


CATEGORIES = {"c_mktsegment": "text", "c_nationkey": "int", "c_name": "text"}
CU = profile_sql("customer", CATEGORIES)


@query("top_values", f"""WITH {CU}, {top_sql()} SELECT t.col AS "column", position, value, n,
 round(n * 100.0 / total_valid, 6) AS percentage FROM tops t JOIN base b USING (ordinal)""")
def top_values(spark, sf):
    ft = frequency(table(spark, sf, "customer"), list(CATEGORIES), materialized=True)
    return stats.top_values(ft, stats.base_stats(ft)).select(
        "column", F.col("position").cast("bigint").alias("position"), "value", "n",
        F.round("percentage", 6).alias("percentage"))


@query("top_values_long", f"""WITH {profile_sql("documents", {"text": "text", "lang": "text"})}, {top_sql()}
SELECT col AS "column", position, value, n FROM tops""")
def top_values_long(spark, sf):
    df = table(spark, sf, "documents")
    ft = frequency(df, ["text", "lang"], materialized=True)
    return stats.top_values(ft, stats.base_stats(ft), df).select(
        "column", F.col("position").cast("bigint").alias("position"), "value", "n")


@query("top_values_sql", """SELECT "column", value, n, position FROM (SELECT *, row_number() OVER
 (PARTITION BY "column" ORDER BY n DESC, value) AS position FROM (
 SELECT 'l_returnflag' AS "column", l_returnflag AS value, count(*) AS n FROM lineitem GROUP BY ALL UNION ALL
 SELECT 'l_linestatus', l_linestatus, count(*) FROM lineitem GROUP BY ALL UNION ALL
 SELECT 'l_shipdate', CAST(l_shipdate AS VARCHAR), count(*) FROM lineitem GROUP BY ALL)) WHERE position <= 10""")
def top_values_sql(spark, sf):
    ft = frequency(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus", "l_shipdate"], materialized=True)
    return stats.top_values(ft, stats.base_stats(ft)).select(
        "column", "value", "n", F.col("position").cast("bigint").alias("position"))


@query("unique_count", f"""WITH {LI} SELECT col AS "column", "distinct", "distinct" AS unique_count FROM base""")
def unique_count(spark, sf):
    return stats.base_stats(frequency(table(spark, sf, "lineitem"))).select("column", "distinct", "unique_count")


PG = {"url": "text", "html": "text"}


@query("text_lengths", f"""WITH {profile_sql("pages", PG)} SELECT col AS "column", min_length, max_length FROM base""")
def text_lengths(spark, sf):
    return stats.base_stats(cell_table(table(spark, sf, "pages"), list(PG))).select("column", "min_length", "max_length")


def _histogram_sql(cte, bins, width, where):
    return f"""WITH {cte}, f AS (SELECT ordinal, col, min, max, num_count, {bins} AS bins, {width} AS w FROM base
 WHERE num_count > 0 {where}), g AS (SELECT f.*, unnest(range(0, bins)) AS bin FROM f),
 h AS (SELECT f.ordinal, CASE WHEN f.max > f.min THEN least(floor((c.num - f.min) / f.w), f.bins - 1) ELSE 0 END AS bin,
 count(*) AS n FROM f JOIN cells c ON c.ordinal = f.ordinal WHERE c.num IS NOT NULL GROUP BY ALL)
SELECT g.col AS "column", CAST(g.bin AS INTEGER) AS bin, {rr_sql('g.min + g.bin * g.w')} AS "start",
 {rr_sql('g.min + (g.bin + 1) * g.w')} AS "end", coalesce(h.n, 0) AS n FROM g LEFT JOIN h ON h.ordinal = g.ordinal AND h.bin = g.bin"""


BINS_SQL = "CAST(least(greatest(ceil(log2(num_count) + 1), 5), 50) AS INTEGER)"


@query("histogram", _histogram_sql(LI, BINS_SQL, f"(max - min) / {BINS_SQL}", "AND max > min"))
def histogram(spark, sf):
    ft, base = li_base(spark, sf, LI_NUMBERS)
    return stats.histogram(ft, base).select(
        "column", "bin", rr("start").alias("start"), rr("end").alias("end"), "n")


@query("histogram_fixed", _histogram_sql(ME, "10", "CASE WHEN max > min THEN (max - min) / 10 ELSE 1.0 END", ""))
def histogram_fixed(spark, sf):
    ft = cell_table(messy(spark, sf))
    return stats.histogram(ft, session.materialize(stats.base_stats(ft), "base"), fixed_bins=stats.PLAIN_BINS).select(
        "column", "bin", rr("start").alias("start"), rr("end").alias("end"), "n")


@query("value_sample", """WITH r AS (SELECT event_id, unnest(['value', 'user_id']) AS "column",
 unnest([value, CAST(user_id AS DOUBLE)]) AS num FROM events)
SELECT "column", event_id, num FROM r WHERE isfinite(num)
QUALIFY row_number() OVER (PARTITION BY "column" ORDER BY md5('0|' || event_id), event_id) <= 1000""")
def value_sample(spark, sf):
    return stats.value_sample(table(spark, sf, "events"), ["value", "user_id"], "event_id")


@query("sample_values", f"""WITH m AS ({MESSY}), r AS (SELECT event_id, unnest(['user_text', 'flag_text', 'padded', 'day_text']) AS "column",
 unnest([{', '.join(clean_sql(c) for c in ('user_text', 'flag_text', 'padded', 'day_text'))}]) AS v FROM m),
 f AS (SELECT "column", v, min(event_id) AS first FROM r WHERE NOT {missing_sql('v')} GROUP BY ALL)
SELECT "column", row_number() OVER (PARTITION BY "column" ORDER BY first, v) AS position, v AS value FROM f QUALIFY position <= 5""")
def sample_values(spark, sf):
    ft = frequency(messy(spark, sf), ["user_text", "flag_text", "padded", "day_text"], row_order="event_id")
    return stats.sample_values(ft).select("column", F.col("position").cast("bigint").alias("position"), "value")


@query("duplicate_rows", """WITH g AS (SELECT count(*) AS n FROM (SELECT text, lang FROM documents) GROUP BY text, lang)
SELECT sum(n)::BIGINT AS total_rows, sum(n - 1)::BIGINT AS duplicate_rows,
 round(sum(n - 1) * 100.0 / sum(n), 6) AS duplicate_pct FROM g""")
def duplicate_rows(spark, sf):
    return stats.duplicate_rows(session.spread(table(spark, sf, "documents").select("text", "lang"))).select(
        "total_rows", "duplicate_rows", F.round("duplicate_pct", 6).alias("duplicate_pct"))


def _corr_sql(relation, columns, n):
    def r(a, b):
        return (f"CASE WHEN var_pop({a}) FILTER (WHERE {b} IS NOT NULL) > 0 AND var_pop({b}) FILTER (WHERE {a} IS NOT NULL) > 0 "
                f"THEN greatest(-1, least(1, corr({a}, {b}))) ELSE 0 END")
    out = []
    for i, a in enumerate(columns):
        for b in columns[i + 1:]:
            out.append(f"SELECT '{a}' AS col_x, '{b}' AS col_y, count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n, "
                       f"round(CAST({r(a, b)} AS DOUBLE), 6) AS r FROM {relation}")
    half = " UNION ALL ".join(out)
    if n:
        return half
    ones = " UNION ALL ".join(f"SELECT '{c}', '{c}', CAST(1.0 AS DOUBLE)" for c in columns)
    return (f"WITH h AS ({half}) SELECT col_x, col_y, r FROM h UNION ALL SELECT col_y, col_x, r FROM h UNION ALL {ones}")


@query("correlation_matrix", _corr_sql("lineitem", LI_NUMBERS, False))
def correlation_matrix(spark, sf):
    return correlation.matrix(table(spark, sf, "lineitem"), LI_NUMBERS).withColumn("r", F.round("r", 6))


PAIRS = """SELECT value, CAST(user_id AS DOUBLE) AS user_number, CASE WHEN event_type = 'view' THEN NULL ELSE value * 2 END AS twice,
 CASE WHEN event_type = 'click' THEN NULL ELSE CAST(3 AS DOUBLE) END AS three FROM events"""


@query("correlation_pairwise", _corr_sql(f"({PAIRS})", ["value", "user_number", "twice", "three"], True))
def correlation_pairwise(spark, sf):
    return correlation.pairwise(derived(spark, sf, PAIRS), ["value", "user_number", "twice", "three"]).withColumn(
        "r", F.round("r", 6))


@query("health_score", f"""WITH {ME}, s AS (SELECT sum(count - missing) * 100.0 / sum(count) AS p FROM base)
SELECT round(p, 1) AS health_score, CASE WHEN p < 70 THEN 'red' WHEN p < 90 THEN 'amber' ELSE 'green' END AS band FROM s""")
def health_score(spark, sf):
    return quality.health_score(stats.base_stats(cell_table(messy(spark, sf))), [])


@query("missing_badge", f"""WITH {ME}, p AS (SELECT col, missing * 100.0 / count AS pct FROM base)
SELECT col AS "column", round(pct, 6) AS missing_pct, CASE WHEN pct < 10 THEN 'excellent' WHEN pct <= 25 THEN 'warning' ELSE 'critical' END AS badge,
 CASE WHEN pct < 5 THEN 'good' WHEN pct < 20 THEN 'warning' ELSE 'bad' END AS report_class FROM p""")
def missing_badge(spark, sf):
    return quality.missing_badge(stats.base_stats(cell_table(messy(spark, sf)))).select(
        "column", F.round("missing_pct", 6).alias("missing_pct"), "badge", "report_class")


# --- quality -----------------------------------------------------------------------

COMPLETENESS_SEVERITY = "CASE WHEN completeness < 0.5 THEN 'error' WHEN completeness < 0.9 THEN 'warning' WHEN completeness < 1 THEN 'info' END"


def messy_quality(spark, sf):
    return quality.with_quality(stats.base_stats(frequency(messy(spark, sf))))


@query("completeness", f"""WITH {ME} SELECT col AS "column", round(completeness, 6) AS completeness,
 {COMPLETENESS_SEVERITY} AS severity FROM prof""")
def completeness(spark, sf):
    p = messy_quality(spark, sf)
    return p.select("column", F.round("completeness", 6).alias("completeness"),
                    quality.completeness_issue(F.col("column"), F.col("completeness"))["severity"].alias("severity"))


@query("uniqueness", f"""WITH {ME} SELECT col AS "column", round(uniqueness, 6) AS uniqueness,
 uniqueness > 0 AND uniqueness <= 0.02 AS constant, inferred_type = 'String' AND uniqueness > 0.9 AS high_cardinality FROM prof""")
def uniqueness(spark, sf):
    p = messy_quality(spark, sf)
    u = F.col("uniqueness")
    return p.select("column", F.round(u, 6).alias("uniqueness"),
                    quality.constant_issue(F.col("column"), u).isNotNull().alias("constant"),
                    quality.cardinality_issue(F.col("column"), u, F.col("inferred_type")).isNotNull().alias("high_cardinality"))


@query("duplicate_issue", """WITH g AS (SELECT count(*) AS n FROM labels GROUP BY quality, toxic),
 t AS (SELECT sum(n)::BIGINT AS total, sum(n - 1)::BIGINT AS dup FROM g)
SELECT 'duplicate_rows' AS id, format('{} duplicate rows detected ({:.2f}% of total)', dup, dup * 100.0 / total) AS message,
 CASE WHEN dup * 100.0 / total > 10 THEN 'error' WHEN dup * 100.0 / total > 1 THEN 'warning' ELSE 'info' END AS severity
FROM t WHERE dup > 0""")
def duplicate_issue(spark, sf):
    d = stats.duplicate_rows(table(spark, sf, "labels"), ["quality", "toxic"])
    return d.select(quality.duplicate_issue(F.col("duplicate_rows"), F.col("duplicate_pct")).alias("i")).select("i.*").filter(
        F.col("id").isNotNull())


def _pct1(x):
    return f"format('{{:.1f}}', round({x} * 100, 1))"


ISSUES_SQL = f"""issues AS (
 SELECT col, CASE WHEN completeness < 0.5 THEN col || '_completeness_critical' WHEN completeness < 0.9 THEN col || '_completeness_warning'
  ELSE col || '_completeness_info' END AS id, CASE WHEN completeness < 0.5 THEN 'Critical: Only ' || {_pct1('completeness')} || '% of values are present'
  WHEN completeness < 0.9 THEN 'Completeness is ' || {_pct1('completeness')} || '% (below 90% threshold)'
  ELSE 'Completeness is ' || {_pct1('completeness')} || '%' END AS message, {COMPLETENESS_SEVERITY} AS severity FROM prof WHERE completeness < 1
 UNION ALL SELECT col, col || '_constant_column', 'Column has only one unique value (constant)', 'warning' FROM prof WHERE uniqueness > 0 AND uniqueness <= 0.02
 UNION ALL SELECT col, col || '_high_cardinality', 'High cardinality: ' || {_pct1('uniqueness')} || '% unique values (potential identifier or free text)', 'info'
  FROM prof WHERE inferred_type = 'String' AND uniqueness > 0.9)"""


@query("column_issues", f"""WITH {ME}, {ISSUES_SQL} SELECT col AS "column", id, message, severity FROM issues""")
def column_issues(spark, sf):
    return quality.issue_table(messy_quality(spark, sf), [])


@query("column_score", f"""WITH {ME}, {ISSUES_SQL}, pen AS (SELECT col, sum(CASE severity WHEN 'error' THEN 0.3 WHEN 'warning' THEN 0.15 ELSE 0.05 END) AS cost
 FROM issues GROUP BY col)
SELECT p.col AS "column", round(CAST(greatest(0, least(1, completeness * 0.4 + CASE WHEN inferred_type <> 'String' OR uniqueness < 0.9 THEN uniqueness * 0.2 ELSE 0.2 END
 + 0.4 - coalesce(cost, 0))) AS DOUBLE), 6) AS score FROM prof p LEFT JOIN pen USING (col)""")
def column_score(spark, sf):
    return messy_quality(spark, sf).select("column", F.round("score", 6).alias("score"))


# --- personal data -------------------------------------------------------------------

#: columns with e-mail addresses, phone numbers and the like, built from customer and documents
CONTACTS = """SELECT c_custkey, concat(lower(c_mktsegment), '@mail.example.com') AS contact,
 concat('555-', substr(c_name, 13, 2), '1-', substr(c_name, 15, 4)) AS line_no,
 concat('123-45-', substr(c_name, 15, 4)) AS ref_no,
 concat('4111 1111 1111 ', substr(c_name, 15, 4)) AS account_no,
 concat('10.0.', CAST(c_nationkey AS STRING), '.7') AS host_no,
 concat('19', substr(c_name, 17, 2), '-05-17') AS birth_day,
 concat('9', substr(c_name, 15, 4)) AS zip_code,
 c_mktsegment AS segment, c_name AS cell_name FROM customer"""
CONTACT_COLUMNS = ["contact", "line_no", "ref_no", "account_no", "host_no", "birth_day", "zip_code", "segment", "cell_name"]


def _hit_sql(kind, t="v"):
    pattern, low, high = CONTENT_PATTERNS[kind]
    out = f"regexp_matches({t}, '{pattern}')"
    if low:
        out += f" AND strlen({t}) >= {low}"
    if high:
        out += f" AND strlen({t}) <= {high}"
    return f"({out})"


def _hint_sql(c='"column"'):
    return "CASE " + " ".join(f"WHEN regexp_matches(lower({c}), '{p}') THEN '{k}'" for k, p in NAME_HINTS.items()) + " END"


def _severity_sql(c):
    return f"CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SEVERITY.items()) + " END"


PII_SQL = f"""m AS ({CONTACTS}), r AS (SELECT c_custkey, unnest([{', '.join(f"'{c}'" for c in CONTACT_COLUMNS)}]) AS "column",
 unnest([{', '.join(f"trim({c})" for c in CONTACT_COLUMNS)}]) AS v FROM m),
 f AS (SELECT * FROM r WHERE NOT {missing_sql('v')}),
 h AS (SELECT "column", count(*) AS looked_at, {', '.join(f'count(*) FILTER (WHERE {_hit_sql(k)}) AS "{k}"' for k in CONTENT_PATTERNS)},
 greatest(floor(count(*) * 0.3), 1) AS need, {_hint_sql()} AS hint FROM f GROUP BY "column"),
 kinds AS (SELECT "column", looked_at, CASE WHEN "SSN" >= need THEN 'SSN' WHEN "credit card" >= need THEN 'credit card' WHEN "email" >= need THEN 'email'
 WHEN "phone number" >= need THEN 'phone number' WHEN "IP address" >= need THEN 'IP address'
 WHEN "date of birth" >= CASE WHEN hint = 'date of birth' THEN greatest(floor(need / 2), 1) ELSE need END THEN 'date of birth'
 WHEN "postal code" >= need AND hint = 'postal code' THEN 'postal code' ELSE hint END AS pii_type FROM h)"""


def contact_kinds(spark, sf):
    return personal_data.detect(derived(spark, sf, CONTACTS), CONTACT_COLUMNS)


@query("pii_content", f"""WITH {PII_SQL} SELECT "column", looked_at, pii_type FROM kinds""")
def pii_content(spark, sf):
    return contact_kinds(spark, sf).select("column", "looked_at", "pii_type")


def _by_dataset(sql):
    for old, new in (("r AS (SELECT c_custkey,", "r AS (SELECT CAST(c_custkey % 3 AS VARCHAR) AS dataset, c_custkey,"),
                     ('h AS (SELECT "column"', 'h AS (SELECT dataset, "column"'), ('GROUP BY "column")', 'GROUP BY dataset, "column")'),
                     ('kinds AS (SELECT "column"', 'kinds AS (SELECT dataset, "column"')):
        sql = sql.replace(old, new)
    return sql


@query("batch_pii", f"""WITH {_by_dataset(PII_SQL)} SELECT dataset, "column", pii_type FROM kinds""")
def batch_pii(spark, sf):
    """Personal data by content in each of three batches, in one profile."""
    df = derived(spark, sf, CONTACTS).withColumn("dataset", (F.col("c_custkey") % 3).cast("string"))
    return profile(df, CONTACT_COLUMNS, by="dataset", parts={"pii"}).filter("total_valid > 0").select("dataset", "column", "pii_type")


@query("pii_name_hint", f"""SELECT DISTINCT role, {_hint_sql("concat(role, '_email')")} AS with_email,
 {_hint_sql("concat(role, '_fax')")} AS with_fax, {_hint_sql("concat('source_ip_', role)")} AS with_ip,
 {_hint_sql("concat(role, '_street')")} AS with_street, {_hint_sql("concat(role, '_DOB')")} AS with_dob, {_hint_sql("role")} AS plain FROM conversations""")
def pii_name_hint(spark, sf):
    roles = table(spark, sf, "conversations").select("role").distinct()
    r = F.col("role")

    def tail(x):
        return pii.name_hint(F.concat(r, F.lit(x)))

    return roles.select("role", tail("_email").alias("with_email"), tail("_fax").alias("with_fax"),
                        pii.name_hint(F.concat(F.lit("source_ip_"), r)).alias("with_ip"), tail("_street").alias("with_street"),
                        tail("_DOB").alias("with_dob"), pii.name_hint(r).alias("plain"))


@query("pii_issue", f"""WITH {PII_SQL} SELECT "column", "column" || '_pii_' || replace(pii_type, ' ', '_') AS id,
 'Potential PII detected: ' || pii_type AS message, {_severity_sql('pii_type')} AS severity FROM kinds WHERE pii_type IS NOT NULL""")
def pii_issue(spark, sf):
    kinds = contact_kinds(spark, sf).filter(F.col("pii_type").isNotNull())
    return kinds.select("column", quality.pii_issue(F.col("column"), F.col("pii_type")).alias("i")).select("column", "i.*")


@query("pii_summary", f"""WITH {PII_SQL}, c AS (SELECT "column", count(*) AS rows FROM r WHERE NOT {missing_sql('v')} GROUP BY 1)
SELECT "column", pii_type, {_severity_sql('pii_type')} AS severity, c.rows, bool_or({_severity_sql('pii_type')} = 'error') OVER () AS critical
FROM kinds JOIN c USING ("column") WHERE pii_type IS NOT NULL""")
def pii_summary(spark, sf):
    df = derived(spark, sf, CONTACTS)
    ft = frequency(df, CONTACT_COLUMNS, materialized=True)
    kinds, base = personal_data.detect_values(ft), stats.base_stats(ft)
    joined = base.join(session.bounded(kinds.select("column", "pii_type"), len(CONTACT_COLUMNS)), "column")
    return quality.pii_summary(joined, "pii_type")


#: the columns of the given tables, as their schemas have them
NAMES = {
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment", "supplier": "s_suppkey s_name s_nationkey s_acctbal",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority", "pages": "page_id url html",
    "events": "event_id ts user_id event_type value props", "documents": "doc_id text lang source n_chars",
    "conversations": "conv_id turn role text", "nation": "n_nationkey n_name n_regionkey"}


@query("potential_pii_name", "WITH n AS (" + " UNION ALL ".join(
    f"SELECT '{t}' AS dataset, '{c}' AS \"column\", count({c}) AS filled FROM {t}" for t, cs in NAMES.items() for c in cs.split())
    + f""") SELECT dataset, "column", filled, filled > 0 AND regexp_matches(lower("column"), '{'|'.join(REPORT_NAME_FRAGMENTS)}') AS potential_pii FROM n""")
def potential_pii_name(spark, sf):
    """Every column of the tables by its name, with the cells it fills."""
    parts = []
    for name in NAMES:
        base = stats.base_stats(cell_table(table(spark, sf, name)))
        parts.append(base.select(F.lit(name).alias("dataset"), "column", F.col("total_valid").alias("filled")))
    tall = reduce(lambda a, b: a.unionByName(b), parts)
    return tall.withColumn("potential_pii", (F.col("filled") > 0) & pii.is_personal_name(F.col("column")))


# --- row findings ----------------------------------------------------------------------

ORDERED_OUTLIERS = """f AS (SELECT avg(value) AS m, stddev_samp(value) AS s, count(value) AS n FROM events)
SELECT 'value' AS "column", event_id, value FROM events, f WHERE n > 10 AND s > 0 AND abs(value - m) > 3 * s"""


OUTLIER_KEYS = """f AS (SELECT avg(value) AS m, stddev_samp(value) AS s, count(value) AS n FROM events),
 o AS (SELECT event_id FROM events, f WHERE n > 10 AND s > 0 AND abs(value - m) > 3 * s)"""


@query("outliers", f"""WITH {ORDERED_OUTLIERS}""")
def outliers(spark, sf):
    return anomalies.outliers(table(spark, sf, "events"), "event_id", ["value"])


@query("missing_rows", f"""WITH m AS ({MESSY}), r AS (SELECT event_id, unnest(['user_text', 'flag_text', 'amount']) AS "column",
 unnest([user_text, flag_text, CAST(amount AS VARCHAR)]) AS v FROM m)
SELECT "column", event_id FROM r WHERE {missing_sql(clean_sql('v'))}""")
def missing_rows(spark, sf):
    return anomalies.missing_rows(messy(spark, sf), "event_id", ["user_text", "flag_text", "amount"])


@query("pii_rows", " UNION ALL ".join(
    f"SELECT doc_id, '{k}' AS pii_type FROM documents WHERE {_hit_sql(k, clean_sql('text'))}" for k in CONTENT_PATTERNS))
def pii_rows(spark, sf):
    return personal_data.rows_with(session.spread(table(spark, sf, "documents").select("doc_id", "text")), "doc_id", "text")


@query("drilldown", f"""WITH {OUTLIER_KEYS}, p AS (SELECT event_id, row_number() OVER (ORDER BY event_id) AS position, count(*) OVER () AS total_affected FROM o)
SELECT e.event_id, e.user_id, e.event_type, e.value, p.position, total_affected, CAST(ceil(total_affected / 50.0) AS BIGINT) AS total_pages
FROM p JOIN events e USING (event_id) WHERE position > 50 AND position <= 100""")
def drilldown(spark, sf):
    df = table(spark, sf, "events")
    found = anomalies.outliers(df, "event_id", ["value"])
    page = anomalies.drilldown(df, "event_id", found, "value", page=2)
    return page.select("event_id", "user_id", "event_type", "value", F.col("position").cast("bigint").alias("position"),
                       "total_affected", "total_pages")


@query("export_anomaly_rows", f"""WITH {OUTLIER_KEYS}, n AS (SELECT *, row_number() OVER () AS row_number FROM events)
SELECT row_number, event_id, event_type, value FROM n WHERE event_id IN (SELECT event_id FROM o)""")
def export_anomaly_rows(spark, sf):
    numbered = anomalies.read_numbered(spark, f"{sf}/events.parquet")
    found = anomalies.outliers(numbered, "event_id", ["value"], cap=None)
    return anomalies.anomaly_rows(numbered, "event_id", found, "value").select("row_number", "event_id", "event_type", "value")


@query("fetch_rows", """WITH n AS (SELECT *, row_number() OVER () AS row_number FROM orders), w AS (SELECT c_custkey AS row_number FROM customer)
SELECT row_number, o_orderkey, o_totalprice FROM n WHERE row_number IN (SELECT row_number FROM w)""")
def fetch_rows(spark, sf):
    numbered = anomalies.read_numbered(spark, f"{sf}/orders.parquet")
    wanted = table(spark, sf, "customer").select(F.col("c_custkey").alias("row_number"))
    many = wanted.limit(session.BROADCAST_ROWS + 1).count()
    return anomalies.fetch_rows(numbered, "row_number", wanted, many).select("row_number", "o_orderkey", "o_totalprice")
