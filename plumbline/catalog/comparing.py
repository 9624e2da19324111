"""Comparisons and merges of profiles, set operations and orderings."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline import session
from plumbline.catalog.twin import (
    EARLY, EARLY_COLUMNS, LATE, LATE_COLUMNS, MESSY, MESSY_COLUMNS, YEARLY, YEARLY_COLUMNS, derived, profile_sql,
    query, rr, rr_sql, table, top_sql,
)
from plumbline.operators import compare, merge, reports, sketches, stats
from plumbline.operators.frequency import frequency
from plumbline.plans import batch
from plumbline.plans.profile import SUMMARY, profile

BASELINE = "1995"


def early_late(spark, sf):
    a = profile(derived(spark, sf, EARLY), parts=SUMMARY)
    b = profile(derived(spark, sf, LATE), parts=SUMMARY)
    return a, b


def early_late_types(spark, sf):
    """Only counts and types, for operators that need no moments."""
    return (stats.base_stats(frequency(derived(spark, sf, EARLY))), stats.base_stats(frequency(derived(spark, sf, LATE))))


#: "prof" of both halves as pa and pb
BOTH = (f"pa AS (WITH {profile_sql(f'({EARLY})', EARLY_COLUMNS)} SELECT * FROM prof), "
        f"pb AS (WITH {profile_sql(f'({LATE})', LATE_COLUMNS)} SELECT * FROM prof)")


def _cmp_sql() -> str:
    values = {"mean": "mean", "std_dev": "std_dev", "missing_pct": 'CASE WHEN count > 0 THEN missing * 100.0 / count END',
              "distinct": 'CAST("distinct" AS DOUBLE)', "min": "min", "max": "max"}
    lower = compare.LOWER_IS_BETTER
    side = ", ".join(f'{v} AS "{k}"' for k, v in values.items())
    cols = []
    for m in values:
        d = f'(b."{m}" - a."{m}")'
        up, down = ("degraded", "improved") if m in lower else ("improved", "degraded")
        both = "a.col IS NOT NULL AND b.col IS NOT NULL"
        cols.append(f'a."{m}" AS {m}_a, b."{m}" AS {m}_b, CASE WHEN {both} THEN {d} END AS {m}_delta, '
                    f'CASE WHEN {both} AND a."{m}" <> 0 THEN {d} / abs(a."{m}") * 100 END AS {m}_pct, '
                    f'CASE WHEN {both} AND (a."{m}" IS NOT NULL OR b."{m}" IS NOT NULL) THEN CASE WHEN {d} IS NULL THEN \'na\' '
                    f"WHEN abs({d}) < 0.0001 THEN 'unchanged' WHEN {d} > 0 THEN '{up}' ELSE '{down}' END END AS {m}_direction")
    return f"""{BOTH}, sa AS (SELECT col, inferred_type, {side} FROM pa), sb AS (SELECT col, inferred_type, {side} FROM pb),
 j AS (SELECT coalesce(a.col, b.col) AS col, a.col IS NOT NULL AS in_a, b.col IS NOT NULL AS in_b, a.inferred_type AS type_a,
  b.inferred_type AS type_b, {', '.join(cols)} FROM sa a FULL JOIN sb b ON a.col = b.col),
 cmp AS (SELECT *, coalesce(type_a <> type_b, false) AS type_changed, CASE WHEN NOT in_b THEN 'removed' WHEN NOT in_a THEN 'added'
  WHEN coalesce(type_a <> type_b, false) OR coalesce(mean_direction <> 'unchanged', false) OR coalesce(std_dev_direction <> 'unchanged', false)
   OR coalesce(missing_pct_direction <> 'unchanged', false) OR coalesce(distinct_direction <> 'unchanged', false) THEN 'modified' ELSE 'unchanged' END AS status FROM j)"""


CMP = _cmp_sql()
NUMS = [f"{m}_{p}" for m in compare.METRICS for p in ("a", "b", "delta", "pct")]
DIRS = [f"{m}_direction" for m in compare.METRICS]


@query("compare_profiles", f"""WITH {CMP} SELECT col AS "column", status, type_a, type_b, type_changed,
 {', '.join(f'{rr_sql(c)} AS {c}' for c in NUMS)}, {', '.join(DIRS)} FROM cmp""")
def compare_profiles(spark, sf):
    c = compare.compare_profiles(*early_late(spark, sf))
    return c.select("column", "status", "type_a", "type_b", "type_changed", *[rr(x).alias(x) for x in NUMS], *DIRS)


@query("compare_summary", f"""WITH {CMP} SELECT count(*) AS total, count(*) FILTER (WHERE status = 'added') AS added,
 count(*) FILTER (WHERE status = 'removed') AS removed, count(*) FILTER (WHERE status = 'modified') AS modified,
 count(*) FILTER (WHERE status = 'unchanged') AS unchanged FROM cmp""")
def compare_summary(spark, sf):
    return compare.compare_summary(compare.compare_profiles(*early_late(spark, sf)))


@query("filter_comparison", f"""WITH {CMP} SELECT col AS "column", status FROM cmp WHERE status = 'modified' AND contains(lower(col), 'price')""")
def filter_comparison(spark, sf):
    c = compare.compare_profiles(*early_late(spark, sf))
    return compare.filter_comparison(c, "modified", "Price").select("column", "status")


@query("sort_comparison", f"""WITH {CMP}, r AS (SELECT col, status, CASE status WHEN 'removed' THEN 0 WHEN 'added' THEN 1 WHEN 'modified' THEN 2 ELSE 3 END AS k FROM cmp)
SELECT row_number() OVER (ORDER BY k, col) AS position, col AS "column", status FROM r""")
def sort_comparison(spark, sf):
    c = compare.sort_comparison(compare.compare_profiles(*early_late(spark, sf))).select("column", "status")
    return in_order(c)


def in_order(df):
    """Number the rows of a small sorted result so that its order can be compared."""
    from plumbline.operators.anomalies import number_rows

    return number_rows(session.materialize(df.coalesce(1), "sorted"), "position")


@query("comparison_report", f"""WITH {CMP} SELECT col AS "column", status, type_a, type_b, round(missing_pct_a, 2) AS missing_pct_a,
 round(missing_pct_b, 2) AS missing_pct_b, {rr_sql('mean_a')} AS mean_a, {rr_sql('mean_b')} AS mean_b FROM cmp""")
def comparison_report(spark, sf):
    r = compare.comparison_report(compare.compare_profiles(*early_late(spark, sf)))
    return r.withColumns({"missing_pct_a": F.round("missing_pct_a", 2), "missing_pct_b": F.round("missing_pct_b", 2),
                          "mean_a": rr("mean_a"), "mean_b": rr("mean_b")})


@query("schema_diff", f"""WITH {BOTH}, d AS (SELECT coalesce(a.col, b.col) AS col, a.inferred_type AS from_type, b.inferred_type AS to_type
 FROM pa a FULL JOIN pb b ON a.col = b.col)
SELECT col AS "column", from_type, to_type, CASE WHEN from_type IS NULL THEN 'added' WHEN to_type IS NULL THEN 'removed' ELSE 'type_changed' END AS change
FROM d WHERE from_type IS DISTINCT FROM to_type""")
def schema_diff(spark, sf):
    return compare.schema_diff(*early_late_types(spark, sf))


@query("columns_added", f"""WITH {BOTH} SELECT col AS "column" FROM pb WHERE col NOT IN (SELECT col FROM pa)""")
def columns_added(spark, sf):
    return compare.columns_added(*early_late_types(spark, sf))


@query("columns_removed", f"""WITH {BOTH} SELECT col AS "column" FROM pa WHERE col NOT IN (SELECT col FROM pb)""")
def columns_removed(spark, sf):
    return compare.columns_removed(*early_late_types(spark, sf))


@query("columns_all", f"""WITH {BOTH}, u AS (SELECT 0 AS d, ordinal, col FROM pa UNION ALL SELECT 1, ordinal, col FROM pb),
 f AS (SELECT col, min((d, ordinal)) AS first_at FROM u GROUP BY col)
SELECT col AS "column", row_number() OVER (ORDER BY first_at) AS position FROM f""")
def columns_all(spark, sf):
    a, b = early_late_types(spark, sf)
    both = a.select("ordinal", "column", F.lit(0).alias("nth")).unionByName(b.select("ordinal", "column", F.lit(1).alias("nth")))
    listed = compare.columns_all(both, "nth", "nth")
    return in_order(listed.orderBy("first_dataset", "first_ordinal").select("column"))


# --- many datasets -----------------------------------------------------------------

YP = profile_sql(f"({YEARLY})", YEARLY_COLUMNS, by="dataset")
#: the year files do not all have the same columns
KEPT_SQL = ("yp AS (SELECT * FROM prof WHERE NOT (dataset = '1995' AND col = 'o_custkey') "
            "AND NOT (dataset = '1997' AND col = 'o_orderpriority'))")


def yearly(spark, sf, parts=SUMMARY, ragged=True):
    p = batch.batch_profile(derived(spark, sf, YEARLY), "dataset", list(YEARLY_COLUMNS), parts)
    if ragged:
        p = p.filter(~((F.col("dataset") == "1995") & (F.col("column") == "o_custkey"))
                     & ~((F.col("dataset") == "1997") & (F.col("column") == "o_orderpriority")))
    return p


@query("batch_profile", f"""WITH {YP} SELECT dataset, col AS "column", count, missing, "distinct", inferred_type,
 {rr_sql('mean')} AS mean, {rr_sql('std_dev')} AS std_dev, {rr_sql('median')} AS median FROM prof""")
def batch_profile(spark, sf):
    p = yearly(spark, sf, {"moments", "quantiles"}, ragged=False)
    return p.select("dataset", "column", "count", "missing", "distinct", "inferred_type", rr("mean").alias("mean"),
                    rr("std_dev").alias("std_dev"), rr("median").alias("median"))


SCHEMA_CHECK = f"""{YP}, {KEPT_SQL}, b AS (SELECT col, inferred_type FROM yp WHERE dataset = '1995'),
 c AS (SELECT y.dataset, count(*) FILTER (WHERE b.col IS NULL) AS added, (SELECT count(*) FROM b) - count(b.col) AS removed,
 count(*) FILTER (WHERE b.inferred_type <> y.inferred_type) AS type_changes FROM yp y LEFT JOIN b ON b.col = y.col GROUP BY y.dataset)"""


@query("batch_schema_check", f"""WITH {SCHEMA_CHECK} SELECT *, added = 0 AND removed = 0 AND type_changes = 0 AS compatible,
 bool_and(added = 0 AND removed = 0 AND type_changes = 0) OVER () AS all_compatible FROM c""")
def batch_schema_check(spark, sf):
    return compare.batch_schema_check(yearly(spark, sf), "dataset", BASELINE)


@query("schema_signature", f"""WITH {YP}, {KEPT_SQL}, s AS (SELECT dataset, string_agg(lower(col) || ':' || lower(inferred_type), '|' ORDER BY lower(col) || ':' || lower(inferred_type)) AS signature
 FROM yp GROUP BY dataset) SELECT dataset, signature, sha256(signature) AS digest FROM s""")
def schema_signature(spark, sf):
    return compare.schema_signature(yearly(spark, sf), ["dataset"])


def _nway_sql():
    metrics = {"row_count": "CAST(count AS DOUBLE)", "null_rate": "CASE WHEN count > 0 THEN missing / CAST(count AS DOUBLE) ELSE 0 END",
               "distinct": 'CAST("distinct" AS DOUBLE)', "mean": "mean", "std_dev": "std_dev"}
    listed = ", ".join(f'{v} AS "{k}"' for k, v in metrics.items())
    parts = []
    for m in metrics:
        parts.append(f'b."{m}" AS {m}_baseline, o."{m}" AS {m}_current, o."{m}" - b."{m}" AS {m}_delta, '
                     f'CASE WHEN b."{m}" <> 0 THEN (o."{m}" - b."{m}") / abs(b."{m}") * 100 END AS {m}_pct')
    return f"""{YP}, {KEPT_SQL}, mm AS (SELECT dataset, col, inferred_type, {listed} FROM yp),
 slots AS (SELECT d.dataset, c.col FROM (SELECT DISTINCT dataset FROM mm WHERE dataset <> '1995') d,
  (SELECT DISTINCT col FROM mm) c),
 nd AS (SELECT s.dataset, s.col, CASE WHEN b.col IS NULL THEN 'added' WHEN o.col IS NULL THEN 'removed' ELSE 'shared' END AS presence,
  b.inferred_type AS baseline_type, o.inferred_type AS current_type, coalesce(b.inferred_type <> o.inferred_type, false) AS type_changed,
  {', '.join(parts)} FROM slots s LEFT JOIN mm b ON b.dataset = '1995' AND b.col = s.col LEFT JOIN mm o ON o.dataset = s.dataset AND o.col = s.col
  WHERE b.col IS NOT NULL OR o.col IS NOT NULL)"""


NWAY = _nway_sql()
NWAY_NUMS = [f"{m}_{p}" for m in compare.NWAY_METRICS for p in ("baseline", "current", "delta", "pct")]


def yearly_deltas(spark, sf):
    return batch.batch_compare(yearly(spark, sf), "dataset", BASELINE, len(YEARLY_COLUMNS)).deltas


@query("nway_deltas", f"""WITH {NWAY} SELECT dataset, col AS "column", presence, baseline_type, current_type, type_changed,
 {', '.join(f'{rr_sql(c)} AS {c}' for c in NWAY_NUMS)} FROM nd""")
def nway_deltas(spark, sf):
    d = compare.nway_deltas(yearly(spark, sf), "dataset", BASELINE, len(YEARLY_COLUMNS))
    return d.select("dataset", "column", "presence", "baseline_type", "current_type", "type_changed",
                    *[rr(c).alias(c) for c in NWAY_NUMS])


TRENDS = f"""{NWAY}, tall AS (SELECT col, 'null_rate' AS metric, null_rate_baseline AS base, null_rate_delta AS d FROM nd WHERE presence = 'shared'
 UNION ALL SELECT col, 'distinct', distinct_baseline, distinct_delta FROM nd WHERE presence = 'shared'
 UNION ALL SELECT col, 'mean', mean_baseline, mean_delta FROM nd WHERE presence = 'shared'),
 ch AS (SELECT col, metric, base, CASE WHEN base = 0 THEN d ELSE d / abs(base) END AS c FROM tall WHERE d IS NOT NULL),
 ag AS (SELECT col, metric, max(base) AS baseline, count(*) AS datasets, bool_and(abs(c) < 0.01) AS calm, avg(c) AS avg_change,
 count(*) FILTER (WHERE c > 0.01) AS up, count(*) FILTER (WHERE c < -0.01) AS down FROM ch GROUP BY ALL),
 tr AS (SELECT *, CASE WHEN calm THEN 'stable' WHEN up + down > 0 AND least(up, down) / CAST(up + down AS DOUBLE) > 0.5 THEN 'volatile'
 WHEN abs(avg_change) < 0.01 THEN 'stable' WHEN (metric = 'null_rate') = (avg_change < 0) THEN 'improving' ELSE 'degrading' END AS direction FROM ag)"""


@query("trends", f"""WITH {TRENDS} SELECT col AS "column", metric, {rr_sql('baseline')} AS baseline, datasets, {rr_sql('avg_change')} AS avg_change, direction FROM tr""")
def trends(spark, sf):
    t = compare.trends(yearly_deltas(spark, sf))
    return t.withColumns({"baseline": rr("baseline"), "avg_change": rr("avg_change")})


@query("batch_compare", f"""WITH {TRENDS} SELECT col AS "column", metric, {rr_sql('baseline')} AS baseline, datasets, {rr_sql('avg_change')} AS avg_change, direction,
 (SELECT count(*) FROM nd) AS deltas, (SELECT count(*) FROM nd WHERE presence <> 'shared') AS not_shared FROM tr""")
def batch_compare(spark, sf):
    r = batch.batch_compare(yearly(spark, sf), "dataset", BASELINE, len(YEARLY_COLUMNS))
    deltas = r.deltas.agg(F.count(F.lit(1)).alias("deltas"), F.count_if(F.col("presence") != "shared").alias("not_shared"))
    return r.trends.select("column", "metric", rr("baseline").alias("baseline"), "datasets", rr("avg_change").alias("avg_change"), "direction").withColumns(
        {c: deltas.select(c).scalar() for c in deltas.columns})


@query("nway_summary", f"""WITH {NWAY} SELECT count(DISTINCT dataset) AS files_compared,
 count(DISTINCT col) FILTER (WHERE presence = 'shared') AS columns_tracked,
 count(*) FILTER (WHERE presence = 'shared' AND (abs(coalesce(null_rate_pct, 0)) > 5 OR abs(coalesce(distinct_pct, 0)) > 5 OR abs(coalesce(mean_pct, 0)) > 5)) AS significant_changes,
 count(*) FILTER (WHERE presence = 'added') AS added_columns, count(*) FILTER (WHERE presence = 'removed') AS removed_columns,
 count(*) FILTER (WHERE presence = 'shared' AND type_changed) AS type_changes FROM nd""")
def nway_summary(spark, sf):
    return compare.nway_summary(yearly_deltas(spark, sf), "dataset")


SCORE = ("CASE WHEN type_changed THEN 100.0 ELSE 0.0 END + abs(coalesce(null_rate_pct, 0)) + abs(coalesce(distinct_pct, 0)) "
         "+ abs(coalesce(mean_pct, 0)) + abs(coalesce(std_dev_pct, 0))")


@query("sort_most_changed", f"""WITH {NWAY}, s AS (SELECT dataset, col, CAST({SCORE} AS DOUBLE) AS score FROM nd WHERE presence = 'shared')
SELECT row_number() OVER (ORDER BY score DESC, dataset, col) AS position, dataset, col AS "column", {rr_sql('score')} AS change_score FROM s""")
def sort_most_changed(spark, sf):
    s = compare.sort_most_changed(yearly_deltas(spark, sf), "dataset")
    return in_order(s.select("dataset", "column", rr("change_score").alias("change_score")))


@query("rank_changed_columns", f"""WITH {NWAY}, s AS (SELECT col, max(baseline_type) AS type,
 CAST(sum(abs(coalesce(null_rate_pct, 0)) + abs(coalesce(distinct_pct, 0))) AS DOUBLE) AS total FROM nd WHERE presence = 'shared' GROUP BY col)
SELECT row_number() OVER (ORDER BY total DESC, col) AS position, col AS "column", type, {rr_sql('total')} AS total_change FROM s""")
def rank_changed_columns(spark, sf):
    r = compare.rank_changed_columns(yearly_deltas(spark, sf))
    return in_order(r.withColumn("total_change", rr("total_change")))


# --- merging -------------------------------------------------------------------------

def _merged_sql(group: str) -> str:
    name = "min_by(col, dataset) AS name, " if group == "ordinal" else ""
    return f"""w AS (SELECT *, CASE WHEN num_count > 0 THEN num_count ELSE 0 END AS wn FROM yp),
 ty AS (SELECT {group}, inferred_type, sum(count) AS rows, min(dataset) AS first FROM w GROUP BY ALL),
 tb AS (SELECT {group}, inferred_type FROM ty QUALIFY row_number() OVER (PARTITION BY {group} ORDER BY rows DESC, first) = 1),
 su AS (SELECT {group}, {name} CAST(sum(count) AS BIGINT) AS count, CAST(sum(missing) AS BIGINT) AS missing,
  CAST(least(sum("distinct"), sum(count)) AS BIGINT) AS "distinct", CAST(sum(wn) AS BIGINT) AS num_count,
  sum(mean * wn) AS wmean, sum(median * wn) AS wmedian, sum(variance * wn) AS within, sum(sum) AS sum, min(min) AS min, max(max) AS max FROM w GROUP BY ALL),
 bt AS (SELECT w.{group}, sum(w.wn * power(w.mean - s.wmean / s.num_count, 2)) AS between_ FROM w JOIN su s ON s.{group} = w.{group} WHERE w.wn > 0 GROUP BY ALL),
 mg AS (SELECT s.*, tb.inferred_type, CASE WHEN num_count > 0 THEN wmean / num_count END AS mean, CASE WHEN num_count > 0 THEN wmedian / num_count END AS median,
  CASE WHEN num_count > 0 THEN (within + between_) / num_count END AS variance FROM su s JOIN tb ON tb.{group} = s.{group} LEFT JOIN bt ON bt.{group} = s.{group})"""


MERGED_COLUMNS = ("mean", "median", "variance", "std_dev", "sum", "min", "max")


def _numbered(profiles):
    return profiles.withColumn("nth", F.col("dataset").cast("int"))


@query("merge_profiles_by_name", f"""WITH {YP}, {KEPT_SQL}, {_merged_sql('col')} SELECT col AS "column", count, missing, "distinct", inferred_type, num_count,
 {', '.join(f"{rr_sql(c if c != 'std_dev' else 'sqrt(variance)')} AS {c}" for c in MERGED_COLUMNS)} FROM mg""")
def merge_profiles_by_name(spark, sf):
    m = merge.merge_by_name(_numbered(yearly(spark, sf, {"moments", "quantiles"})), "nth")
    return m.select("column", "count", "missing", "distinct", "inferred_type", "num_count",
                    *[rr(c).alias(c) for c in MERGED_COLUMNS])


@query("merge_profiles_by_position", f"""WITH {YP}, yp AS (SELECT * FROM prof), {_merged_sql('ordinal')} SELECT ordinal, name AS "column", count, missing, "distinct",
 inferred_type, {rr_sql('mean')} AS mean, {rr_sql('variance')} AS variance FROM mg""")
def merge_profiles_by_position(spark, sf):
    m = merge.merge_by_position(_numbered(yearly(spark, sf, {"moments", "quantiles"}, ragged=False)), "nth")
    return m.select("ordinal", "column", "count", "missing", "distinct", "inferred_type", rr("mean").alias("mean"),
                    rr("variance").alias("variance"))


@query("merge_top_values", f"""WITH {YP}, {top_sql(by=True)}, s AS (SELECT col, value, CAST(sum(n) AS BIGINT) AS n FROM tops WHERE col IN ('o_orderstatus', 'o_orderpriority') GROUP BY ALL)
SELECT col AS "column", value, n, row_number() OVER (PARTITION BY col ORDER BY n DESC, value) AS position FROM s QUALIFY position <= 10""")
def merge_top_values(spark, sf):
    ft = frequency(derived(spark, sf, YEARLY), ["o_orderstatus", "o_orderpriority"], by="dataset", materialized=True)
    top = stats.top_values(ft, stats.base_stats(ft))
    return merge.merge_top_values(top).withColumn("position", F.col("position").cast("bigint"))


@query("batch_merge", f"""WITH {YP}, yp AS (SELECT * FROM prof), {_merged_sql('col')} SELECT col AS "column", count, missing, "distinct", inferred_type, num_count,
 {', '.join(f"{rr_sql(c if c != 'std_dev' else 'sqrt(variance)')} AS {c}" for c in MERGED_COLUMNS)} FROM mg""")
def batch_merge(spark, sf):
    r = batch.batch_merge(_numbered(yearly(spark, sf, {"moments", "quantiles"}, ragged=False)), "dataset", "nth", BASELINE, forced=True)
    return r.merged.select("column", "count", "missing", "distinct", "inferred_type", "num_count", *[rr(c).alias(c) for c in MERGED_COLUMNS])


@query("merge_sketched", f"""WITH {YP}, yp AS (SELECT * FROM prof), {_merged_sql('col')}, entire AS (SELECT * FROM ({{whole}}))
SELECT mg.col AS "column", mg.count, mg."distinct", entire."distinct" AS exact, true AS distinct_close, CASE WHEN entire.median IS NOT NULL THEN true END AS median_close
 FROM mg JOIN entire ON entire.col = mg.col""".replace("{whole}", f"WITH {profile_sql(f'({YEARLY})', YEARLY_COLUMNS)} SELECT * FROM prof"))
def merge_sketched(spark, sf):
    """Whether distinct counts and medians of all years are within the bounds of the united sketches."""
    df = derived(spark, sf, YEARLY)
    parts = session.materialize(sketches.sketches(df, list(YEARLY_COLUMNS), by="dataset"), "sketches")
    m = merge.merge_by_name(_numbered(yearly(spark, sf, {"moments", "quantiles"}, ragged=False)), "nth", parts)
    exact = profile(df, list(YEARLY_COLUMNS), parts={"quantiles"}).select("column", F.col("distinct").alias("exact"), F.col("median").alias("middle"))
    return m.join(session.bounded(exact, len(YEARLY_COLUMNS)), "column").select(
        "column", "count", "distinct", "exact", F.col("exact").between(F.col("distinct_low"), F.col("distinct_high")).alias("distinct_close"),
        F.col("middle").between(F.col("median_low"), F.col("median_high")).alias("median_close"))


@query("sort_merged", f"""WITH {YP}, {KEPT_SQL}, {_merged_sql('col')}
SELECT row_number() OVER (ORDER BY coalesce(mean, '-inf'::DOUBLE) DESC, col) AS position, col AS "column", {rr_sql('mean')} AS mean FROM mg""")
def sort_merged(spark, sf):
    m = merge.merge_by_name(_numbered(yearly(spark, sf, {"moments", "quantiles"})), "nth")
    return in_order(merge.sort_merged(m, "mean", descending=True).select("column", rr("mean").alias("mean")))


# --- filters and orders on a profile ---------------------------------------------------

ME = profile_sql(f"({MESSY})", MESSY_COLUMNS)


def messy_base(spark, sf):
    return stats.base_stats(frequency(derived(spark, sf, MESSY)))


@query("filter_columns", f"""WITH {ME} SELECT col AS "column", count FROM base WHERE contains(lower(col), 'text')""")
def filter_columns(spark, sf):
    return reports.filter_columns(messy_base(spark, sf), "TEXT").select("column", "count")


@query("numeric_columns", f"""WITH {ME} SELECT col AS "column", inferred_type FROM base WHERE inferred_type IN ('Integer', 'Numeric')""")
def numeric_columns(spark, sf):
    return reports.numeric_columns(messy_base(spark, sf)).select("column", "inferred_type")


@query("sort_profile", f"""WITH {ME} SELECT row_number() OVER (ORDER BY missing / CAST(count AS DOUBLE) DESC, col) AS position, col AS "column", missing FROM base""")
def sort_profile(spark, sf):
    return in_order(reports.sort_profile(messy_base(spark, sf), "missing_pct", descending=True).select("column", "missing"))


@query("preview", """SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) > 1000 AS truncated,
 (SELECT count(*) FROM orders) >= 100000 AS large_result FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1000""")
def preview(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return reports.preview(df, [F.desc("o_totalprice"), "o_orderkey"])


@query("values_in_set", """WITH v AS (SELECT DISTINCT o_orderstatus AS value FROM orders)
SELECT 'o_orderstatus' AS "column", value FROM v WHERE value NOT IN (SELECT DISTINCT l_linestatus FROM lineitem)""")
def values_in_set(spark, sf):
    from plumbline.operators.rules_eval import values_in_set as outside

    seen = table(spark, sf, "orders").select(F.lit("o_orderstatus").alias("column"), F.col("o_orderstatus").alias("value"))
    allowed = table(spark, sf, "lineitem").select(
        F.lit("o_orderstatus").alias("column"), F.col("l_linestatus").alias("value")).distinct()
    return outside(seen, allowed)
