"""SQL over loaded tables, profiles of query results, and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline import session
from plumbline.catalog.twin import LINEITEM, clean_sql, missing_sql, profile_sql, query, rr, rr_sql, table, top_sql
from plumbline.operators import stats
from plumbline.plans import sqlmode
from plumbline.streaming import profile_stream as streams


def statement(name, text, twin=None):
    """A statement over the view ``data``; ``{data}`` names the table it is loaded from."""
    source, _, body = text.partition(": ")

    @query(name, (twin or body).replace("FROM data", f"FROM {source}"))
    def run(spark, sf):
        return sqlmode.sql_query(spark, body.replace("FROM data", "FROM {data}"), data=table(spark, sf, source))


statement("sql_query", "part: SELECT p_brand, count(*) AS n, max(p_size) AS biggest FROM data GROUP BY p_brand")
statement("sql_filter", "orders: SELECT o_orderkey, o_totalprice FROM data WHERE o_orderstatus IS NOT NULL AND o_totalprice > 300000")
statement("sql_group_having", """customer: SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 4) AS avg_balance FROM data
 GROUP BY c_mktsegment HAVING count(*) > 10 ORDER BY n DESC""")
statement("sql_date_trunc", """orders: SELECT date_trunc('month', o_orderdate) AS month, round(sum(o_totalprice), 2) AS total, count(*) AS n FROM data
 GROUP BY date_trunc('month', o_orderdate)""",
          """SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS month, round(sum(o_totalprice), 2) AS total, count(*) AS n FROM data
 GROUP BY date_trunc('month', o_orderdate)""")
statement("sql_row_number", """orders: SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS nth FROM data""")
statement("sql_cast", """events: SELECT event_id, CAST(value AS DECIMAL(10,2)) AS amount, to_date(substr(CAST(ts AS STRING), 1, 10), 'yyyy-MM-dd') AS day FROM data""",
          """SELECT event_id, CAST(value AS DECIMAL(10,2)) AS amount, CAST(strptime(substr(CAST(ts AS VARCHAR), 1, 10), '%Y-%m-%d') AS DATE) AS day FROM data""")
statement("sql_recent", """events: SELECT event_id, event_type FROM data WHERE ts >= (SELECT max(ts) FROM data) - INTERVAL 7 DAYS""")
statement("sql_clean", """part: SELECT p_partkey, p_name FROM data WHERE p_name LIKE '%ring' AND p_size BETWEEN 10 AND 30""")
statement("sql_derived", """lineitem: SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net,
 round(try_divide(l_tax, l_discount), 6) AS tax_per_discount FROM data""",
          """SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net,
 round(CASE WHEN l_discount <> 0 THEN l_tax / l_discount END, 6) AS tax_per_discount FROM data""")
statement("sql_limit", "orders: SELECT o_orderkey, o_totalprice FROM data ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")


@query("sql_sample", "SELECT event_id, value FROM events ORDER BY md5('0|' || event_id), event_id LIMIT 500")
def sql_sample(spark, sf):
    return sqlmode.sql_sample(table(spark, sf, "events").select("event_id", "value"), "event_id", 500)


GROUPED = "SELECT o_custkey, count(*) AS orders, sum(o_totalprice) AS spent FROM {o} GROUP BY o_custkey"


@query("profile_query", f"""WITH {profile_sql('(' + GROUPED.replace('{o}', 'orders') + ')', {'o_custkey': 'int', 'orders': 'int', 'spent': 'real'})}
SELECT col AS "column", count, missing, inferred_type, {rr_sql('mean')} AS mean, {rr_sql('median')} AS median, {rr_sql('std_dev')} AS std_dev FROM prof""")
def profile_query(spark, sf):
    p = sqlmode.profile_query(spark, GROUPED, parts={"moments", "quantiles"}, o=table(spark, sf, "orders"))
    return p.select("column", "count", "missing", "inferred_type", *[rr(c).alias(c) for c in ("mean", "median", "std_dev")])


@query("profile_paths", """WITH v AS (SELECT CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k FROM events)
SELECT "column", count(*) AS count, count(*) FILTER (WHERE k IS NULL) AS missing, count(DISTINCT k) AS "distinct", 'Integer' AS inferred_type FROM (SELECT 'k' AS "column", k FROM v) GROUP BY "column"
UNION ALL SELECT 'absent.x', count(*), count(*), 0, 'Null' FROM events""")
def profile_paths(spark, sf):
    p = sqlmode.profile_paths(table(spark, sf, "events"), ["$.k", "$.absent.x"], "props", parts=set())
    return p.select("column", "count", "missing", "distinct", "inferred_type")


# --- streams -----------------------------------------------------------------------------

def events_stream(spark, sf, name="events"):
    """The table as a file stream."""
    return streams.read_table(spark, f"{sf}/{name}.parquet")


EV = profile_sql("events", {"event_id": "int", "ts": "time", "user_id": "int", "event_type": "text", "value": "real", "props": "text"})


@query("profile_stream", f"""WITH {EV} SELECT col AS "column", count, missing, total_valid, integer_count, numeric_count, boolean_count, date_count, inferred_type, min_length, max_length,
 {', '.join(f'{rr_sql(c)} AS {c}' for c in ('min', 'max', 'mean', 'std_dev'))}, round(skewness, 5) AS skewness, round(kurtosis, 5) AS kurtosis FROM prof""")
def profile_stream(spark, sf):
    state = streams.run_to_table(streams.profile_stream(events_stream(spark, sf)), "profile-stream")
    return state.select("column", "count", "missing", "total_valid", "integer_count", "numeric_count", "boolean_count", "date_count", "inferred_type",
                        "min_length", "max_length", *[rr(c).alias(c) for c in ("min", "max", "mean", "std_dev")],
                        F.round("skewness", 5).alias("skewness"), F.round("kurtosis", 5).alias("kurtosis"))


#: texts of the documents with gaps, and some texts above 256 bytes with a common beginning
STREAM = {"doc_id": "int", "text": "text", "lang": "text", "source": "text", "n_chars": "int"}
DOCS = profile_sql("documents", STREAM)


@query("profile_stream_full", f"""WITH {DOCS}, {top_sql()},
 tl AS (SELECT ordinal, sha256(string_agg(value || '=' || n, chr(10) ORDER BY position)) AS top_values FROM tops GROUP BY 1),
 fs AS (SELECT ordinal, value, min(doc_id) AS first_row FROM (
   SELECT 0 AS ordinal, CAST(doc_id AS VARCHAR) AS value, doc_id FROM documents UNION ALL SELECT 1, {clean_sql('text')}, doc_id FROM documents UNION ALL SELECT 2, {clean_sql('lang')}, doc_id FROM documents UNION ALL
   SELECT 3, {clean_sql('source')}, doc_id FROM documents UNION ALL SELECT 4, CAST(n_chars AS VARCHAR), doc_id FROM documents) WHERE NOT {missing_sql('value')} GROUP BY ALL),
 sl AS (SELECT ordinal, sha256(string_agg(value, chr(10) ORDER BY first_row, value)) AS samples FROM (SELECT * FROM fs QUALIFY row_number() OVER (PARTITION BY ordinal ORDER BY first_row, value) <= 5) GROUP BY 1)
SELECT ordinal, col AS "column", inferred_type, count, missing, total_valid, "distinct", min_length, max_length, {', '.join(f'{rr_sql(c)} AS {c}' for c in ('min', 'max', 'mean', 'std_dev', 'median', 'p25', 'p75', 'p90', 'p95', 'p99'))},
 round(completeness, 6) AS completeness, round(uniqueness, 6) AS uniqueness, top_values, samples
FROM prof LEFT JOIN tl USING (ordinal) LEFT JOIN sl USING (ordinal)""")
def profile_stream_full(spark, sf):
    stream = events_stream(spark, sf, "documents")
    p = streams.StreamProfile.of(stream, row_order="doc_id").run(stream).profile()
    tops = F.transform(F.slice("top_values", 1, 10), lambda t: F.concat(t["value"], F.lit("="), t["n"].cast("string")))
    return p.select("ordinal", "column", "inferred_type", "count", "missing", "total_valid", "distinct", "min_length", "max_length",
                    *[rr(c).alias(c) for c in ("min", "max", "mean", "std_dev", "median", "p25", "p75", "p90", "p95", "p99")],
                    F.round("completeness", 6).alias("completeness"), F.round("uniqueness", 6).alias("uniqueness"),
                    F.sha2(F.array_join(tops, "\n"), 256).alias("top_values"), F.sha2(F.array_join("sample_values", "\n"), 256).alias("samples"))


@query("stream_frequency", f"""WITH c AS (SELECT unnest(['event_type', 'props', 'user_id']) AS "column", unnest([event_type, props, CAST(user_id AS VARCHAR)]) AS value FROM events),
 n AS (SELECT "column", value, count(*) AS n FROM c GROUP BY ALL)
SELECT "column", value, n FROM n QUALIFY row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) <= 10""")
def stream_frequency(spark, sf):
    from pyspark.sql import Window

    running = streams.frequency_stream(events_stream(spark, sf).select("event_type", "props", "user_id"))
    state = streams.run_to_table(running, "frequency-stream", ["column", "value"])
    order = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    return state.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= 10).drop("nth")


@query("stream_duplicates", """WITH g AS (SELECT count(*) AS n FROM conversations GROUP BY conv_id, role)
SELECT sum(n)::BIGINT AS total_rows, sum(n - 1)::BIGINT AS duplicate_rows, round(sum(n - 1) * 100.0 / sum(n), 6) AS duplicate_pct FROM g""")
def stream_duplicates(spark, sf):
    running = streams.duplicates_stream(events_stream(spark, sf, "conversations").select("conv_id", "role"))
    state = streams.run_to_table(running, "duplicates-stream", ["row_digest"])
    return stats.duplicate_summary(state).withColumn("duplicate_pct", F.round("duplicate_pct", 6))
