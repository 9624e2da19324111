"""Helpers to state a query twice: as DataFrame code and as plain SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.text import INTEGER_PATTERN, NON_FINITE_PATTERN, NUMBER_PATTERN, WHITESPACE

Query = Callable[[SparkSession, str], DataFrame]
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()

QUERIES: dict[str, Query] = {}
TWINS: dict[str, str] = {}


def query(name: str, twin: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``; ``twin`` is the SQL that gives the same rows."""
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if twin is not None:
            TWINS[name] = twin
        return fn
    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def derived(spark: SparkSession, sf: str, statement: str) -> DataFrame:
    """A statement both engines understand, run by Spark over the given tables."""
    used = [t for t in TABLES if re.search(rf"\b{t}\b", statement)]
    marked = statement.replace("{", "{{").replace("}", "}}")
    for t in used:
        marked = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", marked)
    return spark.sql(marked, **{t: table(spark, sf, t) for t in used if "{" + t + "}" in marked})


#: Decimals kept below each size, so that the last bits of a sum do not matter.
ROUNDING = ((1e3, 8), (1e5, 5), (1e7, 4), (1e10, 2), (float("inf"), 0))


def rr(c: Column | str) -> Column:
    """Round by magnitude."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(*[F.when(F.abs(c) < size, F.round(c, digits)) for size, digits in ROUNDING])


def rr_sql(x: str) -> str:
    whens = " ".join(f"WHEN abs({x}) < {size:g} THEN round({x}, {digits})" for size, digits in ROUNDING[:-1])
    return f"CASE {whens} ELSE round({x}, 0) END"


# --- the profile in SQL --------------------------------------------------------

def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def clean_sql(c: str) -> str:
    return f"trim({c}, {_q(WHITESPACE)})"


def missing_sql(t: str) -> str:
    return f"({t} IS NULL OR lower({t}) IN ('', 'null', 'n/a'))"


def number_sql(t: str) -> str:
    return f"CASE WHEN regexp_matches({t}, {_q(NUMBER_PATTERN)}) THEN TRY_CAST({t} AS DOUBLE) END"


def is_integer_sql(t: str) -> str:
    return f"coalesce(regexp_matches({t}, {_q(INTEGER_PATTERN)}) AND TRY_CAST({t} AS BIGINT) IS NOT NULL, false)"


def is_numeric_sql(t: str) -> str:
    return (f"coalesce(regexp_matches({t}, {_q(NUMBER_PATTERN)}) OR "
            f"regexp_matches(lower({t}), {_q(NON_FINITE_PATTERN)}), false)")


def is_boolean_sql(t: str) -> str:
    return f"coalesce(lower({t}) IN ('true', 'false', 't', 'f'), false)"


def is_date_sql(t: str) -> str:
    return (f"coalesce(regexp_matches({t}, '[-/]') AND strlen({t}) >= 8 AND regexp_matches({t}, '[0-9]'), false)")


def cells_sql(relation: str, columns: dict[str, str], by: str | None = None) -> str:
    """CTEs ``raw`` and ``cells`` over ``relation``; kinds are int, real, bool, time and text."""
    parts = []
    for i, (c, kind) in enumerate(columns.items()):
        t = clean_sql(c) if kind == "text" else f"CAST({c} AS VARCHAR)"
        num = {"int": f"CAST({c} AS DOUBLE)", "real": f"CASE WHEN isfinite({c}) THEN CAST({c} AS DOUBLE) END",
               "text": number_sql(t)}.get(kind, "CAST(NULL AS DOUBLE)")
        dataset = f"CAST({by} AS VARCHAR) AS dataset, " if by else ""
        parts.append(f"SELECT {dataset}{i} AS ordinal, '{c}' AS col, '{kind}' AS kind, {t} AS t, {num} AS num "
                     f"FROM {relation}")
    raw = " UNION ALL ".join(parts)
    flags = {
        "is_int": f"kind = 'int' OR (kind = 'text' AND {is_integer_sql('t')})",
        "is_num": f"kind IN ('int', 'real') OR (kind = 'text' AND {is_numeric_sql('t')})",
        "is_bool": f"kind = 'bool' OR (kind = 'text' AND {is_boolean_sql('t')})",
        "is_date": f"kind = 'time' OR (kind = 'text' AND {is_date_sql('t')})",
    }
    listed = ", ".join(f"({v}) AS {k}" for k, v in flags.items())
    return f"raw AS ({raw}), cells AS (SELECT *, {missing_sql('t')} AS gone, {listed} FROM raw)"


def profile_sql(relation: str, columns: dict[str, str], by: str | None = None) -> str:
    """CTEs down to ``prof``: one row per column (and dataset) with the statistics of a profile."""
    k = "dataset, " if by else ""
    on = "b.dataset = m.dataset AND b.ordinal = m.ordinal" if by else "b.ordinal = m.ordinal"
    con = "c.dataset = b.dataset AND c.ordinal = b.ordinal" if by else "c.ordinal = b.ordinal"
    bk = "b.dataset, " if by else ""
    inferred = ("CASE WHEN total_valid = 0 THEN 'Null' WHEN integer_count = total_valid THEN 'Integer' "
                "WHEN numeric_count = total_valid THEN 'Numeric' WHEN boolean_count = total_valid THEN 'Boolean' "
                "WHEN date_count = total_valid THEN 'Date' ELSE 'String' END")
    return f"""{cells_sql(relation, columns, by)},
base0 AS (SELECT {k}ordinal, col, count(*) AS count, count(*) FILTER (WHERE gone) AS missing,
  count(DISTINCT t) FILTER (WHERE NOT gone) AS "distinct", count(*) FILTER (WHERE NOT gone) AS total_valid,
  count(*) FILTER (WHERE NOT gone AND is_int) AS integer_count,
  count(*) FILTER (WHERE NOT gone AND is_num) AS numeric_count,
  count(*) FILTER (WHERE NOT gone AND is_bool AND NOT is_num) AS boolean_count,
  count(*) FILTER (WHERE NOT gone AND is_date AND NOT is_num AND NOT is_bool) AS date_count,
  min(strlen(t)) FILTER (WHERE NOT gone) AS min_length, max(strlen(t)) FILTER (WHERE NOT gone) AS max_length,
  count(num) AS num_count, min(num) AS min, max(num) AS max, sum(num) AS sum,
  CASE WHEN count(num) > 0 THEN sum(num) / count(num) END AS mean
  FROM cells GROUP BY {k}ordinal, col),
base AS (SELECT *, {inferred} AS inferred_type FROM base0),
mom AS (SELECT {bk}b.ordinal, sum(power(c.num - b.mean, 2)) AS m2, sum(power(c.num - b.mean, 3)) AS m3,
  sum(power(c.num - b.mean, 4)) AS m4, quantile_cont(c.num, 0.5) AS median, quantile_cont(c.num, 0.25) AS p25,
  quantile_cont(c.num, 0.75) AS p75, quantile_cont(c.num, 0.9) AS p90, quantile_cont(c.num, 0.95) AS p95,
  quantile_cont(c.num, 0.99) AS p99
  FROM base b JOIN cells c ON {con} WHERE c.num IS NOT NULL GROUP BY {bk}b.ordinal),
prof0 AS (SELECT b.*, m.m2, m.m3, m.m4, m.median, m.p25, m.p75, m.p90, m.p95, m.p99,
  CASE WHEN num_count = 0 THEN NULL WHEN max > min AND num_count > 1 THEN m2 / (num_count - 1) ELSE 0.0 END AS variance,
  CASE WHEN num_count = 0 THEN NULL WHEN max > min THEN m2 / num_count ELSE 0.0 END AS variance_pop,
  CASE WHEN num_count = 0 THEN NULL WHEN max > min THEN sqrt(num_count) * m3 / power(m2, 1.5) ELSE 0.0 END AS skewness,
  CASE WHEN num_count = 0 THEN NULL WHEN max > min THEN num_count * m4 / (m2 * m2) - 3 ELSE 0.0 END AS kurtosis,
  CASE WHEN count > 0 THEN (count - missing) / CAST(count AS DOUBLE) ELSE 1.0 END AS completeness,
  CASE WHEN count - missing > 0 THEN "distinct" / CAST(count - missing AS DOUBLE) ELSE 1.0 END AS uniqueness
  FROM base b LEFT JOIN mom m ON {on}),
prof AS (SELECT *, sqrt(variance) AS std_dev, sqrt(variance_pop) AS std_dev_pop FROM prof0)"""


def top_sql(by: bool = False, size: int = 10) -> str:
    """CTE ``tops`` on top of the CTEs of ``profile_sql``."""
    k = "dataset, " if by else ""
    return (f"counted AS (SELECT {k}ordinal, col, t AS value, count(*) AS n FROM cells WHERE NOT gone GROUP BY ALL), "
            f"tops AS (SELECT *, row_number() OVER (PARTITION BY {k}ordinal ORDER BY n DESC, value) AS position "
            f"FROM counted QUALIFY position <= {size})")


LINEITEM = {"l_orderkey": "int", "l_partkey": "int", "l_suppkey": "int", "l_linenumber": "int",
            "l_quantity": "real", "l_extendedprice": "real", "l_discount": "real", "l_tax": "real",
            "l_returnflag": "text", "l_linestatus": "text", "l_shipdate": "time"}

#: events turned into a table with gaps, padded texts and every inferred type.
MESSY = """SELECT event_id,
  CASE WHEN event_type = 'view' THEN NULL ELSE value END AS amount,
  CASE WHEN event_type = 'error' THEN ' N/A ' WHEN event_type = 'view' THEN '' ELSE CAST(user_id AS STRING) END AS user_text,
  CASE WHEN value > 100 THEN 'unknown' ELSE CAST(user_id AS STRING) END AS mostly_number,
  CASE WHEN event_type = 'click' THEN 'TRUE' WHEN event_type = 'view' THEN 'NULL' ELSE 'f' END AS flag_text,
  substr(CAST(ts AS STRING), 1, 10) AS day_text,
  concat('  ', event_type, ' ') AS padded,
  CASE WHEN value < 0 THEN 'x' END AS nothing
FROM events"""
MESSY_COLUMNS = {"event_id": "int", "amount": "real", "user_text": "text", "mostly_number": "text",
                 "flag_text": "text", "day_text": "text", "padded": "text", "nothing": "text"}

#: orders as one dataset per year, with prices missing in later years and statuses changing type.
YEARLY = """SELECT CAST(year(o_orderdate) AS STRING) AS dataset, o_orderkey, o_custkey,
  CASE WHEN year(o_orderdate) >= 1999 AND o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS o_totalprice,
  CASE WHEN year(o_orderdate) = 2001 THEN CAST(o_custkey AS STRING) ELSE o_orderstatus END AS o_orderstatus,
  o_orderpriority
FROM orders"""
YEARLY_COLUMNS = {"o_orderkey": "int", "o_custkey": "int", "o_totalprice": "real", "o_orderstatus": "text",
                  "o_orderpriority": "text"}

#: orders before and since 1998, the later part with another schema.
EARLY = """SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus, CASE WHEN o_orderkey >= 0 THEN 7 END AS seven
FROM orders WHERE year(o_orderdate) < 1998"""
EARLY_COLUMNS = {"o_orderkey": "int", "o_custkey": "int", "o_totalprice": "real", "o_orderstatus": "text", "seven": "int"}
LATE = """SELECT o_orderkey, concat('C', CAST(o_custkey AS STRING)) AS o_custkey,
  CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS o_totalprice, o_orderpriority,
  CASE WHEN o_orderkey >= 0 THEN 7 END AS seven
FROM orders WHERE year(o_orderdate) >= 1998"""
LATE_COLUMNS = {"o_orderkey": "int", "o_custkey": "text", "o_totalprice": "real", "o_orderpriority": "text", "seven": "int"}
