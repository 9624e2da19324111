"""Nested records, JSON texts and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline import session
from plumbline.catalog.ruling import GROUPS
from plumbline.catalog.twin import derived, query, table
from plumbline.operators import flatten, structure
from plumbline.sources import readers

# --- typed nested records ------------------------------------------------------------


def order_records(spark, sf):
    """Orders as records four levels deep, the deepest level below what is flattened."""
    o = table(spark, sf, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.struct(
            F.col("o_custkey").alias("key"),
            F.struct(F.col("o_orderstatus").alias("status"),
                     F.struct(F.col("o_orderpriority").alias("priority"),
                              F.struct(F.year("o_orderdate").alias("year")).alias("when")).alias("more")).alias("state"),
        ).alias("customer"),
        F.when(F.col("o_orderstatus") != "P", F.split("o_orderpriority", "-")).alias("tags"),
    )


@query("flatten_json", """SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS "customer.key", o_orderstatus AS "customer.state.status",
 o_orderpriority AS "customer.state.more.priority", '{"year":' || year(o_orderdate) || '}' AS "customer.state.more.when",
 CASE WHEN o_orderstatus <> 'P' THEN '[array:' || len(string_split(o_orderpriority, '-')) || ']' ELSE '' END AS tags FROM orders""")
def flatten_json(spark, sf):
    return flatten.flatten_json(order_records(spark, sf))


@query("flatten_struct", """SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS "customer.key", o_orderstatus AS "customer.state.status",
 o_orderpriority AS "customer.state.more.priority", CAST(year(o_orderdate) AS VARCHAR) AS "customer.state.more.when.year",
 CASE WHEN o_orderstatus <> 'P' THEN '["' || replace(o_orderpriority, '-', '","') || '"]' ELSE '' END AS tags FROM orders""")
def flatten_struct(spark, sf):
    return flatten.flatten_struct(order_records(spark, sf))


@query("select_paths", """SELECT o_orderkey AS id, o_orderstatus AS "customer.state.status", CASE WHEN o_orderstatus <> 'P' THEN string_split(o_orderpriority, '-')[1] END AS "tags.0",
 NULL::VARCHAR AS "customer.absent" FROM orders""")
def select_paths(spark, sf):
    return flatten.select_paths(order_records(spark, sf), ["$.id", "$.customer.state.status", "$.tags.0", "$.customer.absent"])


@query("array_stats", """SELECT 'embedding' AS path, CAST(min(len(embedding)) AS BIGINT) AS min_length, CAST(max(len(embedding)) AS BIGINT) AS max_length, CAST(sum(len(embedding)) AS BIGINT) AS total_length,
 count(embedding) AS arrays, avg(len(embedding)) AS avg_length FROM embeddings""")
def array_stats(spark, sf):
    return flatten.array_stats(table(spark, sf, "embeddings"))


@query("array_stats_nested", """WITH c AS (SELECT 'tags' AS path, len(string_split(o_orderpriority, '-')) AS n FROM orders WHERE o_orderstatus <> 'P')
SELECT path, min(n)::BIGINT AS min_length, max(n)::BIGINT AS max_length, sum(n)::BIGINT AS total_length, count(*) AS arrays, round(avg(n), 6) AS avg_length FROM c GROUP BY path""")
def array_stats_nested(spark, sf):
    return flatten.array_stats(order_records(spark, sf)).withColumn("avg_length", F.round("avg_length", 6))


@query("schema_tree", """WITH n AS (SELECT count(*) AS rows, count(*) FILTER (WHERE o_orderstatus <> 'P') AS tagged FROM orders) SELECT path, parent_path, depth, data_type,
 CASE WHEN path = '$.tags' THEN tagged * 100.0::DOUBLE / rows ELSE 100.0::DOUBLE END AS population, child_count FROM n, (VALUES
 ('$', NULL, 0, 'object', 3), ('$.id', '$', 1, 'number', 0), ('$.customer', '$', 1, 'object', 2), ('$.customer.key', '$.customer', 2, 'number', 0),
 ('$.customer.state', '$.customer', 2, 'object', 2), ('$.customer.state.status', '$.customer.state', 3, 'string', 0), ('$.customer.state.more', '$.customer.state', 3, 'object', 2),
 ('$.customer.state.more.priority', '$.customer.state.more', 4, 'string', 0), ('$.customer.state.more.when', '$.customer.state.more', 4, 'object', 1),
 ('$.customer.state.more.when.year', '$.customer.state.more.when', 5, 'number', 0), ('$.tags', '$', 1, 'array', 0)) v(path, parent_path, depth, data_type, child_count)""")
def schema_tree(spark, sf):
    return flatten.schema_tree(order_records(spark, sf))


# --- JSON texts ------------------------------------------------------------------------

#: one JSON text per event with optional keys, mixed types and six levels
DEEP = """SELECT event_id, concat('{"id": ', CAST(event_id AS STRING), ', "kind": "', event_type, '"',
 CASE WHEN event_type = 'view' THEN '' ELSE concat(', "user": {"id": ', CAST(user_id AS STRING), ', "tags": ["a", "b"], "l3": {"l4": {"l5": {"leaf": true}}}}') END,
 ', "mix": ', CASE WHEN event_type = 'click' THEN '"text"' WHEN event_type = 'error' THEN '7' ELSE 'false' END,
 ', "gone": null}') AS doc FROM events"""

DEEP_PATHS = """p AS (SELECT event_id, event_type, unnest(['$', '$.id', '$.kind', '$.mix', '$.gone']) AS path FROM events UNION ALL
 SELECT event_id, event_type, unnest(['$.user', '$.user.id', '$.user.tags', '$.user.l3', '$.user.l3.l4', '$.user.l3.l4.l5', '$.user.l3.l4.l5.leaf']) FROM events WHERE event_type <> 'view'),
 t AS (SELECT *, len(string_split(path, '.')) - 1 AS depth, CASE WHEN path IN ('$.id', '$.user.id') THEN 'number' WHEN path = '$.kind' THEN 'string' WHEN path = '$.gone' THEN 'null'
 WHEN path = '$.user.tags' THEN 'array' WHEN path = '$.user.l3.l4.l5.leaf' THEN 'boolean' WHEN path = '$.mix' THEN CASE event_type WHEN 'click' THEN 'string' WHEN 'error' THEN 'number' ELSE 'boolean' END ELSE 'object' END AS ty FROM p),
 s AS (SELECT path, depth, count(*) AS occurrences, CASE WHEN count(DISTINCT ty) > 1 THEN 'mixed' ELSE max(ty) END AS data_type FROM t GROUP BY ALL),
 k AS (SELECT regexp_replace(path, '\\.[^.]*$', '') AS path, count(*) AS child_count FROM s WHERE path <> '$' GROUP BY 1),
 st AS (SELECT s.*, CASE WHEN s.path <> '$' THEN regexp_replace(s.path, '\\.[^.]*$', '') END AS parent_path, occurrences * 100.0 / (SELECT count(*) FROM events) AS population, coalesce(child_count, 0) AS child_count FROM s LEFT JOIN k ON k.path = s.path)"""


def deep_paths(spark, sf):
    docs = session.spread(derived(spark, sf, DEEP))
    return structure.structure_scan(docs, "doc", "event_id")


@query("structure_scan", f"""WITH {DEEP_PATHS} SELECT path, parent_path, CAST(depth AS INTEGER) AS depth, data_type, occurrences, round(population, 6) AS population, child_count,
 CASE path WHEN '$.id' THEN '0|1|2' WHEN '$.user.l3.l4.l5.leaf' THEN 'true|true|true' WHEN '$.kind' THEN (SELECT string_agg(event_type, '|' ORDER BY event_id) FROM (SELECT * FROM events ORDER BY event_id LIMIT 3))
 WHEN '$.mix' THEN (SELECT string_agg(CASE event_type WHEN 'click' THEN 'text' WHEN 'error' THEN '7' ELSE 'false' END, '|' ORDER BY event_id) FROM (SELECT * FROM events ORDER BY event_id LIMIT 3))
 WHEN '$.user.id' THEN (SELECT string_agg(CAST(user_id AS VARCHAR), '|' ORDER BY event_id) FROM (SELECT * FROM events WHERE event_type <> 'view' ORDER BY event_id LIMIT 3)) ELSE '' END AS examples FROM st""")
def structure_scan(spark, sf):
    return deep_paths(spark, sf).withColumns({"population": F.round("population", 6), "examples": F.array_join("examples", "|")})


@query("structure_scan_props", """SELECT '$' AS path, 0 AS depth, 'object' AS data_type, count(*) AS occurrences FROM events UNION ALL
SELECT '$.' || k, 1, 'number', count(*) FROM (SELECT unnest(json_keys(props)) AS k FROM events) GROUP BY k""")
def structure_scan_props(spark, sf):
    s = structure.structure_scan(session.spread(table(spark, sf, "events").select("event_id", "props")), "props", "event_id")
    return s.select("path", "depth", "data_type", "occurrences")


@query("structure_summary", f"""WITH {DEEP_PATHS} SELECT CAST(max(depth) AS INTEGER) AS max_depth, count(*) AS total_paths, (SELECT count(*) FROM events) AS rows_scanned,
 CASE WHEN max(depth) > 5 OR count(*) > 1000 THEN 'tree' ELSE 'tabular' END AS mode FROM st""")
def structure_summary(spark, sf):
    return structure.structure_summary(deep_paths(spark, sf))


@query("tree_stats", f"""WITH {DEEP_PATHS} SELECT count(*) AS total_nodes, count(*) FILTER (WHERE child_count = 0) AS leaf_nodes, CAST(max(depth) AS INTEGER) AS max_depth, round(avg(population), 6) AS avg_population FROM st""")
def tree_stats(spark, sf):
    return structure.tree_stats(deep_paths(spark, sf)).withColumn("avg_population", F.round("avg_population", 6))


@query("leaf_paths", f"""WITH {DEEP_PATHS} SELECT path FROM st WHERE child_count = 0""")
def leaf_paths(spark, sf):
    return structure.leaf_paths(deep_paths(spark, sf)).select("path")


@query("all_paths", f"""WITH {DEEP_PATHS} SELECT path FROM st""")
def all_paths(spark, sf):
    return deep_paths(spark, sf).select("path")


@query("filter_paths", f"""WITH {DEEP_PATHS} SELECT path FROM st WHERE contains(lower(path), 'l4')""")
def filter_paths(spark, sf):
    return structure.filter_paths(deep_paths(spark, sf), "L4").select("path")


@query("find_path", f"""WITH {DEEP_PATHS} SELECT path, data_type, occurrences FROM st WHERE path = '$.user.tags'""")
def find_path(spark, sf):
    return structure.find_path(deep_paths(spark, sf), "$.user.tags").select("path", "data_type", "occurrences")


@query("select_paths_json", """SELECT CAST(event_id AS VARCHAR) AS id, CASE WHEN event_type <> 'view' THEN CAST(user_id AS VARCHAR) END AS "user.id",
 CASE WHEN event_type <> 'view' THEN 'b' END AS "user.tags.1", NULL::VARCHAR AS "user.none" FROM events""")
def select_paths_json(spark, sf):
    return flatten.select_paths(derived(spark, sf, DEEP), ["$.id", "$.user.id", "$.user.tags.1", "$.user.none"], "doc")


# --- JSON containers ----------------------------------------------------------------------

#: per group of customers, JSON items of one kind or of several
ARRAYS = f"""SELECT c_group AS k, CASE WHEN c_group = 0 THEN concat('{{"n": "', c_name, '"}}') WHEN c_group = 1 THEN CAST(c_custkey AS STRING)
 WHEN c_group = 2 THEN concat('["', c_name, '"]') WHEN c_group = 3 AND c_custkey > 10 THEN concat('"', c_name, '"') WHEN c_group = 3 THEN concat('{{"n": ', CAST(c_custkey AS STRING), '}}')
 ELSE 'null' END AS value FROM {GROUPS}"""


@query("json_container_kind", f"""SELECT c_group AS k, CASE c_group WHEN 0 THEN 'array_of_objects' WHEN 1 THEN 'array_of_primitives' WHEN 2 THEN 'array_of_arrays'
 WHEN 3 THEN CASE WHEN min(c_custkey) <= 10 AND max(c_custkey) > 10 THEN 'mixed_array' WHEN min(c_custkey) > 10 THEN 'array_of_primitives' ELSE 'array_of_objects' END ELSE 'array_of_primitives' END AS kind, count(*) AS items FROM {GROUPS} GROUP BY c_group""")
def json_container_kind(spark, sf):
    items = derived(spark, sf, ARRAYS)
    out = None
    for k in range(5):
        one = readers.json_container_kind(items.filter(F.col("k") == k)).select(F.lit(k).alias("k"), "kind", "items")
        out = one if out is None else out.unionByName(one)
    return out


@query("scan_primitive_json", f"""SELECT CASE c_group WHEN 1 THEN CAST(c_custkey AS VARCHAR) WHEN 2 THEN '["' || c_name || '"]' WHEN 3 THEN c_name ELSE '' END AS value
 FROM {GROUPS} WHERE c_group IN (1, 2, 4) OR (c_group = 3 AND c_custkey > 10)""")
def scan_primitive_json(spark, sf):
    return readers.scan_primitive_json(derived(spark, sf, ARRAYS))


@query("scan_json", """SELECT event_id, event_type, CASE WHEN event_type <> 'view' THEN user_id END AS user_id FROM events""")
def scan_json(spark, sf):
    path = session.scratch_path(spark, "events-json")
    derived(spark, sf, DEEP).select("doc").write.text(path)
    df = readers.scan_json(spark, path)
    return df.select(F.col("id").alias("event_id"), F.col("kind").alias("event_type"), F.col("user.id").alias("user_id"))


@query("scan_json_array", """SELECT n_nationkey AS id, n_name AS name FROM nation""")
def scan_json_array(spark, sf):
    path = session.scratch_path(spark, "nation-json")
    one = table(spark, sf, "nation").agg(F.to_json(F.array_sort(F.collect_list(
        F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))))).alias("v"))
    one.write.text(path)
    return readers.scan_json(spark, path).select(F.col("id").cast("int").alias("id"), "name")


BROKEN = """SELECT event_id, CASE WHEN value > 100 THEN concat('{"id": ', CAST(event_id AS STRING)) ELSE props END AS value FROM events"""


@query("json_bad_lines", """SELECT count(*) AS total_rows, count(*) FILTER (WHERE value > 100) AS malformed, count(*) FILTER (WHERE value <= 100) AS good_rows FROM events""")
def json_bad_lines(spark, sf):
    path = session.scratch_path(spark, "broken-json")
    derived(spark, sf, BROKEN).select("value").write.text(path)
    return readers.json_bad_lines(spark.read.text(path))


# --- CSV and tables -----------------------------------------------------------------------

def write_csv(spark, sf, name, columns, **options):
    path = session.scratch_path(spark, f"{name}-csv")
    table(spark, sf, name).select(*columns).write.options(header=True, escape='"', **options).csv(path)
    return path


@query("scan_csv", """SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_acctbal AS VARCHAR) AS c_acctbal, c_mktsegment FROM customer""")
def scan_csv(spark, sf):
    path = write_csv(spark, sf, "customer", ["c_custkey", "c_name", "c_acctbal", "c_mktsegment"])
    return readers.good_rows(readers.scan_csv(spark, path))


@query("scan_csv_quoted", """SELECT CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn AS VARCHAR) AS turn, text FROM conversations""")
def scan_csv_quoted(spark, sf):
    path = session.scratch_path(spark, "conversations-csv")
    table(spark, sf, "conversations").select("conv_id", "turn", "text").write.options(header=True, escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return readers.good_rows(readers.scan_csv(spark, path))


@query("scan_csv_layouts", """SELECT CAST(s_suppkey AS VARCHAR) AS key, s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN CAST(s_nationkey AS VARCHAR) END AS nation FROM supplier""")
def scan_csv_layouts(spark, sf):
    """Two files in one call, with different delimiters and headers."""
    rows = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    paths = [session.scratch_path(spark, f"layout-{i}") for i in range(2)]
    rows.filter("key % 2 = 0").coalesce(1).write.options(header=True, sep=";").csv(paths[0])
    rows.filter("key % 2 = 1").select("name", "key").coalesce(1).write.options(header=True, sep="\t").csv(paths[1])
    return readers.good_rows(readers.scan_csv(spark, paths)).select("key", "name", "nation")


@query("detect_delimiter", """SELECT name, delimiter FROM (VALUES ('comma', ','), ('tab', chr(9)), ('semicolon', ';'), ('pipe', '|')) v(name, delimiter), (SELECT count(*) AS n FROM supplier) WHERE n > 1""")
def detect_delimiter(spark, sf):
    out = None
    for name, mark in readers.DELIMITERS.items():
        path = write_csv(spark, sf, "supplier", ["s_suppkey", "s_name", "s_acctbal"], sep=mark)
        found = readers.detect_delimiter(spark, [path]).select(F.lit(name).alias("name"), "delimiter")
        out = found if out is None else out.unionByName(found)
    return out


#: supplier as lines, some with a field too many or too few
RAGGED = """SELECT concat(CAST(s_suppkey AS STRING), ',', s_name, CASE WHEN s_nationkey < 5 THEN ',9,extra' WHEN s_nationkey > 20 THEN '' ELSE ',5' END) AS value FROM supplier"""


@query("malformed_rows", """SELECT count(*) AS total_rows, count(*) FILTER (WHERE s_nationkey < 5 OR s_nationkey > 20) AS malformed, count(*) FILTER (WHERE s_nationkey BETWEEN 5 AND 20) AS good_rows FROM supplier""")
def malformed_rows(spark, sf):
    path = session.scratch_path(spark, "ragged-csv")
    lines = derived(spark, sf, RAGGED).coalesce(1)
    head = spark.createDataFrame([("key,name,n",)], "value string")
    head.unionByName(lines).coalesce(1).write.text(path)
    return readers.malformed_rows(readers.scan_csv(spark, path, ","))


@query("scan_parquet", "SELECT r_regionkey, r_name FROM region")
def scan_parquet(spark, sf):
    return readers.scan_parquet(spark, f"{sf}/region.parquet")


@query("scan_many", """SELECT 'first' AS dataset, count(*) AS rows, NULL::BIGINT AS failed FROM customer WHERE c_nationkey < 10
 UNION ALL SELECT 'second', count(*), NULL FROM customer WHERE c_nationkey >= 10 UNION ALL SELECT 'broken', NULL, count(*) FROM region WHERE r_regionkey = 0""")
def scan_many(spark, sf):
    """Two files of one name in different folders, and one that is no Parquet file."""
    place = session.scratch_path(spark, "many")
    customers = table(spark, sf, "customer")
    customers.filter("c_nationkey < 10").write.parquet(f"{place}/first/d.parquet")
    customers.filter("c_nationkey >= 10").write.parquet(f"{place}/second/d.parquet")
    customers.select("c_name").write.text(f"{place}/broken/d.parquet")
    paths = [f"{place}/{part}/d.parquet" for part in ("first", "second", "broken")]
    folder = lambda c: F.regexp_extract(c, r"/(\w+)/d\.parquet", 1)
    good = readers.scan_many(spark, paths).groupBy(folder("dataset").alias("dataset")).agg(F.count(F.lit(1)).alias("rows"))
    bad = readers.unreadable(spark, paths).groupBy(folder("path").alias("dataset")).agg(F.count(F.lit(1)).alias("failed"))
    return good.withColumn("failed", F.lit(None).cast("bigint")).unionByName(bad.withColumn("rows", F.lit(None).cast("bigint")))


@query("register_table", """SELECT p_type, count(*) AS n FROM part GROUP BY p_type""")
def register_table(spark, sf):
    readers.register_table(spark, f"{sf}/part.parquet", "data")
    return spark.sql("SELECT p_type, count(*) AS n FROM data GROUP BY p_type")


@query("describe_schema", " UNION ALL ".join(
    f"""SELECT {i} AS ordinal, '{c}' AS "column", CASE any_value(typeof({c})) WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' ELSE 'string' END AS type,
 count(*) AS rows, count({c}) AS filled FROM part""" for i, c in enumerate(("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"))))
def describe_schema(spark, sf):
    return readers.describe_schema(table(spark, sf, "part"))


@query("row_count", "SELECT count(*) AS total_rows FROM lineitem")
def row_count(spark, sf):
    return readers.row_count(table(spark, sf, "lineitem"))


@query("list_tables", "SELECT name, n FROM (SELECT count(*) AS n FROM orders), (VALUES ('listed_one'), ('listed_two')) v(name)")
def list_tables(spark, sf):
    for name in ("listed_one", "listed_two", "listed_three"):
        readers.register_table(spark, f"{sf}/orders.parquet", name)
    readers.drop_table(spark, "listed_three")
    names = [n for n in readers.list_tables(spark) if n.startswith("listed_")]
    counts = [readers.row_count(spark.table(n)).select(F.lit(n).alias("name"), F.col("total_rows").alias("n")) for n in names]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@query("schema_json", " UNION ALL ".join(
    f"""SELECT '{c}' AS name, CASE any_value(typeof({c})) WHEN 'INTEGER' THEN 'integer' ELSE 'string' END AS kind, count({c}) AS filled FROM nation"""
    for c in ("n_nationkey", "n_name", "n_regionkey")))
def schema_json(spark, sf):
    df = table(spark, sf, "nation")
    fields = F.from_json(F.lit(readers.schema_json(df)), "struct<fields:array<struct<name:string,type:string>>>")["fields"]
    filled = readers.describe_schema(df).select(F.col("column").alias("name"), "filled", F.filter(fields, lambda f: f["name"] == F.col("column"))[0]["type"].alias("kind"))
    return filled.select("name", "kind", "filled")


@query("write_rows_csv", """SELECT c_name, CAST(c_custkey AS VARCHAR) AS c_custkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE CAST(c_acctbal AS VARCHAR) END AS balance FROM customer""")
def write_rows_csv(spark, sf):
    from plumbline.operators.reports import write_rows_csv as write

    path = session.scratch_path(spark, "rows-csv")
    rows = table(spark, sf, "customer").withColumn("balance", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")))
    write(rows, path, ["c_name", "c_custkey", "balance"])
    return readers.good_rows(readers.scan_csv(spark, path, ","))
