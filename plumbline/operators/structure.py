"""Which paths occur in JSON texts, how often and with which types."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline import session

# Examples kept per path; limits above which a tree view is advised.
EXAMPLES, TREE_DEPTH, TREE_PATHS = 3, 5, 1000
#: Levels that one pass goes down.
LEVELS = 8
_TYPE_NAMES = {
    "object": "OBJECT<%", "array": "ARRAY<%", "string": "STRING", "boolean": "BOOLEAN", "null": "VOID",
}


def _typed(values: DataFrame) -> DataFrame:
    schema = F.schema_of_variant("v")
    kind = F.coalesce(*[F.when(schema.like(pattern), F.lit(name)) for name, pattern in _TYPE_NAMES.items()],
                      F.lit("number"))
    return values.withColumn("data_type", F.when(F.is_variant_null("v"), "null").otherwise(kind))


def _unrolled(starts: DataFrame, levels: int) -> DataFrame:
    """All members of the nodes ``row_key, path, v`` down to ``levels`` below them, the nodes too; arrays are not entered.

    The levels are arrays of the same row, each made from the one above it, so one pass over the texts yields them all.
    """
    member = "struct<path: array<string>, v: variant>"
    opened = starts.select("row_key", F.array(F.struct("path", "v")).alias("level0"))
    for k in range(levels):
        # a value that is no object has no members
        below = F.expr(
            f"flatten(transform(level{k}, n -> coalesce(transform(map_entries(try_variant_get(n.v, '$', 'map<string, variant>')), "
            f"m -> struct(array_append(n.path, m.key) as path, m.value as v)), cast(array() as array<{member}>))))")
        opened = opened.withColumn(f"level{k + 1}", below)
    every = F.concat(*[F.col(f"level{k}") for k in range(levels + 1)])
    return opened.select("row_key", F.inline(every).alias("path", "v"))


def _counts(nodes: DataFrame) -> DataFrame:
    # one partially aggregated record per path and type, however often the path occurs
    return nodes.groupBy("path", "data_type").agg(F.count(F.lit(1)).alias("n"))


def _examples(nodes: DataFrame) -> DataFrame:
    """The first scalar values of each path by row key; ranked per task before the shuffle."""
    first = Window.partitionBy("path").orderBy("row_key")
    return (
        nodes.filter(F.col("data_type").isin("string", "number", "boolean"))
        .select("path", "row_key", F.col("v").cast("string").alias("text"))
        .filter(F.col("text") != "")
        .withColumn("nth", F.row_number().over(first))
        .filter(F.col("nth") <= EXAMPLES)
        .groupBy("path")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "text"))), lambda e: e["text"]).alias("examples"))
    )


def structure_scan(df: DataFrame, json_column: str, key: str) -> DataFrame:
    """Path, parent, depth, occurrences, population in percent of the rows, type, children, examples.

    One pass over the texts yields the nodes of ``LEVELS`` levels, counted by path and type where the rows are; the passes go
    on only where objects are left below. Nothing but these counts is written, however many nodes there are. A path is the list
    of its keys, so keys with dots stay what they are; it is printed with dots. Texts that are no JSON are left out.
    """
    parsed = df.select(F.col(key).alias("row_key"), F.try_parse_json(F.col(json_column)).alias("v"))
    starts = parsed.filter(F.col("v").isNotNull()).select("row_key", F.array().cast("array<string>").alias("path"), "v")
    counts, examples, depth = [], [], 0
    while True:
        nodes = _unrolled(starts, LEVELS)
        # what the next pass starts from is counted there
        here = nodes if depth == 0 else nodes.filter(F.size("path") > depth)
        typed = _typed(here)
        counts.append(session.materialize(_counts(typed), "paths"))
        examples.append(_examples(typed))
        depth += LEVELS
        if counts[-1].filter((F.size("path") == depth) & (F.col("data_type") == "object")).isEmpty():
            break
        starts = nodes.filter(F.size("path") == depth)
    return _summarize(reduce(DataFrame.unionByName, counts), reduce(DataFrame.unionByName, examples))


def _summarize(kinds: DataFrame, examples: DataFrame) -> DataFrame:
    def printed(keys: Column) -> Column:
        return F.concat_ws(".", F.lit("$"), keys)

    paths = kinds.groupBy("path").agg(
        F.sum("n").alias("occurrences"),
        F.when(F.count(F.lit(1)) > 1, "mixed").otherwise(F.max("data_type")).alias("data_type"),
    )
    parent = F.when(F.size("path") > 0, F.slice("path", F.lit(1), F.size("path") - 1))
    children = paths.groupBy(parent.alias("path")).agg(F.count(F.lit(1)).alias("child_count"))
    rows = paths.filter(F.size("path") == 0).agg(F.max("occurrences")).scalar()
    return (
        paths.join(examples, "path", "left")
        .join(children, "path", "left")
        .select(
            printed(F.col("path")).alias("path"), F.when(F.size("path") > 0, printed(parent)).alias("parent_path"),
            F.size("path").alias("depth"), "data_type", "occurrences",
            (F.col("occurrences") / rows * 100).alias("population"),
            F.coalesce("child_count", F.lit(0)).cast("bigint").alias("child_count"),
            F.coalesce("examples", F.array().cast("array<string>")).alias("examples"),
        )
    )


def structure_summary(paths: DataFrame) -> DataFrame:
    """Depth, number of paths, rows scanned and the advised view."""
    return paths.agg(
        F.max("depth").alias("max_depth"),
        F.count(F.lit(1)).alias("total_paths"),
        F.max(F.when(F.col("path") == "$", F.col("occurrences"))).alias("rows_scanned"),
    ).withColumn(
        "mode",
        F.when((F.col("max_depth") > TREE_DEPTH) | (F.col("total_paths") > TREE_PATHS), "tree").otherwise("tabular"),
    )


def tree_stats(paths: DataFrame) -> DataFrame:
    return paths.agg(
        F.count(F.lit(1)).alias("total_nodes"),
        F.count_if(F.col("child_count") == 0).alias("leaf_nodes"),
        F.max("depth").alias("max_depth"),
        F.avg("population").alias("avg_population"),
    )


def leaf_paths(paths: DataFrame) -> DataFrame:
    return paths.filter(F.col("child_count") == 0)


def filter_paths(paths: DataFrame, part: str) -> DataFrame:
    return paths.filter(F.contains(F.lower("path"), F.lit(part.lower())))


def find_path(paths: DataFrame, path: str) -> DataFrame:
    return paths.filter(F.col("path") == path)
