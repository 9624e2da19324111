"""Nested records to flat columns, by walking the schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import text

# Levels of objects expanded, and columns above which a tree view is advised.
MAX_DEPTH, MANY_COLUMNS = 3, 500


def _quoted(path: list[str]) -> Column:
    return F.col(".".join(f"`{p}`" for p in path))


def _walk(schema: T.StructType, path: list[str], depth: int, limit: int | None):
    for field in schema.fields:
        here = [*path, field.name]
        if isinstance(field.dataType, T.StructType) and (limit is None or depth < limit):
            yield from _walk(field.dataType, here, depth + 1, limit)
        else:
            yield here, field.dataType


def flatten_json(df: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Dotted columns; deeper objects become JSON text, arrays ``[array:N]``, null an empty text."""
    out = []
    for path, dtype in _walk(df.schema, [], 0, max_depth):
        c = _quoted(path)
        if isinstance(dtype, T.ArrayType):
            c = F.concat(F.lit("[array:"), F.size(c).cast("string"), F.lit("]"))
        elif isinstance(dtype, (T.StructType, T.MapType)):
            c = F.to_json(c)
        out.append(F.coalesce(c.cast("string"), F.lit("")).alias(".".join(path)))
    return df.select(*out)


def flatten_struct(df: DataFrame) -> DataFrame:
    """Dotted columns sorted by name, all levels; arrays become JSON text, null an empty text."""
    out = {}
    for path, dtype in _walk(df.schema, [], 0, None):
        c = _quoted(path)
        if isinstance(dtype, (T.ArrayType, T.MapType)):
            c = F.to_json(c)
        out[".".join(path)] = F.coalesce(c.cast("string"), F.lit(""))
    return df.select(*[out[name].alias(name) for name in sorted(out)])


def array_paths(df: DataFrame, max_depth: int = MAX_DEPTH) -> list[list[str]]:
    return [p for p, t in _walk(df.schema, [], 0, max_depth) if isinstance(t, T.ArrayType)]


def array_stats(df: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Shortest, longest, total and mean length and number of arrays, per array path."""
    paths = array_paths(df, max_depth)
    stacked = [F.lit(len(paths))]
    for p in paths:
        stacked += [F.lit(".".join(p)), F.when(_quoted(p).isNotNull(), F.size(_quoted(p)))]
    sizes = df.select(F.stack(*stacked).alias("path", "length")).filter(F.col("length").isNotNull())
    return sizes.groupBy("path").agg(
        F.min("length").cast("bigint").alias("min_length"),
        F.max("length").cast("bigint").alias("max_length"),
        F.sum("length").alias("total_length"),
        F.count(F.lit(1)).alias("arrays"),
        F.avg("length").alias("avg_length"),
    )


def select_paths(df: DataFrame, paths: list[str], json_column: str | None = None) -> DataFrame:
    """Project chosen ``$.a.b`` paths; a number step indexes an array; what is absent is null.

    With ``json_column`` the paths are looked up in JSON texts, else in typed columns.
    """
    out = []
    parsed = F.try_parse_json(F.col(json_column)) if json_column else None
    for path in paths:
        steps = path.removeprefix("$.").split(".")
        name = ".".join(steps)
        if parsed is not None:
            inside = "$" + "".join(f"[{s}]" if s.isdigit() else f"['{s}']" for s in steps)
            out.append(F.try_variant_get(parsed, inside, "string").alias(name))
            continue
        c, dtype = None, df.schema
        for s in steps:
            if isinstance(dtype, T.StructType) and s in dtype.fieldNames():
                c = F.col(f"`{s}`") if c is None else c.getField(s)
                dtype = dtype[s].dataType
            elif isinstance(dtype, T.ArrayType) and s.isdigit():
                c = F.get(c, F.lit(int(s)))
                dtype = dtype.elementType
            else:
                c = F.lit(None).cast("string")
                break
        out.append(c.alias(name))
    return df.select(*out)


def schema_tree(df: DataFrame) -> DataFrame:
    """Every path of a typed schema with depth, type, number of children, and the share of rows in which it is filled.

    One aggregate counts all paths; an empty table fills none.
    """
    nodes: list[tuple[str, str | None, int, str, int, Column]] = [("$", None, 0, "object", len(df.schema.fields), F.lit(1))]

    def visit(parent: str, schema: T.StructType, depth: int, of: Column | None) -> None:
        for field in schema.fields:
            path = f"{parent}.{field.name}"
            own = df[text.quoted(field.name)] if of is None else of.getField(field.name)
            nested = field.dataType if isinstance(field.dataType, T.StructType) else None
            nodes.append((path, parent, depth, node_type(field.dataType), len(nested.fields) if nested else 0, own))
            if nested:
                visit(path, nested, depth + 1, own)

    visit("$", df.schema, 1, None)
    counts = df.agg(F.count(F.lit(1)).alias("rows"), F.array(*[F.count(own) for *_, own in nodes]).alias("filled"))
    told = F.array(*[
        F.struct(F.lit(path).alias("path"), F.lit(parent).cast("string").alias("parent_path"), F.lit(depth).alias("depth"),
                 F.lit(kind).alias("data_type"), F.lit(children).alias("child_count"))
        for path, parent, depth, kind, children, _ in nodes])
    tall = counts.select("rows", F.posexplode(F.arrays_zip(told.alias("told"), "filled")).alias("nth", "node"))
    return tall.select(
        "node.told.path", "node.told.parent_path", "node.told.depth", "node.told.data_type",
        F.when(F.col("rows") > 0, F.col("node.filled") * 100.0 / F.col("rows")).otherwise(0.0).alias("population"), "node.told.child_count")


def node_type(dtype: T.DataType) -> str:
    if isinstance(dtype, T.StructType):
        return "object"
    if isinstance(dtype, T.ArrayType):
        return "array"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, T.NumericType):
        return "number"
    return "string"


def recommended_view(tree: DataFrame, max_columns: int = MANY_COLUMNS, max_depth: int = 3) -> DataFrame:
    """``tree`` or ``tabular`` for a typed schema."""
    leaves = F.count_if(F.col("child_count") == 0)
    return tree.agg(
        leaves.alias("columns"), F.max("depth").alias("depth"),
    ).withColumn(
        "mode", F.when((F.col("columns") > max_columns) | (F.col("depth") > max_depth), "tree").otherwise("tabular")
    )
