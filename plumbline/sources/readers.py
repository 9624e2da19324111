"""CSV, JSON and Parquet inputs as DataFrames of text or typed columns."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline import session
from plumbline.functions import text

# Candidate delimiters in order of preference, records looked at.
DELIMITERS, RECORDS_LOOKED_AT = {"comma": ",", "tab": "\t", "semicolon": ";", "pipe": "|"}, 10
#: Up to this many files are peeked at one by one, each stopping after the first records; more in one job. The answers are the same.
PEEKED_FILES = 64
BAD_RECORD = "_bad_record"


def _first_lines(spark: SparkSession, paths: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` lines of every file, numbered, with the file name."""
    if len(paths) <= PEEKED_FILES:
        heads = [spark.read.text(p).select(F.lit(p).alias("file"), "value", F.monotonically_increasing_id().alias("nth")).limit(n) for p in paths]
        return reduce(DataFrame.unionByName, heads)
    lines = spark.read.text(list(paths)).select(
        F.col("_metadata.file_path").alias("file"), "value", F.monotonically_increasing_id().alias("at")
    ).filter(F.col("_metadata.file_block_start") == 0)
    first = Window.partitionBy("file").orderBy("at")
    return lines.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= n).select("file", "value", "nth")


def delimiter_scores(lines: DataFrame) -> DataFrame:
    """Score of each delimiter for the given ``(file, value)`` lines.

    A delimiter scores records times fields when at least two records have the same
    number of fields, more than one. Quoted parts do not count.
    """
    bare = F.regexp_replace("value", '"(?:[^"]|"")*"', "q")
    tried = F.explode(F.array(*[
        F.struct(F.lit(i).alias("preference"), F.lit(d).alias("delimiter"),
                 F.size(F.split(bare, F.lit("[" + d + "]"))).alias("fields"))
        for i, d in enumerate(DELIMITERS.values())
    ]))
    counted = lines.filter(F.length("value") > 0).select("file", tried.alias("t")).select("file", "t.*")
    per = counted.groupBy("file", "preference", "delimiter").agg(
        F.count(F.lit(1)).alias("records"), F.min("fields").alias("fewest"), F.max("fields").alias("most"))
    fits = (F.col("records") >= 2) & (F.col("fewest") == F.col("most")) & (F.col("most") > 1)
    return per.select("file", "preference", "delimiter",
                      F.when(fits, F.col("records") * F.col("most")).otherwise(0).alias("score"))


def detect_delimiter(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``(file, delimiter)``; a comma when nothing fits better."""
    scores = delimiter_scores(_first_lines(spark, paths, RECORDS_LOOKED_AT))
    return scores.groupBy("file").agg(
        F.max_by("delimiter", F.struct("score", (-F.col("preference")).alias("earlier"))).alias("delimiter")
    )


def _files(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    return sorted(spark.read.text(list(paths)).inputFiles())


def files_with_long_records(spark: SparkSession, files: Sequence[str]) -> set[str]:
    """Files in which some line holds an odd number of quotes: a quoted cell goes on in the next line."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    lines = spark.read.text(list(files)).select(F.col("_metadata.file_path").alias("file"), (quotes % 2).alias("odd"))
    return {_place(r["file"]) for r in lines.filter("odd = 1").select("file").distinct().collect()}


def _place(uri: str) -> str:
    """One spelling of a file's address."""
    return "/" + uri.removeprefix("file:").lstrip("/") if uri.startswith("file:") else uri


def csv_layouts(spark: SparkSession, files: Sequence[str], delimiter: str | None = None,
                multiline: bool | None = None) -> dict[tuple[str, str, bool], list[str]]:
    """Files by delimiter, first line and whether records span lines. One small row per file comes to the driver."""
    first = _first_lines(spark, files, 1).select("file", F.col("value").alias("head"))
    found = first.withColumn("delimiter", F.lit(delimiter)) if delimiter else first.join(detect_delimiter(spark, files), "file", "left")
    spanning = files_with_long_records(spark, files) if multiline is None else {_place(f) for f in files} if multiline else set()
    layouts: dict[tuple[str, str, bool], list[str]] = {}
    for r in found.orderBy("file").collect():
        layouts.setdefault((r["delimiter"] or ",", r["head"], _place(r["file"]) in spanning), []).append(r["file"])
    return layouts


LINES = "file string, block long, ends_if_out boolean, ends_if_in boolean, opens boolean"
RECORDS = "file string, block long, part string, first boolean, record string"


class QuoteState:
    """Whether a line ends inside a quoted cell, from whether it begins inside one. A quote opens a cell only where a cell begins."""

    def __init__(self, mark: str):
        sep = re.escape(mark)
        self.cell = re.compile(rf'(^|{sep})"[^"]*(?:""[^"]*)*"(?={sep}|\r?\Z)')
        self.opening = re.compile(rf'(?:^|{sep})"')
        self.closing = re.compile(rf'[^"]*(?:""[^"]*)*"(?={sep}|\r?\Z)')

    def after(self, line: str, inside: bool) -> bool:
        if inside:
            closed = self.closing.match(line)
            if not closed:
                return True
            line = line[closed.end():] or "\r"
        return self.opening.search(self.cell.sub(r"\1", line)) is not None


def _lines(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    """Lines as they stand between line feeds, with the split each belongs to. They arrive in order within a split."""
    return spark.read.option("lineSep", "\n").text(list(files)).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], str, bool]]:
    """(split, line, does it hold a quote) of each line."""
    for batch in batches:
        quoted = pc.match_substring(batch.column(2), '"').to_pylist()
        yield from zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()), batch.column(2).to_pylist(), quoted)


def split_states(lines: DataFrame, mark: str) -> dict[str, list[tuple[int, bool, bool, bool]]]:
    """Per file and split, in order: where it starts, whether it starts inside a quoted cell, whether it ends inside one, whether any line does.

    Every split is looked at alone, for both ways it may start; one small row per split comes to the driver, where
    the ways are put together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, found = QuoteState(mark), {}
        for split, line, quoted in _runs(batches):
            out, in_, opens = found.get(split, (False, True, False))
            if quoted:
                out, in_ = state.after(line, out), state.after(line, in_)
            found[split] = out, in_, opens or out
        yield pa.record_batch({
            "file": pa.array([f for f, _ in found], pa.string()), "block": pa.array([b for _, b in found], pa.int64()),
            **{name: pa.array([v[k] for v in found.values()], pa.bool_()) for k, name in enumerate(("ends_if_out", "ends_if_in", "opens"))}})

    states: dict[str, list[tuple[int, bool, bool, bool]]] = {}
    inside: dict[str, bool] = {}
    for r in lines.mapInArrow(run, LINES).orderBy("file", "block").collect():
        start = inside.get(r["file"], False)
        inside[r["file"]] = r["ends_if_in"] if start else r["ends_if_out"]
        states.setdefault(r["file"], []).append((r["block"], start, inside[r["file"]], start or r["opens"]))
    return states


def _records(lines: DataFrame, mark: str, inside: frozenset[tuple[str, int]]) -> DataFrame:
    """Lines put together to records, split by split; ``part`` is ``whole``, or what the split holds of a record: ``head`` (its end), ``tail``, ``through``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, now, open_, came_in, held, first, rows = QuoteState(mark), None, False, False, [], False, []

        def take(part: str) -> None:
            nonlocal held, first
            rows.append((*now, part, first, "\n".join(held)))
            held, first = [], False

        def out() -> pa.RecordBatch:
            names = [c.split()[0] for c in RECORDS.split(", ")]
            types = [pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.string()]
            done = pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)
            rows.clear()
            return done

        for split, line, quoted in _runs(batches):
            if split != now:
                if held:
                    take("through" if came_in else "tail")
                now, open_ = split, split in inside
                came_in, first = open_, split[1] == 0
            held.append(line)
            if quoted:
                open_ = state.after(line, open_)
            if not open_:
                take("head" if came_in else "whole")
                came_in = False
                if len(rows) >= 10_000:
                    yield out()
        if held:
            take("through" if came_in else "tail")
        yield out()

    return lines.mapInArrow(run, RECORDS)


def _spanning_records(spark: SparkSession, files: Sequence[str], mark: str) -> DataFrame:
    """``file, first, record`` of files whose records span lines. Splits are put together alone; what crosses their borders is joined afterwards."""
    lines = _lines(spark, files)
    states = split_states(lines, mark)
    inside = frozenset((f, block) for f, splits in states.items() for block, start, *_ in splits if start)
    whole = _records(lines, mark, inside).where("part = 'whole'").select("file", "first", "record")
    crossing = [(f, block) for f, splits in states.items() for block, start, end, _ in splits if start or end]
    if not crossing:
        return whole
    asked = spark.createDataFrame(crossing, "file string, block long")
    pieces = _records(lines.join(session.bounded(asked, len(crossing)), ["file", "block"], "left_semi"), mark, inside).where("part <> 'whole'")
    # at most two pieces for each split: the end of a record that came in, and the beginning of one that goes on
    so_far = Window.partitionBy("file").orderBy("block", F.col("part") == "tail").rowsBetween(Window.unboundedPreceding, 0)
    numbered = pieces.withColumn("nth", F.count_if(F.col("part") == "tail").over(so_far))
    order = F.sort_array(F.collect_list(F.struct("block", "first", "record")))
    joined = numbered.groupBy("file", "nth").agg(F.bool_or("first").alias("first"), F.array_join(F.transform(order, lambda p: p["record"]), "\n").alias("record"))
    return whole.union(joined.select("file", "first", "record"))


def _parsed(records: DataFrame, schema: T.StructType, options: dict, header: bool) -> DataFrame:
    """Records as columns, each parsed alone; blank ones and the header of each file are left out."""
    # as in a file read whole: line breaks are line feeds
    text_ = F.replace(F.regexp_replace("record", "\r$", ""), F.lit("\r\n"), F.lit("\n"))
    kept = records.where(~F.col("first")) if header else records
    kept = kept.select("file", text_.alias("record")).where(F.length("record") > 0)
    said = {k: str(v).lower() if isinstance(v, bool) else v for k, v in options.items() if k not in ("header", "multiLine", "inferSchema")}
    ddl = ", ".join(f"{text.quoted(f.name)} {f.dataType.simpleString()}" for f in schema.fields)
    row = F.from_csv("record", ddl, {**said, "columnNameOfCorruptRecord": BAD_RECORD})
    return kept.select("file", row.alias("row")).select("file", *[F.col("row").getField(f.name).alias(f.name) for f in schema.fields])


def scan_csv(spark: SparkSession, paths: Sequence[str] | str, delimiter: str | None = None,
             header: bool = True, multiline: bool | None = None, dataset: str | None = None) -> DataFrame:
    """All cells as text; records with the wrong number of fields are kept aside in ``_bad_record``.

    Delimiter and header are those of each file; files of equal layout are read together. All files are split. In those with line
    breaks inside quotes, the state in which each split starts is found first; its records are put together then, those
    that cross a border from their pieces (``multiline`` says without looking whether there may be such records).
    Without a header the columns are called ``_c0, _c1, …``. ``dataset`` names a column for the path of each row's file.
    """
    files = _files(spark, [paths] if isinstance(paths, str) else paths)
    parts = []
    for (mark, _, spans), group in csv_layouts(spark, files, delimiter, multiline).items():
        options = {"sep": mark, "header": header, "quote": '"', "escape": '"', "inferSchema": False, "mode": "PERMISSIVE", "multiLine": spans}
        names = spark.read.options(**options).csv(group[0]).columns
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names] + [T.StructField(BAD_RECORD, T.StringType())])
        # every field is parsed even when few are asked for, else short and long records go unnoticed
        if spans:
            part = _parsed(_spanning_records(spark, group, mark), schema, options, header)
            parts.append(part.withColumnRenamed("file", dataset).select(*names, BAD_RECORD, dataset) if dataset else part.drop("file"))
            continue
        part = spark.read.options(**options, columnNameOfCorruptRecord=BAD_RECORD, columnPruning=False).schema(schema).csv(group)
        parts.append(part.select("*", F.col("_metadata.file_path").alias(dataset)) if dataset else part)
    if not parts:
        return spark.createDataFrame([], T.StructType([T.StructField(BAD_RECORD, T.StringType())]))
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    last = [BAD_RECORD] + ([dataset] if dataset else [])
    return whole.select(*[F.col(text.quoted(c)) for c in whole.columns if c not in last], *last)


def _is_bad(scanned: DataFrame) -> Column:
    # a field has to be asked for besides the bad record, else Spark declines to read the file
    anchor = next(c for c in scanned.columns if c != BAD_RECORD)
    asked = F.length(F.coalesce(scanned[text.quoted(anchor)].cast("string"), F.lit(""))) >= 0
    return asked & F.col(BAD_RECORD).isNotNull()


def good_rows(scanned: DataFrame) -> DataFrame:
    """Without the malformed records."""
    return scanned.filter(~_is_bad(scanned)).drop(BAD_RECORD)


def malformed_rows(scanned: DataFrame) -> DataFrame:
    """How many records were read and how many were malformed."""
    return scanned.select(_is_bad(scanned).alias("bad")).agg(
        F.count(F.lit(1)).alias("total_rows"), F.count_if("bad").alias("malformed"),
        F.count_if(~F.col("bad")).alias("good_rows"),
    )


def scan_json(spark: SparkSession, paths: Sequence[str] | str, lines: bool | None = None) -> DataFrame:
    """JSON lines or an array of objects; lines that cannot be read are kept in ``_bad_record``."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    if lines is None:
        lines = json_format(spark, paths[0]) != "array"
    return spark.read.options(
        multiLine=not lines, mode="PERMISSIVE", columnNameOfCorruptRecord=BAD_RECORD
    ).json(paths)


def json_format(spark: SparkSession, path: str) -> str:
    """``array``, ``lines`` or ``unknown`` by the first character that is not blank."""
    head = spark.read.text(path).filter(F.length(F.trim("value")) > 0).select(
        F.substring(F.ltrim("value"), 1, 1).alias("c")).head()
    return {"[": "array", "{": "lines"}.get(head["c"] if head else "", "unknown")


def json_container_kind(items: DataFrame, value: str = "value", lines: bool = False) -> DataFrame:
    """Kind of a collection of JSON texts: of objects, arrays, primitives, or mixed."""
    parsed = F.try_parse_json(value)
    shape = F.schema_of_variant(parsed)
    kind = F.when(shape.startswith("OBJECT"), "objects").when(shape.startswith("ARRAY"), "arrays").otherwise("primitives")
    seen = items.filter(parsed.isNotNull()).select(kind.alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    single = F.count(F.lit(1)) == 1
    only = F.max("kind")
    if lines:
        out = F.when(single & (only == "objects"), "newline_delimited_objects").otherwise("unknown")
    else:
        out = F.when(F.count(F.lit(1)) == 0, "unknown").when(single, F.concat(F.lit("array_of_"), only)).otherwise("mixed_array")
    return seen.agg(out.alias("kind"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("items"))


def json_items(texts: DataFrame, value: str = "value") -> DataFrame:
    """The items of JSON array texts, one per row, as JSON texts."""
    items = F.try_variant_get(F.try_parse_json(value), "$", "array<variant>")
    return texts.select(F.explode(items).alias("item")).select(F.to_json("item").alias("value"))


def scan_primitive_json(items: DataFrame, value: str = "value") -> DataFrame:
    """Items that are no objects as one text column; strings as they are, null as empty."""
    parsed = F.try_parse_json(value)
    return items.filter(parsed.isNotNull() & ~F.schema_of_variant(parsed).startswith("OBJECT")).select(
        F.coalesce(F.when(F.schema_of_variant(parsed).startswith("ARRAY"), F.to_json(parsed)).otherwise(
            F.try_variant_get(parsed, "$", "string")), F.lit("")).alias("value"))


def json_bad_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """How many JSON lines there are and how many cannot be read."""
    filled = lines.filter(F.length(F.trim(value)) > 0)
    bad = F.try_parse_json(value).isNull()
    return filled.agg(F.count(F.lit(1)).alias("total_rows"), F.count_if(bad).alias("malformed"),
                    F.count_if(~bad).alias("good_rows"))


def scan_parquet(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    return spark.read.parquet(*([paths] if isinstance(paths, str) else paths))


READERS = {"csv": scan_csv, "tsv": scan_csv, "json": scan_json, "jsonl": scan_json, "ndjson": scan_json,
           "parquet": scan_parquet}


def extension(path: str) -> str:
    tail = path.rstrip("/").rsplit("/", 1)[-1].lower()
    return tail.rsplit(".", 1)[-1] if "." in tail else ""


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """Reader by extension, CSV for anything else; malformed records are left out."""
    df = READERS.get(extension(path), scan_csv)(spark, path)
    return good_rows(df) if BAD_RECORD in df.columns else df


def unreadable(spark: SparkSession, paths: Sequence[str], form: str = "parquet") -> DataFrame:
    """``path, error`` of the files that cannot be opened."""
    failed = []
    for path in paths:  # footers and listings only
        try:
            spark.read.format(form).load(path).schema  # noqa: B018  reading it is the test
        except Exception as error:
            failed.append((path, str(error).splitlines()[0]))
    return spark.createDataFrame(failed, "path string, error string")


def scan_many(spark: SparkSession, paths: Sequence[str], form: str = "parquet", dataset: str = "dataset") -> DataFrame:
    """Several files of one format as one table, each row naming the path of its file.

    Files that cannot be opened are left out; ``unreadable`` lists them with the reason.
    """
    bad = {r["path"] for r in unreadable(spark, paths, form).collect()}
    paths = [p for p in paths if p not in bad]
    if form == "csv":
        return scan_csv(spark, paths, dataset=dataset)
    reader = spark.read.option("mergeSchema", True)
    if form == "json":
        reader = reader.option("columnNameOfCorruptRecord", BAD_RECORD)
    return reader.format(form).load(paths).select("*", F.col("_metadata.file_path").alias(dataset))


def register_table(spark: SparkSession, source: str | DataFrame, name: str = "data") -> DataFrame:
    """Make a file or DataFrame available to SQL under a name."""
    df = read_any(spark, source) if isinstance(source, str) else source
    df.createOrReplaceTempView(name)
    return df


def describe_schema(df: DataFrame) -> DataFrame:
    """Column names and types, with the rows of the table and how many of them fill each column."""
    fields = list(enumerate(df.schema.fields))
    counts = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(df[text.quoted(f.name)]).alias(f"n{i}") for i, f in fields])
    entries = [F.struct(F.lit(i).alias("ordinal"), F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"),
                        "rows", F.col(f"n{i}").alias("filled")) for i, f in fields]
    return counts.select(F.inline(F.array(*entries)))


def schema_json(df: DataFrame) -> str:
    return df.schema.json()


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total_rows"))


def list_tables(spark: SparkSession) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables())


def drop_table(spark: SparkSession, name: str) -> bool:
    return bool(spark.catalog.dropTempView(name))
