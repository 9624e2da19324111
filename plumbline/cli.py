"""Job entry point: profile files, write reports, merge or compare them, apply gates.

    spark-submit --py-files plumbline.zip -m plumbline.cli PATH... [--out DIR] [--merge] [--compare]

A path with * ? [ or { stands for every file it matches, each profiled on its own. Exit code 0 when all gates hold, 1 when one
fails, 2 on an error.
"""

from __future__ import annotations

import argparse
import csv
import io
import sys
import time
import traceback
from collections import Counter
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline import session
from plumbline.operators import gates, reports
from plumbline.plans import batch
from plumbline.plans.profile import profile
from plumbline.sources.readers import read_any

#: ``json`` is the whole report as one document, ``jsonl`` one object per column.
FORMATS = ("json", "jsonl", "csv", "markdown")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="plumbline", description=__doc__.splitlines()[0])
    p.add_argument("paths", nargs="+")
    p.add_argument("--format", choices=FORMATS, default="json")
    p.add_argument("--out", help="folder for the reports; printed when left out")
    p.add_argument("--merge", action="store_true", help="one profile of all files together, if their schemas agree")
    p.add_argument("--force", action="store_true", help="merge files of different schemas too")
    p.add_argument("--compare", action="store_true", help="every file against the first, and the trend of each column")
    p.add_argument("--fail-on-missing", type=float, metavar="PCT")
    p.add_argument("--fail-on-duplicates", action="store_true")
    p.add_argument("--quiet", action="store_true")
    return p


def expand(spark: SparkSession, pattern: str) -> list[tuple[str, int]]:
    """The files a path stands for and their sizes, in order of their names; a path without wildcards stands for itself."""
    # only listed: the contents are not asked for
    listing = spark.read.format("binaryFile").load(pattern).select("path", "length")
    if any(c in pattern for c in "*?[{"):
        files = [(r["path"], r["length"]) for r in listing.orderBy("path").collect()]
        if not files:
            raise FileNotFoundError(f"no file matches {pattern}")
        return files
    return [(pattern, listing.agg(F.coalesce(F.sum("length"), F.lit(0))).head()[0])]


def report_names(paths: Sequence[str]) -> list[str]:
    """A name for the report of each path: its last part, with the folders above it where others end alike."""
    parts = [[x for x in p.rstrip("/").split("/") if x not in ("", "file:")] or ["data"] for p in paths]
    names = [p[-1] for p in parts]
    for depth in range(2, max(map(len, parts), default=1) + 1):
        often = Counter(names)
        names = ["_".join(p[-depth:]) if often[n] > 1 else n for p, n in zip(parts, names)]
    # the same path twice
    seen: Counter[str] = Counter()
    out = []
    for name in names:
        seen[name] += 1
        out.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return out


def render(column_profile: DataFrame, form: str, title: str, size: int = 0, seconds: float = 0.0) -> DataFrame:
    """The report as ordered lines."""
    if form == "json":
        return reports.report_document(column_profile, title.rstrip("/").rsplit("/", 1)[-1], size, seconds)
    if form == "jsonl":
        return reports.report_json(column_profile).orderBy("ordinal").select("text")
    if form == "csv":
        return render_table(reports.report_csv(column_profile), form, title)
    return reports.report_markdown(column_profile, title).orderBy("nth").select(F.col("line").alias("text"))


def render_table(table: DataFrame, form: str, title: str) -> DataFrame:
    """An ordered table as lines: a JSON object per row, CSV or Markdown with a header."""
    names = table.columns
    if form in ("json", "jsonl"):
        return table.select(F.to_json(F.struct(*names)).alias("text"))
    if form == "csv":
        written = io.StringIO()
        csv.writer(written, lineterminator="").writerow(names)
        head, line = [written.getvalue()], F.to_csv(F.struct(*names))
    else:
        head = [f"# {title}", "", "| " + " | ".join(names) + " |", "|" + " --- |" * len(names)]
        cells = [F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in names]
        line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    first = table.sparkSession.createDataFrame(list(enumerate(head, -len(head))), "nth bigint, text string")
    rows = table.select(F.monotonically_increasing_id().alias("nth"), line.alias("text"))
    return first.unionByName(rows).orderBy("nth").select("text")


def _flat(df: DataFrame) -> DataFrame:
    """The columns that a line of a report can hold."""
    return df.select(*[F.col(f"`{f.name}`") for f in df.schema if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))])


class Reports:
    """Where reports go: a folder, the screen or nowhere."""

    def __init__(self, out: str | None, quiet: bool, form: str):
        self.out, self.quiet, self.form = out, quiet, form

    def put(self, lines: DataFrame, name: str) -> None:
        if self.out:
            lines.coalesce(1).write.mode("overwrite").text(f"{self.out}/{name}.{self.form}")
        elif not self.quiet:
            for row in lines.toLocalIterator():
                print(row["text"])

    def put_table(self, table: DataFrame, name: str) -> None:
        self.put(render_table(table, self.form, name), name)


def failed_gates(column_profile: DataFrame, options: argparse.Namespace) -> list[tuple[str, str]]:
    failed = []
    if options.fail_on_missing is not None:
        failed += [("missing", r["column"]) for r in gates.gate_missing(column_profile, options.fail_on_missing).toLocalIterator()]
    if options.fail_on_duplicates:
        failed += [("duplicates", r["column"]) for r in gates.gate_duplicates(column_profile).toLocalIterator()]
    return failed


def together(profiles: dict[str, DataFrame], options: argparse.Namespace, to: Reports) -> None:
    """What is told of all files: the schema check and the merged profile, deltas from the first file and trends."""
    numbered = [_flat(p).withColumns({"dataset": F.lit(path), "nth": F.lit(nth)}) for nth, (path, p) in enumerate(profiles.items())]
    every = session.materialize(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered), "profiles")
    baseline = next(iter(profiles))
    if options.merge:
        result = batch.batch_merge(every, "dataset", "nth", baseline, options.force)
        to.put_table(result.schema_check.orderBy("dataset"), "schema_check")
        if result.merged is None:
            raise ValueError("the schemas differ; --force merges them all the same")
        to.put_table(result.merged.orderBy("column"), "merged_profile")
    if options.compare:
        widest = every.groupBy("dataset").count().agg(F.max("count")).head()[0]
        result = batch.batch_compare(every, "dataset", baseline, widest)
        to.put_table(result.deltas.orderBy("dataset", "column"), "comparison")
        to.put_table(result.trends.orderBy("column", "metric"), "trends")


def run(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    options = parser().parse_args(argv)
    spark = spark or session.build_session()
    to = Reports(options.out, options.quiet, options.format)
    code, files = 0, []
    for pattern in options.paths:
        try:
            files += expand(spark, pattern)
        except Exception:  # a bad path does not stop the others
            traceback.print_exc()
            code = 2
    profiles: dict[str, DataFrame] = {}
    for (path, size), name in zip(files, report_names([p for p, _ in files])):
        try:
            begun = time.monotonic()
            column_profile = profile(read_any(spark, path))
            to.put(render(column_profile, options.format, path, size, time.monotonic() - begun), f"{name}_profile")
            failed = failed_gates(column_profile, options)
            for gate, column in failed:
                print(f"gate failed: {gate}: {path}: {column}", file=sys.stderr)
            code = max(code, 1 if failed else 0)
            profiles[path] = column_profile
        except Exception:  # a bad file does not stop the others
            traceback.print_exc()
            code = 2
    if options.merge or options.compare:
        try:
            if len(profiles) < 2:
                raise ValueError("merging and comparing need at least two files that can be read")
            together(profiles, options, to)
        except Exception:
            traceback.print_exc()
            code = 2
    return code


if __name__ == "__main__":
    sys.exit(run())
