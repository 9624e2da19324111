"""Headline timings. Prints one JSON line.

Each query runs once to warm the JVM and is then timed once, at $BENCH_SF_DIR on
local[$BENCH_CPUS]. The CSV and JSON inputs are written from lineitem before timing.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from plumbline import catalog, session  # noqa: E402
from plumbline.operators import stats  # noqa: E402
from plumbline.plans.profile import profile  # noqa: E402
from plumbline.sources import readers  # noqa: E402

HEADLINE = (
    "base_stats", "numeric_moments", "quantiles", "histogram", "top_values", "duplicate_rows", "correlation_matrix",
    "column_issues", "pii_rows", "outliers", "compare_profiles", "nway_deltas", "merge_profiles_by_name",
    "generate_gx", "structure_scan_props", "sql_group_having", "profile_stream",
)


def consume(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    shuffles = str(max(8, int(cpus))) if cpus.isdigit() else "8"
    spark = session.build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": shuffles, "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"},
    )
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    csv_path, json_path = session.scratch_path(spark, "bench-csv"), session.scratch_path(spark, "bench-json")
    session.spread(lineitem).write.option("header", True).csv(csv_path)
    session.spread(lineitem).write.json(json_path)

    runs = {
        "average_and_count": lambda: consume(lineitem.agg(F.avg("l_extendedprice"), F.count(F.lit(1)))),
        "profile_lineitem_parquet": lambda: consume(profile(lineitem)),
        "profile_lineitem_csv": lambda: consume(profile(readers.good_rows(readers.scan_csv(spark, csv_path)))),
        "profile_lineitem_json": lambda: consume(profile(readers.scan_json(spark, json_path))),
        "duplicate_rows_lineitem": lambda: consume(stats.duplicate_rows(session.spread(lineitem))),
    }
    queries = catalog.queries()
    for name in HEADLINE:
        runs[name] = lambda q=queries[name]: consume(q(spark, sf_dir))

    seconds = {}
    for name, run in runs.items():
        run()
        start = time.perf_counter()
        run()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "rows": {"lineitem": lineitem.count()},
        "cpus": cpus,
    }))


if __name__ == "__main__":
    main()
