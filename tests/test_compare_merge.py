import pytest
from pyspark.sql import functions as F

from conftest import by_column, rows
from plumbline.operators import compare, merge, sketches
from plumbline.plans import batch
from plumbline.plans.profile import SUMMARY, profile


@pytest.fixture(scope="module")
def orders(spark, sf):
    return spark.read.parquet(f"{sf}/orders.parquet")


def test_a_table_compared_with_itself_is_unchanged(orders):
    p = profile(orders, parts=SUMMARY)
    c = compare.compare_profiles(p, p)
    # a column without numbers has no mean on either side, which is no change
    assert {r["status"] for r in c.collect()} == {"unchanged"}
    s = compare.compare_summary(c).head()
    assert (s["total"], s["unchanged"], s["added"], s["removed"], s["modified"]) == (6, 6, 0, 0, 0)
    assert compare.schema_diff(p, p).count() == 0


def test_directions(spark):
    a = profile(spark.createDataFrame([(1.0, "x"), (2.0, None)], "n double, t string"), parts=SUMMARY)
    b = profile(spark.createDataFrame([(5.0, "x"), (5.0, "y")], "n double, t string"), parts=SUMMARY)
    c = by_column(compare.compare_profiles(a, b))
    assert c["n"]["mean_direction"] == "improved" and c["n"]["std_dev_direction"] == "improved"
    assert c["t"]["missing_pct_direction"] == "improved" and c["t"]["mean_direction"] is None
    assert c["n"]["distinct_direction"] == "degraded" and c["n"]["status"] == "modified"


def test_merging_parts_equals_the_whole(orders):
    parts = orders.withColumn("dataset", F.year("o_orderdate").cast("string"))
    columns = ["o_totalprice", "o_custkey", "o_orderstatus"]
    merged = by_column(merge.merge_by_name(
        batch.batch_profile(parts, "dataset", columns, {"moments", "quantiles"}).withColumn("nth", F.col("dataset").cast("int")), "nth"))
    whole = by_column(profile(orders, columns, parts=SUMMARY))
    for c in columns:
        for stat in ("count", "missing", "num_count"):
            assert merged[c][stat] == whole[c][stat]
        for stat in ("min", "max", "sum", "mean"):
            assert merged[c][stat] == pytest.approx(whole[c][stat])
        assert merged[c]["inferred_type"] == whole[c]["inferred_type"]


def test_united_sketches_tell_of_all_rows_what_one_sketch_tells(spark):
    """Datasets that share most values and differ in size: sums and weighted medians are far off, united sketches are not."""
    df = spark.range(60_000).select(
        F.when(F.col("id") < 50_000, "big").otherwise("small").alias("dataset"), (F.col("id") % 5_000).alias("n"),
        F.concat(F.lit("x" * 300), F.col("id") % 700).alias("t"), F.lit(None).cast("double").alias("gone"))
    parts = sketches.sketches(df, ["n", "t", "gone"], by="dataset")
    got = by_column(sketches.united(parts))
    assert set(got) == {"n", "t"}
    assert got["n"]["distinct_low"] <= 5_000 <= got["n"]["distinct_high"] and got["n"]["distinct_high"] < 5_200
    assert got["t"]["distinct_low"] <= 700 <= got["t"]["distinct_high"] and got["t"]["median_estimate"] is None
    assert got["n"]["median_low"] <= 2_500 <= got["n"]["median_high"] and abs(got["n"]["median_estimate"] - 2_500) <= 50
    assert sketches.united(parts.where("false")).count() == 0


def deltas(spark, changes):
    """One column whose mean moves from 100 by the given amounts."""
    rows_ = [("base", 100.0)] + [(f"d{i}", 100.0 + x) for i, x in enumerate(changes)]
    return batch.batch_compare(
        batch.batch_profile(spark.createDataFrame(rows_, "dataset string, x double"), "dataset", ["x"], SUMMARY), "dataset", "base", 1)


@pytest.mark.parametrize("changes,direction", [
    ([0.5, -0.5], "stable"), ([10, 20], "improving"), ([-10, -20], "degrading"), ([50, -50], "stable"), ([50, -10], "improving"),
])
def test_trends(spark, changes, direction):
    t = {r["metric"]: r["direction"] for r in deltas(spark, changes).trends.collect()}
    assert t["mean"] == direction and t["null_rate"] == "stable"


def test_added_and_removed_columns(spark):
    p = spark.createDataFrame(
        [("a", 0, "x", 10, 0, 10, "Integer", 10, 1.0, 1.0), ("a", 1, "y", 10, 0, 10, "String", 0, None, None),
         ("b", 0, "x", 10, 5, 5, "String", 0, None, None), ("b", 1, "z", 10, 0, 1, "String", 0, None, None)],
        "dataset string, ordinal int, column string, count long, missing long, distinct long, inferred_type string, num_count long, mean double, std_dev double")
    d = compare.nway_deltas(p, "dataset", "a", 2)
    assert rows(d, "column", "presence", "type_changed") == [("x", "shared", True), ("y", "removed", False), ("z", "added", False)]
    s = compare.nway_summary(d, "dataset").head()
    assert (s["files_compared"], s["columns_tracked"], s["added_columns"], s["removed_columns"], s["type_changes"], s["significant_changes"]) == (1, 1, 1, 1, 1, 1)
    check = {r["dataset"]: r for r in compare.batch_schema_check(p, "dataset", "a").collect()}
    assert check["a"]["compatible"] and not check["b"]["compatible"] and not check["a"]["all_compatible"]
    assert (check["b"]["added"], check["b"]["removed"], check["b"]["type_changes"]) == (1, 1, 1)
    with pytest.raises(ValueError):
        batch.batch_merge(p.filter("dataset = 'a'"), "dataset", "dataset", "a")
    assert batch.batch_merge(p, "dataset", "dataset", "a").merged is None
