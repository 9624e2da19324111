"""Column statistics against brute force, and their invariants."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from conftest import by_column, rows
from plumbline import session
from plumbline.operators import anomalies, correlation, quality, stats
from plumbline.operators.frequency import cell_table, frequency
from plumbline.plans.profile import profile, table_profile


def interpolated(values, q):
    v = sorted(values)
    h = q * (len(v) - 1)
    low = math.floor(h)
    return v[low] + (v[math.ceil(h)] - v[low]) * (h - low)


def numbers(spark, values, kind="double"):
    return spark.createDataFrame([(v,) for v in values], f"x {kind}")


def test_one_to_ten(spark):
    p = by_column(profile(numbers(spark, range(1, 11), "bigint")))["x"]
    assert (p["inferred_type"], p["count"], p["missing"], p["distinct"]) == ("Integer", 10, 0, 10)
    assert (p["mean"], p["median"], p["min"], p["max"]) == (5.5, 5.5, 1.0, 10.0)
    assert p["variance"] == pytest.approx(9.1666667) and p["kurtosis"] == pytest.approx(-1.2242424)
    assert sum(b["n"] for b in p["histogram"]) == 10 and len(p["histogram"]) == 5


@pytest.mark.parametrize("shape", ["heavy", "cluster", "few", "constant", "single", "signed"])
@pytest.mark.parametrize("ordered_rows", [5, 1_000_000])
def test_quantiles_match_brute_force(spark, monkeypatch, shape, ordered_rows):
    """Small limits force the search to divide slices again and again."""
    rnd = random.Random(7)
    values = {
        "heavy": [rnd.lognormvariate(0, 6) for _ in range(800)] + [1e300, -1e300],
        "cluster": [1e9 + rnd.random() * 1e-3 for _ in range(500)] + [0.0],
        "few": [rnd.choice([0.01, 0.02, 0.05]) for _ in range(300)],
        "constant": [0.1] * 50, "single": [3.0],
        "signed": [rnd.gauss(0, 1) for _ in range(501)],
    }[shape]
    monkeypatch.setattr(stats, "ORDERED_ROWS", ordered_rows)
    ft = frequency(numbers(spark, values), materialized=True)
    got = by_column(stats.quantiles_wide(ft, stats.base_stats(ft)))["x"]
    for name, q in stats.QUANTILES.items():
        assert got[name] == pytest.approx(interpolated(values, q), rel=1e-12), name


def test_moments_match_brute_force(spark):
    rnd = random.Random(3)
    values = [rnd.expovariate(1) for _ in range(400)]
    ft = frequency(numbers(spark, values))
    got = by_column(stats.moments(ft, stats.base_stats(ft)))["x"]
    mean = statistics.fmean(values)
    m2, m3, m4 = (sum((v - mean) ** k for v in values) / len(values) for k in (2, 3, 4))
    assert got["mean"] == pytest.approx(mean) and got["variance"] == pytest.approx(statistics.variance(values))
    assert got["variance_pop"] == pytest.approx(m2)
    assert got["skewness"] == pytest.approx(m3 / m2 ** 1.5) and got["kurtosis"] == pytest.approx(m4 / m2 ** 2 - 3)


def test_no_spread_means_zero_shape(spark):
    ft = frequency(numbers(spark, [0.1] * 7))
    got = by_column(stats.moments(ft, stats.base_stats(ft)))["x"]
    assert (got["variance"], got["skewness"], got["kurtosis"]) == (0.0, 0.0, 0.0)


def test_infinite_and_nan_are_numeric_but_not_in_statistics(spark):
    got = by_column(stats.base_stats(frequency(numbers(spark, [1.0, float("nan"), float("inf"), None]))))["x"]
    assert (got["inferred_type"], got["numeric_count"], got["num_count"], got["missing"]) == ("Numeric", 3, 1, 1)


def test_text_numbers_with_two_spellings(spark):
    ft = frequency(spark.createDataFrame([("1",), ("1.0",), ("2",), ("3",)], "x string"))
    got = by_column(stats.quantiles_wide(ft, stats.base_stats(ft)))["x"]
    assert got["median"] == 1.5


def test_histogram_last_bin_closed(spark):
    ft = frequency(numbers(spark, [0.0, 1.0, 2.0, 3.0, 4.0]))
    bins = stats.histogram(ft, stats.base_stats(ft)).orderBy("bin").collect()
    assert [b["n"] for b in bins] == [1, 1, 1, 1, 1] and bins[-1]["end"] == 4.0


def test_top_values_restore_long_texts(spark):
    long_text = "word " * 200
    df = spark.createDataFrame([(long_text,)] * 3 + [("short",)] * 2 + [(" short ",), (None,)], "x string")
    ft = frequency(df, materialized=True)
    top = stats.top_values(ft, stats.base_stats(ft), df).orderBy("position").collect()
    # equal counts: ties are put in order by value, long texts by their digest
    assert {(t["value"], t["n"]) for t in top} == {(long_text.strip(), 3), ("short", 3)}
    base = by_column(stats.base_stats(ft))["x"]
    assert (base["distinct"], base["missing"], base["max_length"], base["min_length"]) == (2, 1, 999, 5)


def test_columns_with_dots_and_every_type(spark):
    df = spark.sql("""select 1 as `a.b`, true as flag, date'2024-01-02' as d, cast(1.50 as decimal(5,2)) as dec,
        array(1, 2) as arr, named_struct('k', 1) as s, cast(1.5 as float) as f, binary('x') as bin, cast(null as string) as gone""")
    p = by_column(profile(df))
    kinds = {c: r["inferred_type"] for c, r in p.items()}
    assert kinds == {"a.b": "Integer", "flag": "Boolean", "d": "Date", "dec": "Numeric", "arr": "String", "s": "String",
                     "f": "Numeric", "bin": "String", "gone": "Null"}
    assert p["f"]["mean"] == 1.5 and p["dec"]["mean"] == 1.5


def test_frequency_counts_a_hot_value_exactly(spark):
    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("x"))
    ft = frequency(df)
    hot = ft.df.filter(F.col("value") == "hot").collect()
    assert len(hot) == 1 and hot[0]["n"] == 10_000
    assert ft.df.agg(F.sum("n")).head()[0] == 30_000


def test_joins_without_broadcast_give_the_same(spark, sf, monkeypatch):
    df = spark.read.parquet(f"{sf}/orders.parquet")
    columns = ["o_totalprice", "o_custkey", "o_orderstatus"]
    want = rows(profile(df, columns), "column", F.round("std_dev", 6), F.round("median", 6), "histogram", "top_values")
    monkeypatch.setattr(session, "BROADCAST_ROWS", 0)
    assert rows(profile(df, columns), "column", F.round("std_dev", 6), F.round("median", 6), "histogram", "top_values") == want


def test_duplicates(spark):
    df = spark.createDataFrame([("a", "1", "x"), ("b", "2", "y"), ("a", "1", "x"), ("c", "3", "z"), ("b", "2", "y")], "a string, b string, c string")
    d = stats.duplicate_rows(df).head()
    assert (d["total_rows"], d["duplicate_rows"], d["duplicate_pct"]) == (5, 2, 40.0)
    t = table_profile(df, stats.base_stats(frequency(df))).head()
    assert t["duplicate_issues"][0]["severity"] == "error" and t["total_columns"] == 3
    # cells that only look alike when joined are different rows
    tricky = spark.createDataFrame([("ab", "c"), ("a", "bc"), (None, ""), ("", None)], "a string, b string")
    assert stats.duplicate_rows(tricky).head()["duplicate_rows"] == 0


def test_correlation(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i, 6.0 - i, 0.1, None if i == 1 else float(i)) for i in range(1, 6)],
                               "x double, twice double, back double, same double, gap double")
    r = {(p["col_x"], p["col_y"]): (p["n"], round(p["r"], 9)) for p in correlation.pairwise(df, df.columns).collect()}
    assert r[("x", "twice")] == (5, 1.0) and r[("x", "back")] == (5, -1.0)
    assert r[("x", "same")] == (5, 0.0) and r[("x", "gap")] == (4, 1.0)


def test_correlation_by_blocks_of_columns(spark):
    """Column blocks give what one matrix gives; offsets, gaps and numbers that are equal only where both are there."""
    import numpy as np

    draw = np.random.default_rng(3)
    x = draw.normal(size=(200, 7)) * [1, 5, 1e4, 1, 1e-3, 1, 1] + [0, 1e8, 0, -3, 0, 0, 0]
    x[:, 5] = np.where(x[:, 6] > 0, 3.7, x[:, 5])
    x[x[:, 6] <= 0, 6] = np.nan
    x[::9, 0] = np.nan
    names = [f"c{i}" for i in range(7)]
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in row) for row in x], ", ".join(f"{c} double" for c in names))
    want = {}
    for i in range(7):
        for j in range(i + 1, 7):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            a, b = x[both, i], x[both, j]
            want[names[i], names[j]] = (int(both.sum()), 0.0 if a.min() == a.max() or b.min() == b.max() else np.corrcoef(a, b)[0, 1])
    whole = {(r[0], r[1]): (r[2], r[3]) for r in correlation.pairwise(df, names).collect()}
    assert whole.keys() == want.keys() and all(whole[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    sums = {(r["i"], r["j"]): r for r in correlation._pair_sums(df, names, block=3).collect()}
    assert len(sums) == 21 and all(sums[i, j]["n"] == want[names[i], names[j]][0] for i, j in sums)
    one = {(r["i"], r["j"]): r["xy"] for r in correlation._pair_sums(df, names).collect()}
    assert all(r["xy"] == pytest.approx(one[k], rel=1e-9, abs=1e-9) for k, r in sums.items())


def test_correlation_of_nothing(spark):
    empty = spark.range(3).selectExpr("double(id) as a", "double(id) as b").where("a < 0")
    assert [tuple(r) for r in correlation.pairwise(empty, ["a", "b"]).collect()] == [("a", "b", 0, 0.0)]
    assert correlation.pairwise(empty, ["a"]).count() == 0 and correlation.matrix(empty, ["a"]).count() == 1


@pytest.mark.parametrize("count,missing,want", [(100, 15, 0.85), (100, 0, 1.0), (100, 100, 0.0), (0, 0, 1.0)])
def test_completeness(spark, count, missing, want):
    assert spark.range(1).select(quality.completeness(F.lit(count), F.lit(missing))).head()[0] == want


@pytest.mark.parametrize("count,missing,distinct,want", [(100, 15, 80, 80 / 85), (100, 0, 100, 1.0), (100, 0, 1, 0.01), (100, 100, 0, 1.0)])
def test_uniqueness(spark, count, missing, distinct, want):
    assert spark.range(1).select(quality.uniqueness(F.lit(count), F.lit(missing), F.lit(distinct))).head()[0] == pytest.approx(want)


def test_row_numbers_follow_scan_order(spark, sf):
    df = spark.range(0, 1000, 1, 7).select(F.col("id"))
    assert anomalies.number_rows(df).filter(F.col("row_number") != F.col("id") + 1).count() == 0
    numbered = anomalies.read_numbered(spark, f"{sf}/orders.parquet")
    assert numbered.agg(F.count_distinct("row_number"), F.min("row_number"), F.max("row_number")).head()[0:3] == (1500, 1, 1500)


def test_outliers_need_more_than_ten_values(spark):
    few = spark.createDataFrame([(i, 1.0 if i else 1000.0) for i in range(10)], "k int, x double")
    many = spark.createDataFrame([(i, 1.0 + i % 3 if i else 1000.0) for i in range(50)], "k int, x double")
    assert anomalies.outliers(few, "k", ["x"]).count() == 0
    assert rows(anomalies.outliers(many, "k", ["x"]), "column", "k") == [("x", 0)]


def test_pages_cover_all_findings(spark):
    df = spark.range(500).select(F.col("id"), F.when(F.col("id") % 4 == 0, None).otherwise(F.col("id")).alias("x"))
    found = anomalies.missing_rows(df, "id", ["x"])
    seen = [r["id"] for page in (1, 2, 3) for r in anomalies.drilldown(df, "id", found, "x", page).collect()]
    assert sorted(seen) == list(range(0, 500, 4))


def test_estimates_are_close(spark, sf):
    df = spark.read.parquet(f"{sf}/lineitem.parquet")
    ft = frequency(df, ["l_orderkey", "l_extendedprice"])
    exact = by_column(stats.base_stats(ft))
    for c, r in by_column(stats.distinct_estimate(df, ["l_orderkey", "l_extendedprice"])).items():
        assert abs(r["distinct"] - exact[c]["distinct"]) / exact[c]["distinct"] < 0.06
    est = by_column(stats.quantiles_estimate(df, ["l_extendedprice"]))["l_extendedprice"]
    full = frequency(df, ["l_extendedprice"], materialized=True)
    true = by_column(stats.quantiles_wide(full, stats.base_stats(full)))["l_extendedprice"]
    assert est["median"] == pytest.approx(true["median"], rel=0.01)


def test_texts_of_any_length(spark):
    """A number of 300 digits is a number, and long texts come back whole and in order."""
    df = spark.createDataFrame([("1" * 300, "b" * 300), ("2", "a" * 300 + "z"), ("3.5", "a" * 300 + "c"), ("0" * 298 + "17", "a" * 300 + "c")], "n string, t string")
    ft = frequency(df, ["n", "t"], materialized=True)
    base = stats.base_stats(ft)
    got = by_column(base)
    assert got["n"]["inferred_type"] == "Numeric" and got["n"]["integer_count"] == 2 and got["n"]["max"] == pytest.approx(float("1" * 300))
    top = [r["value"] for r in stats.top_values(ft, base).filter("column = 't'").orderBy("position").collect()]
    assert top == ["a" * 300 + "c", "a" * 300 + "z", "b" * 300]
    assert [r["value"] for r in stats.top_values(ft, base, size=2).filter("column = 't'").orderBy("position").collect()] == top[:2]


def test_top_values_of_many_equal_counts(spark, monkeypatch):
    """Short values are cut exactly; long ones that begin alike are put in order as whole texts."""
    lead = "https://example.com/a/common/beginning/that/is/longer/than/sixty-four/characters/"
    rows = [(f"{lead}{k:05d}", f"{lead * 4}{k:05d}") for k in range(5000)] + [(f"{lead}00007", f"{lead * 4}99999"), ("z", f"{lead * 4}99999")]
    df = spark.createDataFrame(rows, "short string, long string").repartition(4)
    ft = frequency(df)
    sizes = []
    attach = session.attach

    def counted(rows, facts, keys, most, *rest, **more):
        sizes.append((facts.count(), most))
        return attach(rows, facts, keys, most, *rest, **more)

    monkeypatch.setattr(session, "attach", counted)
    got = {}
    for r in stats.top_values(ft, stats.base_stats(ft)).orderBy("position").collect():
        got.setdefault(r["column"], []).append(r["value"])
    assert got["short"] == [f"{lead}00007"] + [f"{lead}{k:05d}" for k in (0, 1, 2, 3, 4, 5, 6, 8, 9)]
    assert got["long"] == [f"{lead * 4}99999"] + [f"{lead * 4}{k:05d}" for k in range(9)]
    assert all(rows <= most for rows, most in sizes)


def test_statistics_of_cells_need_no_shuffle_of_values(spark):
    """The same figures from cells as from frequencies, and nothing is dealt out by value."""
    r = random.Random(1)
    df = spark.createDataFrame([(k, r.choice([None, 1.5, float(k), -2e9]), r.choice(["7", "x", " 8.5 ", "N/A", "z" * 300])) for k in range(500)], "a long, b double, c string")
    counted, cells = frequency(df), cell_table(df)
    base = stats.base_stats(cells)
    pairs = [(base.drop("distinct", "unique_count"), stats.base_stats(counted).drop("distinct", "unique_count"))]
    for of in (stats.moments, stats.histogram, stats.quantiles_wide):
        pairs.append((of(cells, base), of(counted, stats.base_stats(counted))))
    for a, b in pairs:
        rounded = lambda df: rows(df.select(*[F.format_string("%.8e", c) if t == "double" else c for c, t in df.dtypes]))
        assert rounded(a) == rounded(b)
    for df in (base, stats.moments(cells, base), stats.histogram(cells, base)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" in plan
        assert not any(name in line for line in plan.splitlines() if "Exchange hashpartitioning" in line for name in ("short", "whole", "real", "value", "num#"))
