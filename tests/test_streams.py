import pytest
from pyspark.sql import functions as F

from conftest import by_column
from plumbline import session
from plumbline.catalog import statements
from plumbline.operators import stats
from plumbline.operators.frequency import frequency
from plumbline.plans.profile import SUMMARY, profile
from plumbline.streaming import profile_stream as streams


def test_stream_equals_batch(spark, sf):
    """Five files, one per batch."""
    df = spark.read.parquet(f"{sf}/events.parquet")
    folder = session.scratch_path(spark, "stream-source")
    df.repartition(5).write.parquet(folder)
    stream = streams.read_stream(spark, folder, df.schema, files_per_batch=1)
    running = by_column(streams.run_to_table(streams.profile_stream(stream), "state"))
    whole = by_column(profile(df, parts=SUMMARY))
    for c, r in running.items():
        for stat in ("count", "missing", "total_valid", "integer_count", "numeric_count", "date_count", "inferred_type", "min_length", "max_length"):
            assert r[stat] == whole[c][stat], (c, stat)
        if r["num_count"]:
            assert abs(r["std_dev"] - whole[c]["std_dev"]) < 1e-6 * whole[c]["std_dev"]
            assert abs(r["kurtosis"] - whole[c]["kurtosis"]) < 1e-6


def test_frequencies_and_duplicates(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    folder = session.scratch_path(spark, "stream-source")
    df.select("role", "text").repartition(3).write.parquet(folder)
    schema = df.select("role", "text").schema

    def stream():
        return streams.read_stream(spark, folder, schema, files_per_batch=1)

    counted = streams.run_to_table(streams.frequency_stream(stream()), "frequencies", ["column", "value"])
    whole = F.trim("text").alias("value")
    batch = df.select(F.lit("role").alias("column"), F.col("role").alias("value")).union(df.select(F.lit("text"), whole)).groupBy("column", "value").agg(
        F.count(F.lit(1)).alias("n"))
    assert counted.exceptAll(batch).count() == 0 and batch.exceptAll(counted).count() == 0
    d = stats.duplicate_summary(streams.run_to_table(streams.duplicates_stream(stream()), "rows", ["row_digest"])).head()
    assert tuple(d) == tuple(stats.duplicate_rows(df, ["role", "text"]).head())


LONG = "the same beginning of every text, whatever its end may be; " * 6


def mixed_rows(n=400):
    for k in range(n):
        yield (k, f"user{k % 9}@example.com" if k % 4 else None, float(k % 37) if k % 5 else None, LONG + str(k % 50) if k % 3 else "short", k % 2 == 0, [k % 3, None])


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return abs(a - b) <= 1e-9 * max(1.0, abs(a))
    if isinstance(a, (list, tuple)) and isinstance(b, (list, tuple)):
        return len(a) == len(b) and all(map(same, a, b))
    return a == b


@pytest.mark.parametrize("added_up_after", [32, 2])
def test_finished_profile_of_a_stream_equals_that_of_the_table(spark, monkeypatch, added_up_after):
    """Files come in two runs, one file per batch; the second run fails once in the middle."""
    monkeypatch.setattr(streams, "ADDED_UP_AFTER", added_up_after)
    df = spark.createDataFrame(list(mixed_rows()), "id long, mail string, x double, body string, even boolean, list array<int>")
    folder, place = session.scratch_path(spark, "stream-source"), session.scratch_path(spark, "stream-profile")
    df.filter("id < 240").repartition(3).write.parquet(folder)

    def stream():
        return streams.read_stream(spark, folder, df.schema, files_per_batch=1)

    kept = streams.StreamProfile.of(stream(), place, row_order="id").run(stream())
    halfway = by_column(kept.profile())
    assert halfway["id"]["count"] == 240
    df.filter("id >= 240").repartition(3).write.mode("append").parquet(folder)
    count, failures = streams.StreamProfile._count, []

    def fails_once(self, batch, number):
        count(self, batch, number)
        if number == 4 and not failures:
            failures.append(number)
            raise OSError("lost after it was written")

    monkeypatch.setattr(streams.StreamProfile, "_count", fails_once)
    with pytest.raises(Exception, match="lost after"):
        kept.run(stream())
    kept.run(stream())
    got, whole = by_column(kept.profile()), by_column(profile(df, row_order="id"))
    for c in df.columns:
        for stat in whole[c].asDict():
            assert same(got[c][stat], whole[c][stat]), (c, stat, got[c][stat], whole[c][stat])
    assert got["mail"]["pii_type"] == "email" and got["body"]["top_values"][1]["value"].startswith(LONG)
    monkeypatch.undo()
    assert kept.run(stream()).profile().exceptAll(kept.profile()).count() == 0


def test_stream_without_an_order_and_without_files(spark):
    df = spark.createDataFrame([(k, None if k % 2 else "v") for k in range(40)], "a long, b string")
    folder = session.scratch_path(spark, "stream-source")
    df.repartition(4).write.parquet(folder)
    stream = streams.read_stream(spark, folder, df.schema, files_per_batch=1)
    got = by_column(streams.StreamProfile.of(stream).run(stream).profile())
    assert (got["b"]["missing"], got["b"]["distinct"], len(got["a"]["sample_values"]), got["a"]["median"]) == (20, 1, 5, 19.5)
    assert streams.StreamProfile.of(stream).profile().count() == 0


def test_tables_as_streams_be_they_files_or_folders(spark, sf):
    """A table of many files used to give a stream without files, and a stream without files used to fail."""
    df = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "role")
    place = session.scratch_path(spark, "stream-tables")
    df.repartition(3).write.parquet(f"{place}/conversations.parquet")
    df.repartition(1).write.parquet(f"{place}/events.parquet")
    whole = tuple(stats.duplicate_rows(df).head())
    for path in (f"{sf}/conversations.parquet", f"{place}/conversations.parquet", f"{place}/events.parquet"):
        stream = streams.read_table(spark, path, files_per_batch=1).select("conv_id", "role")
        assert tuple(stats.duplicate_summary(streams.run_to_table(streams.duplicates_stream(stream), "rows", ["row_digest"])).head()) == whole
    asked = statements.stream_duplicates(spark, place).head()
    assert (asked["total_rows"], asked["duplicate_rows"]) == whole[:2]
    nothing = streams.read_stream(spark, place, df.schema, glob="absent.parquet")
    assert tuple(stats.duplicate_summary(streams.run_to_table(streams.duplicates_stream(nothing), "rows", ["row_digest"])).head())[:2] == (0, 0)
    assert streams.run_to_table(streams.frequency_stream(nothing), "values").count() == 0
