"""Cell predicates, personal-data patterns, small arithmetic."""

import pytest
from pyspark.sql import functions as F

from conftest import rows
from plumbline.functions import numeric, pii, text
from plumbline.operators.frequency import cell_table


def flags(spark, values, fn):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = df.select("v", F.coalesce(fn(text.clean(F.col("v"))), F.lit(False)).alias("f")).collect()
    return {r["v"] for r in got if r["f"]}


def test_missing(spark):
    assert flags(spark, [None, "", " ", "NULL", "n/a", " N/A ", "0", "none", "x"], text.is_missing_text) == {
        None, "", " ", "NULL", "n/a", " N/A "}


def test_numbers(spark):
    values = ["5", "-5", "+7", " 5 ", "5.7", "1e3", ".5", "5.", "1d", "1.5f", "0x1p3", "1_000", "inf", "NaN", "9223372036854775808", "x", ""]
    assert flags(spark, values, text.is_integer_text) == {"5", "-5", "+7", " 5 "}
    assert flags(spark, values, text.is_numeric_text) == {
        "5", "-5", "+7", " 5 ", "5.7", "1e3", ".5", "5.", "inf", "NaN", "9223372036854775808"}


def test_booleans_and_dates(spark):
    assert flags(spark, ["true", "F", "T", "yes", "1"], text.is_boolean_text) == {"true", "F", "T"}
    assert flags(spark, ["2024-01-05", "1/2/2024", "1/2/24", "a-b-c-d-e", "20240105", "café-1é"], text.is_date_text) == {
        "2024-01-05", "1/2/2024", "café-1é"}


@pytest.mark.parametrize("kind,good,bad", [
    ("email", ["a.b@example.com", "see A@B.ORG now"], ["a@b", "nothing"]),
    ("phone number", ["555-123-4567", "(555) 123-4567", "+1 555 123 4567", "5551234567"], ["555-1234"]),
    ("SSN", ["123-45-6789"], ["123-45-67890", "123456789", "x123-45-6789"]),
    ("credit card", ["4111 1111 1111 1111", "4111-1111-1111-1111"], ["4111 1111", "123-45-6789"]),
    ("IP address", ["192.168.1.1"], ["1.2.3"]),
    ("date of birth", ["1985-03-12", "2001/12/31"], ["1885-03-12", "1985-13-12"]),
    ("postal code", ["12345", "12345-6789", "K1A 0B6", "k1a0b6"], ["1234", "KK1 0B6"]),
])
def test_personal_data_patterns(spark, kind, good, bad):
    assert flags(spark, good + bad, lambda c: pii.matches(c, kind)) == set(good)


@pytest.mark.parametrize("name,kind", [
    ("Email", "email"), ("work_e-mail", "email"), ("cell", "phone number"), ("FAX_no", "phone number"),
    ("ssn", "SSN"), ("client_ip", "IP address"), ("ip", "IP address"), ("ip_address", "IP address"), ("zip", "postal code"),
    ("street", "postal code"), ("birth_date", "date of birth"), ("first_name", None), ("filename", None), ("amount", None),
])
def test_name_hints(spark, name, kind):
    assert spark.createDataFrame([(name,)], "c string").select(pii.name_hint(F.col("c"))).head()[0] == kind


def test_report_names(spark):
    got = spark.createDataFrame([("email",), ("FirstName",), ("amount",)], "c string").select("c", pii.is_personal_name(F.col("c")))
    assert rows(got) == [("FirstName", True), ("amount", False), ("email", True)]


def test_arithmetic(spark):
    one = spark.range(1)
    got = one.select(
        numeric.percent_change(F.lit(0.0), F.lit(5.0)), numeric.percent_change(F.lit(-4.0), F.lit(-5.0)),
        numeric.lower_bound(F.lit(-10.0), 0.1), numeric.upper_bound(F.lit(-10.0), 0.1), F.round(F.lit(1.23456789), 6),
        numeric.grouped(F.lit(1234567.5)), numeric.grouped(F.lit(1234567), 0), numeric.fixed(F.lit(2.0), 1), numeric.plain(F.lit(3.0)),
    ).head()
    assert tuple(got) == (None, -25.0, -11.0, -9.0, 1.234568, "1,234,567.5", "1,234,567", "2.0", "3")


def test_cells_are_described_by_compiled_methods_in_small_pieces(spark):
    """Generated methods above 8000 bytes were interpreted: histogram_fixed took 77.7 s for a million rows, 36.1 s now."""
    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
    cells = cell_table(spark.createDataFrame([(k, str(k)) for k in range(100)], "a long, b string").coalesce(1))
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"
    assert cells.source.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
    assert sum(r["n"] for r in cells.df.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()) == 200
