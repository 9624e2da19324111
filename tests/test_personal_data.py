from pyspark.sql import functions as F

from conftest import by_column
from plumbline.operators import personal_data


def test_all_cells_decide(spark):
    """Addresses count wherever they are, also in long texts and from row 101 on."""
    long = "word " * 80
    df = spark.range(150).select(
        F.col("id"), F.when(F.col("id") < 100, F.concat(F.lit("u"), "id", F.lit("@example.com"))).otherwise("x").alias("note"),
        F.when(F.col("id") >= 100, F.lit("192.168.0.1")).otherwise("none").alias("late"),
        F.when(F.col("id") >= 120, F.lit("10.0.0.7")).alias("sparse"),
        F.concat(F.lit(long), F.when(F.col("id") % 2 == 0, F.lit("a@example.com ")).otherwise("x"), "id").alias("essay"),
    )
    got = by_column(personal_data.detect(df, ["note", "late", "sparse", "essay"]))
    assert got["note"]["pii_type"] == "email" and got["note"]["looked_at"] == 150
    assert got["late"]["pii_type"] == "IP address" and got["late"]["looked_at"] == 150
    assert got["sparse"]["pii_type"] == "IP address" and got["sparse"]["looked_at"] == 30
    assert got["essay"]["pii_type"] == "email"
    again = personal_data.detect(df.withColumn("half", F.col("id") < 60), ["late"], by="half")
    assert {r["half"]: r["pii_type"] for r in again.collect()} == {True: None, False: "IP address"}


def test_order_of_decision(spark):
    df = spark.createDataFrame([(i, "123-45-6789", "1985-03-12", "12345", "4111 1111 1111 1111") for i in range(5)],
                               "id int, a string, b string, zip string, c string")
    got = {c: r["pii_type"] for c, r in by_column(personal_data.detect(df, ["a", "b", "zip", "c"])).items()}
    assert got == {"a": "SSN", "b": "date of birth", "zip": "postal code", "c": "credit card"}
