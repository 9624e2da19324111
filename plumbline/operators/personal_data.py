"""Which columns and rows hold personal data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import pii, text
from plumbline.operators.frequency import FIRST_KIND_BIT, FrequencyTable, frequency

# Share of hits needed, order of the decision.
SHARE_NEEDED = 0.3
DECISION_ORDER = ("SSN", "credit card", "email", "phone number", "IP address")


def detect(df: DataFrame, columns: list[str], by: str | None = None) -> DataFrame:
    """Kind of personal data per column (and dataset): content of all valid cells first, then the name."""
    return detect_values(frequency(df, columns, by))


def detect_values(ft: FrequencyTable) -> DataFrame:
    """The same from a frequency table: patterns run once per distinct value."""
    kinds = list(pii.CONTENT_PATTERNS)
    tags = {k: "hits_" + k.lower().replace(" ", "_") for k in kinds}

    def hit(i: int, kind: str) -> Column:
        told = F.col("facts").bitwiseAND(F.lit(FIRST_KIND_BIT << i)) != 0
        return F.when(F.col("facts").isNotNull(), told).otherwise(pii.matches(F.col("value"), kind))

    hits = ft.valid.groupBy(*ft.labelled).agg(
        F.sum("n").alias("looked_at"),
        *[F.coalesce(F.sum(F.when(hit(i, k), F.col("n"))), F.lit(0)).alias(tags[k]) for i, k in enumerate(kinds)],
    )
    needed = F.greatest(F.floor(F.col("looked_at") * SHARE_NEEDED), F.lit(1))
    hint = pii.name_hint(F.col("column"))
    birth_needed = F.when(hint == "date of birth", F.greatest(F.floor(needed / 2), F.lit(1))).otherwise(needed)
    found = F.coalesce(
        *[F.when(F.col(tags[k]) >= needed, F.lit(k)) for k in DECISION_ORDER],
        F.when(F.col(tags["date of birth"]) >= birth_needed, F.lit("date of birth")),
        F.when((F.col(tags["postal code"]) >= needed) & (hint == "postal code"), F.lit("postal code")),
        hint,
    )
    return hits.withColumn("pii_type", found)


def rows_with(df: DataFrame, key: str, column: str, kinds: list[str] | None = None) -> DataFrame:
    """Rows whose cell contains personal data, one output row per kind found."""
    kinds = kinds or list(pii.CONTENT_PATTERNS)
    cell = text.clean(df[column].cast("string"))
    found = F.array_compact(F.array(*[F.when(pii.matches(F.col("_cell"), k), F.lit(k)) for k in kinds]))
    return df.select(key, cell.alias("_cell")).select(key, F.explode(found).alias("pii_type"))
