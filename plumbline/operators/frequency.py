"""Cells and their frequencies.

Nearly every column statistic is a weighted aggregate of one table that says how
often each column holds each value. It is built with a single scan and a single
shuffle keyed by the value itself, so a value that fills a third of a column is one
partially aggregated row per task, and regular expressions run once per distinct
value instead of once per cell.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline import session
from plumbline.functions import pii, text

#: Pieces a core into which a table of few splits is divided where every cell is described.
CELL_PIECES = 4
#: Texts above this many bytes travel through shuffles as a digest, not in full, with what is told of them.
LONG_TEXT = 256
#: A digest begins with this many characters of its text, which puts it in order.
LEAD = 64
#: What is told of a long text: bits for date, integer, number and each kind of personal data; its length above them.
DATE_BIT, INTEGER_BIT, NUMERIC_BIT, FIRST_KIND_BIT, LENGTH_SHIFT = 1, 2, 4, 8, 16


def kind_of(dtype: T.DataType) -> str:
    """How a typed column is profiled."""
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "integer"
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return "real"
    if isinstance(dtype, T.DecimalType):
        return "decimal"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, T.DateType):
        return "date"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return "timestamp"
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.VariantType)):
        return "container"
    return "text"


def text_of(c: Column, dtype: T.DataType) -> Column:
    """A cell as text; containers as JSON, bytes as hexadecimal digits."""
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(c)
    if isinstance(dtype, T.VariantType):
        return c.cast("string")
    if isinstance(dtype, T.BinaryType):
        return F.hex(c)
    return c.cast("string")


@dataclass(frozen=True)
class ColumnSet:
    """The columns being profiled, by position."""

    names: tuple[str, ...]
    types: tuple[T.DataType, ...]

    @property
    def kinds(self) -> tuple[str, ...]:
        return tuple(kind_of(t) for t in self.types)

    def of_kind(self, *kinds: str) -> list[int]:
        return [i for i, k in enumerate(self.kinds) if k in kinds]

    def among(self, *kinds: str) -> str:
        """SQL condition on ``ordinal`` that holds for the columns of these kinds."""
        wanted = self.of_kind(*kinds)
        if len(wanted) == len(self.names):
            return "true"
        return f"ordinal in ({', '.join(map(str, wanted))})" if wanted else "false"

    @classmethod
    def pick(cls, df: DataFrame, columns: Sequence[str] | None, skip: Sequence[str]) -> ColumnSet:
        wanted = list(columns) if columns is not None else [c for c in df.columns if c not in skip]
        return cls(tuple(wanted), tuple(df.schema[c].dataType for c in wanted))


#: Columns are counted in three lanes, so that numbers are grouped as numbers and not as text.
LANES = {
    "text": ("text", "decimal", "container"),
    "whole": ("integer", "boolean", "date", "timestamp"),
    "real": ("real",),
}
LANE_COLUMNS = {"text": ["short", "facts", "number"], "whole": ["whole"], "real": ["real"]}


def _cell(df: DataFrame, name: str, dtype: T.DataType) -> Column:
    """One cell in the type of its lane; a missing typed cell is null."""
    c = df[text.quoted(name)]
    kind = kind_of(dtype)
    if kind == "integer":
        return c.cast("bigint")
    if kind == "boolean":
        return c.cast("int").cast("bigint")
    if kind == "date":
        return F.unix_date(c).cast("bigint")
    if kind == "timestamp":
        return F.unix_micros(c.cast("timestamp"))
    if kind == "real":
        return c if isinstance(dtype, T.DoubleType) else c.cast("string").cast("double")
    if kind == "decimal":
        return c.cast("string")
    return text_of(c, dtype)


def cells(df: DataFrame, columns: ColumnSet, lane: str, carry: Sequence[str] = ()) -> DataFrame | None:
    """One row per cell of one lane: the carried columns, ``ordinal`` and the lane columns."""
    members = columns.of_kind(*LANES[lane])
    if not members:
        return None
    carried = [text.quoted(c) for c in carry]
    stacked: list[Column] = [F.lit(len(members))]
    for i in members:
        stacked += [F.lit(i), _cell(df, columns.names[i], columns.types[i])]
    if lane != "text":
        return df.select(*carried, F.stack(*stacked).alias("ordinal", *LANE_COLUMNS[lane]))
    # what is told of a text is worked out after stacking, once per cell
    cell = F.col("cell")
    is_long = F.octet_length(cell) > LONG_TEXT
    # a digest no longer shows what its text looked like
    marks = {DATE_BIT: text.is_date_text(cell), INTEGER_BIT: text.is_integer_text(cell), NUMERIC_BIT: text.is_numeric_text(cell)}
    marks |= {FIRST_KIND_BIT << i: pii.matches(cell, kind) for i, kind in enumerate(pii.CONTENT_PATTERNS)}
    facts = F.shiftleft(F.octet_length(cell).cast("bigint"), LENGTH_SHIFT)
    for bit, holds in marks.items():
        facts = facts + F.when(holds, F.lit(bit)).otherwise(F.lit(0))
    trimmed = df.select(*carried, F.stack(*stacked).alias("ordinal", "cell")).select(
        *carried, "ordinal", text.clean_cell(cell).alias("cell")
    )
    return trimmed.select(
        *carried, "ordinal",
        F.when(is_long, digest_of(cell)).when(~text.is_missing_text(cell), cell).alias("short"),
        F.when(is_long, facts).alias("facts"), F.when(is_long, text.number_of_text(cell)).alias("number"),
    )


def describe_values(counted: DataFrame, columns: ColumnSet) -> DataFrame:
    """Turn counted lane columns into text, number, length and type flags.

    Runs on distinct values, not on cells. With so many expressions the whole of a stage can be too large to be compiled.
    """
    session.compiled(counted.sparkSession)
    parts = {"short": "string", "facts": "bigint", "number": "double", "whole": "bigint", "real": "double"}
    have = counted.columns
    gaps = [f"cast(null as {kind}) as {name}" for name, kind in parts.items() if name not in have]
    kept = [c for c in have if c not in parts]
    marks = {k: columns.among(k) for k in ("integer", "decimal", "boolean", "date", "timestamp", "text")}
    # containers are shown as text but not read as numbers or dates
    readable = f"({marks['text']} and short is not null and facts is null)"
    moment = f"({marks['date']} or {marks['timestamp']})"
    flags = {
        "is_integer": (text.INTEGER_SQL, f"({marks['integer']} and whole is not null) or ({marks['text']} and facts & {INTEGER_BIT} <> 0)"),
        "is_numeric": (text.NUMERIC_SQL, f"({marks['integer']} and whole is not null) or real is not null "
                                         f"or ({marks['decimal']} and short is not null) or ({marks['text']} and facts & {NUMERIC_BIT} <> 0)"),
        "is_boolean": (text.BOOLEAN_SQL, f"{marks['boolean']} and whole is not null"),
        "is_date": (text.DATE_SQL, f"({moment} and whole is not null) or ({marks['text']} and facts & {DATE_BIT} <> 0)"),
    }
    first = counted.selectExpr("*", *gaps).selectExpr(
        *[f"`{c}`" for c in kept],
        f"element_at(array({', '.join(_literal(n) for n in columns.names)}), ordinal + 1) as column",
        "(short is null and whole is null and real is null) as missing",
        f"""coalesce(case when facts is null then short end,
            case when {marks['boolean']} then cast(cast(whole as boolean) as string)
                 when {marks['date']} then cast(date_from_unix_date(cast(whole as int)) as string)
                 when {marks['timestamp']} then cast(timestamp_micros(whole) as string)
                 else cast(whole as string) end,
            cast(real as string)) as value""",
        "case when facts is not null then short end as digest",
        f"""coalesce(case when {marks['integer']} then cast(whole as double) end,
            case when {marks['decimal']} then try_cast(short as double)
                 when {readable} then {text.NUMBER_OF_SQL.format(c='short')}
                 when {marks['text']} and facts is not null then number
                 when not isnan(real) and abs(real) <> double('infinity') then real end) as num""",
        *[f"coalesce(case when {readable} then {sql.format(c='short')} else {typed} end, false) as {name}"
          for name, (sql, typed) in flags.items()],
        "facts",
    )
    # each valid cell is counted under one leading type only
    return first.selectExpr(
        *[f"`{c}`" for c in kept], "column", "missing", "value", "digest", "num",
        f"coalesce(shiftright(facts, {LENGTH_SHIFT}), cast(octet_length(value) as bigint)) as bytes", "facts", "is_integer", "is_numeric",
        "is_boolean and not is_numeric as is_boolean",
        "is_date and not is_numeric and not is_boolean as is_date",
    )


def _literal(name: str) -> str:
    escaped = name.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


@dataclass(frozen=True)
class FrequencyTable:
    """``df``: keys, ordinal, column, value, digest, num, bytes, flags, ``n`` and maybe ``first_row``."""

    df: DataFrame
    columns: ColumnSet
    by: str | None = None
    datasets: int | None = field(default=None)
    #: the rows that were counted, for texts that travelled as digests
    source: DataFrame | None = field(default=None, compare=False)
    #: whether equal values are one row; else every cell is a row of its own and nothing was shuffled
    counted: bool = True
    #: those texts themselves (``ordinal, digest, full``), where the rows are gone
    texts: DataFrame | None = field(default=None, compare=False)

    @property
    def keys(self) -> list[str]:
        return ([self.by] if self.by else []) + ["ordinal"]

    @property
    def labelled(self) -> list[str]:
        return [*self.keys, "column"]

    @property
    def max_profiles(self) -> int:
        """Upper bound on the rows of a table with one row per profiled column."""
        return len(self.columns.names) * (self.datasets or 1)

    def with_facts(self, facts: DataFrame, per_profile: int = 1) -> DataFrame:
        """Frequency rows with per-column facts joined on."""
        return session.attach(
            self.df, facts, self.keys, self.max_profiles * per_profile, spread=["value", "digest"]
        )

    @property
    def valid(self) -> DataFrame:
        return self.df.filter(~F.col("missing"))


def frequency(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    by: str | None = None,
    row_order: str | None = None,
    materialized: bool = False,
) -> FrequencyTable:
    """Count every distinct value of every column, per dataset when ``by`` names one.

    ``row_order`` names a column giving the order of rows; each value then keeps the
    first row it was seen in. ``materialized`` writes the table to the shared folder,
    for callers that read it several times.
    """
    picked = ColumnSet.pick(df, columns, [by] if by else [])
    carry = ([by] if by else []) + ([row_order] if row_order and row_order != by else [])
    df = session.spread(df.select(*[text.quoted(c) for c in dict.fromkeys([*carry, *picked.names])]))
    counted = describe_values(count_cells(df, picked, by, row_order), picked)
    if materialized:
        counted = session.materialize(counted, "frequency")
    table = FrequencyTable(counted, picked, by, source=df)
    if by:
        # joins of per-dataset facts are sized by the real number of datasets
        seen = df.select(by).distinct().limit(session.BROADCAST_ROWS + 1).count()
        table = replace(table, datasets=seen)
    return table


def cell_table(df: DataFrame, columns: Sequence[str] | None = None, by: str | None = None) -> FrequencyTable:
    """Every cell as a row with ``n`` = 1, for statistics that need no equal values brought together: counts, types, lengths,
    moments, bins, quantiles. They are sums over rows, partially aggregated where the rows are, and no value is shuffled.
    """
    picked = ColumnSet.pick(df, columns, [by] if by else [])
    df = session.spread(df.select(*[text.quoted(c) for c in dict.fromkeys([*([by] if by else []), *picked.names])]), CELL_PIECES)
    lanes = [raw.withColumn("n", F.lit(1).cast("bigint")) for lane in LANES if (raw := cells(df, picked, lane, [by] if by else [])) is not None]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), lanes)
    table = FrequencyTable(describe_values(stacked, picked), picked, by, source=df, counted=False)
    if by:
        table = replace(table, datasets=df.select(by).distinct().limit(session.BROADCAST_ROWS + 1).count())
    return table


def count_cells(df: DataFrame, picked: ColumnSet, by: str | None = None, row_order: str | None = None) -> DataFrame:
    """How often each column holds each value, as lane columns with ``n`` and maybe ``first_row``. Such counts add up."""
    carry = ([by] if by else []) + ([row_order] if row_order and row_order != by else [])
    lanes = []
    for lane in LANES:
        raw = cells(df, picked, lane, carry)
        if raw is None:
            continue
        wanted = [F.count(F.lit(1)).alias("n")]
        if row_order is not None:
            wanted.append(F.min(row_order).alias("first_row"))
        lanes.append(raw.groupBy(*([by] if by else []), "ordinal", *LANE_COLUMNS[lane]).agg(*wanted))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), lanes)


def add_counts(counts: DataFrame) -> DataFrame:
    """Counts of several parts of a table added up."""
    summed = {"n": F.sum("n").alias("n"), "first_row": F.min("first_row").alias("first_row")}
    return counts.groupBy(*[c for c in counts.columns if c not in summed]).agg(*[v for c, v in summed.items() if c in counts.columns])


def long_texts(df: DataFrame, picked: ColumnSet) -> DataFrame | None:
    """``ordinal, digest, full``: every cell that is counted as a digest, with its text."""
    members = picked.of_kind("text", "container")
    if not members:
        return None
    stacked = [F.lit(len(members))]
    for i in members:
        stacked += [F.lit(i), text.clean(text_of(df[text.quoted(picked.names[i])], picked.types[i]))]
    cells_ = df.select(F.stack(*stacked).alias("ordinal", "full")).filter(F.octet_length("full") > LONG_TEXT)
    return cells_.select("ordinal", digest_of(F.col("full")).alias("digest"), "full")


def digest_of(full: Column) -> Column:
    """What stands for a long text."""
    return F.concat(F.substring(full, 1, LEAD), F.sha2(full, 256))
