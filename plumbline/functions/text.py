"""What a text cell is: missing, integer, numeric, boolean or date."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points with the Unicode White_Space property.
WHITESPACE = (
    "\u0009\u000a\u000b\u000c\u000d\u0020\u0085\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Texts that stand for a missing cell, and for a boolean (lower case).
MISSING_TEXTS = ("", "null", "n/a")
BOOLEAN_TEXTS = ("true", "false", "t", "f")

INTEGER_PATTERN = r"^[+-]?[0-9]+$"
NUMBER_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
NON_FINITE_PATTERN = r"^[+-]?(inf|infinity|nan)$"


def quoted(name: str) -> str:
    """A column name that may hold dots, written as one reference."""
    return "`" + name.replace("`", "``") + "`"


def clean(c: Column) -> Column:
    """Strip Unicode whitespace from both ends."""
    return F.btrim(c, F.lit(WHITESPACE))


def clean_cell(c: Column) -> Column:
    """The same for a plain column: texts that start and end with a visible ASCII character stay as they are."""
    def visible(end: Column) -> Column:
        return F.ascii(end).between(33, 126)

    return F.when(visible(c) & visible(F.substring(c, -1, 1)), c).otherwise(clean(c))


def is_missing_text(cleaned: Column) -> Column:
    return cleaned.isNull() | F.lower(cleaned).isin(*MISSING_TEXTS)


def missing_predicate(c: Column) -> Column:
    """Null, or a text cell that only says it is empty."""
    return is_missing_text(clean(c.cast("string")))


# The predicates below once more as SQL over {c}, for plans with many of them. The patterns
# keep out what a bare cast would let in.
INTEGER_SQL = f"({{c}} rlike r'{INTEGER_PATTERN}' and try_cast({{c}} as bigint) is not null)"
NUMERIC_SQL = f"({{c}} rlike r'{NUMBER_PATTERN}' or lower({{c}}) rlike r'{NON_FINITE_PATTERN}')"
BOOLEAN_SQL = f"lower({{c}}) in ({', '.join(repr(t) for t in BOOLEAN_TEXTS)})"
# a separator, a digit and at least eight bytes
DATE_SQL = "({c} rlike '[-/]' and octet_length({c}) >= 8 and {c} rlike '[0-9]')"
_CAST_SQL = f"case when {{c}} rlike r'{NUMBER_PATTERN}' then try_cast({{c}} as double) end"
NUMBER_OF_SQL = f"nullif({_CAST_SQL}, case when {{c}} like '-%' then -double('infinity') else double('infinity') end)"


def is_integer_text(cleaned: Column) -> Column:
    """Parses as a 64-bit integer."""
    return cleaned.rlike(INTEGER_PATTERN) & cleaned.try_cast("bigint").isNotNull()


def is_numeric_text(cleaned: Column) -> Column:
    return cleaned.rlike(NUMBER_PATTERN) | F.lower(cleaned).rlike(NON_FINITE_PATTERN)


def number_of_text(cleaned: Column) -> Column:
    """The finite number a cell holds, else null."""
    return finite(F.when(cleaned.rlike(NUMBER_PATTERN), cleaned.try_cast("double")))


def is_boolean_text(cleaned: Column) -> Column:
    return F.lower(cleaned).isin(*BOOLEAN_TEXTS)


def is_date_text(cleaned: Column) -> Column:
    """Looks like a date: a separator, a digit and at least eight bytes."""
    return cleaned.rlike("[-/]") & (F.octet_length(cleaned) >= 8) & cleaned.rlike("[0-9]")


def finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)
