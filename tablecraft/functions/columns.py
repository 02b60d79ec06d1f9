"""Schema helpers and null-safe column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters removed by a Unicode-aware strip.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

NUMBER_PATTERN = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"

# Accepted date spellings: year first, or month/day/year, each with an optional time part.
YEAR_FIRST = r"^([0-9]{4})[-/.]([0-9]{1,2})[-/.]([0-9]{1,2})([ T][0-9].*)?$"
MONTH_FIRST = r"^([0-9]{1,2})[-/.]([0-9]{1,2})[-/.]([0-9]{4})([ T][0-9].*)?$"
NAMED_MONTHS = (
    ("MMM d, yyyy", r"^[A-Z][a-z]{2} [0-9]{1,2}, [0-9]{4}$"),
    ("d MMM yyyy", r"^[0-9]{1,2} [A-Z][a-z]{2} [0-9]{4}$"),
)


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quote(name))


def numeric_cols(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def string_cols(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def datetime_cols(df: DataFrame) -> list[str]:
    kinds = (T.DateType, T.TimestampType, T.TimestampNTZType)
    return [f.name for f in df.schema if isinstance(f.dataType, kinds)]


def is_floating(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def present(df: DataFrame, name: str) -> Column:
    """The column with NaN turned into NULL, so every aggregate sees one kind of missing value."""
    c = col(name)
    return F.when(~F.isnan(c), c) if is_floating(df.schema[name].dataType) else c


def number(df: DataFrame, name: str) -> Column:
    """The column as double; text that is no number becomes NULL."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.StringType):
        text = F.btrim(col(name), F.lit(WHITESPACE))
        return F.when(text.rlike(NUMBER_PATTERN), text.try_cast("double"))
    if isinstance(dtype, (T.NumericType, T.BooleanType)):
        return present(df, name).cast("double")
    return F.lit(None).cast("double")


def filled_number(df: DataFrame, name: str) -> Column:
    return F.coalesce(number(df, name), F.lit(0.0))


def strip(c: Column) -> Column:
    """Whitespace trimmed at both ends; the literal text nan is a missing value."""
    return F.nullif(F.btrim(c, F.lit(WHITESPACE)), F.lit("nan"))


def moment(df: DataFrame, name: str) -> Column:
    """A date, timestamp or date-like text column as TIMESTAMP_NTZ, NULL where unparseable."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.StringType):
        return parse_moment(col(name))
    return col(name).cast("timestamp_ntz")


def parse_moment(c: Column) -> Column:
    text = F.btrim(c, F.lit(WHITESPACE))
    iso = F.when(text.rlike(YEAR_FIRST), F.regexp_replace(text, YEAR_FIRST, "$1-$2-$3$4")).when(
        text.rlike(MONTH_FIRST), F.regexp_replace(text, MONTH_FIRST, "$3-$1-$2$4")
    )
    named = [F.when(text.rlike(p), F.try_to_timestamp(text, F.lit(f))).cast("timestamp_ntz") for f, p in NAMED_MONTHS]
    return F.coalesce(iso.try_cast("timestamp_ntz"), *named)


def add_columns(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """Append columns (or replace same-named ones in place) in a single projection."""
    kept = [new[c].alias(c) if c in new else col(c) for c in df.columns]
    return df.select(*kept, *[e.alias(n) for n, e in new.items() if n not in df.columns])
