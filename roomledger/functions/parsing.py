"""Casts and date parts that turn bad text into NULL instead of an error."""

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roomledger.schemas import MONTH_NAMES


def _named(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


# What text must look like to have a chance; anything else is not worth a failed conversion.
_PLAUSIBLE = {
    "int": r"^\s*[+-]?[0-9]+\s*$",
    "bigint": r"^\s*[+-]?[0-9]+\s*$",
    "decimal": "[0-9]",
    "date": "[0-9]",
    "timestamp": "[0-9]",
}


def soft_cast(col, to: str, source: str | None = None) -> Column:
    """Cast, NULL when the value does not fit the type.

    ``source`` is the column's type when known. A cast that fails inside Spark costs an exception per
    row, some twenty microseconds, so text is first matched against what the type can look like;
    a column full of NA is then as cheap as any other.
    """
    value = _named(col)
    cast = value.try_cast(to)
    pattern = _PLAUSIBLE.get(to.split("(")[0]) if source == "string" else None
    return cast if pattern is None else F.when(value.rlike(pattern), cast)


def int_or_zero(col, source: str | None = None) -> Column:
    """Integer, 0 when absent or unreadable."""
    return F.coalesce(soft_cast(col, "int", source), F.lit(0))


def month_number(col) -> Column:
    """English month name to 1..12, NULL for any other text."""
    names = F.array(*[F.lit(name) for name in MONTH_NAMES])
    return F.nullif(F.array_position(names, _named(col)).cast("int"), F.lit(0))


def date_from_parts(year, month, day) -> Column:
    """Date from three integers, NULL for a day the month does not have.

    Arithmetic on the first of the month stays in generated code; a text pattern would build a
    string and run a parser for every row.
    """
    year, month, day = _named(year), _named(month), _named(day)
    in_range = year.between(1, 9999) & month.between(1, 12) & day.between(1, 31)
    candidate = F.when(in_range, F.date_add(F.make_date(year, month, F.lit(1)), day - 1))
    return F.when(F.month(candidate) == month, candidate)


def as_number(column: Column, kind: T.DataType) -> Column:
    """A double in the order of the values: numbers, dates as days and instants as seconds since 1970-01-01."""
    if isinstance(kind, T.DateType):
        return F.unix_date(column).cast("double")
    if isinstance(kind, T.TimestampNTZType):
        column = F.unix_micros(F.to_timestamp(F.concat(column.cast("string"), F.lit("+00:00")))) / 1_000_000
    return column.cast("double")
