"""Functions on columns: results are columns again, usable in projections, conditions, join keys, groupings and aggregates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column as SparkColumn
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kolonna.expr import Column, function_field

#: What the date and address functions give for values they can not read.
NO_DATE, NO_ADDRESS, NO_NUMBER = -1, "0.0.0.0", 0


def column_function(kind: T.DataType | None = None, name: str | None = None, native: bool = True) -> Callable[[Callable], Callable[[Column], Column]]:
    """Make a function on columns of a function on values.

    With ``native`` it maps a Spark column to a Spark column and runs in the JVM. Without, it maps a pandas Series to one (a vectorised
    UDF over Arrow batches), for what built-in expressions can not say. ``kind`` is the type of the outcome, by default that of the argument.
    """

    def make(f: Callable) -> Callable[[Column], Column]:
        label = name or f.__name__

        def apply(column: Column) -> Column:
            if native:
                run = f
            else:
                import pandas as pd

                def call(values):
                    return f(values)

                call.__annotations__ = {"values": pd.Series, "return": pd.Series}
                run = F.pandas_udf(call, kind or column.field.type)
            return column.under(label, run, function_field(column, kind))

        apply.__name__, apply.__doc__ = label, f.__doc__
        return apply

    return make


@column_function(T.StringType())
def ip_ntoa(c: SparkColumn) -> SparkColumn:
    """The dotted form of an unsigned 32-bit address; ``0.0.0.0`` for anything else."""
    n = c.cast("bigint")
    parts = [F.shiftright(n, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)]
    return F.when(n.between(0, 0xFFFFFFFF), F.concat_ws(".", *parts)).otherwise(NO_ADDRESS)


def _number(part: SparkColumn) -> SparkColumn:
    """One part of an address: decimal, octal (0…) or hexadecimal (0x…)."""
    lower = F.lower(part)
    plain = F.when(lower.rlike("^(0|[1-9][0-9]{0,9})$"), lower.try_cast("bigint"))
    octal = F.when(lower.rlike("^0[0-7]{1,11}$"), F.conv(lower, 8, 10).try_cast("bigint"))
    hexed = F.when(lower.rlike("^0x[0-9a-f]{1,8}$"), F.conv(F.substring(lower, 3, 8), 16, 10).try_cast("bigint"))
    return F.coalesce(plain, octal, hexed)


@column_function(T.LongType())
def ip_aton(c: SparkColumn) -> SparkColumn:
    """The number of an address of one to four parts, the last of which fills the remaining bytes; 0 if it is none."""
    parts = F.split(c, r"\.")
    numbers = [_number(F.get(parts, F.lit(i))) for i in range(4)]
    total = F.lit(None).cast("bigint")
    for count in (4, 3, 2, 1):
        value, good = F.lit(0).cast("bigint"), F.size(parts) == count
        for i in range(count):
            last = i == count - 1
            good = good & (numbers[i] <= ((1 << (8 * (5 - count))) - 1 if last else 255))
            value = value + numbers[i] * F.lit(1 if last else 1 << (8 * (3 - i)))
        total = F.coalesce(total, F.when(good, value))
    return F.coalesce(total, F.lit(NO_NUMBER).cast("bigint"))


def _part(text: SparkColumn, kind: str) -> SparkColumn:
    return F.coalesce(text.try_cast(kind), F.lit(NO_DATE).cast(kind))


@column_function(T.ShortType())
def year(c: SparkColumn) -> SparkColumn:
    """The year of ``YYYY-MM-DD``; -1 if it has none."""
    return _part(F.substring(c, 1, 4), "smallint")


@column_function(T.ByteType())
def month(c: SparkColumn) -> SparkColumn:
    """The month of ``YYYY-MM-DD``; -1 if it has none."""
    return _part(F.substring(c, 6, 2), "tinyint")


@column_function(T.ByteType())
def day(c: SparkColumn) -> SparkColumn:
    """The day, from the last two characters; -1 if it has none."""
    return _part(F.substring(c, -2, 2), "tinyint")
