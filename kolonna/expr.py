"""Columns and boolean expressions of the query language; both are recipes for Spark columns."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import replace
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kolonna.schema import Field

if TYPE_CHECKING:
    from kolonna.table import Table

#: Gives the Spark column of a field's name.
Lookup = Callable[[str], SparkColumn]


class Column:
    """A field of a table, perhaps under a function, perhaps renamed."""

    def __init__(self, table: Table, field: Field, source: str | None = None, functions: tuple[tuple[str, Callable[[SparkColumn], SparkColumn]], ...] = (), alias: str | None = None) -> None:
        self.table, self.field, self.source, self.functions, self.alias = table, field, source or field.name, functions, alias

    @property
    def label(self) -> str:
        """The name without its table: ``x``, or ``fn(x)``."""
        name = self.source
        for function, _ in self.functions:
            name = f"{function}({name})"
        return name

    @property
    def name(self) -> str:
        return self.alias or self.label

    @property
    def fullname(self) -> str:
        return f"{self.table._name}.{self.label}"

    @property
    def tables(self) -> list[Table]:
        return [self.table]

    def named(self, alias: str) -> Column:
        """The same column under another name in results."""
        return Column(self.table, self.field, self.source, self.functions, alias)

    def under(self, name: str, function: Callable[[SparkColumn], SparkColumn], field: Field) -> Column:
        """The column with ``function`` applied; ``field`` describes the outcome."""
        return Column(self.table, field, self.source, (*self.functions, (name, function)), self.alias)

    def spark(self, lookup: Lookup) -> SparkColumn:
        column = lookup(self.source)
        for _, function in self.functions:
            column = function(column)
        return column

    def _check(self, ranged: bool) -> None:
        f = self.field
        if f.derived:
            return
        if ranged and not f.partition and f.kind in ("trie", "lz4", "binary"):
            raise TypeError(f"column {self.fullname} of kind {f.kind} has no order to compare by")
        if not f.index:
            raise TypeError(f"column {self.fullname} is not indexed and can not stand in a condition")

    def _compare(self, op: str, other: object) -> Predicate:
        self._check(op in ("<", "<=", ">", ">="))
        if isinstance(other, (Column, SparkColumn)):
            raise TypeError("the right side of a comparison is a value")
        value = _literal(self.field, other)
        make: dict[str, Callable[[SparkColumn], SparkColumn]] = {"==": lambda c: c == value, "!=": lambda c: c != value, "<": lambda c: c < value, "<=": lambda c: c <= value, ">": lambda c: c > value, ">=": lambda c: c >= value}
        return Comparison(self, make[op], f"{self.fullname} {op} {other!r}")

    def __eq__(self, other: object) -> Predicate:  # type: ignore[override]
        return self._compare("==", other)

    def __ne__(self, other: object) -> Predicate:  # type: ignore[override]
        return self._compare("!=", other)

    def __lt__(self, other: object) -> Predicate:
        return self._compare("<", other)

    def __le__(self, other: object) -> Predicate:
        return self._compare("<=", other)

    def __gt__(self, other: object) -> Predicate:
        return self._compare(">", other)

    def __ge__(self, other: object) -> Predicate:
        return self._compare(">=", other)

    def __lshift__(self, other: Iterable) -> Predicate:
        """In: one of the values, or of the first column of a query's result."""
        self._check(False)
        return Membership(self, other, False)

    def __rshift__(self, other: Iterable) -> Predicate:
        """Not in."""
        self._check(False)
        return Membership(self, other, True)

    __hash__ = object.__hash__

    def __repr__(self) -> str:
        return f"<column {self.fullname}>"


def _literal(field: Field, value: object) -> Any:
    if isinstance(value, bool) and (field.kind in ("bit", "int", "uint")):
        return int(value)
    if field.partition and not isinstance(value, str):
        return str(value)  # partition values are strings
    return value


class Predicate:
    """A boolean expression over the columns of one table."""

    table: Table

    def __and__(self, other: Predicate) -> Predicate:
        return Both(self, other)

    def __or__(self, other: Predicate) -> Predicate:
        return Either(self, other)

    def __invert__(self) -> Predicate:
        return Negation(self)

    def __bool__(self) -> bool:
        raise TypeError("combine conditions with &, | and ~")

    @property
    def partition_only(self) -> bool:
        """Whether partition values alone decide it."""
        raise NotImplementedError

    def spark(self, lookup: Lookup) -> SparkColumn:
        raise NotImplementedError

    def restrict(self, frame: DataFrame, lookup: Lookup) -> DataFrame:
        """The rows of ``frame`` that satisfy it."""
        return frame.where(self.spark(lookup))

    @property
    def name(self) -> str:
        return self.table._name


class Comparison(Predicate):
    def __init__(self, column: Column, make: Callable[[SparkColumn], SparkColumn], text: str) -> None:
        self.table, self.column, self.make, self.text = column.table, column, make, text

    @property
    def partition_only(self) -> bool:
        return self.column.field.partition

    def spark(self, lookup: Lookup) -> SparkColumn:
        return self.make(self.column.spark(lookup))

    def __repr__(self) -> str:
        return self.text


class Membership(Predicate):
    """In or not in: a list of values, or the first column of another query."""

    def __init__(self, column: Column, values: Iterable, absent: bool) -> None:
        self.table, self.column, self.absent = column.table, column, absent
        frame = values if isinstance(values, DataFrame) else getattr(values, "frame", None)
        self.frame: DataFrame | None = frame
        if frame is None:
            if isinstance(values, (str, bytes)) or not hasattr(values, "__iter__"):
                raise ValueError("in and not in take an iterable of values, not a single one")
            firsts = [v[0] if isinstance(v, tuple) else v for v in values]
            self.values = list(dict.fromkeys(_literal(column.field, v) for v in firsts))

    @property
    def partition_only(self) -> bool:
        return self.column.field.partition and self.frame is None

    def spark(self, lookup: Lookup) -> SparkColumn:
        column = self.column.spark(lookup)
        if self.frame is not None:
            # inside a larger condition: Catalyst turns this into an existence join
            inside = F.coalesce(column.isin(self._other()), F.lit(False))
        elif self.values:
            inside = column.isin(self.values)
        else:
            inside = F.lit(False)
        # a null is neither in nor not in anything, as in any comparison
        inside = F.when(column.isNotNull(), inside) if self.frame is not None or not self.values else inside
        return ~inside if self.absent else inside

    def _other(self) -> DataFrame:
        first = F.col("`" + self.frame.columns[0].replace("`", "``") + "`")
        return self.frame.select(first.alias("_member")).where(F.col("_member").isNotNull())

    def restrict(self, frame: DataFrame, lookup: Lookup) -> DataFrame:
        if self.frame is None:
            return super().restrict(frame, lookup)
        # standing alone: a plain semi or anti join, which needs no broadcast
        if self.absent:
            frame = frame.where(self.column.spark(lookup).isNotNull())
        return frame.join(self._other(), self.column.spark(lookup) == F.col("_member"), "left_anti" if self.absent else "left_semi")

    def __repr__(self) -> str:
        return f"{self.column.fullname} {'not in' if self.absent else 'in'} {'a query' if self.frame is not None else self.values}"


class _Combined(Predicate):
    def __init__(self, left: Predicate, right: Predicate) -> None:
        for side in (left, right):
            if not isinstance(side, Predicate):
                raise TypeError(f"{side!r} is not a condition")
        if left.table is not right.table and left.table._name != right.table._name:
            raise ValueError(f"a condition speaks of one table, not of {left.table._name} and {right.table._name}")
        self.table, self.left, self.right = left.table, left, right

    @property
    def partition_only(self) -> bool:
        return self.left.partition_only and self.right.partition_only


class Both(_Combined):
    def spark(self, lookup: Lookup) -> SparkColumn:
        return self.left.spark(lookup) & self.right.spark(lookup)

    def restrict(self, frame: DataFrame, lookup: Lookup) -> DataFrame:
        return self.right.restrict(self.left.restrict(frame, lookup), lookup)


class Either(_Combined):
    def spark(self, lookup: Lookup) -> SparkColumn:
        return self.left.spark(lookup) | self.right.spark(lookup)


class Negation(Predicate):
    def __init__(self, inner: Predicate) -> None:
        self.table, self.inner = inner.table, inner

    @property
    def partition_only(self) -> bool:
        return self.inner.partition_only

    def spark(self, lookup: Lookup) -> SparkColumn:
        return ~self.inner.spark(lookup)

    def restrict(self, frame: DataFrame, lookup: Lookup) -> DataFrame:
        if isinstance(self.inner, Membership):
            turned = Membership.__new__(Membership)
            turned.__dict__ = self.inner.__dict__ | {"absent": not self.inner.absent}
            return turned.restrict(frame, lookup)
        return super().restrict(frame, lookup)


def function_field(column: Column, kind: T.DataType | None) -> Field:
    """The field of a function's outcome: its own type, else the argument's; indexed as the argument is."""
    f = column.field
    if kind is None:
        return replace(f, partition=False)
    made = {T.StringType: ("string", 0), T.ByteType: ("int", 8), T.ShortType: ("int", 16), T.IntegerType: ("int", 32), T.LongType: ("int", 64)}.get(type(kind), (kind.simpleString(), 0))
    return Field(f.name, made[0], made[1], f.index or "index", derived=f.derived, spark_type=kind)
