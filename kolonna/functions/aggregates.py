"""Aggregates: built on Spark's own, with one general fold for functions written in Python."""

from __future__ import annotations

import copy
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column as SparkColumn
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kolonna.expr import Column

#: 2**12 registers: a standard error of 1.625 %.
LOG2_REGISTERS = 12


class Aggregation:
    """A named aggregate of a column. ``build`` maps the Spark column of the values to the Spark aggregate."""

    def __init__(self, function: str, column: Column | None, build: Callable[[SparkColumn], SparkColumn], empty: Any = None) -> None:
        self.function, self.column, self.build, self.empty, self.alias = function, column, build, empty, None

    @property
    def label(self) -> str:
        return f"{self.function}({self.column.label if self.column is not None else ''})"

    @property
    def name(self) -> str:
        return self.alias or self.label

    @property
    def fullname(self) -> str:
        return f"{self.function}({self.column.fullname if self.column is not None else ''})"

    def named(self, alias: str) -> Aggregation:
        other = copy.copy(self)
        other.alias = alias
        return other


class Fold(Aggregation):
    """An aggregate written in Python: ``fold(acc, value)`` over the values of each part of the data, ``merge`` of two
    accumulators, ``finish`` at the end. Each task folds its rows and sends one accumulator a group; memory never depends on the size of a group.
    """

    def __init__(self, function: str, column: Column, kind: T.DataType, start: Callable[[], Any], fold: Callable[[Any, Any], Any], merge: Callable[[Any, Any], Any], finish: Callable[[Any], Any] = lambda acc: acc) -> None:
        super().__init__(function, column, lambda c: c)
        self.kind, self.start, self.fold, self.merge, self.finish = kind, start, fold, merge, finish


class Extremes(Aggregation):
    """The ``capacity`` extreme values of a group as one array: ranked in parts, then together (:mod:`kolonna.functions.sketches`), never gathered.

    Over arrays (``samples``) the extremes of all their elements.
    """

    def __init__(self, function: str, column: Column, kind: T.DataType, capacity: int, greatest: bool, samples: bool) -> None:
        super().__init__(function, column, lambda c: c)
        self.kind, self.capacity, self.greatest, self.samples = kind, capacity, greatest, samples


def h_sum(column: Column) -> Aggregation:
    """Sum; 0 over no rows at all."""
    return Aggregation("sum", column, F.sum, 0)


def h_count() -> Aggregation:
    """Number of rows."""
    return Aggregation("count", None, lambda _: F.count(F.lit(1)), 0)


def h_min(column: Column) -> Aggregation:
    """Least value, of numbers or strings (by code point)."""
    return Aggregation("min", column, F.min)


def h_max(column: Column) -> Aggregation:
    """Greatest value, of numbers or strings (by code point)."""
    return Aggregation("max", column, F.max)


def h_avg(column: Column) -> Aggregation:
    """Mean, as a double."""
    return Aggregation("avg", column, lambda c: F.avg(c).cast("double"))


def h_combine(column: Column, separator: str = ",") -> Aggregation:
    """All values as one string, in their order as strings so that the result is defined. The result is one cell as large as its group: for groups that fit a task."""
    return Aggregation("combine", column, lambda c: F.array_join(F.array_sort(F.collect_list(c.cast("string"))), separator))


def aggregate_expression(function: str, column: Column, build: Callable[[SparkColumn], SparkColumn]) -> Aggregation:
    """A user's aggregate as a Spark expression: stays in the JVM, with partial aggregation."""
    return Aggregation(function, column, build)


def hashed(c: SparkColumn) -> SparkColumn:
    """What a sketch counts: a hash of the value. Spark's own sketch of strings leaves out the empty one, and takes few types."""
    return F.when(c.isNotNull(), F.xxhash64(c))


def _sketch(column: Column, c: SparkColumn) -> SparkColumn:
    return F.hll_union_agg(c) if isinstance(column.field.type, T.BinaryType) else F.hll_sketch_agg(hashed(c), LOG2_REGISTERS)


def h_cardinality(column: Column) -> Aggregation:
    """Estimated number of different values: of a column of sketches their union's, of any other column its own."""
    return Aggregation("cardinality", column, lambda c: F.hll_sketch_estimate(_sketch(column, c)))


def h_union(column: Column) -> Aggregation:
    """The sketch behind :func:`h_cardinality`, to be stored and combined further."""
    return Aggregation("union", column, lambda c: _sketch(column, c))


def h_minhash_merge(column: Column, capacity: int = 65_535) -> Aggregation:
    """Merge sketches of the greatest hashes (arrays of bigint): the ``capacity`` greatest of all."""
    return Extremes("minhash_merge", column, T.LongType(), capacity, True, True)


def h_nlargest(column: Column, n: int) -> Aggregation:
    """The ``n`` greatest different values, as an array from the greatest down."""
    return Extremes("nlargest", column, column.field.type, n, True, False)


def h_nsmallest(column: Column, n: int) -> Aggregation:
    """The ``n`` least different values, as an array from the least up."""
    return Extremes("nsmallest", column, column.field.type, n, False, False)
