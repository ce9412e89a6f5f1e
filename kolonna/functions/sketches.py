"""Sketches as tables of their own: HyperLogLog unions and intersections, and bottom-k or top-k hash samples."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kolonna.functions.aggregates import LOG2_REGISTERS, hashed
from kolonna.runtime import free_name


#: Parts of a group that are cut down on their own.
PARTS = 64


def _q(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def hll_sketches(df: DataFrame, keys: list[str], column: str, log2_registers: int = LOG2_REGISTERS, is_hash: bool = False) -> DataFrame:
    """The keys and ``sketch``: one HyperLogLog sketch of ``column`` a group. With ``is_hash`` the values are 64-bit hashes already, as by ``xxhash64``."""
    if not 4 <= log2_registers <= 16:
        raise ValueError("log2_registers lies between 4 and 16")
    return df.groupBy(*[_q(k) for k in keys]).agg(F.hll_sketch_agg(_q(column) if is_hash else hashed(_q(column)), log2_registers).alias(free_name("sketch", keys)))


def hll_error(count: int, log2_registers: int = LOG2_REGISTERS) -> float:
    """The absolute standard error of an estimate."""
    return count * 1.04 / math.sqrt(1 << log2_registers)


def hll_intersection(*sketches: Column, log2_registers: int = LOG2_REGISTERS) -> Column:
    """A struct of ``count`` (by inclusion and exclusion over the unions of all choices of the sketches, not below 0), ``error`` and ``resolution``.

    With e the standard error of a union, ``error`` is the root of the sum of all e squared, ``resolution`` the root of the harmonic mean of
    all e squared, which favours the smaller sets. If any union is empty all three are 0. The work doubles with every sketch.
    """
    if not sketches:
        raise ValueError("an intersection takes at least one sketch")
    count, squares, inverse, empty, n = F.lit(0).cast("bigint"), F.lit(0.0), F.lit(0.0), F.lit(False), 0
    for size in range(1, len(sketches) + 1):
        for chosen in combinations(sketches, size):
            union = chosen[0]
            for other in chosen[1:]:
                union = F.hll_union(union, other)
            estimate = F.hll_sketch_estimate(union)
            square = F.pow(estimate * F.lit(hll_error(1, log2_registers)), F.lit(2.0))
            count = count + estimate if size % 2 else count - estimate
            squares, inverse, empty, n = squares + square, inverse + F.try_divide(F.lit(1.0), square), empty | (estimate == 0), n + 1
    error, resolution = F.round(F.sqrt(squares)).cast("bigint"), F.round(F.sqrt(F.try_divide(F.lit(float(n)), inverse))).cast("bigint")
    none = F.lit(0).cast("bigint")
    values = (F.greatest(none, count), error, resolution)
    return F.struct(*[F.when(empty, none).otherwise(v).alias(k) for k, v in zip(("count", "error", "resolution"), values)])


def hash_sample(df: DataFrame, keys: list[str], column: str, capacity: int, greatest: bool = True) -> DataFrame:
    """The keys and ``sample``: the ``capacity`` greatest (or least) different 64-bit hashes of the column's values, in that order.

    Null values are left out. A hot group is first cut down in ``PARTS`` parts by hash, so no task ranks more of it than its part.
    """
    h, rank, sample = (free_name(n, keys) for n in ("h", "rank", "sample"))
    hashes = df.where(_q(column).isNotNull()).select(*[_q(k) for k in keys], F.xxhash64(_q(column)).alias(h)).distinct()
    return _top(hashes, keys, h, rank, sample, capacity, greatest)


def _top(hashes: DataFrame, keys: list[str], h: str, rank: str, sample: str, capacity: int, greatest: bool) -> DataFrame:
    order = F.desc(h) if greatest else F.asc(h)
    by = [_q(k) for k in keys]
    for parts in ([*by, F.pmod(F.xxhash64(h), F.lit(PARTS))], by or [F.lit(0)]):
        hashes = hashes.withColumn(rank, F.row_number().over(Window.partitionBy(*parts).orderBy(order))).where(F.col(rank) <= capacity).drop(rank)
    return hashes.groupBy(*[_q(k) for k in keys]).agg(F.sort_array(F.collect_list(h), asc=not greatest).alias(sample))


def extreme_values(df: DataFrame, keys: list[str], column: str, n: int, greatest: bool = True) -> DataFrame:
    """The keys and ``sample``: the ``n`` greatest (or least) different values of the column, in that order. Null values are left out."""
    h, rank, sample = (free_name(x, keys) for x in ("h", "rank", "sample"))
    values = df.where(_q(column).isNotNull()).select(*[_q(k) for k in keys], _q(column).alias(h)).distinct()
    return _top(values, keys, h, rank, sample, n, greatest)


def merge_samples(samples: DataFrame, keys: list[str], capacity: int, greatest: bool = True) -> DataFrame:
    """Combine samples (the last column) to coarser keys."""
    source = samples.columns[-1]
    h, rank, sample = (free_name(n, keys) for n in ("h", "rank", "sample"))
    hashes = samples.select(*[_q(k) for k in keys], F.explode(_q(source)).alias(h)).distinct()
    return _top(hashes, keys, h, rank, sample, capacity, greatest)


def jaccard(*samples: Column, capacity: int, greatest: bool = True) -> Column:
    """The Jaccard index of samples: exact while none is full, else estimated from the ``capacity`` extreme hashes of the union. Of fewer than two it is 1."""
    if len(samples) < 2:
        return F.lit(1.0)
    union, shared, full = samples[0], samples[0], F.size(samples[0]) >= capacity
    for other in samples[1:]:
        union, shared, full = F.array_union(union, other), F.array_intersect(shared, other), full | (F.size(other) >= capacity)
    top = F.slice(F.sort_array(union, asc=not greatest), 1, capacity)
    exact = F.size(shared) / F.size(union)
    estimate = F.size(F.array_intersect(shared, top)) / F.lit(float(capacity))
    return F.when(F.size(union) == 0, F.lit(0.0)).when(full, estimate).otherwise(exact)
