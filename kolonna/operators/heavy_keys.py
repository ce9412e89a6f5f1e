"""Results for every key with the work spread evenly, however few keys hold most rows.

Rows are range-partitioned on (keys, order, a tie-breaker) with sampled quantiles as bounds, so the range of a heavy key is cut into
as many partitions as its size asks for. Each partition folds its sorted stream into one partial state a key. A key that does not
touch an end of its partition is complete there; only the first and the last key of a partition can go on elsewhere, and these at
most two states a partition are stitched together in partition order by one small aggregation.

Before the range shuffle each task combines rows that agree in keys and order, so heavy keys with few order values hardly travel. These rows
are written to the shared folder: their quantiles are sampled there, so the source is read once. So are the partial states, which both
kinds of keys are taken from.

Defined results: a null key is a key; a row with a null order value counts in ``n_rows`` and the value statistics and in no order
statistic; null and NaN values are not counted; an empty table gives no rows; ties and repeated rows all count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from kolonna.runtime import chunks, fold_sorted, free_name, materialize, shuffle_partitions

#: Rows that a task holds at once.
CHUNK = 1 << 19
#: The state of a key: rows, non-null values, their sum, least and largest; first and last order value, runs of equal order, sessions.
STATE = ("n_rows", "n_values", "sum_value", "min_value", "max_value", "first_order", "last_order", "n_orders", "n_sessions")
EDGE, PLACE, TIE = "_edge", "_place", "_tie"


def _q(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _combine(table: pa.Table, keys: list[str], names: list[str], gap: float | None, adjacent: bool) -> pa.Table:
    """Merge neighbouring rows of equal keys (and, before the shuffle, equal order) of a table of states."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    n, values, total, low, high, first, last, orders, sessions = names
    rows = table.num_rows
    change = np.zeros(rows, bool)
    change[0] = True
    codes = {}
    for key in [*keys, first, last]:
        column = table.column(key).combine_chunks()
        codes[key] = column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        if key not in (first, last):
            change[1:] |= codes[key][1:] != codes[key][:-1]
    start = np.flatnonzero(change)
    run = np.cumsum(change) - 1
    end = np.r_[start[1:], rows] - 1
    out = {k: table.column(k).combine_chunks().take(pa.array(start)) for k in keys}

    def summed(name: str) -> np.ndarray:
        return np.add.reduceat(pc.fill_null(table.column(name).combine_chunks(), 0).to_numpy(zero_copy_only=False), start)

    grouped = pa.table({"r": run, low: table.column(low), high: table.column(high)}).group_by("r", use_threads=False).aggregate([(low, "min"), (high, "max")]).sort_by("r")
    # rows without order come first in their key, so the first row that has one starts at the first non-null place
    has = pc.is_valid(table.column(first).combine_chunks()).to_numpy(zero_copy_only=False)
    at = np.where(has, np.arange(rows), rows)
    begin = np.minimum.reduceat(at, start)
    some = begin < rows
    pick = pa.array(np.where(some, begin, 0), mask=~some)
    same = np.zeros(rows, bool)
    if rows > 1:
        whole = pa.chunked_array([table.column(last).combine_chunks().slice(0, rows - 1)])
        follows = table.column(first).combine_chunks().slice(1)
        same[1:] = pc.fill_null(pc.equal(whole, follows), False).to_numpy() & ~change[1:]
    near = np.zeros(rows, bool)
    if gap is not None and rows > 1:
        step = pc.subtract(pc.cast(table.column(first).combine_chunks().slice(1), pa.float64()), pc.cast(table.column(last).combine_chunks().slice(0, rows - 1), pa.float64()))
        near[1:] = pc.fill_null(pc.less_equal(step, gap), False).to_numpy(zero_copy_only=False) & ~change[1:]
    out |= {
        n: pa.array(summed(n)), values: pa.array(summed(values)), total: pa.array(summed(total), mask=summed(values) == 0),
        low: grouped.column(f"{low}_min"), high: grouped.column(f"{high}_max"),
        first: table.column(first).combine_chunks().take(pick), last: table.column(last).combine_chunks().take(pa.array(np.where(some, end, 0), mask=~some)),
        orders: pa.array(summed(orders) - np.add.reduceat(same.astype(np.int64), start)), sessions: pa.array(summed(sessions) - np.add.reduceat(near.astype(np.int64), start)),
    }
    return pa.table(out)


def keyed_aggregate(df: DataFrame, keys: list[str], order: str, value: str | None = None, gap: float | None = None, partitions: int | None = None) -> DataFrame:
    """One row a key: the keys (at least one) and the STATE columns.

    ``order`` is the secondary order (any sortable type; numeric where ``gap`` is given): ``n_orders`` counts its different values,
    ``n_sessions`` the runs of rows in which no step is longer than ``gap`` (null without ``gap``). ``value`` is numeric. A key named
    like a state column keeps its name; the state column then gets a trailing underscore.
    """
    spark = df.sparkSession
    names = [free_name(n, keys) for n in STATE]
    n, values, total, low, high, first, last, orders, sessions = names
    whole = value is None or isinstance(df.schema[value].dataType, T.IntegralType)
    kind = T.LongType() if whole else T.DoubleType()
    number = F.lit(None).cast(kind) if value is None else _q(value).cast(kind)
    if not whole:
        number = F.when(~F.isnan(number), number)
    edge, place, tie = (free_name(x, [*keys, *names]) for x in (EDGE, PLACE, TIE))
    counted = number.isNotNull().cast("long")
    ordered = _q(order).isNotNull().cast("long")
    if isinstance(df.schema[order].dataType, (T.FloatType, T.DoubleType)):
        order_value = F.when(~F.isnan(_q(order)), _q(order))
    else:
        order_value = _q(order)
    raw = df.select(*[_q(k) for k in keys], F.lit(1).cast("long").alias(n), counted.alias(values), number.alias(total), number.alias(low), number.alias(high), order_value.alias(first), order_value.alias(last), ordered.alias(orders), ordered.alias(sessions))
    fields = [T.StructField(k, raw.schema[k].dataType) for k in keys] + [T.StructField(x, raw.schema[x].dataType) for x in names]
    state = T.StructType(fields)
    tied = T.StructType([*fields, T.StructField(tie, T.LongType())])
    placed = T.StructType([*fields, T.StructField(edge, T.BooleanType()), T.StructField(place, T.IntegerType())])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Combine rows that agree in keys and order, chunk by chunk."""
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        out, here, count = to_arrow_schema(tied), TaskContext.get().partitionId() << 40, 0
        for table in chunks(batches, CHUNK):
            order_by = [*keys, first]
            if not any(pa.types.is_nested(table.schema.field(k).type) for k in order_by):
                sums = table.group_by(order_by, use_threads=False).aggregate([(n, "sum"), (values, "sum"), (total, "sum"), (low, "min"), (high, "max"), (orders, "max"), (sessions, "max")])
                table = pa.table([sums.column(k) for k in keys] + [sums.column(f"{n}_sum"), sums.column(f"{values}_sum"), sums.column(f"{total}_sum"), sums.column(f"{low}_min"), sums.column(f"{high}_max"), sums.column(first), sums.column(first), sums.column(f"{orders}_max"), sums.column(f"{sessions}_max")], names=[*keys, *names])
            ties = pa.array(np.arange(here + count, here + count + table.num_rows))
            count += table.num_rows
            yield from table.append_column(tie, ties).cast(out).to_batches()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One state a key of this partition; the first and the last are marked."""
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        slim, out, here = to_arrow_schema(state), to_arrow_schema(placed), TaskContext.get().partitionId()
        held, begun = None, False
        for table in fold_sorted((b.select(slim.names) for b in batches), lambda t: _combine(t, keys, names, gap, True).cast(slim), CHUNK):
            if held is not None:
                yield from mark(held, begun, False, here, out)
                begun = True
            held = table
        if held is not None:
            yield from mark(held, begun, True, here, out)

    def mark(table: pa.Table, begun: bool, ends: bool, here: int, out: pa.Schema) -> list[pa.RecordBatch]:
        flags = np.zeros(table.num_rows, bool)
        if not begun:
            flags[0] = True
        if ends:
            flags[-1] = True
        return table.append_column(edge, pa.array(flags)).append_column(place, pa.array(np.full(table.num_rows, here, np.int32))).cast(out).to_batches()

    by = [_q(k) for k in keys] + [F.col(first), F.col(tie)]
    combined = materialize(raw.mapInArrow(local, tied), "combined")
    parts = combined.repartitionByRange(partitions or shuffle_partitions(spark), *by).sortWithinPartitions(*by).mapInArrow(fold, placed)
    parts = materialize(parts, "states")
    # the second branch carries at most two rows a partition
    inner = parts.where(~F.col(edge)).select(*[_q(k) for k in keys], *names)
    before = F.last(last, ignorenulls=True).over(Window.partitionBy(*[_q(k) for k in keys]).orderBy(place).rowsBetween(Window.unboundedPreceding, -1))
    edges = parts.where(F.col(edge)).withColumn(tie, before)
    joined = (F.col(tie) == F.col(first)).cast("long")
    near = F.lit(0) if gap is None else (F.col(first).cast("double") - F.col(tie).cast("double") <= gap).cast("long")
    stitched = edges.groupBy(*[_q(k) for k in keys]).agg(
        F.sum(n).alias(n), F.sum(values).alias(values), F.sum(total).alias(total), F.min(low).alias(low), F.max(high).alias(high), F.min(first).alias(first), F.max(last).alias(last),
        (F.sum(orders) - F.coalesce(F.sum(joined), F.lit(0))).alias(orders), (F.sum(sessions) - F.coalesce(F.sum(near), F.lit(0))).alias(sessions),
    )
    result = inner.unionByName(stitched)
    return result if gap is not None else result.withColumn(sessions, F.lit(None).cast("long"))


def heavy_keys(df: DataFrame, keys: list[str], order: str, share: float, of: list[str]) -> DataFrame:
    """The keys that hold at least ``share`` of the rows with the same ``of`` (a part of ``keys``), with their ``n_rows``."""
    counts = keyed_aggregate(df, keys, order)
    n = counts.columns[len(keys)]
    total = free_name("total_rows", counts.columns)
    # the totals are sums of the counts, so the rows are not read again
    ends = {k: free_name("of_" + k, [*counts.columns, total]) for k in of}
    whole = counts.groupBy(*[_q(k).alias(ends[k]) for k in of]).agg(F.sum(_q(n)).alias(total))
    on = F.lit(True)
    for k in of:
        on = on & _q(k).eqNullSafe(_q(ends[k]))
    # at most one row for each combination of ``of``: Spark broadcasts it only below its size threshold
    return counts.join(whole, on).where(_q(n) >= F.lit(share) * _q(total)).select(*[_q(k) for k in keys], _q(n), _q(total))
