"""Percentiles of very large numeric columns: mergeable randomized compactor hierarchies.

A sketch keeps items in levels; an item of level h stands for 2**h values. A full level is sorted, every other item (from a
random offset) moves one level up and the rest is dropped. Sketches merge level by level, so partial results of partitions,
days or sites can be combined in any order. The rank of a reported percentile differs from the asked one by about
``1.7 / k`` of the number of values (99 % of the time; the tests measure it); a group of at most ``k`` values is exact.

Everything runs on whole Arrow batches with all their groups at once; each map task sends one sketch a group for every ``CHUNK`` rows.
Merging is a fold over a sorted stream, first of ``SPREAD`` parts of a group apart, then of these, so a group that holds a third of all
rows costs a task no more memory than one sketch, and no task reads the sketches of every map task.

Defined results: null and NaN values are not counted; a group of only such values has n = 0 and null percentiles; a null key is a
key; an empty table gives no rows; percentile q is the value of rank ceil(q * n) (the smallest for q = 0), so it is always a stored value; the smallest and the largest are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kolonna.runtime import chunks, fold_sorted, free_name, group_codes

#: Size of the top level; see the error bound above.
K = 1024
#: Each level below the top holds this share of the one above it, and at least LEAST items.
SHRINK, LEAST = 2 / 3, 8
#: Rows of input, or items of sketches, that a task holds at once.
CHUNK = 1 << 19
#: Parts in which the partial sketches of a group are merged before they are merged together.
SPREAD = 32
STATE = ("sketch_n", "sketch_min", "sketch_max", "sketch_items", "sketch_levels")


def _kind(df: DataFrame, value: str) -> T.DataType:
    return T.LongType() if isinstance(df.schema[value].dataType, T.IntegralType) else T.DoubleType()


def compact(group: np.ndarray, level: np.ndarray, value: np.ndarray, k: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bring every group's hierarchy under its capacity. All groups at once; returns the kept items in order of group and level."""
    while len(group):
        groups = int(group.max()) + 1
        height = np.zeros(groups, np.int64)
        np.maximum.at(height, group, level + 1)
        top = int(height.max())
        count = np.bincount(group * top + level, minlength=groups * top).reshape(groups, top)
        below = height[:, None] - 1 - np.arange(top)[None, :]
        capacity = np.where(below >= 0, np.maximum(LEAST, np.ceil(k * SHRINK ** np.maximum(below, 0))), 0)
        over = (count.sum(1) > capacity.sum(1))[:, None] & (count >= capacity) & (count >= 2) & (below >= 0)
        chosen = np.where(over.any(1), over.argmax(1), -1)
        hit = level == chosen[group]
        if not hit.any():
            break
        g, l, v = group[hit], level[hit], value[hit]
        order = np.lexsort((v, g))
        g, l, v = g[order], l[order], v[order]
        start = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        size = np.diff(np.r_[start, len(g)])
        place = np.arange(len(g)) - np.repeat(start, size)
        odd = size % 2 == 1
        # of an odd number one end item stays; which end is random, as the offset is
        first = rng.integers(0, 2, len(start))
        stays = np.repeat(odd & (first == 0), size) & (place == 0) | np.repeat(odd & (first == 1), size) & (place == np.repeat(size - 1, size))
        shift = np.repeat(rng.integers(0, 2, len(start)) + (odd & (first == 0)), size)
        moves = ~stays & ((place + shift) % 2 == 0)
        group = np.concatenate([group[~hit], g[stays], g[moves]])
        level = np.concatenate([level[~hit], l[stays], l[moves] + 1])
        value = np.concatenate([value[~hit], v[stays], v[moves]])
    order = np.lexsort((level, group))
    return group[order], level[order], value[order]


def _state(keys: pa.Table, groups: int, parts: tuple[np.ndarray, np.ndarray, np.ndarray], n: np.ndarray, low: np.ndarray, high: np.ndarray, names: tuple[str, ...]) -> pa.Table:
    group, level, value = parts
    item_at = np.r_[0, np.cumsum(np.bincount(group, minlength=groups))].astype(np.int32)
    height = np.zeros(groups, np.int64)
    np.maximum.at(height, group, level + 1)
    level_at = np.r_[0, np.cumsum(height)]
    sizes = np.zeros(int(level_at[-1]), np.int32)
    np.add.at(sizes, level_at[group] + level, 1)
    kind = pa.int64() if value.dtype.kind == "i" else pa.float64()
    none = n == 0
    columns = [pa.array(n), pa.array(low, kind, mask=none), pa.array(high, kind, mask=none), pa.ListArray.from_arrays(pa.array(item_at), pa.array(value, kind)), pa.ListArray.from_arrays(pa.array(level_at.astype(np.int32)), pa.array(sizes))]
    return pa.Table.from_arrays([*keys.columns, *columns], [*keys.column_names, *names])


def _ends(kind: np.dtype) -> tuple[float, float]:
    return (np.iinfo(np.int64).max, np.iinfo(np.int64).min) if kind.kind == "i" else (np.inf, -np.inf)


def _sketch_rows(table: pa.Table, keys: list[str], value: str, names: tuple[str, ...], k: int, rng: np.random.Generator) -> pa.Table:
    group, first = group_codes(table, keys)
    groups = len(first)
    column = table.column(value).combine_chunks()
    good = pc.is_valid(column)
    if pa.types.is_floating(column.type):
        good = pc.and_(good, pc.invert(pc.fill_null(pc.is_nan(column), True)))
    good = good.to_numpy(zero_copy_only=False)
    v = column.filter(pa.array(good)).to_numpy(zero_copy_only=False)
    g = group[good]
    low, high = (np.full(groups, x, v.dtype) for x in _ends(v.dtype))
    np.minimum.at(low, g, v)
    np.maximum.at(high, g, v)
    return _state(table.select(keys).take(first), groups, compact(g, np.zeros(len(g), np.int64), v, k, rng), np.bincount(g, minlength=groups), low, high, names)


def _flat(table: pa.Table, names: tuple[str, ...], row_group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The items of all sketches of a table: group, level, value."""
    levels = table.column(names[4]).combine_chunks()
    height = pc.list_value_length(levels).to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = levels.flatten().to_numpy(zero_copy_only=False)
    within = np.arange(len(sizes)) - np.repeat(np.r_[0, np.cumsum(height)[:-1]], height)
    items = table.column(names[3]).combine_chunks()
    length = pc.list_value_length(items).to_numpy(zero_copy_only=False)
    return np.repeat(row_group, length), np.repeat(within, sizes).astype(np.int64), items.flatten().to_numpy(zero_copy_only=False)


def _merge(table: pa.Table, keys: list[str], names: tuple[str, ...], k: int, rng: np.random.Generator) -> pa.Table:
    row_group, first = group_codes(table, keys)
    groups = len(first)
    group, level, value = _flat(table, names, row_group)
    n = np.zeros(groups, np.int64)
    np.add.at(n, row_group, table.column(names[0]).to_numpy())
    low, high = (np.full(groups, x, value.dtype) for x in _ends(value.dtype))
    for ends, name, best in ((low, names[1], np.minimum), (high, names[2], np.maximum)):
        column = table.column(name).combine_chunks()
        there = pc.is_valid(column).to_numpy(zero_copy_only=False)
        best.at(ends, row_group[there], column.drop_null().to_numpy(zero_copy_only=False))
    return _state(table.select(keys).take(first), groups, compact(group, level, value, k, rng), n, low, high, names)


def _state_schema(keys: list[T.StructField], kind: T.DataType, names: tuple[str, ...]) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType) for f in keys] + [T.StructField(n, t) for n, t in zip(names, (T.LongType(), kind, kind, T.ArrayType(kind), T.ArrayType(T.IntegerType())))])


def _as(table: pa.Table, schema: pa.Schema) -> list[pa.RecordBatch]:
    return table.cast(schema).to_batches()


def percentile_sketches(df: DataFrame, keys: list[str], value: str, k: int = K, seed: int = 7) -> DataFrame:
    """One mergeable sketch of ``value`` for each combination of ``keys`` (none: of all rows): the keys and the STATE columns.

    Store the result to combine it later with that of other days (:func:`merge_sketches`). A key named like a state column keeps its
    name; the state column then gets a trailing underscore.
    """
    names = tuple(free_name(n, keys) for n in STATE)
    kind = _kind(df, value)
    slim = df.select(*keys, df[value].cast(kind).alias(free_name("value", keys)))
    return _merged(_partials(slim, keys, kind, names, k, seed), keys, names, k, seed)


def _partials(slim: DataFrame, keys: list[str], kind: T.DataType, names: tuple[str, ...], k: int, seed: int) -> DataFrame:
    schema = _state_schema([slim.schema[c] for c in keys], kind, names)
    value = slim.columns[-1]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        rng = np.random.default_rng((seed, TaskContext.get().partitionId()))
        out = to_arrow_schema(schema)
        for table in chunks(batches, CHUNK):
            yield from _as(_sketch_rows(table, keys, value, names, k, rng), out)

    return slim.mapInArrow(build, schema)


def _merged(states: DataFrame, keys: list[str], names: tuple[str, ...], k: int, seed: int) -> DataFrame:
    schema = states.schema

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        rng = np.random.default_rng((seed + 1, TaskContext.get().partitionId()))
        out = to_arrow_schema(schema)
        weigh = lambda b: max(b.num_rows, len(b.column(b.schema.get_field_index(names[3])).flatten()))
        for table in fold_sorted(batches, lambda t: _merge(t.cast(out), keys, names, k, rng), CHUNK, weigh):
            yield from _as(table, out)

    salt, by = free_name("salt", schema.names), [F.col(_q(c)) for c in keys]
    spread = states.withColumn(salt, F.pmod(F.spark_partition_id(), F.lit(SPREAD)).cast("int"))
    states = spread.repartition(*by, F.col(salt)).sortWithinPartitions(*by, salt).drop(salt).mapInArrow(fold, schema)
    if not keys:
        # an exchange: the parts are merged where they are
        return states.repartition(1).mapInArrow(fold, schema)
    return states.repartition(*by).sortWithinPartitions(*by).mapInArrow(fold, schema)


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def merge_sketches(states: DataFrame, keys: list[str], k: int = K, seed: int = 7) -> DataFrame:
    """Combine stored sketches to coarser ``keys`` (a part of those they were made for; none: one sketch of all)."""
    names = tuple(states.columns[-5:])
    return _merged(states.select(*[F.col(_q(c)) for c in keys], *names), keys, names, k, seed)


def sketch_percentiles(states: DataFrame, probabilities: dict[str, float]) -> DataFrame:
    """The keys, ``n`` and a column for each named probability of the sketches of ``states``."""
    names = tuple(states.columns[-5:])
    keys = states.columns[:-5]
    kind = states.schema[names[1]].dataType
    total = free_name("n", [*keys, *probabilities])
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in states.schema.fields[:-5]] + [T.StructField(total, T.LongType())] + [T.StructField(p, kind) for p in probabilities])
    asked = list(probabilities.values())
    if any(not 0 <= q <= 1 for q in asked) or len({*probabilities, *keys, total}) < len(schema):
        raise ValueError("probabilities lie between 0 and 1 and have names of their own")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        for table in chunks(batches, CHUNK // 64):
            n = table.column(names[0]).to_numpy()
            group, level, value = _flat(table, names, np.arange(len(n)))
            order = np.lexsort((value, group))
            reach = np.cumsum(1 << level[order])
            base = np.r_[0, np.cumsum(n)[:-1]]
            result = [*table.select(keys).columns, pa.array(n)]
            value = value[order]
            for q in asked:
                if q in (0, 1):  # the ends are kept exactly
                    result.append(table.column(names[1 if q == 0 else 2]))
                    continue
                # float dust must not lift a whole rank: 0.9 * 70 is 63
                rank = np.clip(np.ceil(np.round(q * n, 6)).astype(np.int64), 1, np.maximum(n, 1))
                at = np.searchsorted(reach, base + rank, "left")
                none = n == 0
                picked = value[np.minimum(at, max(len(value) - 1, 0))] if len(value) else np.zeros(len(n), value.dtype)
                result.append(pa.array(picked, mask=none))
            yield from _as(pa.Table.from_arrays(result, out.names), out)

    return states.mapInArrow(answer, schema)
