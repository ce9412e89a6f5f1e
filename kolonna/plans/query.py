"""``select``: the one query verb. It validates its arguments and declares a DataFrame; nothing runs until rows are asked for."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import Future as ThreadFuture
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kolonna.expr import Column, Predicate
from kolonna.functions.aggregates import Aggregation, Extremes, Fold
from kolonna.functions.sketches import extreme_values, merge_samples
from kolonna.operators.folds import fold_groups
from kolonna.printing import cat
from kolonna.runtime import materialize
from kolonna.settings import Settings
from kolonna.table import Table

Item = Column | Aggregation
Source = Table | Predicate

_pool = ThreadPoolExecutor(max_workers=8, thread_name_prefix="select")


def _listed(value: Any) -> list:
    if value is None:
        return []
    return list(value) if isinstance(value, (list, tuple, set, frozenset)) else [value]


def _table_of(source: Source) -> Table:
    if isinstance(source, Table):
        return source
    if isinstance(source, Predicate):
        return source.table
    raise ValueError(f"{source!r} is neither a table nor a condition")


def resolve_join(where: list[Source], join: Any) -> list[Column]:
    """The two join columns: given as columns, as two names, or as one name that both tables have."""
    if not isinstance(join, (Column, str)) and not join:
        return []
    parts = [join, join] if isinstance(join, str) else _listed(join)
    if len(where) != 2 or len(parts) != 2:
        raise ValueError(f"a join takes two tables and two columns, not {len(where)} and {len(parts)}")
    columns = []
    for part, source in zip(parts, where):
        if isinstance(part, Column):
            columns.append(part)
        elif part in _table_of(source)._columns:
            columns.append(_table_of(source)[part])
        else:
            raise ValueError(f"table {_table_of(source)._name} has no column {part}")
    return columns


def check_query(project: list[Item], join: list[Column], order_by: list, limit: int | None, where: list[Source]) -> bool:
    """Raise ValueError for a query that can not be meant."""
    if not where:
        raise ValueError("where takes at least one table or condition")
    tables = [_table_of(w) for w in where]
    names = [t._name for t in tables]
    for name in names:
        if names.count(name) > 1:
            raise ValueError(f"table {name} stands twice in where; nest a query to use it again")
    if not project:
        raise ValueError("nothing to select")
    seen: set[str] = set()
    for item in project:
        if not isinstance(item, (Column, Aggregation)):
            raise ValueError(f"{item!r} is neither a column nor an aggregation")
        column = item if isinstance(item, Column) else item.column
        if column is not None and column.table._name not in names:
            raise ValueError(f"{item.fullname} is of a table that where does not name")
        if item.fullname in seen:
            raise ValueError(f"{item.fullname} is selected twice")
        seen.add(item.fullname)
    if join:
        if len(tables) != 2:
            raise ValueError(f"a join takes two tables, not {len(tables)}")
        if len(join) != 2:
            raise ValueError(f"a join takes two columns, not {len(join)}")
        left, right = join
        if left.table._name == right.table._name:
            raise ValueError("both join columns are of one table")
        for c in join:
            if c.table._name not in names:
                raise ValueError(f"join column {c.fullname} is of a table that where does not name")
        if left.field.family != right.field.family:
            raise ValueError(f"join columns differ in type: {left.field.family} and {right.field.family}")
    for key in order_by:
        order_place(key, project)
    if limit is not None and limit < 0:
        raise ValueError("limit is not negative")
    return True


def order_place(key: Any, project: list[Item]) -> int:
    """The place in the projection of an order key: an index, a column or aggregation, a name, an alias, or ``table.column``."""
    if isinstance(key, bool) or not isinstance(key, (int, str, Column, Aggregation)):
        raise ValueError(f"{key!r} is no order key")
    if isinstance(key, int):
        if not 0 <= key < len(project):
            raise ValueError(f"order key {key} is not the place of a selected column")
        return key
    text = key if isinstance(key, str) else None
    for place, item in enumerate(project):
        if text is not None and text in (item.fullname, item.label, item.alias):
            return place
        if text is None and item.fullname == key.fullname:
            return place
    raise ValueError(f"order key {text or key.fullname} is not selected")


class QueryResult:
    """The rows of a query: iterate for tuples, or go on with ``frame``."""

    def __init__(self, frame: DataFrame) -> None:
        self.frame = frame

    def __iter__(self) -> Iterator[tuple]:
        for row in self.frame.toLocalIterator():
            yield tuple(row)

    def purge(self) -> None:
        """Give up anything Spark keeps for this result."""
        self.frame.unpersist()


class Future:
    """A query that runs in the background."""

    def __init__(self, task: ThreadFuture, nest: bool, spark: Any, tag: str) -> None:
        self._task, self._nest, self._spark, self._tag = task, nest, spark, tag

    def status(self) -> str:
        """``active``, ``ready`` or ``dead``."""
        if not self._task.done():
            return "active"
        return "dead" if self._task.cancelled() or self._task.exception() else "ready"

    @property
    def done(self) -> bool:
        return self.status() == "ready"

    def wait(self, timeout: float | None = None) -> QueryResult | Table:
        """The result, as the blocking query would give it; raises what the query raised."""
        return self._task.result(timeout)

    @property
    def table(self) -> Table:
        if not self.done:
            raise RuntimeError("the query has not finished")
        if not self._nest:
            raise TypeError("the query was not nested")
        return self._task.result()

    def cancel(self) -> None:
        """Interrupt the Spark jobs of the query."""
        self._spark.interruptTag(self._tag)

    def purge(self) -> None:
        if self.done:
            result = self._task.result()
            result.frame.unpersist()


def select(
    *project: Item,
    where: Source | Iterable[Source] = (),
    join: Any = (),
    full_join: bool = False,
    order_by: Any = (),
    desc: bool = False,
    distinct: bool = False,
    limit: int | None = None,
    wide: bool = False,
    nest: bool | None = None,
    tag: str | None = None,
    block: bool = True,
    dump: bool | None = None,
    pre_order_stage: Iterable[Callable[[DataFrame], DataFrame]] = (),
    partition: int = 0,
    max_cores: int = 0,
    profile: bool = False,
    purge: bool = True,
    **settings: Any,
) -> QueryResult | Table | Future | None:
    """Query one or more tables.

    ``project``: columns, functions of columns and aggregations; with an aggregation, all plain columns are group keys.
    ``where``: tables, or conditions that stand for their table. Two tables are joined on ``join`` or, with ``full_join``,
    crossed; otherwise the rows of all tables follow each other, with nulls for the columns of the others.
    ``order_by`` takes selected columns, names or places; ties follow the other columns, so the order is defined. ``limit`` 0 is none.
    ``nest`` gives a Table for further queries, ``tag`` also stores it under a name. ``block=False`` gives a Future, ``dump=True`` prints.
    ``partition`` is the number of parts of the result, sorted ones being ranges of the order; 0 leaves it to Spark. ``max_cores`` caps the tasks of
    the last stage. ``profile`` prints the plan. ``purge=False`` keeps the rows, once computed, for later use until the result's
    ``purge()``. ``wide`` is a hint without effect: Spark plans aggregation itself.
    """
    options = Settings.of(**settings)
    nest = options.nest if nest is None else nest
    dump = options.dump if dump is None else dump
    if partition < 0 or max_cores < 0:
        raise ValueError("partition and max_cores are not negative")
    sources, items, keys = _listed(where), list(project), _listed(order_by)
    columns = [] if full_join else resolve_join(sources, join)
    check_query(items, columns, keys, limit, sources)
    frame = declare(sources, items, columns, full_join, keys, desc, distinct, limit, pre_order_stage, partition)
    if max_cores > 0:
        frame = frame.coalesce(max_cores)
    if profile:
        frame.explain("formatted")
    if tag is not None:
        from kolonna.catalog import Catalog

        held = Catalog(frame.sparkSession, options.warehouse)
        if held.find(tag) is not None:
            raise ValueError(f"there is a table {tag} already")
        held.save(tag, frame)
        frame = held.open(tag).frame
    if not purge:
        frame = frame.persist()
    name = tag or f"nested_{'_'.join(_table_of(s)._name for s in sources)[:40]}_{uuid.uuid4().hex[:6]}"

    def result(rows: DataFrame) -> QueryResult | Table:
        return Table.from_frame(name, rows) if nest else QueryResult(rows)

    if not block:
        spark, mark = frame.sparkSession, f"select-{uuid.uuid4().hex}"

        def run() -> QueryResult | Table:
            spark.addTag(mark)
            try:
                return result(materialize(frame, "future"))
            finally:
                spark.removeTag(mark)

        return Future(_pool.submit(run), bool(nest), spark, mark)
    if dump and not nest:
        cat(QueryResult(frame), header=[i.name for i in items], numeric=[isinstance(f.dataType, T.NumericType) for f in frame.schema], out=sys.stdout)
        return None
    return result(frame)


def _names(items: list[Item]) -> list[str]:
    """Output names: alias or label, with the table in front where two would be alike."""
    plain = [i.name for i in items]
    names: list[str] = []
    for item, name in zip(items, plain):
        if plain.count(name) > 1 and item.alias is None:
            name = item.fullname
        while name.lower() in (n.lower() for n in names):
            name += "_"
        names.append(name)
    return names


def _q(name: str) -> SparkColumn:
    return F.col("`" + name.replace("`", "``") + "`")


def _side(source: Source, number: int) -> tuple[DataFrame, Callable[[str], SparkColumn]]:
    """The restricted rows of a table, its columns renamed apart, and where to find them."""
    table = _table_of(source)
    frame = table.frame
    if isinstance(source, Predicate):
        frame = source.restrict(frame, _q)
    known = set(frame.columns)
    frame = frame.select(*[_q(f.name).alias(f"{number}.{f.name}") for f in table._fields if f.name in known])
    return frame, lambda name: _q(f"{number}.{name}")


def declare(sources: list[Source], items: list[Item], join: list[Column], full_join: bool, order_by: list, desc: bool, distinct: bool, limit: int | None, stages: Iterable[Callable[[DataFrame], DataFrame]] = (), split: int = 0) -> DataFrame:
    """The DataFrame of a checked query."""
    tables = [_table_of(s) for s in sources]
    sides = [_side(s, i) for i, s in enumerate(sources)]
    place = {t._name: i for i, t in enumerate(tables)}

    def value(item: Item) -> SparkColumn:
        column = item if isinstance(item, Column) else item.column
        if column is None:
            return F.lit(1)
        return column.spark(sides[place[column.table._name]][1])

    def typed(item: Item, owner: int) -> SparkColumn:
        column = item if isinstance(item, Column) else item.column
        if column is None or column.table._name == tables[owner]._name:
            return value(item)
        return F.lit(None).cast(sides[place[column.table._name]][0].select(value(item)).schema[0].dataType)

    inner = [f"_{i}" for i in range(len(items))]
    if len(sides) == 1 or join or full_join:
        if len(sides) == 1:
            base = sides[0][0]
        elif full_join:
            base = sides[0][0]
            for other, _ in sides[1:]:
                base = base.crossJoin(other)
        else:
            ends = [c.spark(sides[place[c.table._name]][1]) for c in join]
            base = sides[0][0].join(sides[1][0], ends[0] == ends[1])
        rows = base.select(*[value(item).alias(n) for item, n in zip(items, inner)])
    else:
        parts = [side[0].select(*[typed(item, i).alias(n) for item, n in zip(items, inner)]) for i, side in enumerate(sides)]
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionAll(part)

    keys = [n for item, n in zip(items, inner) if isinstance(item, Column)]
    if len(keys) < len(items):
        rows = aggregate(rows, items, inner, keys)
    if distinct:
        rows = rows.distinct()
    names = _names(items)
    rows = rows.select(*[F.col(n).alias(name) for n, name in zip(inner, names)])
    for stage in stages:
        rows = stage(rows)
    if order_by:
        first = [order_place(k, items) for k in order_by]
        rest = [i for i in range(len(items)) if i not in first and names[i] in rows.columns and not isinstance(rows.schema[names[i]].dataType, (T.BinaryType, T.MapType))]
        order = [_q(names[i]).desc() if desc else _q(names[i]).asc() for i in [*dict.fromkeys(first), *rest]]
        if split and not limit:
            return rows.repartitionByRange(split, *order).sortWithinPartitions(*order)
        rows = rows.orderBy(*order)
    rows = rows.limit(limit) if limit else rows
    return rows.repartition(split) if split and not order_by else rows


def aggregate(rows: DataFrame, items: list[Item], inner: list[str], keys: list[str]) -> DataFrame:
    """Group by ``keys``: Spark's aggregates in one pass, all Python folds in another, extremes in one each, joined on the keys."""
    of = [(item, n) for item, n in zip(items, inner) if isinstance(item, Aggregation)]
    plain = [(item, n) for item, n in of if not isinstance(item, (Fold, Extremes))]
    folds = {n: item for item, n in of if isinstance(item, Fold)}
    extremes = {n: item for item, n in of if isinstance(item, Extremes)}

    def made(item: Aggregation, n: str) -> SparkColumn:
        column = item.build(F.col(n))
        if item.empty is not None and not keys:
            column = F.coalesce(column, F.lit(item.empty))
        return column.alias(n)

    def joined(left: DataFrame, part: DataFrame, how: str) -> DataFrame:
        if not keys:
            return left.crossJoin(part)  # one row each
        renamed = part.select(*[F.col(k).alias(f"r{k}") for k in keys], *[c for c in part.columns if c not in keys])
        on = F.lit(True)
        for k in keys:
            on = on & F.col(k).eqNullSafe(F.col(f"r{k}"))
        return left.join(renamed, on, how).drop(*[f"r{k}" for k in keys])

    result = None
    if plain:
        result = rows.groupBy(*keys).agg(*[made(item, n) for item, n in plain])
    if folds:
        part = fold_groups(rows.select(*keys, *folds), keys, folds)
        result = part if result is None else joined(result, part, "inner")
    if result is None:
        # every group has its row, also one without any value
        result = rows.select(*keys).distinct() if keys else rows.sparkSession.range(1).select()
    for n, item in extremes.items():
        source = rows.select(*keys, n)
        found = merge_samples(source, keys, item.capacity, item.greatest) if item.samples else extreme_values(source, keys, n, item.capacity, item.greatest)
        result = joined(result, found.withColumnRenamed(found.columns[-1], n), "left").withColumn(n, F.coalesce(n, F.array().cast(T.ArrayType(item.kind))))
    return result
