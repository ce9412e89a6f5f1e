"""Statistics of stored columns: how many different values they hold against rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from kolonna.expr import Predicate
from kolonna.table import Table


#: Relative standard error of estimated counts.
ERROR = 0.01


def stat(where: Table | Predicate, limit: int | None = None, exact: bool = False) -> dict[str, int]:
    """For each indexed column the cardinality in per cent: the mean over the table's partitions, weighted by their rows, of
    different values against rows, truncated; columns at 0 are left out. ``_`` is the number of rows.

    ``limit`` takes only that many partitions, the first in order. Different values are estimated by a sketch a column and partition, in one
    pass that shuffles the sketches alone; with ``exact`` they are counted, for which Spark sends every row once a column.
    """
    table = where.table if isinstance(where, Predicate) else where
    frame = where.restrict(table.frame, lambda n: F.col(f"`{n}`")) if isinstance(where, Predicate) else table.frame
    indexed = [f.name for f in table._fields if f.index]
    part = F.col(f"`{table._partition}`") if table._partition else F.lit("")
    pairs = frame.select(part.alias("_part"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(indexed)])
    if limit is not None and table._partition:
        first = pairs.select("_part").distinct().orderBy("_part").limit(limit)
        pairs = pairs.join(first, "_part", "left_semi")
    counts = pairs.groupBy("_part").agg(F.count(F.lit(1)).alias("rows"), *[(F.count_distinct(f"c{i}") if exact else F.approx_count_distinct(f"c{i}", ERROR)).alias(f"d{i}") for i in range(len(indexed))])
    # rows / total * different / rows, summed over the partitions
    total = counts.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), *[F.coalesce(F.sum(f"d{i}"), F.lit(0)).alias(f"d{i}") for i in range(len(indexed))]).collect()[0]
    found = {c: min(100, int(100 * total[f"d{i}"] // total["rows"])) for i, c in enumerate(indexed) if total["rows"]}
    return {c: n for c, n in found.items() if n > 0} | {"_": total["rows"]}
