"""Aggregation by a Python fold, distributed: partial folds in the tasks that read, a streamed merge after one shuffle."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kolonna.runtime import chunks, fold_sorted, group_codes

if TYPE_CHECKING:
    from kolonna.functions.aggregates import Fold


def fold_groups(rows: DataFrame, keys: list[str], folds: dict[str, Fold]) -> DataFrame:
    """The keys and a column for each fold of the column of its name, all in one pass. Without keys one row, also of no rows."""
    kinds = [rows.schema[k] for k in keys]
    values = list(folds)
    held = T.StructType([*kinds, *(T.StructField(v, T.BinaryType()) for v in values)])
    final = T.StructType([*kinds, *(T.StructField(v, folds[v].kind) for v in values)])
    steps = {v: (f.start, f.fold, f.merge, f.finish) for v, f in folds.items()}

    def pack(table: pa.Table, first: object, accs: list[list]) -> pa.Table:
        from pyspark import cloudpickle

        blobs = [pa.array([cloudpickle.dumps(a) for a in column], pa.binary()) for column in accs]
        return pa.Table.from_arrays([*table.select(keys).take(first).columns, *blobs], [*keys, *values])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks(batches, 1 << 17):
            code, first = group_codes(table, keys)
            # the rows of each group together, in their order
            order = pa.array(np.argsort(code, kind="stable"))
            ends = np.cumsum(np.bincount(code, minlength=len(first))).tolist()
            folded = []
            for value in values:
                start, fold, _, _ = steps[value]
                held = table.column(value).take(order).to_pylist()
                folded.append([reduce(fold, held[a:b], start()) for a, b in zip([0, *ends[:-1]], ends)])
            yield from pack(table, first, folded).to_batches()

    def combine(table: pa.Table) -> pa.Table:
        import pickle

        code, first = group_codes(table, keys)
        groups, merged = code.tolist(), []
        for value in values:
            merge = steps[value][2]
            accs: list = [None] * len(first)
            seen = [False] * len(first)
            for g, blob in zip(groups, table.column(value).to_pylist()):
                acc = pickle.loads(blob)
                accs[g] = merge(accs[g], acc) if seen[g] else acc
                seen[g] = True
            merged.append(accs)
        return pack(table, first, merged)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        import pickle

        out = to_arrow_schema(final)
        found = False
        for table in fold_sorted(batches, combine, 1 << 14):
            found = True
            done = [pa.array([steps[v][3](pickle.loads(b)) for b in table.column(v).to_pylist()], out.field(v).type) for v in values]
            yield from pa.Table.from_arrays([*table.select(keys).columns, *done], out.names).cast(out).to_batches()
        if not found and not keys:
            yield pa.RecordBatch.from_arrays([pa.array([steps[v][3](steps[v][0]())], out.field(v).type) for v in values], schema=out)

    parts = rows.mapInArrow(partial, held)
    if not keys:
        # an exchange: the partial folds stay in the tasks that read
        return parts.repartition(1).mapInArrow(merged, final)
    return parts.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(merged, final)
