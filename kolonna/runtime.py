"""Session helpers: scratch tables in the shared folder and small Arrow utilities used by the operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``. Only a session that runs on one machine gets a temporary one where that is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="kolonna-")
        spark.conf.set("spark.checkpoint.dir", path)
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder; what is there goes when this process ends, or by :func:`release`."""
    if not _scratch:
        atexit.register(release)
    path = f"{shared_dir(spark)}/kolonna/{label}-{uuid.uuid4().hex}"
    _scratch.append(path)
    return path


_scratch: list[str] = []


def release(keep: int = 0) -> None:
    """Delete every scratch path of this process but the first ``keep``. Results that are still to be read from them must be read before."""
    spark = SparkSession.getActiveSession()
    while len(_scratch) > keep and spark is not None:
        try:
            path = spark._jvm.org.apache.hadoop.fs.Path(_scratch[-1])
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the session is gone: nothing can be deleted any more
            return
        _scratch.pop()


@contextmanager
def scratch() -> Iterator[None]:
    """Delete at the end what was materialized inside, so that a service that runs for long does not fill the shared folder. For one thread."""
    before = len(_scratch)
    try:
        yield
    finally:
        release(before)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder once and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(name: str, taken: Iterable[str]) -> str:
    """``name``, with underscores appended until no column of ``taken`` (compared without case) has it."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name += "_"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def group_codes(table: pa.Table, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code of each row, first row of each code); codes count up in order of first appearance. Null is a key like any other."""
    rows = table.num_rows
    code = np.zeros(rows, np.int64)
    for key in keys:
        column = table.column(key).combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
        encoded = column.dictionary_encode(null_encoding="encode")
        index = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        code = code * (len(encoded.dictionary) + 1) + index
        code = np.unique(code, return_inverse=True)[1] if len(keys) > 1 else code
    _, first, inverse = np.unique(code, return_index=True, return_inverse=True)
    order = np.argsort(first, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return place[inverse.reshape(-1)], first[order]


def chunks(batches: Iterator[pa.RecordBatch], rows: int, weight: Callable[[pa.RecordBatch], int] | None = None) -> Iterator[pa.Table]:
    """Arrow batches joined into tables of about ``rows`` rows (or units of ``weight``)."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += weight(batch) if weight else batch.num_rows
        if size >= rows:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def pieces(table: pa.Table, column: str, size: int, starts: np.ndarray | None = None) -> Iterator[pa.Table]:
    """Slices of about ``size`` bytes of a string column (longer where one row is); they begin only at ``starts``, by default at any row.

    Arrow batches can be far larger than what a vectorised step should hold in the processor's cache.
    """
    import pyarrow.compute as pc

    if not table.num_rows:
        return
    length = pc.fill_null(pc.binary_length(table.column(column)), 0).to_numpy().astype(np.int64)
    before = np.cumsum(length) - length
    starts = np.arange(table.num_rows) if starts is None else starts
    block = before[starts] // size
    first = starts[np.r_[True, block[1:] != block[:-1]]]
    for a, b in zip(first.tolist(), [*first[1:].tolist(), table.num_rows]):
        yield table.slice(a, b - a)


def fold_sorted(batches: Iterator[pa.RecordBatch], combine: Callable[[pa.Table], pa.Table], rows: int, weight: Callable[[pa.RecordBatch], int] | None = None) -> Iterator[pa.Table]:
    """One row per key from a stream sorted by key. ``combine`` is associative: it merges the rows of each key into one, in key order.

    Only the last key of a chunk can go on in the next one, so that one row is carried; memory does not depend on group size.
    """
    carry: pa.Table | None = None
    for chunk in chunks(batches, rows, weight):
        merged = combine(chunk if carry is None else pa.concat_tables([carry, chunk.cast(carry.schema)]))
        carry = merged.slice(merged.num_rows - 1)
        if merged.num_rows > 1:
            yield merged.slice(0, merged.num_rows - 1)
    if carry is not None:
        yield carry
