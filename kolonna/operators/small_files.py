"""Consolidation of a stored table's own Parquet files, with the scheduling of :mod:`kolonna.operators.compaction`.

The files of each partition are assigned, longest first, to as few output files as their bytes need; each task streams its files
through pyarrow into one, so nothing is decoded into rows and no row travels. Row counts are compared for every output and
for the whole table. Outputs are drafts first, and only those that a task reported are moved into the new segment, so what a lost or
repeated task wrote is never read. The next version of the table then names that segment instead of those that were read: rows that
are loaded meanwhile are in segments of their own and stay, and readers see the old files or the new ones.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kolonna.catalog import RETAIN, Catalog, read_segments
from kolonna.operators.compaction import FILES_PER_SHARD, longest_first, open_folder
from kolonna.runtime import materialize, shuffle_partitions
from kolonna.table import Table

TARGET_BYTES = 128 << 20
#: Rows that are read at once.
BATCH_ROWS = 1 << 16


class Compacted(NamedTuple):
    rows: int
    files_before: int
    files_after: int


def compact_table(catalog: Catalog, table: Table, target_bytes: int = TARGET_BYTES, retain: float = RETAIN) -> Compacted:
    """Rewrite the files of a stored table into well-sized ones. Loads go on meanwhile; if rows are deleted or the table is compacted, it stops without effect.

    A table without rows stays as it is. Columns that older files lack become null, as reading them would give. The old files are
    removed by the first compaction, or :meth:`Catalog.vacuum`, that comes more than ``retain`` seconds later.
    """
    spark, name = catalog.spark, table._name
    catalog.vacuum(name, retain)
    state, location = catalog.state(name), catalog.location(name)
    if not state["segments"]:
        return Compacted(0, 0, 0)
    # one row a file, from the footers
    found = read_segments(spark, location, state["segments"], table._fields, table._partition).select(F.col("_metadata.file_path").alias("unit"), F.col("_metadata.file_size").alias("size")).groupBy("unit", "size").agg(F.count(F.lit(1)).alias("rows"))
    files = materialize(found, "files")
    folder = F.url_decode(F.replace(F.regexp_extract("unit", "([^/]*=[^/]*)/[^/]*$", 1), F.lit("+"), F.lit("%2B"))) if table._partition else F.lit("")
    placed = files.withColumn("folder", folder)
    shards = placed.groupBy("folder").agg(F.ceil(F.count(F.lit(1)) / F.lit(FILES_PER_SHARD)).alias("shards"))
    keyed = placed.join(shards, "folder").withColumn("bin_key", F.concat_ws("/", F.hex(F.xxhash64("folder")), F.pmod(F.xxhash64("unit"), F.col("shards")).cast("string")))
    bins = keyed.groupBy("bin_key").agg(F.greatest(F.lit(1), F.ceil(F.sum("size") / F.lit(target_bytes))).cast("int").alias("bins"))
    slots = longest_first(keyed.join(bins, "bin_key").select("bin_key", "bins", "unit", "size"))
    work = slots.select("unit", "slot").join(placed.select("unit", "folder", "rows"), "unit")
    new, target = catalog.new_segment(name)
    drafts = f"{location}/drafts/{new}"
    shape = T.StructType([T.StructField(f.name, f.type) for f in table._fields if f.name != table._partition])
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("written", T.LongType()), T.StructField("expected", T.LongType())])

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import to_arrow_schema

        wanted = to_arrow_schema(shape)
        slot, writer, done = None, None, {}

        def close() -> pa.RecordBatch:
            writer.close()
            fs, at = open_folder(done["path"])
            with fs.open_input_file(at) as f:
                rows = pq.ParquetFile(f).metadata.num_rows
            return pa.RecordBatch.from_arrays([pa.array([done["path"]]), pa.array([rows]), pa.array([done["expected"]])], names=schema.names)

        for batch in batches:
            for row in batch.to_pylist():
                if row["slot"] != slot:
                    if writer is not None:
                        yield close()
                    slot = row["slot"]
                    done = {"path": "/".join(p for p in (drafts, row["folder"], f"part-{uuid.uuid4().hex}.zstd.parquet") if p), "expected": 0}
                    fs, at = open_folder(done["path"])
                    fs.create_dir(at.rpartition("/")[0], recursive=True)
                    writer = pq.ParquetWriter(at, wanted, filesystem=fs, compression="zstd")
                source, at = open_folder(_plain(row["unit"]))
                with source.open_input_file(at) as f:
                    held = pq.ParquetFile(f)
                    have = {n for n in held.schema_arrow.names}
                    for part in held.iter_batches(BATCH_ROWS, columns=[n for n in wanted.names if n in have]):
                        arrays = [part.column(n).cast(wanted.field(n).type) if n in have else pa.nulls(part.num_rows, wanted.field(n).type) for n in wanted.names]
                        writer.write_batch(pa.RecordBatch.from_arrays(arrays, schema=wanted))
                done["expected"] += row["rows"]
        if writer is not None:
            yield close()

    written = materialize(work.repartition(shuffle_partitions(spark), "slot").sortWithinPartitions("slot", "unit").mapInArrow(rewrite, schema), "rewritten")
    wrong, rows, after = written.agg(F.count(F.when(F.col("written") != F.col("expected"), 1)), F.coalesce(F.sum("written"), F.lit(0)), F.count(F.lit(1))).collect()[0]
    counted, before = files.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.count(F.lit(1))).collect()[0]

    def publish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Move the reported drafts; one that another attempt has moved is there already."""
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, at = open_folder(path)
                _, to = open_folder(target + path[len(drafts) :])
                fs.create_dir(to.rpartition("/")[0], recursive=True)
                if fs.get_file_info(to).type.name == "NotFound":
                    fs.move(at, to)
            yield batch

    def replace(now: dict) -> dict:
        if now["deletes"] != state["deletes"] or not {*state["segments"]} <= {*now["segments"]}:
            raise RuntimeError(f"rows of table {name} were deleted or compacted meanwhile; its files stay as they are")
        kept = [s for s in now["segments"] if s not in state["segments"]]
        return now | {"segments": [new, *kept], "retired": [*now["retired"], *([s, time.time()] for s in state["segments"])]}

    try:
        if wrong or rows != counted:
            raise RuntimeError(f"table {name} was not copied whole; its files stay as they are")
        if rows:
            materialize(written.select("path").repartition(shuffle_partitions(spark)).mapInArrow(publish, "path string"), "published")
            catalog.commit(name, replace)
    except Exception:
        catalog.files.delete(target)
        raise
    finally:
        catalog.files.delete(drafts)
    return Compacted(rows, before, after)


def _plain(uri: str) -> str:
    """The path behind Spark's URI of a file, whose special characters are escaped once."""
    from urllib.parse import unquote

    return unquote(uri)
