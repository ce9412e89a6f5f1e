"""Consolidation of many tiny files into few well-sized ones, each record exactly once.

1. Inventory: the listing (with its replicas and repeats) gives the files of each partition; the stored rows themselves give the
   size of each file, since the listed sizes can be stale or null. Only their number a file is shuffled.
2. Schedule: within a partition the files go, longest first, to a fixed number of output groups, each to the least loaded one of a
   heap. Files arrive as a sorted stream, so only the heap is held; a partition with very many files is cut into shards by hash. A
   file above the target size is cut into pieces that are groups of their own.
3. Stream: each group is sorted by file and record number and streamed through pyarrow into one Parquet file; equal (file, record
   number) neighbours are written once. Each carries the number of stored rows it stands for. A task's every attempt writes under a
   name of its own.
4. Verify and publish: every written file is opened again and its row count compared; for each source file the stored rows that
   arrived must equal those counted in step 1. Only then one rename makes the manifest visible. Readers follow the manifest, so
   leftovers of failed attempts are never read.

Defined results: a listed file without records is in the manifest with 0 records and no output; records of a file that is not listed
go to a partition of null keys; a file listed under two partitions is stored under the first of them in order and counted under both;
of records that share (file, record number), the one with the greatest payload in byte order is kept, a null only if all are null; a
null record number is a record number; listing rows without a file id are ignored.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kolonna.catalog import Files
from kolonna.runtime import chunks, free_name, materialize, shuffle_partitions

TARGET_ROWS = 100_000
#: Files of one partition that one heap schedules.
FILES_PER_SHARD = 200_000
#: Rows of the assignment up to which it is broadcast (some 40 bytes each); beyond that it is joined by a shuffle.
BROADCAST_ROWS = 500_000


def _q(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def longest_first(units: DataFrame) -> DataFrame:
    """LPT scheduling. ``units``: bin_key (a string), bins (int, the same for all units of a key), unit (any), size (bigint).

    Returns unit and slot: ``bin_key`` and the number of the bin. Ties go to the bin of the lowest number, equal sizes by unit.
    """
    schema = T.StructType([units.schema["unit"], T.StructField("slot", T.StringType()), T.StructField("size", T.LongType())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import heapq

        from pyspark.sql.pandas.types import to_arrow_schema

        out, current, heap = to_arrow_schema(schema), None, []
        for batch in batches:
            slots = []
            for key, bins, size in zip(batch.column("bin_key").to_pylist(), batch.column("bins").to_pylist(), batch.column("size").to_pylist()):
                if key != current:
                    current, heap = key, [(0, i) for i in range(bins)]
                load, slot = heap[0]
                heapq.heapreplace(heap, (load + size, slot))
                slots.append(f"{key}/{slot}")
            yield pa.RecordBatch.from_arrays([batch.column("unit"), pa.array(slots, pa.string()), batch.column("size")], schema=out)

    streamed = units.select("bin_key", "bins", "unit", "size").repartition("bin_key").sortWithinPartitions("bin_key", F.desc("size"), "unit")
    return streamed.mapInArrow(assign, schema)


@dataclass
class Compaction:
    """``manifest``: partition keys, file_id, n_records, stored_here, listed, slot, path; a row for each (source file, output file), and for each empty file."""

    folder: str
    manifest: DataFrame

    def records(self, spark: SparkSession) -> DataFrame:
        """The records, read from the published files alone."""
        return read_compacted(spark, self.folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The published manifest of ``folder``."""
    current = json.loads(Files(spark).read(f"{folder}/CURRENT"))
    return spark.read.parquet(f"{folder}/{current['manifest']}")


def read_compacted(spark: SparkSession, folder: str) -> DataFrame:
    """The records of the output files that the published manifest names."""
    paths = read_manifest(spark, folder).where("path is not null").select("path").distinct()
    if paths.isEmpty():
        raise ValueError(f"{folder} holds no records")
    whole = spark.read.parquet(f"{folder}/data")
    known = paths.select(F.regexp_extract("path", "[^/]+$", 0).alias("_file"))
    return whole.withColumn("_file", F.regexp_extract(F.col("_metadata.file_path"), "[^/]+$", 0)).join(known, "_file", "left_semi").drop("_file")


def compact_records(
    listing: DataFrame, records: DataFrame, folder: str, keys: list[str], file_id: str, record_no: str, payload: str, target_rows: int = TARGET_ROWS, files_per_shard: int = FILES_PER_SHARD
) -> Compaction:
    """Write ``records`` (file_id, record_no, payload) into files of about ``target_rows`` rows, grouped by the partition ``keys`` that ``listing`` gives each file."""
    spark = listing.sparkSession
    renamed = [f"k{i}" for i in range(len(keys))]
    listed = listing.where(_q(file_id).isNotNull()).select(*[_q(k).alias(a) for k, a in zip(keys, renamed)], _q(file_id).alias("file")).distinct()
    rows = records.select(_q(file_id).alias("file"), _q(record_no).alias("rid"), _q(payload).alias("payload"))

    # 1. inventory of stored rows, repeats included
    sizes = rows.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    first = Window.partitionBy("file").orderBy(*renamed)
    places = listed.withColumn("home", F.row_number().over(first) == 1)
    files = places.join(sizes.withColumnRenamed("file", "f"), F.col("file").eqNullSafe(F.col("f")), "full")
    files = files.select(*renamed, F.coalesce("file", "f").alias("file"), F.col("home").isNotNull().alias("listed"), F.coalesce("home", F.lit(True)).alias("home"), F.coalesce("n", F.lit(0)).alias("n"))
    files = materialize(files, "inventory")

    # 2. schedule
    part = F.concat_ws("\x01", *[F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit("-")) for k in renamed])
    filled = files.where("home and n > 0").withColumn("part", F.hex(F.xxhash64(part)))
    fit = filled.where(F.col("n") <= target_rows)
    shards = fit.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / F.lit(files_per_shard)).alias("shards"))
    units = fit.join(shards, "part").withColumn("bin_key", F.concat_ws("-", "part", F.pmod(F.xxhash64("file"), F.col("shards")).cast("string")))
    loads = units.groupBy("bin_key").agg(F.greatest(F.lit(1), F.ceil(F.sum("n") / F.lit(target_rows))).cast("int").alias("bins"))
    slots = longest_first(units.join(loads, "bin_key").select("bin_key", "bins", F.col("file").alias("unit"), F.col("n").alias("size")))
    slots = slots.select(F.col("unit").alias("file"), "slot", F.lit(1).alias("pieces"))
    large = filled.where(F.col("n") > target_rows).select("file", F.concat_ws("/", "part", F.lit("f"), F.hex(F.xxhash64("file"))).alias("slot"), F.ceil(F.col("n") / F.lit(target_rows)).cast("int").alias("pieces"))
    assignment = materialize(slots.unionByName(large), "assignment")

    # 3. stream
    small = assignment.count() <= BROADCAST_ROWS
    to = F.broadcast(assignment) if small else assignment
    counted = T.StructType([*rows.schema, T.StructField("times", T.LongType())])
    placed = rows.mapInArrow(_without_repeats, counted).join(to.withColumnRenamed("file", "f"), F.col("file").eqNullSafe(F.col("f")))
    placed = placed.select(F.when(F.col("pieces") > 1, F.concat_ws("/", "slot", F.pmod(F.xxhash64("rid"), F.col("pieces")).cast("string"))).otherwise(F.col("slot")).alias("slot"), "file", "rid", "payload", "times")
    ordered = placed.repartition(shuffle_partitions(spark), "slot").sortWithinPartitions("slot", "file", "rid", F.desc_nulls_last("payload"))
    Files(spark).make(f"{folder}/data")
    names = (file_id, record_no, payload)
    written = materialize(ordered.mapInArrow(_writer(f"{folder}/data", names), T.StructType([T.StructField("slot", T.StringType()), T.StructField("path", T.StringType()), T.StructField("file", rows.schema["file"].dataType), T.StructField("written", T.LongType()), T.StructField("arrived", T.LongType())])), "written")

    # 4. verify and publish
    total = written.groupBy(F.col("file").alias("g")).agg(F.sum("written").alias("total"), F.sum("arrived").alias("arrived"))
    homes = files.where("home").select("file", "n")
    wrong = homes.join(total, F.col("file").eqNullSafe(F.col("g")), "full").where(F.coalesce("n", F.lit(0)) != F.coalesce("arrived", F.lit(0))).count()
    if wrong:
        raise RuntimeError(f"compaction not published: of {wrong} source files not all rows arrived")
    # a file that spans several batches of a task is one row again
    outputs = written.groupBy("slot", "path", F.col("file").alias("h")).agg(F.sum("written").alias("written"))
    manifest = files.join(outputs, F.col("home") & F.col("file").eqNullSafe(F.col("h")), "left").join(total.select("g", "total"), ~F.col("home") & F.col("file").eqNullSafe(F.col("g")), "left")
    taken = [*keys, file_id]
    columns = [F.col(a).alias(k) for a, k in zip(renamed, keys)] + [F.col("file").alias(file_id)]
    columns += [F.coalesce("written", "total", F.lit(0)).alias(free_name("n_records", taken)), F.col("home").alias(free_name("stored_here", taken)), F.col("listed").alias(free_name("listed", taken)), F.col("slot").alias(free_name("slot", taken)), F.col("path").alias(free_name("path", taken))]
    name = f"manifest-{uuid.uuid4().hex}"
    manifest.select(*columns).write.parquet(f"{folder}/{name}")
    Files(spark).write(f"{folder}/CURRENT", json.dumps({"manifest": name}))
    return Compaction(folder, read_manifest(spark, folder))


def _without_repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact repeats within a chunk as one row with their number, so that a record repeated without end does not travel; the rest of the repeats meet in the stream."""
    for table in chunks(batches, 1 << 17):
        names = table.column_names
        yield from table.group_by(names, use_threads=False).aggregate([([], "count_all")]).select([*names, "count_all"]).rename_columns([*names, "times"]).to_batches()


def open_folder(folder: str) -> tuple:
    """pyarrow's file system of a path that Spark uses, and the path in it."""
    import pyarrow.fs as pafs

    scheme, found, rest = folder.partition("://")
    if not found or scheme == "file":
        plain = rest if found else folder.removeprefix("file:")
        return pafs.LocalFileSystem(), "/" + plain.lstrip("/")
    # only the root is parsed as a URI: partition values can hold any character
    host, _, path = rest.partition("/")
    fs, base = pafs.FileSystem.from_uri(f"{'s3' if scheme == 's3a' else scheme}://{host}/")
    return fs, f"{base.rstrip('/')}/{path}"


def _writer(folder: str, names: tuple[str, str, str]):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        fs, root = open_folder(folder)
        out = None
        state: dict = {"slot": None}

        def close() -> Iterator[pa.RecordBatch]:
            state["writer"].close()
            with fs.open_input_file(state["path"]) as f:
                found = pq.ParquetFile(f).metadata.num_rows
            files = pa.chunked_array(state["files"]).combine_chunks()
            counts, arrived = (np.concatenate(state[k]) for k in ("counts", "arrived"))
            if found != counts.sum():
                raise RuntimeError(f"{state['path']} holds {found} rows, {counts.sum()} were written")
            yield pa.RecordBatch.from_arrays([pa.array([state["slot"]] * len(files), pa.string()), pa.array([state["path"]] * len(files), pa.string()), files, pa.array(counts, pa.int64()), pa.array(arrived, pa.int64())], schema=out)

        def codes(column: pa.Array) -> np.ndarray:
            return column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)

        last = None  # (slot, file, rid) written last
        for batch in batches:
            if not batch.num_rows:
                continue
            kind = batch.schema
            if out is None:
                out = pa.schema([("slot", pa.string()), ("path", pa.string()), ("file", kind.field("file").type), ("written", pa.int64()), ("arrived", pa.int64())])
            slot, file, rid = (codes(batch.column(i)) for i in range(3))
            times = batch.column(4).to_numpy()
            new_slot = np.r_[True, slot[1:] != slot[:-1]]
            new_file = new_slot | np.r_[True, file[1:] != file[:-1]]
            keep = new_file | np.r_[True, rid[1:] != rid[:-1]]
            if last is not None and last == tuple(batch.column(i)[0].as_py() for i in range(3)):
                keep[0] = False
            last = tuple(batch.column(i)[batch.num_rows - 1].as_py() for i in range(3))
            starts = np.flatnonzero(new_slot)
            for a, b in zip(starts, np.r_[starts[1:], batch.num_rows]):
                name = batch.column(0)[int(a)].as_py()
                if name != state["slot"]:
                    if state["slot"] is not None:
                        yield from close()
                    path = f"{root}/{name.replace('/', '_')}-{uuid.uuid4().hex}.parquet"
                    shape = pa.schema([pa.field(n, kind.field(i + 1).type) for i, n in enumerate(names)])
                    state |= {"slot": name, "path": path, "shape": shape, "writer": pq.ParquetWriter(path, shape, filesystem=fs, compression="zstd"), "files": [], "counts": [], "arrived": []}
                kept = keep[a:b]
                part = pa.Table.from_batches([batch.slice(a, b - a)]).filter(pa.array(kept))
                if part.num_rows:
                    # columns that can not be null come as such
                    state["writer"].write_table(part.select([1, 2, 3]).rename_columns(list(names)).cast(state["shape"]))
                begin = np.flatnonzero(new_file[a:b])
                if not len(begin) or begin[0]:
                    begin = np.r_[0, begin]
                state["files"].append(batch.column(1).take(pa.array(begin + a)))
                state["counts"].append(np.add.reduceat(kept.astype(np.int64), begin))
                state["arrived"].append(np.add.reduceat(times[a:b], begin))
        if state["slot"] is not None:
            yield from close()

    return write
