"""Bulk loading: lines or records are decoded, preprocessed, filtered, converted to the table's types and appended as Parquet."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from typing import Any, NamedTuple

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kolonna.catalog import Catalog, Files
from kolonna.runtime import scratch_path
from kolonna.schema import Field
from kolonna.sources.decoders import BROKEN, LINE, Decoder, JsonDecoder, json_decoder
from kolonna.table import Table

#: Records of an iterable that go to one file of the spool.
BATCH = 50_000


class Inserted(NamedTuple):
    table: str
    rows: int
    files: list[str]
    rejected: int


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _as_text(value: Any) -> str | None:
    """A decoded value as the text that conversion starts from."""
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).decode("latin-1")
    return json.dumps(value) if isinstance(value, (bool, list, dict)) else str(value)


def _per_record(lines: DataFrame, names: list[str], decode: Callable[[Any], dict], preprocess: Callable[[dict], Any] | None) -> DataFrame:
    """Decode and preprocess with Python functions, in Arrow batches. A record that raises is broken; one that preprocess refuses is gone."""
    import pandas as pd

    schema = T.StructType([*[T.StructField(n, T.StringType()) for n in names], T.StructField(BROKEN, T.BooleanType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            kept: list[list] = []
            for line in batch[LINE]:
                try:
                    record = decode(line)
                    if preprocess is not None:
                        verdict = preprocess(record)
                        if verdict is not None and not verdict:
                            continue
                    kept.append([*(_as_text(record.get(n)) for n in names), False])
                except Exception:
                    kept.append([*([None] * len(names)), True])
            yield pd.DataFrame(kept, columns=schema.names)

    return lines.mapInPandas(run, schema)


def converted(field: Field, text: SparkColumn) -> tuple[SparkColumn, SparkColumn]:
    """(value, whether the text is wrong for the field). Missing and falsy values become the field's default."""
    if field.bounds is not None:
        low, high = field.bounds
        wide = "decimal(20,0)" if high > (1 << 63) - 1 else "bigint"
        plain = F.trim(text)
        number = F.coalesce(plain.try_cast(wide), F.when(F.lower(plain) == "true", F.lit(1).cast(wide)), F.when(F.lower(plain) == "false", F.lit(0).cast(wide)), F.floor(F.abs(plain.try_cast("double"))).try_cast(wide) * F.when(plain.startswith("-"), -1).otherwise(1))
        missing = text.isNull() | (plain == "")
        wrong = ~missing & (number.isNull() | (number < F.lit(low)) | (number > F.lit(high)))
        return F.when(missing, F.lit(0)).otherwise(number).try_cast(field.type), wrong
    if field.kind == "binary":
        return F.coalesce(F.encode(text, "ISO-8859-1"), F.lit(bytearray())), F.lit(False)
    if isinstance(field.type, T.StringType):
        return F.coalesce(text, F.lit("")), F.lit(False)
    return text.try_cast(field.type), text.isNotNull() & text.try_cast(field.type).isNull()


def converted_frame(decoded: DataFrame, fields: list[Field]) -> DataFrame:
    """Every column in its type, and BROKEN where a value is wrong."""
    pairs = {f.name: converted(f, F.col(_q(f.name)).cast("string")) for f in fields}
    broken = F.coalesce(F.col(BROKEN), F.lit(False))
    for _, wrong in pairs.values():
        broken = broken | F.coalesce(wrong, F.lit(False))
    return decoded.select(*[value.alias(name) for name, (value, _) in pairs.items()], broken.alias(BROKEN))


def insert(
    table: Table,
    file: str | list[str] | None = None,
    streams: Iterable[Iterable] | None = None,
    frame: DataFrame | None = None,
    preprocess: Callable | None = None,
    decoder: Callable[[Any], dict] | None = None,
    header: bool = False,
    partition_filter: Any = None,
    spark: SparkSession | None = None,
) -> Inserted:
    """Append to a stored table from files (read by the executors), from iterables of lines or records, or from a DataFrame.

    ``decoder`` is one of :mod:`kolonna.sources.decoders` (JSON by default) or any function from a line to a dict. ``preprocess``
    changes each dict in place and drops it by a falsy answer other than None; over a DataFrame without decoder it maps the frame.
    ``partition_filter`` keeps only these partition values. Lines that can not be decoded or converted are left out and counted.
    """
    spark = spark or SparkSession.active()
    catalog = Catalog(spark)
    fields, names = table._fields, [f.name for f in table._fields]
    decode = decoder or json_decoder
    if frame is not None:
        frame = preprocess(frame) if preprocess is not None else frame
        have = {c.lower() for c in frame.columns}
        decoded = frame.select(*[(F.col(_q(n)) if n.lower() in have else F.lit(None)).cast("string").alias(n) for n in names], F.lit(False).alias(BROKEN))
        return _append(catalog, table, converted_frame(decoded, fields), partition_filter)
    if file is not None:
        lines = text_lines(spark, file, header)
        return _append(catalog, table, _decoded(lines, names, decode, preprocess, fields), partition_filter)
    if streams is None:
        raise ValueError("nothing to insert")
    lines, records = _spooled(spark, streams, names, decode, preprocess, header)
    parts = [_decoded(lines, names, decode, preprocess, fields)] if lines is not None else []
    parts += [converted_frame(records, fields)] if records is not None else []
    if not parts:
        return Inserted(table._name, 0, [], 0)
    return _append(catalog, table, parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]), partition_filter)


def text_lines(spark: SparkSession, file: str | list[str], header: bool = False) -> DataFrame:
    """The lines of text files; with ``header`` without the first line of each."""
    if not header:
        return spark.read.text(file)
    # Spark's CSV reader knows where a file begins: one column, no quoting, a delimiter that no text has
    shape = T.StructType([T.StructField(LINE, T.StringType())])
    return spark.read.schema(shape).csv(file, sep="\u0001", header=True, enforceSchema=True, quote="", escape="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).where(F.col(LINE).isNotNull())


def _decoded(lines: DataFrame, names: list[str], decode: Callable[[Any], dict], preprocess: Callable | None, fields: list[Field]) -> DataFrame:
    native = isinstance(decode, Decoder) and preprocess is None and type(decode).native is not Decoder.native
    if native and (not isinstance(decode, JsonDecoder) or len({n.lower() for n in names}) == len(names)):
        return converted_frame(decode.native(lines, names), fields)
    return converted_frame(_per_record(lines, names, decode, preprocess), fields)


def _spooled(spark: SparkSession, streams: Iterable[Iterable], names: list[str], decode: Callable[[Any], dict], preprocess: Callable | None, header: bool) -> tuple[DataFrame | None, DataFrame | None]:
    """(lines, decoded records) of iterables, written to the shared folder as they come, so that they are loaded at once whatever their number.

    Records that are no lines are decoded here.
    """
    folder, made, at = scratch_path(spark, "spool"), {"lines": 0, "records": 0}, []
    whole = T.StructType([*[T.StructField(n, T.StringType()) for n in names], T.StructField(BROKEN, T.BooleanType())])

    def flush() -> None:
        for kind in made:
            mine = [row for k, row in at if k == kind]
            if mine:
                made[kind] += 1
                Files(spark).write(f"{folder}/{kind}/{made[kind]:06d}.json", "\n".join(mine))
        at.clear()

    for stream in streams:
        for place, line in enumerate(stream):
            if header and not place:
                continue
            if isinstance(line, (str, bytes)):
                at.append(("lines", json.dumps({LINE: line.decode() if isinstance(line, bytes) else line})))
            elif (record := _record(line, names, decode, preprocess)) is not None:
                at.append(("records", json.dumps(record)))
            if len(at) == BATCH:
                flush()
    flush()
    shapes = {"lines": T.StructType([T.StructField(LINE, T.StringType())]), "records": whole}
    found = [spark.read.schema(shapes[kind]).json(f"{folder}/{kind}") if made[kind] else None for kind in shapes]
    return found[0], found[1]


def _record(record: Any, names: list[str], decode: Callable[[Any], dict], preprocess: Callable | None) -> dict | None:
    """The columns of a record as text, or that it is broken; None if ``preprocess`` refuses it."""
    try:
        held = record if isinstance(record, dict) and isinstance(decode, JsonDecoder) else decode(record)
        verdict = preprocess(held) if preprocess is not None else None
        if verdict is not None and not verdict:
            return None
        return {n: _as_text(held.get(n)) for n in names} | {BROKEN: False}
    except Exception:
        return {BROKEN: True}


def _append(catalog: Catalog, table: Table, rows: DataFrame, partition_filter: Any) -> Inserted:
    if partition_filter is not None and table._partition is not None:
        single = isinstance(partition_filter, str) or not hasattr(partition_filter, "__iter__")
        wanted = [str(v) for v in ([partition_filter] if single else partition_filter)]
        rows = rows.where(F.col(BROKEN) | (F.col(_q(table._partition)).isin(wanted) if wanted else F.lit(False)))
    segment, folder = catalog.new_segment(table._name)
    counted = write_rows(rows, table, folder)
    if counted["rows"]:
        catalog.add_segment(table._name, segment)
    return Inserted(table._name, counted["rows"], sorted(catalog.files.files(folder)) if counted["rows"] else [], counted["rejected"])


def write_rows(rows: DataFrame, table: Table, folder: str) -> dict[str, int]:
    """Write what is not broken to a new folder; the numbers of ``rows`` written and ``rejected``."""
    seen = Observation()
    good = rows.observe(seen, F.count(F.when(~F.col(BROKEN), 1)).alias("rows"), F.count(F.when(F.col(BROKEN), 1)).alias("rejected")).where(~F.col(BROKEN)).drop(BROKEN)
    if table._partition is not None:
        # one well-sized file a partition instead of one a task and partition; AQE splits partitions that are too large for that
        good = good.hint("rebalance", table._partition)
    writer = good.write.mode("errorifexists").option("compression", "zstd")
    if table._partition is not None:
        writer = writer.partitionBy(table._partition)
    writer.parquet(folder)
    return seen.get
