"""Continuous loading: the batch loader of :mod:`kolonna.sources.ingest` over a stream of arriving files."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from kolonna.catalog import Catalog
from kolonna.sources.decoders import LINE, json_decoder
from kolonna.sources.ingest import _decoded, write_rows
from kolonna.table import Table

#: The record of a stream before its first batch.
NOTHING = {"batch": -1, "rows": 0, "rejected": 0}


def follow(spark: SparkSession, table: Table, folder: str, checkpoint: str, decoder: Callable[[Any], dict] | None = None, preprocess: Callable | None = None, once: bool = False) -> StreamingQuery:
    """Append every text file that arrives in ``folder`` to a stored table, each exactly once.

    Spark's checkpoint says which files belong to a batch. A batch is written as a segment of its own; the version of the table that
    names the segment also says that the stream is past this batch, so one that runs again after a failure is either written anew or
    skipped. Lines that can not be decoded or converted are left out and counted (:func:`followed`). ``once`` loads what is there and ends.
    """
    names = [f.name for f in table._fields]
    lines = spark.readStream.schema(T.StructType([T.StructField(LINE, T.StringType())])).text(folder)
    rows = _decoded(lines, names, decoder or json_decoder, preprocess, table._fields)
    mark = _mark(checkpoint)

    def append(batch: DataFrame, number: int) -> None:
        catalog = Catalog(spark)
        if catalog.state(table._name)["streams"].get(mark, NOTHING)["batch"] >= number:
            return
        segment, where = catalog.new_segment(table._name)
        count = write_rows(batch, table, where)

        def add(state: dict) -> dict:
            before = state["streams"].get(mark, NOTHING)
            after = {"batch": number, "rows": before["rows"] + count["rows"], "rejected": before["rejected"] + count["rejected"]}
            return state | {"segments": state["segments"] + [segment] * bool(count["rows"]), "streams": state["streams"] | {mark: after}}

        catalog.commit(table._name, add)

    stream = rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(append)
    return (stream.trigger(availableNow=True) if once else stream).start()


def followed(spark: SparkSession, table: Table, checkpoint: str) -> dict[str, int]:
    """What the stream of ``checkpoint`` has loaded so far: its last batch, its rows and the lines that were left out."""
    return Catalog(spark).state(table._name)["streams"].get(_mark(checkpoint), NOTHING)


def _mark(checkpoint: str) -> str:
    return uuid.uuid5(uuid.NAMESPACE_URL, checkpoint.rstrip("/")).hex
