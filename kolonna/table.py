"""Tables: a name, typed fields, perhaps a partition column, and a DataFrame of the rows."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession

from kolonna.expr import Column
from kolonna.schema import Field, derived_field, parse_fields


class Table:
    """A named relation of a fixed schema. Its columns are attributes (``table.ad_id``) and items (``table["ad_id"]``).

    A column that is named like a method (``frame``, ``dumps``, ``loads``, ``from_frame``, ``from_parquet``) is reached as an item.
    """

    def __init__(self, name: str, fields: Iterable[str | Field], partition: str | None = None, source: DataFrame | Callable[[], DataFrame] | None = None, location: str | None = None, evolved: Iterable[str] = ()) -> None:
        self._name = name
        self._fields = parse_fields(fields, partition)
        self._partition = partition
        self._location = location
        self._evolved = list(evolved)  # columns that older files lack
        self._source = source
        self._columns = {f.name: Column(self, f) for f in self._fields}

    def __getattr__(self, name: str) -> Column:
        columns = self.__dict__.get("_columns")
        if columns is None or name not in columns:
            raise AttributeError(f"table {self.__dict__.get('_name')} has no column {name}")
        return columns[name]

    def __getitem__(self, name: str) -> Column:
        return self._columns[name]

    @property
    def frame(self) -> DataFrame:
        """All rows, lazily."""
        if self._source is None:
            raise ValueError(f"table {self._name} has no data attached")
        return self._source() if callable(self._source) else self._source

    @classmethod
    def from_frame(cls, name: str, frame: DataFrame, fields: Iterable[str | Field] | None = None, partition: str | None = None) -> Table:
        """A table over a DataFrame; without ``fields`` every column keeps its Spark type and takes part in every predicate."""
        if fields is None:
            fields = [derived_field(f.name, f.dataType) for f in frame.schema]
        return cls(name, fields, partition, frame)

    @classmethod
    def from_parquet(cls, spark: SparkSession, name: str, path: str, fields: Iterable[str | Field] | None = None, partition: str | None = None) -> Table:
        return cls.from_frame(name, spark.read.parquet(path), fields, partition)

    def __iter__(self) -> Iterator[tuple]:
        """All rows as tuples, partition by partition."""
        for row in self.frame.select(*["`" + f.name.replace("`", "``") + "`" for f in self._fields]).toLocalIterator():
            yield tuple(row)

    def dumps(self) -> str:
        """The handle as JSON: name, fields, partition and where the rows are stored."""
        return json.dumps({"name": self._name, "fields": [f.to_json() for f in self._fields], "partition": self._partition, "location": self._location, "evolved": self._evolved})

    @classmethod
    def loads(cls, text: str, spark: SparkSession | None = None) -> Table:
        """The handle of :meth:`dumps`; rows of a stored table are read again."""
        held = json.loads(text)
        fields = [Field.from_json(f) for f in held["fields"]]
        source = None
        if held["location"] and spark is not None:
            from kolonna.catalog import stored_frame

            location = held["location"]
            source = lambda: stored_frame(spark, location, fields, held["partition"], held["evolved"])
        return cls(held["name"], fields, held["partition"], source, held["location"], held["evolved"])

    def __repr__(self) -> str:
        return f"<table {self._name}: {', '.join(f.description for f in self._fields)}>"


def star(table: Table) -> list[Column]:
    """All columns of a table in the order of its declaration."""
    return [table._columns[f.name] for f in table._fields]
