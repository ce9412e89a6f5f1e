"""Stored tables: a folder each, with its definition as JSON and its rows as Parquet, partitioned by the partition column.

Rows lie in segments, folders that are written whole and never added to: one a load. A numbered version file names the segments that
make up the table, and a change is the next version, which only one writer can create: a load adds its segment, compaction puts one
in the place of those it has read, and a writer that comes second starts from the version it finds. Readers take the segments of one
version. Segments that were replaced or deleted stay for a while (:meth:`Catalog.vacuum`), for readers that have planned on them.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable, Iterable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kolonna import printing
from kolonna.expr import Predicate
from kolonna.schema import Field, derived_field, parse_fields
from kolonna.settings import Settings
from kolonna.table import Table

DEFINITION = "table.json"
#: The folder level of segments, a partition column to Spark. Older versions that are kept.
SEGMENT, KEPT_VERSIONS = "_kolonna_segment", 50
#: Seconds for which segments that are no longer part of a table are kept.
RETAIN = 3600.0
#: Seconds after which a segment that no version has named is that of a load that failed.
ABANDONED = 7 * 86400.0
#: Where a file system renames over an existing file without notice (the local one does), writers of one process still take turns.
_turn = threading.Lock()


class Files:
    """The few file operations a catalog needs, on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession) -> None:
        self._jvm, self._conf, self._gateway = spark._jvm, spark._jsc.hadoopConfiguration(), spark.sparkContext._gateway

    def _at(self, path: str) -> tuple:
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self._conf)

    def exists(self, path: str) -> bool:
        p, fs = self._at(path)
        return fs.exists(p)

    def changed(self, path: str) -> float:
        """When a path was last changed, in seconds of the epoch."""
        p, fs = self._at(path)
        return fs.getFileStatus(p).getModificationTime() / 1000

    def make(self, path: str) -> None:
        p, fs = self._at(path)
        fs.mkdirs(p)

    def delete(self, path: str) -> None:
        p, fs = self._at(path)
        fs.delete(p, True)

    def names(self, path: str, folders: bool) -> list[str]:
        p, fs = self._at(path)
        if not fs.exists(p):
            return []
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory() == folders)

    def files(self, path: str) -> set[str]:
        p, fs = self._at(path)
        if not fs.exists(p):
            return set()
        found, walk = set(), fs.listFiles(p, True)
        while walk.hasNext():
            at = walk.next().getPath()
            if at.getName().endswith(".parquet"):
                found.add(at.toString())
        return found

    def read(self, path: str) -> str:
        p, fs = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """All or nothing: written aside, then renamed into place."""
        self._rename(self._draft(path, text), path, True)

    def write_new(self, path: str, text: str) -> bool:
        """The same for a path that must not be there yet; False if it is."""
        if self.exists(path):
            return False
        draft = self._draft(path, text)
        try:
            self._rename(draft, path, False)
        except Py4JJavaError as error:
            self._at(path)[1].delete(draft, False)
            if "FileAlreadyExistsException" in str(error.java_exception.getClass()):
                return False
            raise
        return True

    def _draft(self, path: str, text: str) -> object:
        p, fs = self._at(path)
        draft = self._jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{uuid.uuid4().hex}")
        stream = fs.create(draft, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        return draft

    def _rename(self, draft: object, path: str, over: bool) -> None:
        """One atomic rename."""
        hadoop, target = self._jvm.org.apache.hadoop.fs, self._at(path)[0]
        options = self._gateway.new_array(hadoop.Options.Rename, 1)
        options[0] = hadoop.Options.Rename.OVERWRITE if over else hadoop.Options.Rename.NONE
        hadoop.FileContext.getFileContext(target.toUri(), self._conf).rename(draft, target, options)


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def segment_folder(location: str, segment: str) -> str:
    return f"{location}/data/{SEGMENT}={segment}"


def latest(files: Files, location: str) -> tuple[int, dict]:
    """(number, content) of the current version of a table: its segments, those that were replaced and when, how often rows were deleted, what streams have loaded."""
    found = [n for n in files.names(f"{location}/versions", False) if n.endswith(".json") and not n.startswith(".")]
    if not found:
        return 0, {"segments": [], "retired": [], "deletes": 0, "streams": {}}
    return int(found[-1].removesuffix(".json")), json.loads(files.read(f"{location}/versions/{found[-1]}"))


def read_segments(spark: SparkSession, location: str, segments: list[str], fields: list[Field], partition: str | None) -> DataFrame:
    """The rows of some segments as their files hold them."""
    kinds = [T.StructField(f.name, f.type) for f in fields if f.name != partition] + [T.StructField(SEGMENT, T.StringType())]
    schema = T.StructType(kinds + ([T.StructField(partition, T.StringType())] if partition else []))
    if not segments:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{location}/data").parquet(*[segment_folder(location, s) for s in segments])


def stored_frame(spark: SparkSession, location: str, fields: list[Field], partition: str | None, evolved: Iterable[str] = ()) -> DataFrame:
    """The rows of a stored table. Columns that older files lack hold their default; a missing partition value is the empty string."""
    frame = read_segments(spark, location, latest(Files(spark), location)[1]["segments"], fields, partition)
    late = set(evolved)
    shown = []
    for f in fields:
        column = F.col(_q(f.name))
        if f.name == partition:
            column = F.coalesce(column, F.lit(""))
        elif f.name in late and f.default is not None:
            # only these: a default over every column would keep filters from the Parquet reader
            column = F.coalesce(column, F.lit(f.default).cast(f.type))
        shown.append(column.alias(f.name))
    return frame.select(*shown)


class Catalog:
    """The stored tables of one warehouse folder: ``kolonna.warehouse`` of the session, else a folder in Spark's warehouse."""

    def __init__(self, spark: SparkSession, warehouse: str | None = None) -> None:
        self.spark, self.files = spark, Files(spark)
        set_to = warehouse or Settings.of().warehouse or spark.conf.get("kolonna.warehouse", None)
        self.root = (set_to or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/kolonna").rstrip("/")

    def location(self, name: str) -> str:
        """The folder of a table."""
        if not name or "/" in name or name.startswith("."):
            raise ValueError(f"{name!r} is no table name")
        return f"{self.root}/{name}"

    def state(self, name: str) -> dict:
        """The content of a table's current version."""
        return latest(self.files, self.location(name))[1]

    def commit(self, name: str, change: Callable[[dict], dict]) -> dict:
        """Make ``change`` of the current version the next one. It is asked anew if another writer comes first, and may raise to give up."""
        location = self.location(name)
        with _turn:
            while True:
                number, state = latest(self.files, location)
                new = change(json.loads(json.dumps(state)))
                if self.files.write_new(f"{location}/versions/{number + 1:012d}.json", json.dumps(new)):
                    break
        if number > KEPT_VERSIONS:
            self.files.delete(f"{location}/versions/{number - KEPT_VERSIONS:012d}.json")
        return new

    def new_segment(self, name: str) -> tuple[str, str]:
        """(segment, its folder) for rows to be written and then added."""
        segment = uuid.uuid4().hex
        return segment, segment_folder(self.location(name), segment)

    def add_segment(self, name: str, segment: str) -> None:
        self.commit(name, lambda state: state | {"segments": [*state["segments"], segment]})

    def vacuum(self, name: str, retain: float = RETAIN, abandoned: float = ABANDONED) -> int:
        """Remove the segments that left the table more than ``retain`` seconds ago, and those of loads that never ended, after ``abandoned`` seconds; returns their number."""
        state, location = self.state(name), self.location(name)
        due = [s for s, at in state["retired"] if at <= time.time() - retain]
        known = {*state["segments"], *(s for s, _ in state["retired"])}
        folders = [n for n in self.files.names(f"{location}/data", True) if n.startswith(f"{SEGMENT}=")]
        due += [s for s in (n.partition("=")[2] for n in folders) if s not in known and self.files.changed(segment_folder(location, s)) <= time.time() - abandoned]
        for segment in due:
            self.files.delete(segment_folder(location, segment))
        if due:
            self.commit(name, lambda state: state | {"retired": [r for r in state["retired"] if r[0] not in due]})
        return len(due)

    def folders(self, name: str, partition: str, value: str) -> list[str]:
        """The folders that can hold rows of one partition."""
        return [f"{segment_folder(self.location(name), s)}/{partition}={self._escaped(value)}" for s in self.state(name)["segments"]]

    def _escaped(self, value: str) -> str:
        return self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(value) if value else "__HIVE_DEFAULT_PARTITION__"

    def _unescaped(self, value: str) -> str:
        if value == "__HIVE_DEFAULT_PARTITION__":
            return ""
        return self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(value)

    def create(self, name: str, columns: Iterable[str] = (), fields: Iterable[Field] = (), partition: str | None = None, force: bool = False) -> Table | None:
        """Define a table. A name in use gives None, unless ``force``: that replaces the definition and keeps the rows."""
        parsed = parse_fields([*columns, *fields], partition)
        if not parsed:
            raise ValueError("a table has columns")
        if any(f.name.lower() == SEGMENT for f in parsed):
            raise ValueError(f"{SEGMENT} is no name for a column")
        path = f"{self.location(name)}/{DEFINITION}"
        evolved: list[str] = []
        if self.files.exists(path):
            if not force:
                return None
            old = json.loads(self.files.read(path))
            known = {f["name"] for f in old["fields"]}
            evolved = sorted({*old["evolved"]} | {f.name for f in parsed if f.name not in known})
        self.files.write(path, json.dumps({"fields": [f.to_json() for f in parsed], "partition": partition, "evolved": evolved}))
        return self.open(name)

    def find(self, name: str) -> Table | None:
        path = f"{self.location(name)}/{DEFINITION}"
        if not self.files.exists(path):
            return None
        held = json.loads(self.files.read(path))
        fields, location = [Field.from_json(f) for f in held["fields"]], self.location(name)
        return Table(name, fields, held["partition"], lambda: stored_frame(self.spark, location, fields, held["partition"], held["evolved"]), location, held["evolved"])

    def open(self, name: str) -> Table:
        table = self.find(name)
        if table is None:
            raise ValueError(f"there is no table {name}")
        return table

    def save(self, name: str, frame: DataFrame) -> Table:
        """Store the rows of a query as a new table."""
        if self.find(name) is not None:
            raise ValueError(f"there is a table {name} already")
        fields = [derived_field(f.name, f.dataType) for f in frame.schema]
        segment, folder = self.new_segment(name)
        frame.write.mode("errorifexists").parquet(folder)
        self.add_segment(name, segment)
        return self.create(name, fields=fields)

    def names(self) -> list[str]:
        """All tables."""
        return [n for n in self.files.names(self.root, True) if self.files.exists(f"{self.root}/{n}/{DEFINITION}")]

    def partitions(self, table: Table | str) -> list[str]:
        """The values of the partition column that hold rows."""
        table = self.open(table) if isinstance(table, str) else table
        if table._partition is None:
            return []
        mark = f"{table._partition}="
        location = self.location(table._name)
        held = {n for s in self.state(table._name)["segments"] for n in self.files.names(segment_folder(location, s), True)}
        return sorted(self._unescaped(n[len(mark) :]) for n in held if n.startswith(mark))

    def delete(self, what: Table | Predicate) -> list[str]:
        """Delete all rows, or the partitions that a condition on the partition column alone selects; the definition stays."""
        if isinstance(what, Table):
            values = self.partitions(what)
            self.commit(what._name, lambda state: state | {"segments": [], "retired": [*state["retired"], *([s, time.time()] for s in state["segments"])], "deletes": state["deletes"] + 1})
            return values
        if not isinstance(what, Predicate):
            raise ValueError("delete takes a table or a condition")
        if not what.partition_only:
            raise ValueError("the condition may use the partition column only")
        table = what.table
        values = self.partitions(table)
        if not values:
            return []
        listing = self.spark.createDataFrame([(v,) for v in values], T.StructType([T.StructField(table._partition, T.StringType())]))
        gone = [r[0] for r in listing.where(what.spark(lambda n: F.col(_q(n)))).collect()]
        if not gone:
            return []
        # counted before and after: a compaction that read any of these rows gives up
        count = lambda state: state | {"deletes": state["deletes"] + 1}
        self.commit(table._name, count)
        for folder in (f for value in gone for f in self.folders(table._name, table._partition, value)):
            self.files.delete(folder)
        self.commit(table._name, count)
        return sorted(gone)

    def drop(self, table: Table) -> None:
        """Delete rows and definition."""
        if not isinstance(table, Table):
            raise ValueError("drop takes a table")
        self.files.delete(self.location(table._name))


def _catalog(spark: SparkSession | None = None) -> Catalog:
    return Catalog(spark or SparkSession.active())


def create(name: str, columns: Iterable[str] = (), fields: Iterable[Field] = (), partition: str | None = None, force: bool = False) -> Table | None:
    return _catalog().create(name, columns, fields, partition, force)


def open_table(name: str) -> Table | None:
    return _catalog().find(name)


def delete(what: Table | Predicate) -> list[str]:
    return _catalog().delete(what)


def drop(table: Table) -> None:
    _catalog().drop(table)


def get_tables() -> list[str]:
    return _catalog().names()


def save(name: str, table: Table) -> Table:
    """Store a nested result under a name of its own."""
    return _catalog().save(name, table.frame)


def tables() -> None:
    """Print all tables."""
    printing.columns(get_tables())


def get_partitions(table: Table | str) -> list[str]:
    return _catalog().partitions(table)


def partitions(table: Table | str) -> None:
    """Print the partitions of a table."""
    printing.columns(get_partitions(table), width=132)


def describe(table: Table | str, index_only: bool = False) -> list[str]:
    """Sorted descriptions of a table's columns."""
    table = _catalog().open(table) if isinstance(table, str) else table
    return sorted(f.description for f in table._fields if f.index or not index_only)


def schema(table: Table | str, index_only: bool = False) -> None:
    """Print the columns of a table."""
    printing.columns(describe(table, index_only), width=100)
