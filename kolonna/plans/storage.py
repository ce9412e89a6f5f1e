"""Queries of loading, storing and deleting: each works on tables of its own in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kolonna.catalog import Catalog, describe
from kolonna.operators.small_files import compact_table
from kolonna.plans.query import select
from kolonna.plans.registry import Registry, table
from kolonna.plans.relational import EV, LI, OD, events, lineitem, orders
from kolonna.functions.aggregates import h_count, h_sum
from kolonna.runtime import scratch_path
from kolonna.settings import overrides
from kolonna.sources.decoders import csv_decoder, fixed_width_decoder, kv_decoder
from kolonna.sources.ingest import insert
from kolonna.table import Table

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


def loaded(spark: SparkSession, columns: list[str], partition: str | None = None, **how) -> Table:
    """A new table in a warehouse of its own, filled once."""
    held = overrides.get("warehouse")
    overrides["warehouse"] = scratch_path(spark, "warehouse")
    try:
        catalog = Catalog(spark)
        made = catalog.create("loaded", columns, partition=partition)
        insert(made, spark=spark, **how)
        return catalog.open("loaded")
    finally:
        overrides["warehouse"] = held


def text_file(spark: SparkSession, lines: DataFrame) -> str:
    path = scratch_path(spark, "lines")
    lines.write.text(path)
    return path


EVENTS = ["index int64 event_id", "index trie event_type", "index int64 user_id", "index bit is_error", "index uint32 ip", "index string day"]


@query(f"with {EV} select * from ev")
def ingest_json(spark: SparkSession, folder: str) -> DataFrame:
    lines = events(spark, folder).frame.select(F.to_json(F.struct("*")))
    return loaded(spark, EVENTS, "day", file=text_file(spark, lines)).frame


@query(f"with {EV} select event_id, event_type, user_id, day from ev")
def ingest_csv(spark: SparkSession, folder: str) -> DataFrame:
    names = ["event_id", "event_type", "user_id", "day"]
    lines = events(spark, folder).frame.select(F.concat_ws("|", *names))
    return loaded(spark, ["index int64 event_id", "index trie event_type", "int64 user_id", "index string day"], "day", file=text_file(spark, lines), decoder=csv_decoder(names, "|")).frame


@query(f"with {EV} select event_id, event_type, day from ev")
def ingest_fixed_width(spark: SparkSession, folder: str) -> DataFrame:
    lines = events(spark, folder).frame.select(F.concat(F.lpad(F.col("event_id").cast("string"), 12, " "), F.lit("--"), F.rpad("event_type", 10, " "), "day"))
    return loaded(spark, ["index int64 event_id", "trie event_type", "string day"], file=text_file(spark, lines), decoder=fixed_width_decoder([(0, "event_id"), (12, "_"), (14, "event_type"), (24, "day")])).frame


@query("select n_nationkey, n_regionkey, n_name from nation")
def ingest_kv(spark: SparkSession, folder: str) -> DataFrame:
    pairs = [((r[0], r[2]), (r[1],)) for r in table(spark, folder, "nation").select("n_nationkey", "n_name", "n_regionkey").collect()]  # 25 rows
    return loaded(spark, ["index int32 n_nationkey", "int32 n_regionkey", "trie n_name"], streams=[pairs], decoder=kv_decoder(["n_nationkey", "n_regionkey", "n_name"])).frame


def _urgent(record: dict) -> bool | None:
    if record["o_orderpriority"] != "1-URGENT":
        return False
    record["o_orderstatus"] = record["o_orderstatus"].lower()
    return None


@query(f"with {OD} select o_orderkey, lower(o_orderstatus) as o_orderstatus, o_orderpriority from od where o_orderpriority = '1-URGENT'")
def ingest_preprocess(spark: SparkSession, folder: str) -> DataFrame:
    lines = orders(spark, folder).frame.select(F.to_json(F.struct("o_orderkey", "o_orderstatus", "o_orderpriority")))
    return loaded(spark, ["index int64 o_orderkey", "trie o_orderstatus", "trie o_orderpriority"], file=text_file(spark, lines), preprocess=_urgent).frame


@query(f"with {OD} select o_orderkey, total_cents, order_year from od where order_year in ('1996', '1998')")
def ingest_partition_filter(spark: SparkSession, folder: str) -> DataFrame:
    return loaded(spark, ["index int64 o_orderkey", "int64 total_cents", "index string order_year"], "order_year", frame=orders(spark, folder).frame, partition_filter=["1996", "1998"]).frame


@query("""
    select coalesce(token, '') as token, coalesce(site_id, '') as site_id, coalesce(amount, 0) as amount, coalesce(account_id, 0) as account_id, coalesce(metro, 0) as metro, coalesce(isactive, 0) as isactive, coalesce(date, '') as date from pix""")
def ingest_defaults(spark: SparkSession, folder: str) -> DataFrame:
    columns = ["wide index string token", "index trie site_id", "int64 amount", "index int account_id", "index int16 metro", "index bit isactive", "index string date"]
    return loaded(spark, columns, "date", frame=table(spark, folder, "pix")).frame


@query("with c as (select line from (select distinct marble_id, rid, line from marble_rows) where line is not null and json_valid(line)) select coalesce(json_extract_string(line, '$.token'), '') as token, coalesce(json_extract_string(line, '$.site_id'), '') as site_id, cast(coalesce(json_extract_string(line, '$.seq'), '0') as bigint) as seq from c")
def ingest_dirty_json(spark: SparkSession, folder: str) -> DataFrame:
    """Records that are cut off or missing are left out."""
    lines = table(spark, folder, "marble_rows").distinct().where("line is not null").select("line")
    return loaded(spark, ["index string token", "index trie site_id", "index int64 seq"], file=text_file(spark, lines)).frame


@query(f"with {LI} select distinct ship_month as part from li")
def partitions_list(spark: SparkSession, folder: str) -> DataFrame:
    made, catalog = _stored_lineitem(spark, folder)
    return spark.createDataFrame([(p,) for p in catalog.partitions(made)], "part string")


#: The warehouse that holds lineitem as stored, by folder of the test tables: loaded once a process, read by several queries.
_warehouses: dict[str, str] = {}


def _stored_lineitem(spark: SparkSession, folder: str, own: bool = False) -> tuple[Table, Catalog]:
    """Lineitem as a stored table; with ``own`` in a warehouse that nobody else uses."""
    root = None if own else _warehouses.get(folder)
    catalog = Catalog(spark, root or scratch_path(spark, "warehouse"))
    if root is not None and catalog.find("li") is not None:
        return catalog.open("li"), catalog
    source = lineitem(spark, folder)
    made = catalog.create("li", fields=source._fields, partition="ship_month")
    held = overrides.get("warehouse")
    overrides["warehouse"] = catalog.root
    try:
        insert(made, spark=spark, frame=source.frame)
    finally:
        overrides["warehouse"] = held
    if not own:
        _warehouses[folder] = catalog.root
    return catalog.open("li"), catalog


@query(f"with {LI} select ship_month, count(*) as n, cast(sum(price_cents) as bigint) as total from li where not (ship_month < '1997-01' or ship_month in ('1998-03', '1999-12')) group by ship_month")
def delete_partitions(spark: SparkSession, folder: str) -> DataFrame:
    made, catalog = _stored_lineitem(spark, folder, own=True)
    catalog.delete((made.ship_month < "1997-01") | (made.ship_month << ["1998-03", "1999-12"]))
    left = catalog.open("li")
    return select(left.ship_month, h_count().named("n"), h_sum(left.price_cents).named("total"), where=left).frame


@query("select 0 as left_tables, 1 as tables_before")
def drop_table(spark: SparkSession, folder: str) -> DataFrame:
    made, catalog = _stored_lineitem(spark, folder, own=True)
    before = len(catalog.names())
    catalog.drop(made)
    return spark.createDataFrame([(len(catalog.names()), before)], "left_tables int, tables_before int")


@query(f"with {LI} select l_orderkey, qty, ship_month from li where ship_month >= '1998-01' and ship_month <= '1998-02' and l_returnflag = 'N'")
def scan_pruned_partitions(spark: SparkSession, folder: str) -> DataFrame:
    """A stored table is read by partition folders; Catalyst leaves out those the condition excludes."""
    made, _ = _stored_lineitem(spark, folder)
    return select(made.l_orderkey, made.qty, made.ship_month, where=(made.ship_month >= "1998-01") & (made.ship_month <= "1998-02") & (made.l_returnflag == "N")).frame


@query(f"with {OD} select o_custkey, cast(sum(total_cents) as bigint) as total from od group by o_custkey")
def nested_tag(spark: SparkSession, folder: str) -> DataFrame:
    """A nested result stored under a name and opened again."""
    t = orders(spark, folder)
    root = scratch_path(spark, "warehouse")
    select(t.o_custkey, h_sum(t.total_cents).named("total"), where=t, nest=True, tag="by_customer", warehouse=root)
    return Catalog(spark, root).open("by_customer").frame


@query(f"with {OD} select o_custkey, o_orderstatus, total_cents from od")
def ingest_header(spark: SparkSession, folder: str) -> DataFrame:
    """The first line of each file names the columns and is left out."""
    names = ["o_custkey", "o_orderstatus", "total_cents"]
    path = scratch_path(spark, "lines")
    orders(spark, folder).frame.select(*names).write.option("header", True).csv(path)
    return loaded(spark, ["index int64 o_custkey", "trie o_orderstatus", "int64 total_cents"], file=path, decoder=csv_decoder(names), header=True).frame


def _swapped(line: str) -> dict:
    left, right = line.split("/")
    return {"day": left[::-1], "event_type": right}


@query(f"with {EV} select event_type, reverse(day) as day from ev")
def ingest_custom_decoder(spark: SparkSession, folder: str) -> DataFrame:
    """Any function from a line to a record decodes."""
    lines = events(spark, folder).frame.select(F.concat_ws("/", "day", "event_type"))
    return loaded(spark, ["index trie event_type", "index string day"], file=text_file(spark, lines), decoder=_swapped).frame


@query(f"with {OD} select o_orderkey, o_orderstatus, cast(case when o_orderkey % 2 = 0 then 7 else 0 end as bigint) as late from od")
def handle_reloaded(spark: SparkSession, folder: str) -> DataFrame:
    """A handle is dumped and loaded again; rows that are older than a column show its default."""
    source = orders(spark, folder).frame.select("o_orderkey", "o_orderstatus")
    held = overrides.get("warehouse")
    overrides["warehouse"] = scratch_path(spark, "warehouse")
    try:
        catalog = Catalog(spark)
        insert(catalog.create("od", ["index int64 o_orderkey", "trie o_orderstatus"]), spark=spark, frame=source.where("o_orderkey % 2 = 1"))
        grown = catalog.create("od", ["index int64 o_orderkey", "trie o_orderstatus", "int64 late"], force=True)
        insert(grown, spark=spark, frame=source.where("o_orderkey % 2 = 0").withColumn("late", F.lit(7)))
        return Table.loads(catalog.open("od").dumps(), spark).frame
    finally:
        overrides["warehouse"] = held


@query(f"with {LI} select ship_month, count(*) as n, cast(sum(price_cents) as bigint) as total from li group by ship_month")
def compacted_table(spark: SparkSession, folder: str) -> DataFrame:
    """A stored table after three loads and the consolidation of their files."""
    source = lineitem(spark, folder)
    catalog = Catalog(spark, scratch_path(spark, "warehouse"))
    made = catalog.create("li", fields=source._fields, partition="ship_month")
    held = overrides.get("warehouse")
    overrides["warehouse"] = catalog.root
    try:
        for n in range(3):
            insert(made, spark=spark, frame=source.frame.where(F.pmod(F.col("l_orderkey"), F.lit(3)) == n))
        compact_table(catalog, made)
    finally:
        overrides["warehouse"] = held
    left = catalog.open("li")
    return select(left.ship_month, h_count().named("n"), h_sum(left.price_cents).named("total"), where=left).frame


@query("select * from (values ('index int64 l_orderkey'), ('index string *ship_month'), ('int64 qty')) t(line)")
def columns_described(spark: SparkSession, folder: str) -> DataFrame:
    catalog = Catalog(spark, scratch_path(spark, "warehouse"))
    made = catalog.create("li", ["index int64 l_orderkey", "int64 qty", "index string ship_month"], partition="ship_month")
    return spark.createDataFrame([(line,) for line in describe(made)], "line string")
