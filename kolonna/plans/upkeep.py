"""Queries of the core operators for stored files and skewed keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kolonna.operators.compaction import Compaction, compact_records
from kolonna.operators.heavy_keys import heavy_keys, keyed_aggregate
from kolonna.plans.registry import Registry, table
from kolonna.runtime import scratch_path

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

# --- small files -------------------------------------------------------------------------------------------------------


def compacted(spark: SparkSession, folder: str) -> Compaction:
    return compact_records(table(spark, folder, "marbles"), table(spark, folder, "marble_rows"), scratch_path(spark, "compacted"), ["table_name", "date"], "marble_id", "rid", "line")


FILES = """
    with f as (select distinct table_name, date, marble_id from marbles where marble_id is not null),
    n as (select marble_id, count(*) as n from (select distinct marble_id, rid from marble_rows) group by marble_id)"""


@query(f"""{FILES}
    select table_name, date from f left join n using (marble_id) group by table_name, date
    having count(*) >= 12 and 4 * count(*) filter (coalesce(n, 0) < 20) >= 3 * count(*)""")
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Compact all partitions, then read off the verified manifest which of them were scattered."""
    files = compacted(spark, folder).manifest.where("listed").groupBy("table_name", "date", "marble_id").agg(F.sum("n_records").alias("n"))
    of = files.groupBy("table_name", "date").agg(F.count(F.lit(1)).alias("files"), F.count(F.when(F.col("n") < 20, 1)).alias("small"))
    return of.where("files >= 12 and 4 * small >= 3 * files").select("table_name", "date")


@query(f"""{FILES}
    select table_name, date, count(*) as files_before, cast(sum(coalesce(n, 0)) as bigint) as records, cast(ceil(sum(coalesce(n, 0)) / 100000) as bigint) as files_after
    from f left join n using (marble_id) group by table_name, date""")
def p3_partitions(spark: SparkSession, folder: str) -> DataFrame:
    """What compaction made of each partition."""
    of = compacted(spark, folder).manifest.where("listed").groupBy("table_name", "date")
    return of.agg(F.countDistinct("marble_id").alias("files_before"), F.sum("n_records").alias("records"), F.countDistinct("path").alias("files_after"))


@query("select marble_id, rid, max(line) as line from marble_rows group by marble_id, rid")
def p3_records(spark: SparkSession, folder: str) -> DataFrame:
    """The records as read back from the compacted files."""
    return compacted(spark, folder).records(spark)


# --- heavy keys --------------------------------------------------------------------------------------------------------

FIELDS = (("impressions", "site_id"), ("pix", "site_id"), ("impressions", "ad_id"))


def keyed_rows(spark: SparkSession, folder: str) -> DataFrame:
    parts = [table(spark, folder, t).select(F.lit(t).alias("table_name"), F.lit(f).alias("field_name"), F.col(f).cast("string").alias("key_value"), "date") for t, f in FIELDS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    " union all ".join(
        f"select '{t}' as table_name, '{f}' as field_name, cast({f} as varchar) as key_value from {t} group by {f} having cast({f} as varchar) <> '' and count(*) >= 0.035 * (select count(*) from {t})" for t, f in FIELDS
    )
)
def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    found = heavy_keys(keyed_rows(spark, folder), ["table_name", "field_name", "key_value"], "date", 0.035, ["table_name", "field_name"])
    return found.where("key_value <> ''").select("table_name", "field_name", "key_value")


@query(
    " union all ".join(
        f"select '{t}' as table_name, '{f}' as field_name, cast({f} as varchar) as key_value, count(*) as n_rows, min(date) as first_order, max(date) as last_order, count(distinct date) as n_orders from {t} group by {f}" for t, f in FIELDS
    )
)
def p5_key_results(spark: SparkSession, folder: str) -> DataFrame:
    """Rows, first, last and number of dates of every key of the three fields, missing keys included."""
    done = keyed_aggregate(keyed_rows(spark, folder), ["table_name", "field_name", "key_value"], "date")
    return done.select("table_name", "field_name", "key_value", "n_rows", "first_order", "last_order", "n_orders")


@query("""
    with s as (select *, case when time - lag(time) over (partition by site_id order by time) <= 1800 then 0 else 1 end as opens from impressions where time is not null),
    t as (select site_id, sum(opens) as n from s group by site_id)
    select i.site_id, count(*) as n_rows, cast(sum(cpm_millis) as bigint) as sum_value, max(cpm_millis) as max_value, min(time) as first_order, max(time) as last_order, count(distinct time) as n_orders, cast(coalesce(max(n), 0) as bigint) as n_sessions
    from impressions i left join t on i.site_id is not distinct from t.site_id group by i.site_id""")
def p5_site_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Per site: rows, revenue and sessions of impressions at most half an hour apart, in order of time."""
    done = keyed_aggregate(table(spark, folder, "impressions"), ["site_id"], "time", "cpm_millis", gap=1800)
    return done.select("site_id", "n_rows", "sum_value", "max_value", "first_order", "last_order", "n_orders", "n_sessions")
