"""Queries of the query language: one for each operator, over the driver's tables in the shapes of event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kolonna.functions.aggregates import Fold, aggregate_expression, h_avg, h_cardinality, h_combine, h_count, h_max, h_min, h_minhash_merge, h_nlargest, h_nsmallest, h_sum, h_union
from kolonna.functions.columns import column_function, day, ip_aton, ip_ntoa, month, year
from kolonna.functions.sketches import hash_sample, hll_intersection, hll_sketches, jaccard, merge_samples
from kolonna.plans.query import select
from kolonna.plans.registry import Registry, table
from kolonna.plans.stats import stat
from kolonna.table import Table, star

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


def cents(column: str) -> F.Column:
    return F.round(F.col(column) * 100).cast("bigint")


# The shapes: money in cents, so that sums are exact; dates as ISO strings; one partition column each.


def lineitem(spark: SparkSession, folder: str) -> Table:
    frame = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_quantity").cast("bigint").alias("qty"), cents("l_extendedprice").alias("price_cents"), "l_returnflag", "l_linestatus", F.date_format("l_shipdate", "yyyy-MM").alias("ship_month")
    )
    return Table.from_frame("li", frame, ["index int64 l_orderkey", "index int64 l_partkey", "index int64 l_suppkey", "index int32 l_linenumber", "int64 qty", "int64 price_cents", "index trie16 l_returnflag", "index trie16 l_linestatus", "index string ship_month"], "ship_month")


def orders(spark: SparkSession, folder: str) -> Table:
    frame = table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", cents("o_totalprice").alias("total_cents"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_date"), F.date_format("o_orderdate", "yyyy").alias("order_year")
    )
    return Table.from_frame("od", frame, ["index int64 o_orderkey", "index int64 o_custkey", "index trie16 o_orderstatus", "index trie o_orderpriority", "index int64 total_cents", "index string order_date", "index string order_year"], "order_year")


def events(spark: SparkSession, folder: str) -> Table:
    frame = table(spark, folder, "events").select(
        "event_id", "event_type", "user_id", (F.col("event_type") == "error").cast("byte").alias("is_error"), F.pmod(F.col("user_id") * 2654435761, F.lit(4294967296)).alias("ip"), F.date_format("ts", "yyyy-MM-dd").alias("day")
    )
    return Table.from_frame("ev", frame, ["index int64 event_id", "index trie event_type", "index int64 user_id", "index bit is_error", "index uint32 ip", "index string day"], "day")


def impressions(spark: SparkSession, folder: str) -> Table:
    return Table.from_frame("imps", table(spark, folder, "impressions"), ["wide index string token", "trie url", "index trie site_id", "int64 cpm_millis", "index int ad_id", "index string date", "index int64 time", "index bit click", "index bit impression", "index bit conversion"], "date")


def pixels(spark: SparkSession, folder: str) -> Table:
    return Table.from_frame("pix", table(spark, folder, "pix"), ["wide index string token", "index bit isactive", "index trie site_id", "int64 amount", "index int account_id", "index trie city", "index trie16 state", "index int16 metro", "string ip", "lz4 keyword", "index string date"], "date")


def addresses(spark: SparkSession, folder: str) -> Table:
    return Table.from_frame("ips", table(spark, folder, "ips"), ["index trie16 exchange_id", "index int64 ip"])


def plain(spark: SparkSession, folder: str, name: str) -> Table:
    return Table.from_frame(name, table(spark, folder, name))


LI = "li as (select l_orderkey, l_partkey, l_suppkey, l_linenumber, cast(l_quantity as bigint) as qty, cast(round(l_extendedprice * 100) as bigint) as price_cents, l_returnflag, l_linestatus, strftime(l_shipdate, '%Y-%m') as ship_month from lineitem)"
OD = "od as (select o_orderkey, o_custkey, o_orderstatus, o_orderpriority, cast(round(o_totalprice * 100) as bigint) as total_cents, strftime(o_orderdate, '%Y-%m-%d') as order_date, strftime(o_orderdate, '%Y') as order_year from orders)"
EV = "ev as (select event_id, event_type, user_id, cast(case when event_type = 'error' then 1 else 0 end as tinyint) as is_error, (user_id * 2654435761) % 4294967296 as ip, strftime(ts, '%Y-%m-%d') as day from events)"
WITH = f"with {LI}, {OD}, {EV}"


def rows(result) -> DataFrame:
    return result.frame


# --- projection ----------------------------------------------------------------------------------------------------------


@query("select * from impressions")
def scan_star(spark: SparkSession, folder: str) -> DataFrame:
    t = impressions(spark, folder)
    return rows(select(*star(t), where=t))


@query("select site_id as site, cpm_millis as price from impressions")
def project_alias(spark: SparkSession, folder: str) -> DataFrame:
    t = impressions(spark, folder)
    return rows(select(t.site_id.named("site"), t.cpm_millis.named("price"), where=t))


@query("select token, site_id, ad_id, date, click from impressions")
def project_events(spark: SparkSession, folder: str) -> DataFrame:
    t = impressions(spark, folder)
    return rows(select(t.token, t.site_id, t.ad_id, t.date, t.click, where=t))


# --- filters -------------------------------------------------------------------------------------------------------------


def _filter(name: str, sql: str, condition) -> None:
    @query(f"{WITH} select o_orderkey, total_cents from od where {sql}", name=name)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        t = orders(spark, folder)
        return rows(select(t.o_orderkey, t.total_cents, where=condition(t)))


_filter("filter_eq", "o_orderstatus = 'F'", lambda t: t.o_orderstatus == "F")
_filter("filter_ne", "o_orderstatus <> 'F'", lambda t: t.o_orderstatus != "F")
_filter("filter_lt", "o_custkey < 300", lambda t: t.o_custkey < 300)
_filter("filter_le", "o_custkey <= 300", lambda t: t.o_custkey <= 300)
_filter("filter_gt", "o_custkey > 1000", lambda t: t.o_custkey > 1000)
_filter("filter_ge", "order_date >= '1997-02-03'", lambda t: t.order_date >= "1997-02-03")
_filter("filter_in", "o_orderpriority in ('1-URGENT', '5-LOW')", lambda t: t.o_orderpriority << ["1-URGENT", "5-LOW"])
_filter("filter_not_in", "o_orderpriority not in ('1-URGENT', '5-LOW')", lambda t: t.o_orderpriority >> ["1-URGENT", "5-LOW"])
_filter("filter_and_or_not", "not (o_orderstatus = 'F' and o_custkey < 700) or (o_orderpriority = '5-LOW' and not o_custkey > 200)", lambda t: ~((t.o_orderstatus == "F") & (t.o_custkey < 700)) | ((t.o_orderpriority == "5-LOW") & ~(t.o_custkey > 200)))
_filter("filter_partition_range", "order_year >= '1996' and order_year < '1998'", lambda t: (t.order_year >= "1996") & (t.order_year < "1998"))
_filter("filter_mixed_partition_or", "order_year = '1996' or (order_year = '1998' and o_orderstatus = 'O')", lambda t: (t.order_year == "1996") | ((t.order_year == "1998") & (t.o_orderstatus == "O")))
_filter("filter_mixed_partition_and", "(order_year = '1996' and o_orderstatus = 'F') or (order_year = '1997' and o_orderstatus = 'O')", lambda t: ((t.order_year == "1996") & (t.o_orderstatus == "F")) | ((t.order_year == "1997") & (t.o_orderstatus == "O")))
_filter("filter_not_partition_range", "not (order_year > '1997' and o_orderstatus = 'F')", lambda t: ~((t.order_year > "1997") & (t.o_orderstatus == "F")))
_filter("filter_column_fn", "cast(substr(order_date, 6, 2) as int) = 7", lambda t: month(t.order_date) == 7)


@query(f"{WITH} select event_id from ev where is_error = 1")
def filter_bit(spark: SparkSession, folder: str) -> DataFrame:
    t = events(spark, folder)
    return rows(select(t.event_id, where=t.is_error == True))  # noqa: E712


@query("select site_id, ad_id, time from impressions where date = '2016-03-05' and click = 1")
def filter_event_day(spark: SparkSession, folder: str) -> DataFrame:
    t = impressions(spark, folder)
    return rows(select(t.site_id, t.ad_id, t.time, where=(t.date == "2016-03-05") & (t.click == 1)))


BIG = "select o_custkey from od where total_cents > 29000000"


@query(f"{WITH} select c_custkey, c_name from customer where c_custkey in ({BIG})")
def semi_in_query(spark: SparkSession, folder: str) -> DataFrame:
    o, c = orders(spark, folder), plain(spark, folder, "customer")
    return rows(select(c.c_custkey, c.c_name, where=c.c_custkey << select(o.o_custkey, where=o.total_cents > 29_000_000)))


@query(f"{WITH} select c_custkey, c_name from customer where c_custkey not in ({BIG})")
def anti_in_query(spark: SparkSession, folder: str) -> DataFrame:
    o, c = orders(spark, folder), plain(spark, folder, "customer")
    return rows(select(c.c_custkey, c.c_name, where=c.c_custkey >> select(o.o_custkey, where=o.total_cents > 29_000_000)))


@query(f"{WITH} select c_custkey from customer where c_custkey in ({BIG}) or c_nationkey = 3")
def semi_in_query_or(spark: SparkSession, folder: str) -> DataFrame:
    o, c = orders(spark, folder), plain(spark, folder, "customer")
    return rows(select(c.c_custkey, where=(c.c_custkey << select(o.o_custkey, where=o.total_cents > 29_000_000)) | (c.c_nationkey == 3)))


@query("select site_id, date, ad_id from impressions where ad_id is not null and ad_id not in (select account_id from pix where account_id is not null)")
def anti_in_nulls(spark: SparkSession, folder: str) -> DataFrame:
    """A null is neither in nor not in the values of a query."""
    i, p = impressions(spark, folder), pixels(spark, folder)
    return rows(select(i.site_id, i.date, i.ad_id, where=i.ad_id >> select(p.account_id, where=p)))


@query("select site_id, date, ad_id from impressions where not (ad_id in (select account_id from pix where account_id is not null) or date < '2016-03-10')")
def anti_in_nulls_combined(spark: SparkSession, folder: str) -> DataFrame:
    i, p = impressions(spark, folder), pixels(spark, folder)
    return rows(select(i.site_id, i.date, i.ad_id, where=~((i.ad_id << select(p.account_id, where=p)) | (i.date < "2016-03-10"))))


@query("select site_id, date, ad_id from impressions where ad_id not in (1, 2, 3, 5, 8, 13)")
def filter_not_in_nulls(spark: SparkSession, folder: str) -> DataFrame:
    i = impressions(spark, folder)
    return rows(select(i.site_id, i.date, i.ad_id, where=i.ad_id >> [1, 2, 3, 5, 8, 13]))


# --- aggregation ---------------------------------------------------------------------------------------------------------


@query(f"{WITH} select cast(sum(price_cents) as bigint) as total, count(*) as n, min(qty) as least, max(qty) as most from li")
def agg_global(spark: SparkSession, folder: str) -> DataFrame:
    t = lineitem(spark, folder)
    return rows(select(h_sum(t.price_cents).named("total"), h_count().named("n"), h_min(t.qty).named("least"), h_max(t.qty).named("most"), where=t))


@query(f"{WITH} select cast(coalesce(sum(price_cents), 0) as bigint) as total, count(*) as n, min(qty) as least from li where ship_month = '1900-01'")
def agg_global_empty(spark: SparkSession, folder: str) -> DataFrame:
    t = lineitem(spark, folder)
    return rows(select(h_sum(t.price_cents).named("total"), h_count().named("n"), h_min(t.qty).named("least"), where=t.ship_month == "1900-01"))


def _grouped(name: str, sql: str, make) -> None:
    @query(f"{WITH} select l_suppkey, l_returnflag, {sql} as value from li group by l_suppkey, l_returnflag", name=name)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        t = lineitem(spark, folder)
        return rows(select(t.l_suppkey, t.l_returnflag, make(t).named("value"), where=t))


_grouped("agg_sum", "cast(sum(price_cents) as bigint)", lambda t: h_sum(t.price_cents))
_grouped("agg_count", "count(*)", lambda t: h_count())
_grouped("agg_min", "min(price_cents)", lambda t: h_min(t.price_cents))
_grouped("agg_max", "max(price_cents)", lambda t: h_max(t.price_cents))
_grouped("agg_avg", "avg(qty)", lambda t: h_avg(t.qty))
_grouped("agg_minmax_string", "max(ship_month)", lambda t: h_max(t.ship_month))
_grouped("agg_custom", "cast(sum(qty * qty) as bigint)", lambda t: aggregate_expression("squares", t.qty, lambda c: F.sum(c * c)))
_grouped("agg_custom_fold", "cast(sum(qty * qty) as bigint)", lambda t: Fold("squares", t.qty, T.LongType(), lambda: 0, lambda acc, v: acc + v * v, lambda a, b: a + b))
_grouped("agg_column_fn", "max(cast(substr(ship_month, 6, 2) as tinyint))", lambda t: h_max(month(t.ship_month)))


def squares(column) -> Fold:
    return Fold("squares", column, T.LongType(), lambda: 0, lambda acc, v: acc + v * v, lambda a, b: a + b)


@query(f"{WITH} select cast(sum(qty * qty) as bigint) as value from li")
def agg_global_fold(spark: SparkSession, folder: str) -> DataFrame:
    t = lineitem(spark, folder)
    return rows(select(squares(t.qty).named("value"), where=t))


@query(f"{WITH} select l_returnflag, cast(sum(qty * qty) as bigint) as a, cast(sum(l_linenumber * l_linenumber) as bigint) as b, count(*) as n from li group by l_returnflag")
def agg_two_folds(spark: SparkSession, folder: str) -> DataFrame:
    """Several folds run in one pass, Spark's own aggregates in another."""
    t = lineitem(spark, folder)
    return rows(select(t.l_returnflag, squares(t.qty).named("a"), squares(t.l_linenumber).named("b"), h_count().named("n"), where=t))


@query("""
    with d as (select distinct site_id, amount from pix where amount is not null), r as (select *, row_number() over (partition by site_id order by amount desc) as top, row_number() over (partition by site_id order by amount) as low from d),
    a as (select site_id, cast(sum(amount * top) filter (top <= 3) as bigint) as top, cast(sum(amount * low) filter (low <= 3) as bigint) as low, cast(count(*) filter (top <= 3) as integer) as found from r group by site_id)
    select p.site_id, count(*) as n, coalesce(max(top), 0) as top, coalesce(max(low), 0) as low, coalesce(max(found), 0) as found from pix p left join a on p.site_id is not distinct from a.site_id group by p.site_id""")
def agg_extremes(spark: SparkSession, folder: str) -> DataFrame:
    """The three greatest and the three least different amounts of each site, weighted by their places."""
    t = pixels(spark, folder)
    found = select(t.site_id, h_nlargest(t.amount, 3).named("most"), h_nsmallest(t.amount, 3).named("least"), h_count().named("n"), where=t).frame
    total = "aggregate(transform({}, (x, i) -> x * (i + 1)), 0L, (a, x) -> a + x)"
    return found.select("site_id", "n", F.expr(total.format("most")).alias("top"), F.expr(total.format("least")).alias("low"), F.size("most").alias("found"))


@query(f"{WITH} select o_custkey, string_agg(o_orderstatus, ',' order by o_orderstatus) as statuses from od group by o_custkey")
def agg_combine(spark: SparkSession, folder: str) -> DataFrame:
    t = orders(spark, folder)
    return rows(select(t.o_custkey, h_combine(t.o_orderstatus).named("statuses"), where=t))


@query(f"{WITH} select day, cast(sum(is_error) as bigint) as errors from ev group by day")
def agg_bit_sum(spark: SparkSession, folder: str) -> DataFrame:
    t = events(spark, folder)
    return rows(select(t.day, h_sum(t.is_error).named("errors"), where=t))


@query(f"{WITH} select l_orderkey, cast(sum(qty) as bigint) as total from li group by l_orderkey")
def agg_wide(spark: SparkSession, folder: str) -> DataFrame:
    t = lineitem(spark, folder)
    return rows(select(t.l_orderkey, h_sum(t.qty).named("total"), where=t, wide=True, partition=32))


@query(f"{WITH} select cast(substr(order_date, 1, 4) as smallint) as y, cast(sum(total_cents) as bigint) as total from od group by 1")
def agg_group_by_fn(spark: SparkSession, folder: str) -> DataFrame:
    t = orders(spark, folder)
    return rows(select(year(t.order_date).named("y"), h_sum(t.total_cents).named("total"), where=t))


@query("select ad_id, site_id, cast(sum(cpm_millis) as bigint) as spent, count(*) as n from impressions where date >= '2016-03-10' group by ad_id, site_id")
def agg_event_groups(spark: SparkSession, folder: str) -> DataFrame:
    t = impressions(spark, folder)
    return rows(select(t.ad_id, t.site_id, h_sum(t.cpm_millis).named("spent"), h_count().named("n"), where=t.date >= "2016-03-10"))


# --- joins ---------------------------------------------------------------------------------------------------------------


@query(f"{WITH} select l_orderkey, l_linenumber, o_custkey from li join od on l_orderkey = o_orderkey")
def join_inner(spark: SparkSession, folder: str) -> DataFrame:
    li, od = lineitem(spark, folder), orders(spark, folder)
    return rows(select(li.l_orderkey, li.l_linenumber, od.o_custkey, where=(li, od), join=(li.l_orderkey, od.o_orderkey)))


@query(f"{WITH} select l_orderkey, l_linenumber, o_custkey from li join od on l_orderkey = o_orderkey")
def join_by_names(spark: SparkSession, folder: str) -> DataFrame:
    li, od = lineitem(spark, folder), orders(spark, folder)
    return rows(select(li.l_orderkey, li.l_linenumber, od.o_custkey, where=(li, od), join=("l_orderkey", "o_orderkey")))


@query("select n.n_name, s.s_name from supplier s join nation n on s.s_nationkey = n.n_nationkey")
def join_named(spark: SparkSession, folder: str) -> DataFrame:
    n, s = plain(spark, folder, "nation"), plain(spark, folder, "supplier")
    key = select(n.n_name, n.n_nationkey.named("s_nationkey"), where=n, nest=True)
    return rows(select(key.n_name, s.s_name, where=(key, s), join="s_nationkey"))


@query(f"{WITH} select o_orderpriority, cast(sum(price_cents) as bigint) as total, count(*) as n from li join od on l_orderkey = o_orderkey group by o_orderpriority")
def join_agg(spark: SparkSession, folder: str) -> DataFrame:
    li, od = lineitem(spark, folder), orders(spark, folder)
    return rows(select(od.o_orderpriority, h_sum(li.price_cents).named("total"), h_count().named("n"), where=(li, od), join=(li.l_orderkey, od.o_orderkey)))


@query(f"{WITH} select l_orderkey, qty, o_custkey from li join od on l_orderkey = o_orderkey where ship_month < '1996-06' and o_orderstatus = 'F'")
def join_filtered(spark: SparkSession, folder: str) -> DataFrame:
    li, od = lineitem(spark, folder), orders(spark, folder)
    return rows(select(li.l_orderkey, li.qty, od.o_custkey, where=(li.ship_month < "1996-06", od.o_orderstatus == "F"), join=(li.l_orderkey, od.o_orderkey)))


@query(f"{WITH} select l_orderkey, l_linenumber, price_cents, o_custkey from li join od on l_orderkey = o_orderkey order by price_cents desc, l_orderkey desc, l_linenumber desc limit 50")
def join_order_limit(spark: SparkSession, folder: str) -> DataFrame:
    li, od = lineitem(spark, folder), orders(spark, folder)
    return rows(select(li.l_orderkey, li.l_linenumber, li.price_cents, od.o_custkey, where=(li, od), join=(li.l_orderkey, od.o_orderkey), order_by=(li.price_cents, "l_orderkey", 1), desc=True, limit=50))


@query(f"{WITH} select distinct o_custkey, l_returnflag from li join od on l_orderkey = o_orderkey")
def join_distinct(spark: SparkSession, folder: str) -> DataFrame:
    li, od = lineitem(spark, folder), orders(spark, folder)
    return rows(select(od.o_custkey, li.l_returnflag, where=(li, od), join=(li.l_orderkey, od.o_orderkey), distinct=True))


@query(f"{WITH} select c_mktsegment, cast(sum(price_cents) as bigint) as total from li join od on l_orderkey = o_orderkey join customer on o_custkey = c_custkey group by c_mktsegment")
def join_nested_3way(spark: SparkSession, folder: str) -> DataFrame:
    li, od, c = lineitem(spark, folder), orders(spark, folder), plain(spark, folder, "customer")
    sold = select(od.o_custkey, li.price_cents, where=(li, od), join=(li.l_orderkey, od.o_orderkey), nest=True)
    return rows(select(c.c_mktsegment, h_sum(sold.price_cents).named("total"), where=(sold, c), join=(sold.o_custkey, c.c_custkey)))


@query(f"{WITH} select a.o_custkey, count(*) as pairs from od a join od b on a.o_custkey = b.o_custkey where a.order_year = '1996' and b.order_year = '1997' group by a.o_custkey")
def join_self_nested(spark: SparkSession, folder: str) -> DataFrame:
    t = orders(spark, folder)
    a = select(t.o_custkey.named("cust_a"), where=t.order_year == "1996", nest=True)
    b = select(t.o_custkey.named("cust_b"), where=t.order_year == "1997", nest=True)
    return rows(select(a.cust_a.named("o_custkey"), h_count().named("pairs"), where=(a, b), join=(a.cust_a, b.cust_b)))


@query(f"{WITH}, e as (select cast(substr(day, 9, 2) as tinyint) as d, count(*) as n from ev group by 1), o as (select order_date, total_cents from od where order_year = '1996') select d, n, count(*) as orders from o join e on cast(substr(order_date, 9, 2) as tinyint) = d group by d, n")
def join_column_fn(spark: SparkSession, folder: str) -> DataFrame:
    ev, od = events(spark, folder), orders(spark, folder)
    days = select(day(ev.day).named("d"), h_count().named("n"), where=ev, nest=True)
    return rows(select(days.d, days.n, h_count().named("orders"), where=(od.order_year == "1996", days), join=(day(od.order_date), days.d)))


@query("select r_name, n_name from region cross join nation")
def cross_join(spark: SparkSession, folder: str) -> DataFrame:
    r, n = plain(spark, folder, "region"), plain(spark, folder, "nation")
    return rows(select(r.r_name, n.n_name, where=(r, n), full_join=True))


@query("""
    with a as (select site_id, count(*) as shown from impressions group by site_id), b as (select site_id, cast(sum(amount) as bigint) as amount from pix group by site_id)
    select a.site_id, shown, amount from a join b on a.site_id = b.site_id""")
def join_event_sites(spark: SparkSession, folder: str) -> DataFrame:
    i, p = impressions(spark, folder), pixels(spark, folder)
    a = select(i.site_id, h_count().named("shown"), where=i, nest=True)
    b = select(p.site_id, h_sum(p.amount).named("amount"), where=p, nest=True)
    return rows(select(a.site_id, a.shown, b.amount, where=(a, b), join="site_id"))


# --- order, limit, distinct ----------------------------------------------------------------------------------------------


@query(f"{WITH} select o_custkey, order_date, o_orderkey from od order by o_custkey, order_date, o_orderkey")
def order_multi(spark: SparkSession, folder: str) -> DataFrame:
    t = orders(spark, folder)
    return rows(select(t.o_custkey, t.order_date, t.o_orderkey, where=t, order_by=(t.o_custkey, "order_date")))


@query(f"{WITH} select o_custkey, order_date, o_orderkey from od order by o_custkey desc, order_date desc, o_orderkey desc")
def order_desc(spark: SparkSession, folder: str) -> DataFrame:
    t = orders(spark, folder)
    return rows(select(t.o_custkey, t.order_date, t.o_orderkey, where=t, order_by=("od.o_custkey", "order_date"), desc=True))


@query(f"{WITH} select order_date, cast(sum(total_cents) as bigint) as total, 6 as most_parts from od group by order_date")
def order_in_parts(spark: SparkSession, folder: str) -> DataFrame:
    """``partition`` sets the number of parts of an ordered result; their rows follow each other in order."""
    t = orders(spark, folder)
    frame = rows(select(t.order_date, h_sum(t.total_cents).named("total"), where=t, order_by="order_date", partition=6))
    bounds = frame.select(F.spark_partition_id().alias("part"), "order_date").groupBy("part").agg(F.min("order_date").alias("low"), F.max("order_date").alias("high"))
    apart = bounds.alias("x").join(bounds.alias("y"), F.expr("x.part < y.part and x.high >= y.low"), "inner").isEmpty() and bounds.count() <= 6
    return frame.withColumn("most_parts", F.lit(6 if apart else -1))


@query(f"{WITH} select count(*) as n, count(distinct o_orderkey) as different from (select o_orderkey from od limit 37)")
def limit_unordered(spark: SparkSession, folder: str) -> DataFrame:
    t = orders(spark, folder)
    return rows(select(t.o_orderkey, where=t, limit=37)).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderkey").alias("different"))


@query(f"{WITH} select o_custkey, cast(sum(total_cents) as bigint) as total from od group by o_custkey order by total desc, o_custkey desc limit 20")
def order_by_agg_index(spark: SparkSession, folder: str) -> DataFrame:
    t = orders(spark, folder)
    return rows(select(t.o_custkey, h_sum(t.total_cents).named("total"), where=t, order_by=1, desc=True, limit=20))


@query(f"{WITH} select o_custkey, cast(sum(total_cents) as bigint) as total from od group by o_custkey order by total, o_custkey limit 20")
def order_by_name(spark: SparkSession, folder: str) -> DataFrame:
    t = orders(spark, folder)
    return rows(select(t.o_custkey, h_sum(t.total_cents).named("total"), where=t, order_by="sum(total_cents)", limit=20))


@query(f"{WITH} select l_orderkey, l_linenumber, price_cents from li order by price_cents desc, l_orderkey desc, l_linenumber desc limit 100")
def topk(spark: SparkSession, folder: str) -> DataFrame:
    t = lineitem(spark, folder)
    return rows(select(t.l_orderkey, t.l_linenumber, t.price_cents, where=t, order_by=t.price_cents, desc=True, limit=100))


@query("select s_name from supplier")
def limit_high(spark: SparkSession, folder: str) -> DataFrame:
    """A limit above the number of rows gives all of them."""
    t = plain(spark, folder, "supplier")
    return rows(select(t.s_name, where=t, order_by="s_name", limit=1_000_000))


@query("select c_name from customer")
def limit_zero(spark: SparkSession, folder: str) -> DataFrame:
    t = plain(spark, folder, "customer")
    return rows(select(t.c_name, where=t, limit=0))


@query(f"{WITH} select distinct l_returnflag, l_linestatus, ship_month from li")
def distinct_rows(spark: SparkSession, folder: str) -> DataFrame:
    t = lineitem(spark, folder)
    return rows(select(t.l_returnflag, t.l_linestatus, t.ship_month, where=t, distinct=True))


@query(f"{WITH} select distinct ship_month, l_returnflag from li order by ship_month desc, l_returnflag desc limit 40")
def distinct_order_limit(spark: SparkSession, folder: str) -> DataFrame:
    t = lineitem(spark, folder)
    return rows(select(t.ship_month, t.l_returnflag, where=t, distinct=True, order_by=0, desc=True, limit=40))


# --- concatenation and nesting -------------------------------------------------------------------------------------------


@query(f"{WITH} select l_suppkey, null as o_custkey from li where l_returnflag = 'R' union all select null, o_custkey from od")
def concat_tables(spark: SparkSession, folder: str) -> DataFrame:
    li, od = lineitem(spark, folder), orders(spark, folder)
    return rows(select(li.l_suppkey, od.o_custkey, where=(li.l_returnflag == "R", od)))


@query(f"{WITH} select l_suppkey, null as o_custkey from li union select null, o_custkey from od")
def concat_distinct(spark: SparkSession, folder: str) -> DataFrame:
    li, od = lineitem(spark, folder), orders(spark, folder)
    return rows(select(li.l_suppkey, od.o_custkey, where=(li, od), distinct=True))


@query(f"{WITH} select (select count(*) from li) + (select count(*) from od) as n, (select cast(sum(qty) as bigint) from li) as qty, (select cast(sum(total_cents) as bigint) from od) as total")
def concat_agg(spark: SparkSession, folder: str) -> DataFrame:
    li, od = lineitem(spark, folder), orders(spark, folder)
    return rows(select(h_count().named("n"), h_sum(li.qty).named("qty"), h_sum(od.total_cents).named("total"), where=(li, od)))


@query(f"{WITH}, a as (select o_custkey, order_year, sum(total_cents) as total, count(*) as n from od group by o_custkey, order_year) select order_year, cast(max(total) as bigint) as best, cast(sum(n) as bigint) as orders from a group by order_year")
def nested_agg(spark: SparkSession, folder: str) -> DataFrame:
    t = orders(spark, folder)
    a = select(t.o_custkey, t.order_year, h_sum(t.total_cents).named("total"), h_count().named("n"), where=t, nest=True)
    return rows(select(a.order_year, h_max(a.total).named("best"), h_sum(a.n).named("orders"), where=a))


@query(f"{WITH}, f as (select * from od where o_orderstatus = 'F') select x.order_year, x.n, y.best from (select order_year, count(*) as n from f group by 1) x join (select order_year as z, max(total_cents) as best from f group by 1) y on x.order_year = y.z")
def nested_reuse(spark: SparkSession, folder: str) -> DataFrame:
    t = orders(spark, folder)
    f = select(*star(t), where=t.o_orderstatus == "F", nest=True)
    x = select(f.order_year, h_count().named("n"), where=f, nest=True)
    y = select(f.order_year.named("z"), h_max(f.total_cents).named("best"), where=f, nest=True)
    return rows(select(x.order_year, x.n, y.best, where=(x, y), join=("order_year", "z")))


@query(f"{WITH} select o_custkey, count(*) as n from od group by o_custkey having count(*) > 12")
def nested_having(spark: SparkSession, folder: str) -> DataFrame:
    t = orders(spark, folder)
    a = select(t.o_custkey, h_count().named("n"), where=t, nest=True)
    return rows(select(a.o_custkey, a.n, where=a.n > 12))


@query(f"{WITH} select o_custkey, n, n * 10 as ten from (select o_custkey, count(*) as n from od group by 1) order by n desc, o_custkey desc limit 10")
def pre_order_stage(spark: SparkSession, folder: str) -> DataFrame:
    t = orders(spark, folder)
    return rows(select(t.o_custkey, h_count().named("n"), where=t, order_by="n", desc=True, limit=10, pre_order_stage=(lambda df: df.withColumn("ten", F.col("n") * 10),)))


# --- column functions ----------------------------------------------------------------------------------------------------

DOTTED = "case when ip between 0 and 4294967295 then (ip >> 24) || '.' || ((ip >> 16) & 255) || '.' || ((ip >> 8) & 255) || '.' || (ip & 255) else '0.0.0.0' end"


@query(f"select exchange_id, ip, {DOTTED} as dotted from ips")
def fn_ip_ntoa(spark: SparkSession, folder: str) -> DataFrame:
    t = addresses(spark, folder)
    return rows(select(t.exchange_id, t.ip, ip_ntoa(t.ip).named("dotted"), where=t))


@query(f"select exchange_id, max({DOTTED}) as most, min({DOTTED}) as least from ips group by exchange_id")
def fn_in_aggregate(spark: SparkSession, folder: str) -> DataFrame:
    t = addresses(spark, folder)
    return rows(select(t.exchange_id, h_max(ip_ntoa(t.ip)).named("most"), h_min(ip_ntoa(t.ip)).named("least"), where=t))


OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


@query(f"""
    select ip, case when regexp_full_match(ip, '{OCTET}([.]{OCTET}){{3}}') then
    cast(split_part(ip, '.', 1) as bigint) * 16777216 + cast(split_part(ip, '.', 2) as bigint) * 65536 + cast(split_part(ip, '.', 3) as bigint) * 256 + cast(split_part(ip, '.', 4) as bigint)
    else 0 end as number from pix""")
def fn_ip_aton(spark: SparkSession, folder: str) -> DataFrame:
    t = pixels(spark, folder)
    return rows(select(t.ip, ip_aton(t.ip).named("number"), where=t))


def _date(name: str, function, start: int, length: int, kind: str) -> None:
    @query(f"select date, coalesce(try_cast(substr(date, {start}, {length}) as {kind}), cast(-1 as {kind})) as part from impressions", name=name)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        t = impressions(spark, folder)
        return rows(select(t.date, function(t.date).named("part"), where=t))


_date("fn_year", year, 1, 4, "smallint")
_date("fn_month", month, 6, 2, "tinyint")
_date("fn_day", day, -2, 2, "tinyint")


@column_function(T.StringType(), native=False)
def backwards(values):
    return values.str[::-1]


@query("select p_name, reverse(p_name) as back from part")
def fn_user_defined(spark: SparkSession, folder: str) -> DataFrame:
    t = plain(spark, folder, "part")
    return rows(select(t.p_name, backwards(t.p_name).named("back"), where=t))


# --- sketches ------------------------------------------------------------------------------------------------------------


NEAR = "abs(estimate - exact) <= greatest(3, {} * exact)"


@query("select site_id, count(distinct token) as exact, true as near from pix group by site_id")
def hll_cardinality(spark: SparkSession, folder: str) -> DataFrame:
    """Sketches built by day and combined by site, next to the exact counts, and whether they lie within four standard errors (or 3)."""
    p = pixels(spark, folder)
    daily = Table.from_frame("daily", hll_sketches(p.frame, ["site_id", "date"], "token"))
    estimate = select(daily.site_id, h_cardinality(daily.sketch).named("estimate"), where=daily).frame
    exact = p.frame.groupBy("site_id").agg(F.count_distinct("token").alias("exact"))
    both = estimate.alias("a").join(exact.alias("b"), F.col("a.site_id").eqNullSafe(F.col("b.site_id")))
    return both.select("a.site_id", "exact", F.expr(NEAR.format(0.065)).alias("near"))


@query("select site_id, case when count(distinct token) = 0 then 0 when count(distinct token) < 10 then 1 else 2 end as size from pix group by site_id")
def hll_small_sets(spark: SparkSession, folder: str) -> DataFrame:
    """Sets of fewer than ten are counted exactly by a sketch, so the estimates alone tell them from others."""
    p = pixels(spark, folder)
    estimate = select(p.site_id, h_cardinality(p.token).named("n"), where=p).frame
    return estimate.select("site_id", F.expr("case when n = 0 then 0 when n < 10 then 1 else 2 end").alias("size"))


@query("select date, count(distinct token) as exact, true as near, true as same from pix group by date")
def hll_union(spark: SparkSession, folder: str) -> DataFrame:
    """A union of stored sketches next to the exact count, and whether it gives what one sketch of all rows does."""
    p = pixels(spark, folder)
    fine = Table.from_frame("fine", hll_sketches(p.frame, ["site_id", "date"], "token"))
    joined = select(fine.date, h_union(fine.sketch).named("sketch"), where=fine).frame.select("date", F.hll_sketch_estimate("sketch").alias("estimate"))
    direct = p.frame.groupBy("date").agg(F.count_distinct("token").alias("exact"), F.hll_sketch_estimate(F.hll_sketch_agg(F.when(F.col("token").isNotNull(), F.xxhash64("token")), 12)).alias("direct"))
    both = joined.alias("a").join(direct.alias("b"), F.col("a.date").eqNullSafe(F.col("b.date")))
    return both.select("a.date", "exact", F.expr(NEAR.format(0.065)).alias("near"), F.expr("abs(estimate - direct) <= greatest(3, 0.03 * direct)").alias("same"))


@query("select account_id, count(distinct token) filter (token in (select token from impressions)) as exact, true as near from pix where account_id is not null and token is not null group by account_id")
def hll_intersect(spark: SparkSession, folder: str) -> DataFrame:
    """Per account, the tokens it shares with all impressions and all pixels, as an intersection of three sketches next to the exact count: within four errors."""
    i, p = (table(spark, folder, t).where("token is not null") for t in ("impressions", "pix"))
    own = p.where("account_id is not null")
    hit = own.select("account_id", "token").distinct().join(i.select(F.col("token").alias("seen")).distinct(), F.col("token") == F.col("seen"), "left")
    exact = hit.groupBy("account_id").agg(F.count("seen").alias("exact"))
    both = hll_sketches(i, [], "token").withColumnRenamed("sketch", "x").crossJoin(hll_sketches(p, [], "token").withColumnRenamed("sketch", "y"))  # one row
    found = hll_sketches(own, ["account_id"], "token").crossJoin(both).join(exact, "account_id").withColumn("i", hll_intersection(F.col("sketch"), F.col("x"), F.col("y")))
    return found.select("account_id", "exact", F.expr("abs(i.count - exact) <= 4 * i.error").alias("near"))


SHARED = """
    with x as (select distinct l_suppkey, l_partkey from lineitem), n as (select l_suppkey, count(*) as n from x group by 1),
    p as (select a.l_suppkey as a, b.l_suppkey as b, count(*) as k from x a join x b on a.l_partkey = b.l_partkey and b.l_suppkey = a.l_suppkey + 1 group by 1, 2)
    select m.l_suppkey as supplier, coalesce(k, 0) / (m.n + o.n - coalesce(k, 0)) as jaccard from n m join n o on o.l_suppkey = m.l_suppkey + 1 left join p on p.a = m.l_suppkey"""


@query(SHARED)
def minhash_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    """Similarity of the parts of each supplier and the next one; samples of 65,535 hashes are exact here."""
    samples = hash_sample(table(spark, folder, "lineitem"), ["l_suppkey"], "l_partkey", 65_535)
    other = samples.select((F.col("l_suppkey") - 1).alias("l_suppkey"), F.col("sample").alias("next"))
    return samples.join(other, "l_suppkey").select(F.col("l_suppkey").alias("supplier"), jaccard(F.col("sample"), F.col("next"), capacity=65_535).alias("jaccard"))


@query("""
    with x as (select distinct event_type, user_id from events), n as (select event_type, count(*) as n from x group by 1),
    p as (select a.event_type as a, b.event_type as b, count(*) as k from x a join x b on a.user_id = b.user_id and a.event_type < b.event_type group by 1, 2)
    select a, b, k / (m.n + o.n - k) as exact, true as near from p join n m on m.event_type = a join n o on o.event_type = b""")
def minhash_full_samples(spark: SparkSession, folder: str) -> DataFrame:
    """Similarity of the users of each two event types from samples of 64 hashes that are full, next to the exact one: within five standard errors."""
    seen = table(spark, folder, "events").select("event_type", "user_id")
    samples = hash_sample(seen, ["event_type"], "user_id", 64)
    x, y = (samples.select(F.col("event_type").alias(n), F.col("sample").alias(f"s{n}")) for n in "ab")
    pairs = x.join(y, F.col("a") < F.col("b"))  # one row an event type
    estimate = pairs.select("a", "b", jaccard(F.col("sa"), F.col("sb"), capacity=64).alias("estimate"))
    users = seen.groupBy("event_type").agg(F.collect_set("user_id").alias("u"))
    u, v = (users.select(F.col("event_type").alias(n), F.col("u").alias(f"u{n}")) for n in "ab")
    exact = estimate.join(u, "a").join(v, "b").withColumn("exact", F.size(F.array_intersect("ua", "ub")) / F.size(F.array_union("ua", "ub")))
    return exact.where("exact > 0").select("a", "b", "exact", (F.abs(F.col("estimate") - F.col("exact")) <= 5 * F.sqrt(F.col("exact") * (1 - F.col("exact")) / 64) + 1 / 64).alias("near"))


@query("with h as (select distinct l_returnflag, l_suppkey from lineitem) select l_returnflag, count(*) as hashes from h group by l_returnflag")
def minhash_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Samples by flag and status merged to flags, by the aggregate and as tables: the same hashes."""
    fine = hash_sample(table(spark, folder, "lineitem"), ["l_returnflag", "l_linestatus"], "l_suppkey", 65_535)
    t = Table.from_frame("fine", fine)
    merged = select(t.l_returnflag, h_minhash_merge(t.sample).named("s"), where=t).frame
    again = merge_samples(fine, ["l_returnflag"], 65_535)
    return merged.join(again, "l_returnflag").where(F.col("s") == F.col("sample")).select("l_returnflag", F.size("s").cast("bigint").alias("hashes"))


@query("with h as (select distinct l_returnflag, l_suppkey from lineitem) select l_returnflag, cast(count(*) as integer) as hashes, true as ordered from h group by l_returnflag")
def minhash_least(spark: SparkSession, folder: str) -> DataFrame:
    """Samples of the least hashes, merged: as many as there are values, from the least up."""
    fine = hash_sample(table(spark, folder, "lineitem"), ["l_returnflag", "l_linestatus"], "l_suppkey", 65_535, greatest=False)
    merged = merge_samples(fine, ["l_returnflag"], 65_535, greatest=False)
    return merged.select("l_returnflag", F.size("sample").alias("hashes"), (F.col("sample") == F.sort_array("sample")).alias("ordered"))


# --- statistics, futures -------------------------------------------------------------------------------------------------


@query(f"""{WITH}, p as (select ship_month, count(distinct l_orderkey) as o, count(distinct l_partkey) as p, count(distinct l_suppkey) as s, count(distinct l_linenumber) as l, count(distinct l_returnflag) as r, count(distinct l_linestatus) as t, 1 as m from li group by 1),
    n as (select count(*) as n from li), c as (select unnest(['l_orderkey', 'l_partkey', 'l_suppkey', 'l_linenumber', 'l_returnflag', 'l_linestatus', 'ship_month']) as name, unnest([sum(o), sum(p), sum(s), sum(l), sum(r), sum(t), sum(m)]) as d from p)
    select name, cast(floor(100 * d / n) as bigint) as value from c, n where floor(100 * d / n) > 0 union all select '_', n from n""")
def stat_cardinality(spark: SparkSession, folder: str) -> DataFrame:
    return spark.createDataFrame(sorted(stat(lineitem(spark, folder), exact=True).items()), "name string, value bigint")


@query(f"{WITH} select o_orderpriority, count(*) as n from od group by o_orderpriority")
def future_nonblocking(spark: SparkSession, folder: str) -> DataFrame:
    t = orders(spark, folder)
    return rows(select(t.o_orderpriority, h_count().named("n"), where=t, block=False).wait())


@query(f"{WITH} select l_returnflag, l_linestatus, cast(sum(qty) as bigint) as sum_qty, cast(sum(price_cents) as bigint) as sum_price, count(*) as n from li where ship_month <= '1998-09' group by l_returnflag, l_linestatus")
def flagship(spark: SparkSession, folder: str) -> DataFrame:
    t = lineitem(spark, folder)
    return rows(select(t.l_returnflag, t.l_linestatus, h_sum(t.qty).named("sum_qty"), h_sum(t.price_cents).named("sum_price"), h_count().named("n"), where=t.ship_month <= "1998-09", order_by=(0, 1)))
