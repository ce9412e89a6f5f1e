import pytest
import socket
import struct

from pyspark.sql import functions as F

from kolonna.api import Table, day, ip_aton, ip_ntoa, month, select, year
from kolonna.functions.sketches import extreme_values, hash_sample, hll_intersection, hll_sketches, jaccard, merge_samples


def aton(text):
    try:
        return struct.unpack(">L", socket.inet_aton(text))[0]
    except (OSError, TypeError):
        return 0


def test_addresses(spark):
    texts = ["1.2.3.4", "255.255.255.255", "256.1.1.1", "1.2.3", "1.2", "16909060", "0x7f.1", "010.1.1.1", "1.2.3.", "", "word", None, "1.2.3.4.5", "4294967295", "4294967296", "1.2.65535", "1.2.65536", "1.16777215", "-1.2.3.4", "0.0.0.0", "1.2.3.08"]
    t = Table.from_frame("t", spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string"))
    assert [r[1] for r in select(t.i, ip_aton(t.x), where=t, order_by=0)] == [aton(x) for x in texts]
    numbers = [0, 1, 16909060, 4294967295, 4294967296, -1, None]
    t = Table.from_frame("t", spark.createDataFrame([(i, x) for i, x in enumerate(numbers)], "i int, x bigint"))
    assert [r[1] for r in select(t.i, ip_ntoa(t.x), where=t, order_by=0)] == ["0.0.0.0", "0.0.0.1", "1.2.3.4", "255.255.255.255", "0.0.0.0", "0.0.0.0", "0.0.0.0"]


def test_dates(spark):
    values = ["2014-01-27", "2014-1-2", "", None, "word", "99999-12-31", "2014"]

    def number(text, a, b):
        try:
            return int(text[a:b])
        except (TypeError, ValueError):
            return -1

    t = Table.from_frame("t", spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i int, x string"))
    rows = list(select(t.i, year(t.x), month(t.x), day(t.x), where=t, order_by=0))
    assert [r[1:] for r in rows] == [(number(x, 0, 4), number(x, 5, 7), number(x, -2, None)) for x in values]


def test_sketch_tables(spark):
    df = spark.range(3000).selectExpr("id % 2 as k", "id % 900 as x").union(spark.sql("select 0L, null"))
    a = hash_sample(df, ["k"], "x", 100)
    assert {r.k: len(r["sample"]) for r in a.collect()} == {0: 100, 1: 100} and all(r["sample"] == sorted(r["sample"], reverse=True) for r in a.collect())
    assert merge_samples(a, [], 100).collect()[0]["sample"] == hash_sample(df, [], "x", 100).collect()[0]["sample"]
    full = hash_sample(df, ["k"], "x", 1000, greatest=False).select(F.col("k"), F.col("sample").alias("s"))
    pair = full.alias("p").join(full.alias("q")).where("p.k = 0").select(F.col("q.k"), jaccard(F.col("p.s"), F.col("q.s"), capacity=1000, greatest=False).alias("j"))
    assert {r.k: r.j for r in pair.collect()} == {0: 1.0, 1: 0.0}
    both = hll_sketches(df, [], "x").crossJoin(hll_sketches(df.where("x < 300"), [], "x").withColumnRenamed("sketch", "y"))
    got = both.select(hll_intersection(F.col("sketch"), F.col("y")).alias("i")).collect()[0].i
    assert abs(got["count"] - 300) <= 4 * got.error


def test_intersections_and_similarities_of_several_sketches(spark):
    sets = [range(0, 60_000), range(20_000, 80_000), range(10_000, 50_000)]
    one = None
    for i, r in enumerate(sets):
        df = spark.range(r.start, r.stop)
        part = hll_sketches(df, [], "id").withColumnRenamed("sketch", f"h{i}").crossJoin(hash_sample(df, [], "id", 2000).withColumnRenamed("sample", f"m{i}"))
        one = part if one is None else one.crossJoin(part)
    h, m = ([F.col(f"{c}{i}") for i in range(3)] for c in "hm")
    empty = hll_sketches(spark.range(0), [], "id").withColumnRenamed("sketch", "none")
    row = one.crossJoin(empty).select(hll_intersection(*h).alias("i"), hll_intersection(h[0], F.col("none")).alias("z"), hll_intersection(h[0]).alias("s"), jaccard(*m, capacity=2000).alias("j"), jaccard(m[0], capacity=2000).alias("one")).collect()[0]
    unions = [60_000, 60_000, 40_000, 80_000, 60_000, 70_000, 80_000]
    squares = [(u * 1.04 / 64) ** 2 for u in unions]
    assert abs(row.i["count"] - 30_000) <= 4 * row.i.error
    assert abs(row.i.error / sum(squares) ** 0.5 - 1) < 0.1 and abs(row.i.resolution / (7 / sum(1 / s for s in squares)) ** 0.5 - 1) < 0.1
    assert tuple(row.z) == (0, 0, 0) and abs(row.s["count"] - 60_000) < 4000
    assert abs(row.j - 30_000 / 80_000) < 5 * (0.375 * 0.625 / 2000) ** 0.5 and row.one == 1.0
    with pytest.raises(ValueError):
        hll_intersection()


def test_empty_strings_count_in_sketches(spark):
    df = spark.createDataFrame([("",), (None,), ("a",)], "x string")
    assert hll_sketches(df, [], "x").select(F.hll_sketch_estimate("sketch")).collect()[0][0] == 2
    plain, given = hll_sketches(df, [], "x"), hll_sketches(df.where("x is not null").select(F.xxhash64("x").alias("h")), [], "h", is_hash=True)
    assert plain.crossJoin(given.withColumnRenamed("sketch", "other")).select(F.hll_sketch_estimate(F.hll_union("sketch", "other"))).collect()[0][0] == 2
    got = extreme_values(df.selectExpr("x", "1 as k"), ["k"], "x", 5).collect()
    assert [(r.k, r["sample"]) for r in got] == [(1, ["a", ""])]
