import numpy as np
import pandas as pd

from kolonna.operators.heavy_keys import heavy_keys, keyed_aggregate


def brute(rows, gap):
    """rows: (key, order, value)"""
    out = {}
    for key in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == key]
        orders = sorted(r[1] for r in mine if r[1] is not None)
        values = [r[2] for r in mine if r[2] is not None]
        sessions = sum(1 for i, o in enumerate(orders) if i == 0 or o - orders[i - 1] > gap)
        out[key] = (len(mine), len(values), sum(values) if values else None, min(values, default=None), max(values, default=None), orders[0] if orders else None, orders[-1] if orders else None, len(set(orders)), sessions)
    return out


def test_hot_key_cut_into_partitions_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(6000):
        u = rng.random()
        key = "hot" if u < 0.5 else (None if u < 0.55 else f"k{rng.integers(0, 400)}")
        order = None if rng.random() < 0.05 else int(rng.integers(0, 300)) * 7
        rows.append((key, order, None if rng.random() < 0.1 else int(rng.integers(-50, 50))))
    rows += rows[:300]  # repeated rows
    df = spark.createDataFrame(rows, "n_rows string, last_order bigint, _tie bigint").repartition(5)
    got = keyed_aggregate(df, ["n_rows"], "last_order", "_tie", gap=7, partitions=9)
    assert got.columns[:2] == ["n_rows", "n_rows_"]
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == brute(rows, 7)


def test_one_key_of_equal_orders_is_split_and_stitched(spark):
    df = spark.range(4000, numPartitions=8).selectExpr("'x' as k", "'d' as o", "1.5D as v")
    got = keyed_aggregate(df, ["k"], "o", "v", partitions=4).collect()
    assert [tuple(r) for r in got] == [("x", 4000, 4000, 6000.0, 1.5, 1.5, "d", "d", 1, None)]


def test_empty_nan_and_all_null(spark):
    empty = spark.createDataFrame([], "k string, o int")
    assert keyed_aggregate(empty, ["k"], "o").count() == 0
    df = spark.createDataFrame([(None, None, float("nan")), (None, None, None)], "k string, o int, v double")
    r = keyed_aggregate(df, ["k"], "o", "v", gap=1).collect()[0]
    assert tuple(r) == (None, 2, 0, None, None, None, None, None, 0, 0)


def test_heavy_keys(spark):
    data = pd.DataFrame({"t": ["a"] * 100 + ["b"] * 10, "k": ["h"] * 40 + [f"x{i}" for i in range(60)] + ["h"] * 1 + [f"y{i}" for i in range(9)], "o": range(110)})
    got = heavy_keys(spark.createDataFrame(data), ["t", "k"], "o", 0.2, ["t"])
    assert sorted(tuple(r) for r in got.collect()) == [("a", "h", 40, 100)]
