import numpy as np
import pandas as pd
import pytest

from kolonna.llm.percentiles import compact, merge_sketches, percentile_sketches, sketch_percentiles


def exact(values, q):
    v = np.sort(np.asarray(values))
    return v[min(len(v), max(1, int(np.ceil(round(q * len(v), 6))))) - 1]


def rank_error(values, got, q):
    v = np.sort(np.asarray(values))
    low, high = np.searchsorted(v, got, "left"), np.searchsorted(v, got, "right")
    target = q * len(v)
    return max(0, low - target, target - high) / len(v)


def test_small_groups_are_exact_with_nulls_and_null_keys(spark):
    rows = [("a", 5), ("a", 1), ("a", 9), ("a", None), ("b", None), (None, 7), ("", 3), ("a", 9)]
    df = spark.createDataFrame(rows, "k string, v bigint").withColumnRenamed("k", "sketch_n")  # a clashing name
    out = {r[0]: tuple(r)[1:] for r in sketch_percentiles(percentile_sketches(df, ["sketch_n"], "v"), {"p0": 0, "p50": 0.5, "p100": 1}).collect()}
    assert out == {"a": (4, 1, 5, 9), "b": (0, None, None, None), None: (1, 7, 7, 7), "": (1, 3, 3, 3)}


def test_empty_and_doubles(spark):
    empty = spark.createDataFrame([], "k string, v double")
    assert sketch_percentiles(percentile_sketches(empty, ["k"], "v"), {"p": 0.5}).count() == 0
    df = spark.createDataFrame([(1, 0.5), (1, float("nan")), (1, -2.5), (1, None)], "k int, v double")
    assert [tuple(r) for r in sketch_percentiles(percentile_sketches(df, [], "v"), {"p": 0.5}).collect()] == [(2, -2.5)]
    with pytest.raises(ValueError):
        sketch_percentiles(percentile_sketches(df, ["k"], "v"), {"p": 2})


def test_rank_error_of_merged_parts_is_within_the_bound(spark):
    rng = np.random.default_rng(1)
    n, k = 300_000, 256
    data = pd.DataFrame({"hot": rng.random(n) < 0.7, "day": rng.integers(0, 5, n), "v": (rng.pareto(1.1, n) * 1000).astype("int64")})
    df = spark.createDataFrame(data).repartition(7)
    parts = percentile_sketches(df, ["hot", "day"], "v", k=k)
    probs = {"low": 0, "high": 1, "p01": 0.01, "p25": 0.25, "p50": 0.5, "p90": 0.9, "p999": 0.999}
    for keys in (["hot", "day"], ["hot"], []):
        out = sketch_percentiles(parts if len(keys) == 2 else merge_sketches(parts, keys, k=k), probs).toPandas()
        for _, r in out.iterrows():
            values = data["v"]
            for key in keys:
                values = values[data[key] == r[key]]
            assert r["n"] == len(values)
            assert (r["low"], r["high"]) == (values.min(), values.max())
            for name, q in probs.items():
                assert rank_error(values, r[name], q) <= 1.7 * 1.5 / k  # 20 groups times 5 percentiles: a margin over the 99 % bound


def test_items_keep_their_weight():
    rng = np.random.default_rng(0)
    g = rng.integers(0, 3, 10_001)
    group, level, value = compact(g, np.zeros(len(g), np.int64), rng.integers(0, 99, len(g)), 64, rng)
    for i in range(3):
        assert (1 << level[group == i]).sum() == (g == i).sum()
        assert (group == i).sum() < 64 * 3 + 8 * 12


def test_without_keys_the_parts_are_merged_before_the_last_task(spark):
    states = percentile_sketches(spark.range(100), [], "id")
    plan = states._jdf.queryExecution().executedPlan().toString()
    assert "Coalesce" not in plan and plan.count("Exchange") == 2
