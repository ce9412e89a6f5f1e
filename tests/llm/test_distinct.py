import pandas as pd
import numpy as np

from kolonna.llm.distinct import distinct_bitmaps, distinct_estimates, error_bound, merge_bitmaps, merge_bitmaps_cube


def test_nulls_empty_and_clashing_names(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", None), ("b", None), (None, 2)], "mrb_word string, `x``y` int").selectExpr("mrb_word", "`x``y` as mrb_mask", "1 as n_rows")
    out = {r[0]: tuple(r)[1:] for r in distinct_estimates(distinct_bitmaps(df, ["mrb_word"], "mrb_mask")).collect()}
    assert out == {"a": (2, 1), "b": (0, 0), None: (1, 1)}
    assert distinct_estimates(distinct_bitmaps(df.limit(0), ["mrb_word"], "mrb_mask")).count() == 0


def test_error_at_all_scales_and_after_merges(spark):
    sizes = [100, 2_000, 30_000, 200_000]
    df = None
    for n in sizes:
        ids = spark.range(n * 6).selectExpr(f"{n} as n", f"id % 6 as seed", f"concat({n}, '-', id) as x", "id % 3 as day")
        df = ids if df is None else df.union(ids)
    df = df.union(df.where("day = 1"))
    for bits in (256, 4096):
        parts = distinct_bitmaps(df, ["n", "seed", "day"], "x", bits=bits)
        got = distinct_estimates(merge_bitmaps(parts, ["n", "seed"]), bits).toPandas()
        assert len(got) == 24 and (got.n_rows >= got.n).all()
        errors = got.n_distinct / got.n - 1
        assert np.sqrt(np.mean(np.square(errors))) < error_bound(bits)
        assert np.max(np.abs(errors)) < 3.5 * error_bound(bits)


def test_merge_equals_building_at_once(spark):
    df = spark.range(5000).selectExpr("id % 7 as a", "id % 5 as b", "id * id % 999 as x")
    parts = distinct_bitmaps(df, ["a", "b"], "x")
    cube = distinct_estimates(merge_bitmaps_cube(parts, ["a", "b"], [["a", "b"], ["a"], []])).toPandas()
    for keys, gid in ((["a", "b"], 0), (["a"], 1), ([], 3)):
        direct = distinct_estimates(distinct_bitmaps(df, keys, "x")).toPandas()
        part = cube[cube.grouping_id == gid]
        pd.testing.assert_frame_equal(part[[*keys, "n_rows", "n_distinct"]].sort_values(keys or "n_rows").reset_index(drop=True).astype(direct.dtypes), direct.sort_values(keys or "n_rows").reset_index(drop=True))
