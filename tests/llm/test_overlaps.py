import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kolonna.llm.overlaps import BLOCK_SETS, all_overlaps, candidate_pairs, common, decode_run, encode_run, gallop, given_overlaps, merge, set_overlaps, sorted_runs


def test_runs_survive_encoding_and_both_ways_count_alike():
    rng = np.random.default_rng(0)
    for n, top in ((1, 2**64 - 1), (1000, 2**63), (50_000, 200_000), (2, 2**64 - 1)):
        large = np.unique(rng.integers(0, top, n, dtype=np.uint64, endpoint=True))
        assert (decode_run(encode_run(large)) == large).all()
        for small in (large[::7], np.unique(rng.integers(0, top, 60, dtype=np.uint64)), large[-1:], large[:1]):
            want = len(np.intersect1d(small, large))
            assert gallop(small, large) == merge(small, large) == common(small, large) == common(large, small) == want
    assert common(large, large[:0]) == 0


def brute(rows, share, least):
    sets = {}
    for s, i in rows:
        if s is not None and i is not None:
            sets.setdefault(s, set()).add(i)
    names = sorted(s for s in sets if len(sets[s]) >= least)
    return {(a, b, len(sets[a]), len(sets[b]), len(sets[a] & sets[b])) for k, a in enumerate(names) for b in names[k + 1 :] if len(sets[a] & sets[b]) >= share * len(sets[a] | sets[b])}


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    out = []
    for s in range(60):
        size = int(rng.choice([40, 60, 200, 900]))
        own = rng.integers(0, 30_000, size)
        if s % 3 == 1:  # shares with the one before
            own = np.r_[own[: size // 2], last[: size // 2]]
        last = own
        out += [(f"s{s}", f"t{i}") for i in own] + [(f"s{s}", "everywhere")]
    out += [("hot", f"t{i}") for i in range(30_000)] + [("big", f"t{i}") for i in range(9_000, 26_000)]
    return out + out[::9] + [(None, "t1"), ("s1", None), ("", "t5")]


def test_overlaps_equal_brute_force(spark, rows):
    df = spark.createDataFrame(rows, "size string, shared string")
    for least in (1, 40):
        got = {tuple(r) for r in set_overlaps(df, "size", "shared", 0.25, least, range_rows=5000).collect()}
        assert got == brute(rows, 0.25, least) and len(got) > 10


def test_crowded_signatures_have_an_exact_way(spark):
    # all sets share 30 identifiers and have few others: with a crowd of 4 nearly every bin is crowded
    rows = [(f"s{s}", f"c{i}") for s in range(30) for i in range(40)] + [(f"s{s}", f"{s}-{i}") for s in range(30) for i in range(s)]
    got = {tuple(r) for r in set_overlaps(spark.createDataFrame(rows, "k string, i string"), "k", "i", 0.6, crowd=4).collect()}
    assert got == brute(rows, 0.6, 1)


@pytest.mark.parametrize("own,everywhere", [(25, 15), (650, 350)])
def test_pairs_in_crowded_identifiers_alone(spark, own, everywhere):
    # common identifiers are in far fewer than half of the bins, and nothing else is shared
    rows = [(f"s{s}", f"c{i}") for s in range(24) for i in range(everywhere)] + [(f"s{s}", f"{s}-{i}") for s in range(24) for i in range(own)]
    # s0 and s1 have a quarter of that besides, and one holds common identifiers only
    rows += [("thin", f"c{i}") for i in range(everywhere)] + [(s, f"two-{i}") for s in ("s0", "s1") for i in range(own // 4)]
    df = spark.createDataFrame(rows, "k string, i string")
    for block_sets in (BLOCK_SETS, 5):
        runs, names, _ = sorted_runs(df, "k", "i")
        assert candidate_pairs(runs, names, 0.19, 1, crowd=8, block_sets=block_sets).count() == 25 * 24 // 2
    got = {tuple(r) for r in set_overlaps(df, "k", "i", 0.19, crowd=8).collect()}
    assert got == brute(rows, 0.19, 1) and len(got) == 25 * 24 // 2


def test_no_pair_is_lost_at_the_default_crowd(spark):
    # more sets than CROWD share their common identifiers, and nothing else
    n = 560
    sets = spark.range(n).select(F.concat(F.lit("s"), "id").alias("k"), F.explode(F.concat(F.transform(F.sequence(F.lit(1), F.lit(15)), lambda i: F.concat(F.lit("c"), i.cast("string"))), F.transform(F.sequence(F.lit(1), F.lit(25)), lambda i: F.concat("id", F.lit("-"), i.cast("string"))))).alias("i"))
    found = set_overlaps(sets, "k", "i", 0.2, 40).agg(F.count(F.lit(1)), F.min("shared"), F.max("shared")).collect()[0]
    assert tuple(found) == (n * (n - 1) // 2, 15, 15)


def test_recall_of_large_sets_at_the_limit(spark):
    # 60 pairs of sets of 500 to 5,000 identifiers that share a little more than a quarter of their union
    rng = np.random.default_rng(9)
    rows, want = [], set()
    for p in range(60):
        shared = int(rng.integers(200, 2000))
        own = int(shared * 1.45)
        for side in "ab":
            rows += [(f"{p}{side}", f"{p}-{i}") for i in range(shared)] + [(f"{p}{side}", f"{p}{side}{i}") for i in range(own)]
        want.add((f"{p}a", f"{p}b"))
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["k", "i"]))
    assert {(r[0], r[1]) for r in set_overlaps(df, "k", "i", 0.25, 40).collect()} == want


def test_all_pairs_without_a_share(spark, rows):
    small = [r for r in rows if r[0] not in ("hot", "big")] + [("tiny", "everywhere"), ("lone", "only here")]
    df = spark.createDataFrame(small, "k string, i string")
    want = {r for r in brute(small, 0, 1) if r[4]}
    assert ("s0", "tiny") in {r[:2] for r in want}
    for crowd in (512, 7):
        got = [tuple(r) for r in all_overlaps(df, "k", "i", crowd).collect()]
        assert set(got) == want and len(got) == len(want)


def test_given_pairs_and_empty(spark, rows):
    df = spark.createDataFrame(rows, "k string, i string")
    pairs = spark.createDataFrame([("hot", "big"), ("s0", "s1"), ("nobody", "hot"), (None, "s1")], "x string, y string")
    got = {(r[0], r[1]): r[2] for r in given_overlaps(df, "k", "i", pairs).collect()}
    members = lambda s: {i for k, i in rows if k == s and i is not None}
    assert got == {("hot", "big"): 17_000, ("s0", "s1"): len(members("s0") & members("s1")), ("nobody", "hot"): 0, (None, "s1"): 0}
    assert set_overlaps(df.limit(0), "k", "i", 0.25).count() == 0
