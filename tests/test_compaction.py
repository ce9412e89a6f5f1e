import random

import pytest

from kolonna.operators.compaction import compact_records, longest_first, read_compacted, read_manifest

KEYS = ["t", "d"]


def run(spark, listing, records, folder, **kw):
    return compact_records(spark.createDataFrame(listing, "t string, d string, id bigint, node string"), spark.createDataFrame(records, "id bigint, rid int, line string, slot string"), folder, KEYS, "id", "rid", "line", **kw)


def test_every_record_exactly_once(spark, tmp_path):
    rng = random.Random(5)
    listing, records = [], []
    for f in range(120):
        part = ("big" if f < 80 else rng.choice(["a", None]), rng.choice(["1", "2"]) if f % 3 else "1")
        listing += [(*part, f, f"n{r}") for r in range(2)] + [(*part, f, "n0")] * (f % 2)
        records += [(f, r, None if r == 3 else f"{f}:{r}", "x") for r in range(0 if f % 10 == 0 else 700 if f == 7 else rng.randint(1, 30))]
    listing += [("a", "9", 7, "n"), (None, None, None, "n")]
    records += records[::5] + [(999, 0, "orphan", "x"), (7, None, "no number", "x"), (None, 1, "no file", "x"), (5, 0, "5:0 longer", "x")]
    folder = f"file://{tmp_path}/out"
    done = run(spark, listing, records, folder, target_rows=100, files_per_shard=30)
    want = {}
    for i, r, line, _ in records:
        want[(i, r)] = max((x for x in (want.get((i, r)), line) if x is not None), default=None)
    got = [tuple(r) for r in read_compacted(spark, folder).collect()]
    assert len(got) == len(want) and {(i, r): line for i, r, line in got} == want
    manifest = done.manifest.toPandas()
    assert sorted(manifest[manifest.stored_here].groupby("id", dropna=False).n_records.sum()) == sorted(sum(1 for k in want if k[0] == i) for i in {r[2] for r in listing if r[2] is not None} | {999, None})
    assert (manifest[manifest.id == 0].n_records == 0).all() and manifest[manifest.id == 0].path.isna().all()
    assert set(manifest[manifest.id == 7].t) == {"big", "a"}
    fills = manifest[manifest.stored_here].groupby("path").n_records.sum()
    assert fills.max() < 200 and len(fills) < 40


def test_equal_run_replaces_the_published_manifest(spark, tmp_path):
    folder = f"file://{tmp_path}/out"
    for n in (3, 5):
        run(spark, [("a", "1", 1, "n")], [(1, r, "z", "") for r in range(n)], folder)
        assert read_manifest(spark, folder).agg({"n_records": "sum"}).collect()[0][0] == n
        assert read_compacted(spark, folder).count() == n


def test_empty(spark, tmp_path):
    done = run(spark, [], [], f"file://{tmp_path}/out")
    assert done.manifest.count() == 0
    with pytest.raises(ValueError):
        done.records(spark)


def test_longest_first_is_balanced(spark):
    rng = random.Random(2)
    sizes = [rng.randint(1, 100) for _ in range(500)]
    units = spark.createDataFrame([("p", 7, i, s) for i, s in enumerate(sizes)] + [("q", 1, 1000, 5)], "bin_key string, bins int, unit int, size bigint")
    loads = longest_first(units).toPandas().groupby("slot")["size"].sum()
    assert len(loads) == 8 and loads["q/0"] == 5
    assert loads.drop("q/0").max() - loads.drop("q/0").min() <= 100


def test_a_record_repeated_over_batches_is_written_once(spark, tmp_path):
    # payloads differ, so the repeats meet only in the sorted stream, over several Arrow batches
    records = spark.range(25_000).selectExpr("1L as id", "cast(id % 2 as int) as rid", "lpad(id, 9, '0') as line", "'' as slot")
    listing = spark.createDataFrame([("a", "1", 1, "n"), ("b", "2", 1, "n")], "t string, d string, id bigint, node string")
    done = compact_records(listing, records, f"file://{tmp_path}/out", KEYS, "id", "rid", "line")
    assert sorted(tuple(r) for r in done.records(spark).collect()) == [(1, 0, "000024998"), (1, 1, "000024999")]
    assert sorted((r.t, r.n_records, r.stored_here) for r in done.manifest.collect()) == [("a", 2, True), ("b", 2, False)]
