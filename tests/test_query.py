import io
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kolonna.api import *  # noqa: F403
from kolonna.api import Fold, Table, aggregate_expression, check_query, column_function, select, star, stat

ALBUMS = ["index uint32 id", "index lz4 name", "index string date", "index trie16 genre", "index uint16 rating", "artist", "uint32 quantity", "index bit live"]
SALES = ["index uint32 id", "index uint32 item_id", "index string date", "uint32 store_id", "uint32 quantity", "string price"]
ROWS = [(i, f"n{i % 7}", f"199{i % 3}", "RJB"[i % 3 : i % 3 + 1], i % 5, f"a{i % 4}", i * 10, i % 2) for i in range(40)]
SOLD = [(i, i % 20, "d", i % 3, i, "9") for i in range(30)]


@pytest.fixture(scope="module")
def albums(spark):
    df = spark.createDataFrame(ROWS, "id long, name string, date string, genre string, rating int, artist string, quantity long, live int").withColumn("live", F.col("live").cast("byte"))
    return Table.from_frame("albums", df, ALBUMS, "date")


@pytest.fixture(scope="module")
def sales(spark):
    return Table.from_frame("sales", spark.createDataFrame(SOLD, "id long, item_id long, date string, store_id long, quantity long, price string"), SALES)


def got(*project, **kw):
    return sorted(tuple(r) for r in select(*project, **kw))


def test_predicates(albums):
    a = albums
    cases = [
        (a.rating == 3, lambda r: r[4] == 3), (a.rating != 3, lambda r: r[4] != 3), (a.rating < 3, lambda r: r[4] < 3), (a.rating <= 3, lambda r: r[4] <= 3), (a.rating > 3, lambda r: r[4] > 3),
        (a.rating >= 3, lambda r: r[4] >= 3), (a.genre << ["R", "J"], lambda r: r[3] in "RJ"), (a.genre >> ["R"], lambda r: r[3] != "R"), (a.genre << [], lambda r: False), (a.genre >> (), lambda r: True),
        (a.rating << [(1, "x"), (2, "y")], lambda r: r[4] in (1, 2)), (a.live == True, lambda r: r[7] == 1), (a.live == 0, lambda r: r[7] == 0), (a.live != True, lambda r: r[7] == 0),  # noqa: E712
        (~((a.date > "1990") & (a.rating == 1)), lambda r: not (r[2] > "1990" and r[4] == 1)), ((a.date == 1991) | ((a.date == "1992") & (a.rating == 1)), lambda r: r[2] == "1991" or (r[2] == "1992" and r[4] == 1)),
        (((a.date >= "1991") & (a.date <= "1991")) | (a.rating == 0), lambda r: r[2] == "1991" or r[4] == 0), (~(a.rating << [1]), lambda r: r[4] != 1), (year(a.date) == 1992, lambda r: r[2] == "1992"),  # noqa: F405
    ]
    for condition, want in cases:
        assert got(a.id, where=condition) == sorted((r[0],) for r in ROWS if want(r)), condition
    assert (a.date == "1991").partition_only and not ((a.date == "1991") & (a.rating == 1)).partition_only and (~(a.date << ["1"]) | (a.date > "2")).partition_only


def test_membership_of_a_query(albums, sales):
    few = select(sales.item_id, where=sales.id < 5)
    assert got(albums.id, where=albums.id << few) == [(i,) for i in range(5)]
    assert got(albums.id, where=albums.id >> few) == [(i,) for i in range(5, 40)]
    assert got(albums.id, where=~(albums.id << few)) == [(i,) for i in range(5, 40)]
    assert got(albums.id, where=(albums.id << few) & (albums.rating == 1)) == [(1,)]
    assert got(albums.id, where=(albums.id << few) | (albums.id == 30)) == [(0,), (1,), (2,), (3,), (4,), (30,)]
    assert got(albums.id, where=(albums.id >> few) | (albums.id == 0)) == [(0,), *((i,) for i in range(5, 40))]


def test_illegal_predicates(albums, sales):
    for make in (lambda: albums.artist == "x", lambda: albums.quantity > 1, lambda: albums.name < "x", lambda: albums.genre >= "R", lambda: albums.id == albums.rating):
        with pytest.raises(TypeError):
            make()
    for make in (lambda: albums.name << "text", lambda: albums.id << 5, lambda: (albums.id == 1) & (sales.id == 1)):
        with pytest.raises(ValueError):
            make()
    with pytest.raises(TypeError):
        bool(albums.id == 1)
    with pytest.raises(AttributeError):
        albums.nothing


def test_checker(albums, sales):
    one, both = [albums.rating > 3], [albums.rating > 3, sales.id == 1000]
    join = [albums.id, sales.item_id]
    for arguments in (
        ([], [], [], None, one), ([albums.name, albums.name], [], [], None, one), ([albums.name], [], [], None, [sales.id == 1]), ([albums.name], [], [], None, []), ([albums.name], join, [], None, one),
        ([albums.name], [albums.id, sales.price], [], None, both), ([albums.name], [albums.id, albums.id], [], None, both), ([albums.name], [albums.rating, sales.id], [], None, both), ([albums.name], [], [albums.rating], None, one),
        ([albums.name], [], [], -1, one), ([albums.name], [], [1], None, one), ([albums.name], [], ["nothing"], None, one), ([albums.name], [], [], None, [albums, albums.id == 1]), (["name"], [], [], None, one),
    ):
        with pytest.raises(ValueError):
            check_query(*arguments)
    assert check_query([albums.name, sales.price], join, [albums.name, "price", 0, "albums.name"], 100, both)
    with pytest.raises(ValueError):
        select(albums.id, where=(albums, sales), join="genre")


def test_grouping_order_limit(albums):
    want = {}
    for r in ROWS:
        n, q = want.get(r[3], (0, 0))
        want[r[3]] = n + 1, q + r[6]
    assert got(albums.genre, h_count(), h_sum(albums.quantity), where=albums) == sorted((g, n, q) for g, (n, q) in want.items())  # noqa: F405
    rows = list(select(albums.rating, albums.id, where=albums, order_by=albums.rating, desc=True, limit=9))
    assert rows == sorted(((r[4], r[0]) for r in ROWS), reverse=True)[:9]
    assert list(select(albums.id, where=albums, order_by=0, limit=0)) == [(i,) for i in range(40)]
    assert list(select(albums.genre, h_max(albums.name), where=albums, order_by="max(name)", limit=1))[0][1] == "n6"  # noqa: F405
    assert len(got(albums.rating, albums.live, where=albums, distinct=True)) == 10
    assert got(h_sum(albums.quantity), h_count(), h_min(albums.id), where=albums.id > 999) == [(0, 0, None)]  # noqa: F405
    assert got(h_avg(albums.quantity), where=albums) == [(195.0,)]  # noqa: F405
    assert got(albums.live, h_combine(albums.rating, "-"), where=albums.id < 4) == [(0, "0-2"), (1, "1-3")]  # noqa: F405


def test_user_aggregates(albums):
    fold = Fold("spread", albums.quantity, T.LongType(), lambda: [], lambda acc, v: [*acc, v], lambda a, b: a + b, lambda acc: max(acc) - min(acc) if acc else -1)
    squares = aggregate_expression("squares", albums.rating, lambda c: F.sum(c * c))
    got_rows = {r[0]: r[1:] for r in select(albums.genre, fold, squares, where=albums)}
    for genre, row in got_rows.items():
        mine = [r for r in ROWS if r[3] == genre]
        assert row == (max(r[6] for r in mine) - min(r[6] for r in mine), sum(r[4] ** 2 for r in mine))
    assert got(fold, where=albums.id > 99) == [(-1,)] and got(fold, h_count(), where=albums) == [(390, 40)]  # noqa: F405


def test_joins_and_nesting(albums, sales):
    by_id = {r[0]: r for r in ROWS}
    want = sorted((by_id[s[1]][1], s[0]) for s in SOLD)
    for join in ((albums.id, sales.item_id), ("id", "item_id")):
        assert got(albums.name, sales.id, where=(albums, sales), join=join) == want
    assert got(albums.id, sales.id, where=(albums.id < 3, sales.id > 3), join="id") == []
    same = select(albums.id, sales.id, where=(albums, sales), join="id").frame
    assert same.columns == ["albums.id", "sales.id"] and same.count() == 30
    assert len(got(albums.id, sales.id, where=(albums.id < 3, sales.id < 4), full_join=True)) == 12
    a = select(albums.genre, h_count().named("n"), where=albums, nest=True)  # noqa: F405
    assert got(a.genre, where=a.n > 13) == [("R",)]
    b = select(a.genre.named("g"), a.n, where=a, nest=True)
    assert got(a.genre, b.n, where=(a, b), join=(a.genre, b.g)) == [("B", 13), ("J", 13), ("R", 14)]


def test_concatenation(albums, sales):
    rows = list(select(albums.id, sales.price, h_count().named("n"), where=(albums.id < 2, sales.id < 3)))  # noqa: F405
    assert sorted(rows, key=str) == sorted([(0, None, 1), (1, None, 1), (None, "9", 3)], key=str)
    assert len(list(select(albums.id, sales.price, where=(albums, sales)))) == 70
    assert len(list(select(albums.live, sales.price, where=(albums, sales), distinct=True))) == 3


def test_dump_future_and_errors(albums):
    out = io.StringIO()
    with redirect_stdout(out):
        assert select(albums.name, h_sum(albums.quantity).named("sum"), where=albums, order_by=1, dump=True) is None  # noqa: F405
    assert "name" in out.getvalue() and "1,0" in out.getvalue()
    future = select(albums.id, where=albums.id < 3, block=False)
    assert sorted(future.wait(60)) == [(0,), (1,), (2,)] and future.done and future.status() == "ready"
    with pytest.raises(TypeError):
        future.table  # noqa: B018
    nested = select(albums.id, where=albums, block=False, nest=True)
    nested.wait(60)
    assert nested.table.frame.count() == 40
    future.purge()

    @column_function(T.StringType(), native=False)
    def fails(values):
        raise RuntimeError("no")

    dead = select(fails(albums.name), where=albums, block=False)
    with pytest.raises(Exception):  # noqa: B017
        dead.wait(60)
    assert dead.status() == "dead"


def test_stat_and_handles(albums, spark):
    assert stat(albums)["_"] == 40 and stat(albums)["id"] == 100 and stat(albums.date == "1990")["_"] == 14
    assert stat(albums, limit=1)["_"] == 14
    again = Table.loads(albums.dumps())
    assert again._fields == albums._fields and again._partition == "date"
    assert len(list(albums)) == 40 and [c.name for c in star(albums)] == [s.split(" ")[-1] for s in ALBUMS]


def test_plans_push_down(spark, tmp_path):
    spark.range(1000).selectExpr("id", "id % 7 as k", "cast(id as string) as s").write.parquet(str(tmp_path / "t"))
    t = Table.from_parquet(spark, "t", str(tmp_path / "t"))
    plan = select(t.id, where=(t.k == 3) & (t.id > 10)).frame._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(k), EqualTo(k,3)" in plan.replace("IsNotNull(id), ", "").replace("IsNotNull(k), IsNotNull(id)", "IsNotNull(k)") or "EqualTo(k,3)" in plan
    assert "ReadSchema: struct<id:bigint,k:bigint>" in plan
    top = select(t.id, where=t, order_by=0, limit=5).frame._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in top


def test_folds_and_extremes_without_values(spark):
    t = Table.from_frame("t", spark.createDataFrame([("a", 1), ("a", 3), ("a", 2), ("b", None), (None, 5)], "k string, v int"))
    fold = lambda: Fold("f", t.v, T.LongType(), lambda: 0, lambda acc, v: acc + (v or 0), lambda a, b: a + b)
    want = [("a", 6, [3, 2], [1, 2], 3), ("b", 0, [], [], 1), (None, 5, [5], [5], 1)]
    found = select(t.k, fold(), h_nlargest(t.v, 2), h_nsmallest(t.v, 2), h_count(), where=t)  # noqa: F405
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)
    assert sorted(map(tuple, select(t.k, h_nlargest(t.v, 1), where=t)), key=str) == sorted([(k, v[:1]) for k, _, v, _, _ in want], key=str)  # noqa: F405
    none = t.v > 100
    assert [tuple(r) for r in select(fold(), h_nlargest(t.v, 2), where=none)] == [(0, [])]  # noqa: F405
    plan = select(fold(), where=t).frame._jdf.queryExecution().executedPlan().toString()
    assert "Coalesce" not in plan and "Exchange" in plan


def test_parts_profile_and_purge(spark, capsys):
    t = Table.from_frame("t", spark.range(1000).selectExpr("id % 50 as k", "id as v"))
    whole = select(t.k, h_count(), where=t, partition=3)  # noqa: F405
    assert whole.frame.rdd.getNumPartitions() == 3 and len(list(whole)) == 50
    ordered = select(t.v, where=t, order_by=0, desc=True, partition=4)
    assert [r[0] for r in ordered] == list(range(999, -1, -1)) and ordered.frame.rdd.getNumPartitions() <= 4
    kept = select(t.k, where=t, purge=False, profile=True)
    assert kept.frame.storageLevel.useMemory and "Physical Plan" in capsys.readouterr().out
    kept.purge()
    assert not kept.frame.storageLevel.useMemory
    for wrong in ({"partition": -1}, {"max_cores": -1}):
        with pytest.raises(ValueError):
            select(t.k, where=t, **wrong)


def test_nulls_are_neither_in_nor_out(spark):
    t = Table.from_frame("t", spark.createDataFrame([(1,), (2,), (None,)], "k int"))
    o = Table.from_frame("o", spark.createDataFrame([(1,), (None,)], "k int"))
    inner, nothing = select(o.k, where=o), select(o.k, where=o.k > 5)
    for values in ([1], inner):
        assert got(t.k, where=t.k << values) == [(1,)] and got(t.k, where=t.k >> values) == [(2,)] and got(t.k, where=~(t.k << values)) == [(2,)]
        assert got(t.k, where=~((t.k << values) | (t.k == 7))) == [(2,)] and got(t.k, where=~((t.k >> values) & (t.k < 7))) == [(1,)]
    for values in ([], nothing):
        assert got(t.k, where=t.k << values) == [] and got(t.k, where=t.k >> values) == [(1,), (2,)] and got(t.k, where=~((t.k << values) | (t.k == 7))) == [(1,), (2,)]


def test_history(tmp_path):
    from kolonna.__main__ import keep_history

    calls = []

    class Lines:
        set_history_length = staticmethod(lambda n: calls.append(n))
        read_history_file = staticmethod(lambda p: calls.append(p))
        write_history_file = staticmethod(lambda p: None)

    keep_history(Lines, str(tmp_path / "h"))
    (tmp_path / "h").write_text("x")
    keep_history(Lines, str(tmp_path / "h"))
    assert calls == [1000, 1000, str(tmp_path / "h")]
