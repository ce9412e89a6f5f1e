import json

import pytest

from kolonna import __main__ as cli
from kolonna.api import Table, create, csv_decoder, delete, describe, drop, fixed_width_decoder, get_partitions, get_tables, h_count, insert, kv_decoder, open_table, select
from kolonna.settings import Settings, overrides
from kolonna.streaming.continuous import follow

COLUMNS = ["index uint8 n", "index trie name", "index string date", "bit b", "binary raw", "int64 big"]


@pytest.fixture
def warehouse(tmp_path):
    overrides["warehouse"] = f"file://{tmp_path}/tables"
    yield tmp_path
    overrides.pop("warehouse")


def rows(name):
    return sorted(tuple(r) for r in open_table(name).frame.select("n", "name", "date", "b", "big").collect())


def test_create_insert_delete_drop(spark, warehouse):
    t = create("t", COLUMNS, partition="date")
    assert create("t", COLUMNS) is None and get_tables() == ["t"] and list(t) == [] and open_table("u") is None
    lines = [json.dumps(x) for x in ({"n": 1, "name": "a", "date": "2014-01-01", "b": True, "big": 2**40}, {"n": "2", "date": "2014-01-02", "b": 0, "more": [1]}, {"n": 0, "name": None, "date": "", "b": None}, {"n": 300, "date": "x"}, {"n": -1}, {"n": "word"}, {"n": 7.9, "name": 5, "date": "2014-01-02"})] + ["{cut"]
    (warehouse / "in.json").write_text("\n".join(lines))
    done = insert(t, f"file://{warehouse}/in.json")
    assert (done.table, done.rows) == ("t", 4) and done.rejected == 4 and len(done.files) == 3
    assert rows("t") == [(0, "", "", 0, 0), (1, "a", "2014-01-01", 1, 2**40), (2, "", "2014-01-02", 0, 0), (7, "5", "2014-01-02", 0, 0)]
    assert get_partitions("t") == ["", "2014-01-01", "2014-01-02"]
    assert describe("t", index_only=True) == ["index string *date", "index trie32 name", "index uint8 n"]
    with pytest.raises(ValueError):
        delete(t.n == 1)
    with pytest.raises(ValueError):
        delete("t")
    assert delete(t.date == "2014-01-02") == ["2014-01-02"] and get_partitions(t) == ["", "2014-01-01"]
    assert delete(t) == ["", "2014-01-01"] and rows("t") == [] and get_tables() == ["t"]
    with pytest.raises(ValueError):
        drop(t.date == "x")
    drop(t)
    assert get_tables() == []


def test_partition_values_that_need_escapes_and_look_like_numbers(spark, warehouse):
    t = create("t", ["index string p", "int x"], partition="p")
    values = ["1", "01", "a/b=c", "é x", "2014-01-01"]
    insert(t, streams=[[json.dumps({"p": v, "x": i}) for i, v in enumerate(values)]])
    t = open_table("t")
    assert get_partitions(t) == sorted(values)
    assert sorted(r.p for r in t.frame.collect()) == sorted(values)
    assert delete(t.p << ["a/b=c", "1"]) == ["1", "a/b=c"] and get_partitions(t) == sorted(["01", "é x", "2014-01-01"])


def test_preprocess_filter_header_streams(spark, warehouse):
    t = create("t", COLUMNS, partition="date")

    def clean(record):
        if record["name"] == "bad":
            raise KeyError("x")
        record["name"] = record["name"].upper()
        return None if record["name"] != "DROP" else False

    lines = ["n,name,date", "1,a,d1", "2,drop,d1", "3,bad,d1", "4,b,d2", "5,c,d3", "6"]
    done = insert(t, streams=[lines], decoder=csv_decoder(["n", "name", "date"]), preprocess=clean, header=True, partition_filter=["d1", "d2"])
    assert (done.rows, done.rejected) == (2, 2)
    done = insert(t, streams=[["9|z|d1"], iter(["8|y|d1"])], decoder=csv_decoder(["n", "name", "date"], "|"), partition_filter="d1")
    assert done.rows == 2 and rows("t") == [(1, "A", "d1", 0, 0), (4, "B", "d2", 0, 0), (8, "y", "d1", 0, 0), (9, "z", "d1", 0, 0)]
    (warehouse / "h.csv").write_text("\n".join(lines[:2] + ["7,\"q,r"]))
    done = insert(t, f"file://{warehouse}/h.csv", decoder=csv_decoder(["n", "name", "date"]), header=True)
    assert done.rows == 2 and (7, '"q', "r", 0, 0) in rows("t")


def test_decoders_by_line_equal_their_native_form(spark, warehouse):
    lines = ["  12ab  2014", "7   cdefgh", "", "123456"]
    for decoder in (fixed_width_decoder([(0, "n"), (4, "name"), (8, "date")]), fixed_width_decoder([(0, "_"), (2, "name")]), csv_decoder(["name", "date"], " ")):
        names = ["n", "name", "date"]
        df = spark.createDataFrame([(x,) for x in lines], "value string")
        native = [tuple(r)[:3] for r in decoder.native(df, names).collect()]
        assert native == [tuple(decoder(x).get(n) for n in names) for x in lines]
    assert kv_decoder(["a", "b", "c"])((("1", "2"), ("3",))) == {"a": "1", "b": "2", "c": "3"}
    with pytest.raises(ValueError):
        fixed_width_decoder([(4, "a"), (0, "b")])


def test_new_columns_default_in_old_files_and_frames(spark, warehouse):
    t = create("t", ["index int a", "index string d"], partition="d")
    insert(t, frame=spark.sql("select 1 as a, 'x' as d union all select null, null"))
    t = create("t", ["index int a", "index string d", "index trie late", "bit flag"], partition="d", force=True)
    insert(t, frame=spark.sql("select 2 as A, 'x' as d, 'new' as late, true as flag"))
    assert sorted(tuple(r) for r in open_table("t").frame.collect()) == [(0, "", "", 0), (1, "x", "", 0), (2, "x", "new", 1)]
    t = open_table("t")
    assert sorted(select(t.a, where=t.late == "")) == [(0,), (1,)]
    plan = select(t.a, where=(t.d == "x") & (t.a == 1)).frame._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [(coalesce(d" in plan and "EqualTo(a,1)" in plan


def test_tag_and_handles(spark, warehouse):
    t = create("t", ["index int a"])
    insert(t, streams=[[{"a": i % 3} for i in range(9)]])
    t = open_table("t")
    saved = select(t.a, h_count().named("n"), where=t, nest=True, tag="counts")
    assert sorted(saved) == [(0, 3), (1, 3), (2, 3)]
    with pytest.raises(ValueError):
        select(t.a, where=t, nest=True, tag="counts")
    again = Table.loads(t.dumps(), spark)
    assert len(list(again)) == 9
    assert delete(t) == [] and list(open_table("t")) == []


def test_command_line(spark, warehouse, capsys):
    create("t", ["index int a", "name"])
    (warehouse / "x.csv").write_text("a;name\n1;one\n2;two\n")
    (warehouse / "list").write_text(f"file://{warehouse}/x.csv\n")
    assert cli.main(["insert", "t", "-f", str(warehouse / "list"), "--csv-fields", "a,name", "--delimiter", ";", "--header"]) == 0
    assert "2 rows" in capsys.readouterr().out
    assert sorted(open_table("t")) == [(1, "one"), (2, "two")]


def test_continuous_loading_is_exactly_once(spark, warehouse):
    t = create("t", ["index int a", "index string d"], partition="d")
    folder, marks = warehouse / "arrivals", f"file://{warehouse}/marks"
    folder.mkdir()
    for n in range(3):
        (folder / f"{n}.json").write_text("\n".join([json.dumps({"a": n * 10 + i, "d": f"d{n}"}) for i in range(3)] + ["broken"]))
        for _ in range(2):
            follow(spark, t, f"file://{folder}", marks, once=True).awaitTermination(120)
    assert sorted(r[0] for r in open_table("t")) == [n * 10 + i for n in range(3) for i in range(3)]


def test_settings(tmp_path):
    path = tmp_path / "s.yaml"
    path.write_text("nest: true\nhistory: 5\nmine: word\n")
    s = Settings.of(settings_file=str(path), history=7, other=1)
    assert s.nest is True and s.history == 7 and s.dump is False and dict(s.others) == {"mine": "word", "other": 1}


def test_compaction_of_a_stored_table(spark, warehouse):
    from kolonna.api import compact_table
    from kolonna.catalog import Catalog

    catalog = Catalog(spark)
    t = create("t", ["index int a", "index string p"], partition="p")
    assert compact_table(catalog, t) == (0, 0, 0)
    values = ["1", "a/b=c%25", "é x+y", ""]
    for n in range(5):
        insert(t, frame=spark.createDataFrame([(n * 100 + i, values[i % 4]) for i in range(20)], "a int, p string"))
    t = create("t", ["index int a", "index string p", "late"], partition="p", force=True)
    insert(t, frame=spark.sql("select 7 as a, '1' as p, 'new' as late"))
    before = sorted(tuple(r) for r in open_table("t").frame.collect())
    done = compact_table(catalog, open_table("t"))
    assert done.rows == 101 and done.files_before == 21 and done.files_after == 4
    assert sorted(tuple(r) for r in open_table("t").frame.collect()) == before and get_partitions("t") == sorted(values)
    insert(open_table("t"), frame=spark.sql("select 8 as a, '1' as p"))
    assert len(list(open_table("t"))) == 102
    assert delete(t.p == "1") == ["1"] and len(list(open_table("t"))) == 102 - 27
    with pytest.raises(ValueError):
        from kolonna.api import save

        save("t", open_table("t"))


def test_loads_and_deletes_during_compaction(spark, warehouse, monkeypatch):
    from kolonna.api import compact_table
    from kolonna.catalog import SEGMENT, Catalog
    from kolonna.operators import small_files

    catalog = Catalog(spark)
    t = create("t", ["index int a", "index string d"], partition="d")
    for n in range(3):
        insert(t, frame=spark.sql(f"select {n} as a, 'x' as d union all select {n} + 10, 'y'"))
    held = t.frame  # planned on the old files
    real = small_files.materialize

    def meanwhile(what):
        def run(df, label):
            done = real(df, label)
            if label == "published":
                what()
            return done

        monkeypatch.setattr(small_files, "materialize", run)

    meanwhile(lambda: insert(t, frame=spark.sql("select 99 as a, 'x' as d")))
    assert compact_table(catalog, t) == (6, 6, 2)
    want = [0, 1, 2, 10, 11, 12, 99]
    assert sorted(r[0] for r in open_table("t")) == want and sorted(r.a for r in held.collect()) == want[:6]
    # rows deleted while their files are copied, and files that another compaction has copied first
    meanwhile(lambda: delete(t.d == "y"))
    with pytest.raises(RuntimeError):
        compact_table(catalog, t)
    assert sorted(r[0] for r in open_table("t")) == [0, 1, 2, 99]

    def rival():
        monkeypatch.setattr(small_files, "materialize", real)
        compact_table(catalog, t)

    meanwhile(rival)
    with pytest.raises(RuntimeError):
        compact_table(catalog, t)
    assert sorted(r[0] for r in open_table("t")) == [0, 1, 2, 99]
    assert catalog.vacuum("t") == 0 and catalog.vacuum("t", 0) > 0
    folders = [n for n in catalog.files.names(f"{catalog.location('t')}/data", True) if n.startswith(SEGMENT)]
    assert len(folders) == len(catalog.state("t")["segments"]) and sorted(r[0] for r in open_table("t")) == [0, 1, 2, 99]


def test_two_writers_of_one_version(spark, warehouse):
    from concurrent.futures import ThreadPoolExecutor

    from kolonna.catalog import Catalog, segment_folder

    catalog = Catalog(spark)
    create("t", ["index int a"])
    assert catalog.files.write_new(f"{catalog.location('t')}/versions/x", "1") and not catalog.files.write_new(f"{catalog.location('t')}/versions/x", "2")
    with ThreadPoolExecutor(8) as pool:
        list(pool.map(lambda n: Catalog(spark).add_segment("t", f"s{n}"), range(60)))
    assert sorted(catalog.state("t")["segments"]) == sorted(f"s{n}" for n in range(60))
    assert len(catalog.files.names(f"{catalog.location('t')}/versions", False)) <= 53
    assert segment_folder("x", "s1") == "x/data/_kolonna_segment=s1"
    with pytest.raises(ValueError):
        create("u", ["index int _kolonna_segment"])


def test_a_batch_that_failed_before_its_commit_is_loaded_once(spark, warehouse, monkeypatch):
    from kolonna.catalog import Catalog
    from kolonna.streaming.continuous import followed

    t = create("t", ["index int a", "index string d"], partition="d")
    folder, marks = warehouse / "arrivals", f"file://{warehouse}/marks"
    folder.mkdir()
    (folder / "0.json").write_text("\n".join([json.dumps({"a": i, "d": f"d{i}"}) for i in range(4)] + ["broken"]))
    commit, calls = Catalog.commit, []

    def breaks(self, name, change):
        calls.append(name)
        if len(calls) == 1:
            raise OSError("gone")
        return commit(self, name, change)

    monkeypatch.setattr(Catalog, "commit", breaks)
    with pytest.raises(Exception):  # noqa: B017
        follow(spark, t, f"file://{folder}", marks, once=True).awaitTermination(120)
    assert list(open_table("t")) == []
    for _ in range(2):
        follow(spark, t, f"file://{folder}", marks, once=True).awaitTermination(120)
    assert sorted(r[0] for r in open_table("t")) == [0, 1, 2, 3]
    assert followed(spark, t, marks) == {"batch": 0, "rows": 4, "rejected": 1}


def test_streams_of_lines_and_records_are_one_load(spark, warehouse, monkeypatch):
    from kolonna.sources import ingest

    monkeypatch.setattr(ingest, "BATCH", 7)
    t = create("t", ["index int a", "name"])
    done = insert(t, streams=[[json.dumps({"a": i, "name": "l\n"}) for i in range(20)], ({"a": 100 + i, "name": "ré"} for i in range(20)), [b'{"a": 7}', {"a": "word"}, 5]])
    assert (done.rows, done.rejected) == (41, 2) and len(list(open_table("t"))) == 41
    assert insert(t, streams=[[]]).rows == 0
    late = create("t", ["index int a", "name", "int16 late"], force=True)
    again = Table.loads(late.dumps(), spark)
    assert {r[2] for r in again} == {0}
