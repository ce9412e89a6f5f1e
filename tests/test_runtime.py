from types import SimpleNamespace

import pytest

from kolonna import runtime


def test_scratch_paths_go_with_their_scope(spark):
    from kolonna.catalog import Files

    kept = runtime.scratch_path(spark, "kept")
    spark.range(3).write.parquet(kept)
    with runtime.scratch():
        inside = runtime.materialize(spark.range(5), "inside")
        assert inside.count() == 5
        path = inside.inputFiles()[0].rpartition("/")[0]
    assert Files(spark).exists(kept) and not Files(spark).exists(path)


def test_a_cluster_needs_a_shared_folder():
    values = {}
    conf = SimpleNamespace(get=lambda k, d=None: values.get(k, d), set=values.__setitem__)
    made = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="yarn", setCheckpointDir=lambda p: None))
    with pytest.raises(ValueError):
        runtime.shared_dir(made)
    values["spark.checkpoint.dir"] = "hdfs://x/y/"
    assert runtime.shared_dir(made) == "hdfs://x/y"
    values.clear()
    made.sparkContext.master = "local[2]"
    assert runtime.shared_dir(made).startswith("file://") and values
