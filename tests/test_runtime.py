"""The shared folder and the tables in it."""

from types import SimpleNamespace

import pytest

from radiolake.runtime import Stage, discard, materialize, shared_dir


def session(master, conf):
    nothing = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(master=master, getConf=lambda: conf, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: nothing)), setCheckpointDir=lambda d: None)
    return SimpleNamespace(sparkContext=context)


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "k8s://x", "local-cluster[3,2,1000]"])
def test_a_cluster_must_name_its_folder(master):
    with pytest.raises(RuntimeError, match=r"spark\.checkpoint\.dir"):
        shared_dir(session(master, {}))
    assert shared_dir(session(master, {"spark.checkpoint.dir": "hdfs://x/y/"})) == "hdfs://x/y"


def test_one_process_may_do_without():
    assert shared_dir(session("local[4]", {})).startswith("file:///")


def test_tables_go_when_dropped_or_discarded(spark):
    stage, kept = Stage(spark.range(3), "t"), materialize(spark.range(4), "u")
    assert stage.df.count() == 3 and kept.count() == 4
    stage.drop()
    with pytest.raises(Exception):
        spark.read.parquet(stage.path).count()
    discard(spark)
    with pytest.raises(Exception):
        spark.read.parquet(kept.inputFiles()[0]).count()
    assert materialize(spark.range(2), "v").count() == 2
