from types import SimpleNamespace

import pytest

from moodmill.session import durable, scratch_path, shared_dir


def fake(master, folder=None):
    state = {"dir": None}
    context = SimpleNamespace(
        master=master, getCheckpointDir=lambda: state["dir"], setCheckpointDir=lambda d: state.update(dir=d)
    )
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder), sparkContext=context)


def test_the_session_names_the_folder():
    assert shared_dir(fake("yarn", "hdfs:/shared/")) == "hdfs:/shared"


def test_only_a_local_session_makes_its_own():
    local = fake("local[8]")
    made = shared_dir(local)
    assert shared_dir(local) == made
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(fake("spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(fake("local-cluster[2,1,1024]"))


def test_durable_tables(spark):
    df = spark.range(10)
    kept = durable(df)
    assert kept.dtypes == df.dtypes and kept.count() == 10
    assert scratch_path(spark, "a") != scratch_path(spark, "a")
    assert scratch_path(spark, "a").startswith(spark.conf.get("spark.checkpoint.dir"))
