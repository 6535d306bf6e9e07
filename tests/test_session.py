from types import SimpleNamespace

import pytest

from roomledger.session import shared_dir, use_checkpoints, work_dir


class Context:
    def __init__(self, master, folder=None):
        self.master, self.folder = master, folder

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def session(master, named=None, folder=None):
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default: named or default),
        sparkContext=Context(master, folder),
    )


def test_the_named_folder_is_used_everywhere():
    cluster = session("yarn", "hdfs:///shared/")
    assert shared_dir(cluster) == "hdfs:///shared"
    use_checkpoints(cluster)
    assert cluster.sparkContext.folder == "hdfs:///shared"
    assert work_dir(cluster, "x").startswith("hdfs:///shared/x-")


def test_a_cluster_without_a_named_folder_is_an_error():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(session("yarn"))


def test_a_local_session_gets_one_folder():
    local = session("local[2]")
    assert "roomledger-" in shared_dir(local) and shared_dir(local) == shared_dir(local)


def test_folders_are_fresh(spark):
    assert work_dir(spark, "x") != work_dir(spark, "x")
