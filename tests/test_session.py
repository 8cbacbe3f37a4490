"""Settings and the shared folder."""

import pytest

from tidelake import session


def test_runtime_settings_can_be_applied_to_any_session(spark):
    assert all(spark.conf.isModifiable(key) for key in session.RUNTIME_CONF)
    session.tune(spark)
    assert all(spark.conf.get(k) == v for k, v in session.RUNTIME_CONF.items())


class Named:
    """A session as a cluster starts it: the folder is named in its settings."""

    def __init__(self, folder, master):
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}
        self.sparkContext = self
        self.master = master
        self.folder = None

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def test_named_checkpoint_folder_is_used():
    cluster = Named("hdfs://shared/checkpoints/", "yarn")
    assert session.checkpoint_root(cluster) == "hdfs://shared/checkpoints"
    assert cluster.folder == "hdfs://shared/checkpoints/"


def test_a_cluster_without_a_named_folder_is_refused():
    with pytest.raises(RuntimeError):
        session.checkpoint_root(Named(None, "yarn"))


def test_written_tables_get_a_path_of_their_own(spark):
    assert session.scratch_path(spark, "t") != session.scratch_path(spark, "t")
    assert session.written(spark.range(3).toDF("a"), "t").count() == 3


def test_small_table_keeps_types(spark):
    df = session.small_table(spark, [("a'b", 1, None, ["x"])], "t string, n int, d double, l array<string>")
    assert tuple(df.first()) == ("a'b", 1, None, ["x"])
