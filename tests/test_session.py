"""Where results that cut lineage are written."""

import pytest

from canopyq import session


class Context:
    def __init__(self, master, shared=None):
        self.master, self.shared, self.set_to = master, shared, None
        self._jsc = self

    def sc(self):
        return self

    def getCheckpointDir(self):
        return self

    def isDefined(self):
        return self.set_to is not None

    def getConf(self):
        return {"spark.checkpoint.dir": self.shared} if self.shared else {}

    def setCheckpointDir(self, path):
        self.set_to = path


class Spark:
    def __init__(self, *args):
        self.sparkContext = Context(*args)


def test_the_folder_of_the_cluster_is_kept():
    spark = Spark("spark://host:7077", "hdfs:///shared")
    session.with_checkpoint_dir(spark)
    assert spark.sparkContext.set_to == "hdfs:///shared"


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[3,2,1024]"])
def test_a_cluster_without_a_folder_is_an_error(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.with_checkpoint_dir(Spark(master))


def test_a_local_master_may_use_its_own_folder():
    spark = Spark("local[4]")
    session.with_checkpoint_dir(spark)
    assert spark.sparkContext.set_to
