from types import SimpleNamespace

import pytest

from tabularium.llm import common


class Context:
    """What shared_folder asks of a SparkContext."""

    def __init__(self, master, named=None):
        self.master, self.folder, self.named = master, None, named

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, name):
        self.folder = name

    def getConf(self):
        return {"spark.checkpoint.dir": self.named} if self.named else {}


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[3,2,1000]", "k8s://https://host"])
def test_a_cluster_must_name_its_shared_folder(master):
    with pytest.raises(ValueError):
        common.shared_folder(SimpleNamespace(sparkContext=Context(master)))
    assert common.shared_folder(SimpleNamespace(sparkContext=Context(master, "hdfs://shared"))) == "hdfs://shared"


@pytest.mark.parametrize("master", ["local", "local[4]", "local[*]"])
def test_a_local_master_takes_a_temporary_one(master):
    assert common.shared_folder(SimpleNamespace(sparkContext=Context(master)))


def test_written_tables_are_read_back_and_can_be_forgotten(spark):
    df = common.written(spark.range(5))
    assert df.count() == 5
    name = df.inputFiles()[0].rsplit("/", 1)[0]
    common.forget(spark, name)
    with pytest.raises(Exception, match="does not exist|FILE_NOT_EXIST|FileNotFound"):
        spark.read.parquet(name).count()
