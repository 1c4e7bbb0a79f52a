"""Where lineage is cut: the configured folder, and never a local one on a cluster."""

import pytest
from pyspark.sql import functions as F

from sessionloom import session


class FakeContext:
    def __init__(self, master, configured=None):
        self.master, self.configured, self.folder = master, configured, None

    def getConf(self):
        return {"spark.checkpoint.dir": self.configured} if self.configured else {}

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, path):
        self.folder = path


class FakeSession:
    def __init__(self, context):
        self.sparkContext, self.conf = context, {}


def test_configured_folder_is_used():
    context = FakeContext("spark://host:7077", "/shared/checkpoints/")
    assert session.shared_dir(FakeSession(context)) == "/shared/checkpoints"
    assert context.folder == "/shared/checkpoints/"


def test_cluster_without_a_folder_is_an_error():
    with pytest.raises(RuntimeError):
        session.shared_dir(FakeSession(FakeContext("spark://host:7077")))


def test_stable_rows_keep_partition_and_order(spark):
    df = spark.range(1000).repartitionByRange(5, F.desc("id")).sortWithinPartitions(F.desc("id"))
    kept = session.stable(df).withColumn("p", F.spark_partition_id())
    rows = kept.withColumn("i", F.monotonically_increasing_id()).orderBy("i").collect()
    assert [r.id for r in rows] == list(range(999, -1, -1))
    assert kept.rdd.getNumPartitions() == 5
