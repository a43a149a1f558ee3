"""Scratch data goes to the shared folder named by the session."""

import os

from chargeload.config import scratch_path, shared_dir


def test_scratch_lives_under_the_checkpoint_dir(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    base = shared_dir(spark)
    assert base.replace("file:", "").startswith(str(tmp_path))
    a, b = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert a != b and a.startswith(base)
    assert os.path.isdir(base.replace("file:", ""))


class _NoContext:
    """A session stand-in without a reachable SparkContext (as over Spark Connect)."""

    def __init__(self, conf):
        self.conf = type("Conf", (), {"get": lambda _s, k, d=None: conf.get(k, d)})()

    @property
    def sparkContext(self):  # noqa: N802 - mirrors the PySpark attribute
        raise RuntimeError("no SparkContext here")


def test_fallbacks_without_a_spark_context():
    import pytest

    from chargeload.config import parallelism

    assert parallelism(_NoContext({"spark.sql.shuffle.partitions": "64"})) == 64
    assert shared_dir(_NoContext({"spark.checkpoint.dir": "hdfs:///shared/ckpt"})) == "hdfs:///shared/ckpt"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(_NoContext({}))
