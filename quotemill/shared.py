"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; in local mode, where none is named, one of its own."""
    sc = spark.sparkContext._jsc.sc()
    if not sc.getCheckpointDir().isDefined():
        named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not named and spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="quotemill-"))
    return sc.getCheckpointDir().get().rstrip("/")


def scratch(spark: SparkSession, kind: str) -> str:
    """A new folder in it, which goes when the driver ends."""
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(where)  # only what exists can be marked
    store.deleteOnExit(where)
    return path
