"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """What the cluster names in spark.checkpoint.dir. Only a local session without that setting gets a folder of its own."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named.rstrip("/")
    own = sc.getCheckpointDir()
    if own is None:
        if not (sc.master or "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='tidewatch-')}")
        own = sc.getCheckpointDir()
    return own.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared folder."""
    _made.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def clean(spark: SparkSession) -> int:
    """Delete the folders that ``scratch`` named so far in this process; results that still read them are lost. Returns how many there were."""
    paths, _made[:] = list(_made), []
    for uri in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(uri)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(paths)
