"""Cutting lineage through tables written to a folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []
_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where that is unset, a session on one machine gets a folder of its own; on a cluster it is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="folianto-"))
    return _own[0]


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, so that its plan is not run again.

    The files lie outside the executors: a lost executor costs only its running tasks.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/folianto-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_clean)
    _written.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _clean() -> None:
    for spark, path in _written:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session is gone: the cluster's own cleaning has to do it
            return
    _written.clear()
    for path in _own:
        shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)
