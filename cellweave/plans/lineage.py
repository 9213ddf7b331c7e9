"""Lineage cuts that survive the loss of executors.

A cut writes a DataFrame as Parquet into the folder all executors share (the one
named by ``spark.checkpoint.dir``) and reads it again, so later stages, iterations
and retries start from the written files.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: str | None = None
#: Folders of cuts that are still there, oldest first.
_made: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder for written intermediates.

    It is the one named by ``spark.checkpoint.dir``. Only where that is unset *and* the
    master is local (tests), a temporary folder is made; on a cluster its absence is an error.
    """
    global _local
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _local is None:
        _local = tempfile.mkdtemp(prefix="cellweave-")
        atexit.register(shutil.rmtree, _local, ignore_errors=True)
    return f"file://{_local}"


def scratch(spark: SparkSession, suffix: str = "") -> str:
    """A path in the shared folder for a file or folder of one's own; deleted as those of cuts are."""
    path = f"{shared_folder(spark)}/cellweave/{uuid.uuid4().hex}{suffix}"
    if not _made:
        atexit.register(release_all)
    _made[path] = spark
    return path


def cut(df: DataFrame) -> DataFrame:
    """``df``, computed once, written to the shared folder and read from there.

    Its files stay until release(), release_all() or the end of the driver's process.
    """
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path  # type: ignore[attr-defined]
    return out


def _delete(spark: SparkSession, path: str) -> None:
    jvm, context = spark._jvm, spark.sparkContext._jsc
    conf = context.hadoopConfiguration() if context is not None else jvm.org.apache.hadoop.conf.Configuration()  # null once stopped
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(conf).delete(p, True)
    _made.pop(path, None)


def release(*cuts: DataFrame | None) -> None:
    """Delete the files of cuts that nothing reads any more."""
    for df in cuts:
        if path := getattr(df, "_cut_path", None):
            _delete(df.sparkSession, path)


def release_all() -> None:
    """Delete the files of every cut of this process: those that results still to be read are made from too."""
    for path, spark in list(_made.items()):
        try:
            _delete(spark, path)
        except Exception:  # the driver's JVM is gone; its folder is the cluster's to clean
            _made.pop(path, None)
