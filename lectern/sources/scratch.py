"""Intermediate results on storage that all executors share, so that lost executors don't repeat what is before them."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def own_folder() -> str:
    """A temporary folder of this machine, removed at the end of the process."""
    folder = tempfile.mkdtemp(prefix="lectern-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return f"file://{folder}"


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, in local mode a temporary one where that is unset.

    On a cluster an unset folder is an error; the session's settings are never changed.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir is unset: name a folder that all executors share")
    return own_folder()


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet and read back from reliable storage, so that lost executors don't repeat what is before it.

    It lies in a folder of the application below ``shared_folder``, which goes when the driver's JVM ends; ``discard`` removes it earlier.
    """
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/lectern-{spark.sparkContext.applicationId}")
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(folder):
        files.mkdirs(folder)
        files.deleteOnExit(folder)
    path = f"{folder.toString()}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Removes what ``cut_lineage`` wrote for ``df``; neither it nor anything made of it can be read afterwards."""
    context = df.sparkSession.sparkContext
    for file in df.inputFiles():
        path = context._jvm.org.apache.hadoop.fs.Path(file).getParent()
        if path.getParent().getName() == f"lectern-{context.applicationId}":
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
