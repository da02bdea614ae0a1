"""Session set-up: configuration, and this package on every worker's path."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def session(name: str = "wicker", **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; a master or cluster comes from outside."""
    builder = SparkSession.builder.appName(name).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC").config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return ship(builder.getOrCreate())


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it.

    A temporary one only on a single machine whose session names none; on a
    cluster a folder of the driver's would be missing on the executors.
    """
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context._jsc.sc().isLocal():
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="wicker-"))
    return context._jsc.sc().getCheckpointDir().get()


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a folder through Spark's own file systems."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once per application.

    Spark's own file service does it, so workers need neither a shared folder
    nor a PYTHONPATH.
    """
    context = spark.sparkContext
    if getattr(context, "_wicker_shipped", False):
        return spark
    folder = tempfile.mkdtemp(prefix="wicker-src-")
    shutil.copytree(os.path.join(ROOT, "wicker"), os.path.join(folder, "src", "wicker"), ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(os.path.join(folder, "wicker"), "zip", os.path.join(folder, "src")))
    context._wicker_shipped = True
    return spark
