"""Session settings and the shared folder for written intermediates."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", app: str = "tertulia", memory: str = "8g") -> SparkSession:
    """A local session for tests and timings; on a cluster use the one it provides."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``, or the one given to
    ``setCheckpointDir``.

    A machine-local folder is used only by a local master without either setting, as in
    tests; on a cluster the call fails instead of writing where others cannot read.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    folder = context.getCheckpointDir()
    if folder:
        return folder
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="tertulia-")
    context.setCheckpointDir(folder)
    return folder


RUN = f"tertulia-{uuid.uuid4().hex}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path under this run's part of the shared folder that nothing has written yet."""
    return f"{shared_folder(spark).rstrip('/')}/{RUN}/{name}-{uuid.uuid4().hex}"


def remove_written(spark: SparkSession) -> bool:
    """Delete what this run has written to the shared folder; frames read from it are void."""
    return remove_path(spark, f"{shared_folder(spark).rstrip('/')}/{RUN}")


def remove_path(spark: SparkSession, folder: str) -> bool:
    """Delete one of the folders this run has written; frames read from it are void."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
