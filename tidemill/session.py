"""Session settings and the shared folder that job intermediates may use."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(app: str = "tidemill", cpus: int | str = "*", shuffle_partitions: int = 8):
    """A local session for tests and benches; clusters bring their own through spark-submit."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TIDEMILL_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


PARQUET = {"compression": "zstd"}  # for whole texts, about two thirds of what the default writes


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only for a local master without it."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        folder = configured
    elif spark.sparkContext.master.startswith("local"):
        folder = spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp(prefix="tidemill-")
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def work_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder below the shared one."""
    return f"{shared_dir(spark)}/tidemill/{label}-{uuid.uuid4().hex}"


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def delete_path(spark: SparkSession, path: str) -> bool:
    """Remove a folder through the Hadoop file system; says whether it was there."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def move_path(spark: SparkSession, source: str, target: str) -> None:
    """Put a folder in the place of another one on the same file system; no row is read."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    system = path(target).getFileSystem(spark._jsc.hadoopConfiguration())
    system.delete(path(target), True)
    system.mkdirs(path(target).getParent())
    if not system.rename(path(source), path(target)):
        raise OSError(f"{source} could not be moved to {target}")


def list_files(spark: SparkSession, folder: str) -> list[str]:
    """File names directly below a folder, sorted."""
    target = spark._jvm.org.apache.hadoop.fs.Path(folder)
    statuses = target.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(target)
    return sorted(status.getPath().getName() for status in statuses)


def path_size(spark: SparkSession, path: str) -> int:
    """Bytes below a folder."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.getContentSummary(target).getLength()
