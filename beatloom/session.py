"""Session helpers shared by all operators."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of the data directory ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor sees, for checkpoints and written tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a session on one
    machine without that setting (tests) gets a temporary folder of its own;
    on a cluster it would be another folder for every executor, so that is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if not configured:
        if current.isDefined():
            return current.get()
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        configured = f"file://{tempfile.mkdtemp(prefix='beatloom-')}"
    if not current.isDefined():
        context.setCheckpointDir(configured)
    return configured


def hadoop_path(spark: SparkSession, path: str):
    """A path of whatever file system, with that file system."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path, jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or pattern of any file system names something."""
    jvm_path, system = hadoop_path(spark, path)
    found = system.globStatus(jvm_path)
    return found is not None and len(found) > 0


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path for one written table, in a folder of the application that is deleted when it ends."""
    folder = f"{shared_dir(spark).rstrip('/')}/beatloom-{spark.sparkContext.applicationId}"
    if folder not in _FOLDERS:
        jvm_path, system = hadoop_path(spark, folder)
        system.mkdirs(jvm_path)
        system.deleteOnExit(jvm_path)
        _FOLDERS.add(folder)
    return f"{folder}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows as a table in the shared folder: computed once, read as often as needed, safe from lost executors."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Makes the package importable on every executor, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="beatloom-")) / "beatloom.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


_SHIPPED: set[str] = set()
_FOLDERS: set[str] = set()
