"""What every part of the library asks of a session: shared storage and code on the workers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_TABLES: dict[str, SparkSession] = {}
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def ship(spark: SparkSession) -> None:
    """Make this package importable by the session's Python workers, once an application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="foldstone-")
    target = os.path.join(folder, "foldstone.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for top, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(top, name)
                    archive.write(full, os.path.join("foldstone", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(target)
    atexit.register(shutil.rmtree, folder, True)
    _SHIPPED.add(app)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a local one serves a session
    that is one process (tests); a cluster has to name it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("Set spark.checkpoint.dir to a folder that the driver and all executors share.")
        found = "file://" + os.path.join(tempfile.gettempdir(), f"foldstone-{spark.sparkContext.applicationId}")
        spark.conf.set("spark.checkpoint.dir", found)
        atexit.register(shutil.rmtree, found.removeprefix("file://"), True)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back; ``compression`` other than the session's is for texts.

    It cuts the lineage: a lost executor costs its running tasks only. The table goes by ``release``, or when the
    application ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    if not _TABLES:
        atexit.register(_drop_tables)
    _TABLES[path] = spark
    found = spark.read.schema(df.schema).parquet(path)
    _PATHS[found] = path
    return found


def release(*tables: DataFrame) -> None:
    """Delete the files of tables that came from ``materialize`` and that nothing is to read any more."""
    for found in tables:
        path = _PATHS.pop(found, None)
        if path is not None:
            _delete(_TABLES.pop(path), path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _drop_tables() -> None:
    for path, spark in _TABLES.items():
        try:
            _delete(spark, path)
        except Exception:  # the session has ended before: its folder is the cluster's to clean
            return


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
