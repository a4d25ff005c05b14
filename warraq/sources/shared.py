"""Tables written once to the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


#: Spark's own switch: the shuffle files of a query go when it ends, and do not wait for the driver's collectors.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: For each thread the lists of tables that ``scratch`` removes.
_OPEN = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where that is unset, a temporary one in local mode and an error on a cluster."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        known = "file://" + tempfile.mkdtemp(prefix="warraq-")
        spark.sparkContext.setCheckpointDir(known)
    return known


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/warraq/{label}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def tidied(spark: SparkSession):
    """The shuffle files of queries inside go with their end."""
    conf = spark.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)


def saved(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: its lineage is cut, a lost executor loses nothing; the shuffle files of the write go with its end."""
    path = passing(df.sparkSession, label)
    with tidied(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def passing(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, which ``scratch`` removes where it is open."""
    path = shared_path(spark, label)
    for tables in getattr(_OPEN, "stack", [])[-1:]:
        tables.append((spark, path))
    return path


def kept(spark: SparkSession, build: Callable[[], DataFrame], label: str) -> DataFrame:
    """What ``build`` returns, written and read back; what it saves on its way is removed."""
    path = passing(spark, label)
    with scratch():
        df = build()
        with tidied(spark):
            df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, wherever Spark's file systems reach."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(path))
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def let_go(*tables: DataFrame) -> None:
    """Removes tables that ``saved`` wrote and that no later step reads."""
    for df in tables:
        for folder in {name.rpartition("/")[0] for name in df.inputFiles()}:
            remove(df.sparkSession, folder)


@contextlib.contextmanager
def scratch():
    """Tables that ``saved`` writes inside go at the end: for steps whose results are written before it."""
    stack = _OPEN.__dict__.setdefault("stack", [])
    stack.append([])
    try:
        yield
    finally:
        for spark, path in stack.pop():
            remove(spark, path)
