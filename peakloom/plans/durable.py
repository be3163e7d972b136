"""Where intermediate tables live, and how a plan is cut.

A cluster names one shared folder in ``spark.checkpoint.dir``; everything written between two
jobs goes there, so a lost executor never takes the only copy with it.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_open = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """Return the shared folder of the session, setting one only for an unset local session."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if path:
        if current.isEmpty():
            spark.sparkContext.setCheckpointDir(path)
        return path
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="run-", dir="/tmp"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}/{name}"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Jobs begun here remove their shuffle files when they end, which else stay until the driver happens
    to collect its garbage. Only for frames that are run once."""
    before = spark.conf.get(_CLEAN_UP, None)
    spark.conf.set(_CLEAN_UP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEAN_UP) if before is None else spark.conf.set(_CLEAN_UP, before)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and continue from the written copy, whose
    size is known, whose columns can be pruned and whose plan starts afresh."""
    path = scratch_path(df.sparkSession, "round")
    with shuffles_freed(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    if getattr(_open, "scopes", None):
        _open.scopes[-1].append(out)
    return out


def settled(build: Callable[[], DataFrame], keep: bool = False) -> DataFrame:
    """``stored(build())``, after which the tables that ``build`` has stored on its way are removed.
    Nothing else may read those. With ``keep`` the result outlives a ``settled`` around this one."""
    scopes = _open.__dict__.setdefault("scopes", [])
    scopes.append([])
    try:
        out = stored(build())
    finally:
        made = scopes.pop()
    discard(*[df for df in made if df is not out])
    if scopes and not keep:
        scopes[-1].append(out)
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables written by :func:`stored` that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_stored_at", None)
        if path:
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where.getParent(), True)
