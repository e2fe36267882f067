"""Tables in the folder that all executors share, and publishing of finished outputs."""

from __future__ import annotations

import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Where that is unset a local session gets a temporary folder; a cluster gets an error, since a
    machine-local folder would lose data there.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        held = sc._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="fernlog-")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(found)
    return found


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def _hadoop(spark: SparkSession, path: str):
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def exists(spark: SparkSession, path: str) -> bool:
    system, found = _hadoop(spark, path)
    return system.exists(found)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch table."""
    system, found = _hadoop(spark, path)
    system.delete(found, True)


def publish(spark: SparkSession, staging: str, path: str) -> None:
    """Move a finished output to its place; what exists there is refused."""
    system, target = _hadoop(spark, path)
    if system.exists(target):
        raise ValueError(f"output path already exists: {path}")
    system.mkdirs(target.getParent())
    if not system.rename(_hadoop(spark, staging)[1], target):
        raise OSError(f"cannot publish {path}")


class _Made(threading.local):
    """Scratch tables that are there, in the order in which they were made: a list for each thread, as jobs of one driver run in threads."""

    def __init__(self) -> None:
        self.paths: list[str] = []


_made = _Made()


def stored(df: DataFrame, what: str, by: str | None = None) -> DataFrame:
    """``df`` written to the shared folder and read back: a cut in the lineage that survives lost executors.

    With ``by`` rows lie in a folder for each value of that column (a string), so that a filter on it reads no other.
    """
    path = scratch(df.sparkSession, what)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    _made.paths.append(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path).select(*[f"`{c}`" for c in df.columns])
    found._scratch = path
    return found


def discard(*tables: DataFrame) -> None:
    """Delete scratch tables that nothing needs any more."""
    for t in tables:
        remove(t.sparkSession, t._scratch)
        if t._scratch in _made.paths:
            _made.paths.remove(t._scratch)


def made() -> int:
    """How many scratch tables this thread has made that are there."""
    return len(_made.paths)


def keep_only(spark: SparkSession, since: int, *tables: DataFrame) -> None:
    """Delete the scratch tables that this thread made after ``since`` of them, but for ``tables``."""
    kept = [t._scratch for t in tables]
    for path in _made.paths[since:]:
        if path not in kept:
            remove(spark, path)
    _made.paths[since:] = kept


def small(df: DataFrame, most: int) -> DataFrame:
    """``df`` for a join: broadcast if it has at most ``most`` rows, which are counted; else it is shuffled."""
    return F.broadcast(df) if df.count() <= most else df
