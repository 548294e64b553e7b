"""Session helpers: the shared working folder and tables written to it."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import threading
import uuid
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache(maxsize=1)
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="rankflow-")


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local master may run without the setting; it gets a folder of its own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    return _local_dir()


_roots: set[str] = set()


def _scratch_root(root: str, jvm, conf) -> str:
    """The application's own folder; it goes when the driver's interpreter ends."""
    if root in _roots:
        return root
    _roots.add(root)
    folder = jvm.org.apache.hadoop.fs.Path(root)
    files = folder.getFileSystem(conf)

    def remove() -> None:
        with contextlib.suppress(Exception):  # the JVM may have gone first
            files.delete(folder, True)

    atexit.register(remove)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the application's folder below the shared one.

    What stands there serves the running application only and is deleted at its end.
    """
    if folder := getattr(_scope, "folder", None):
        return f"{folder}/{name}-{uuid.uuid4().hex}"
    context = spark.sparkContext
    root = f"{shared_dir(spark)}/rankflow/{context.applicationId}"
    return f"{_scratch_root(root, context._jvm, context._jsc.hadoopConfiguration())}/{name}-{uuid.uuid4().hex}"


_scope = threading.local()


@contextlib.contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Scratch tables that this thread writes within the scope go at its end."""
    outer, _scope.folder = getattr(_scope, "folder", None), scratch_path(spark, "scope")
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_scope.folder)
    try:
        yield
    finally:
        _scope.folder = outer
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with its scheme, for readers other than Spark's."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(target).toString()


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether a completely written table stands at ``path``."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts the lineage at a table that outlives lost executors, and gives the
    following joins real sizes to choose a strategy from.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders right below ``path``; none if it is not there."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in files.listStatus(target) if s.isDirectory()] if files.exists(target) else []


#: bytes of a table for each core, below which its files may be too few to keep the cores busy
SMALL = 128 << 20


def table_bytes(df: DataFrame) -> int:
    """Size of ``df`` as the optimizer finds it."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def is_small(df: DataFrame) -> bool:
    """Whether the optimizer finds ``df`` below ``SMALL`` bytes for each core."""
    return table_bytes(df) < SMALL * df.sparkSession.sparkContext.defaultParallelism


def spread(df: DataFrame, *by: str) -> DataFrame:
    """``df`` dealt anew by ``by`` if it is small; a large table stays as its files divide it."""
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism, *by) if is_small(df) else df
