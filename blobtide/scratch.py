"""Shared-storage scratch tables.

A result that is read more than once, or whose row numbering must stay fixed when an executor
is lost, is written once as Parquet below `spark.checkpoint.dir` and read back. Unlike an RDD
checkpoint the table is columnar, so each reader scans only the columns it needs.

Tables belong to the innermost open `scope` and are deleted with it; without one they stay until the
driver ends. A long refresh opens a scope per step, so that its disk holds what the step needs and
not what all earlier ones needed. For the same reason the shuffle files of a write go when it ends.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_CONF = "spark.checkpoint.dir"
_CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_local_roots: dict[str, str] = {}
_delete_on_exit: set[str] = set()


def scratch_root(spark: SparkSession) -> str:
    """Folder for this application's scratch tables.

    Taken from `spark.checkpoint.dir`. Only a local-mode session may go without it; it then
    gets its own temporary folder.
    """
    context = spark.sparkContext
    app = context.applicationId
    configured = spark.conf.get(_CHECKPOINT_CONF, None) or context.getCheckpointDir()
    if configured:
        return f"{configured.rstrip('/')}/blobtide/{app}"
    if not context.master.startswith("local"):
        raise RuntimeError(
            f"set {_CHECKPOINT_CONF} to a folder that every executor can reach"
        )
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="blobtide-")
    return _local_roots[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the scratch folder."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


class Scope:
    """The scratch tables made while it is open."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []

    @contextmanager
    def open(self) -> Iterator[Scope]:
        """Own the tables made inside; they stay until `free`."""
        token = _current.set(self)
        try:
            yield self
        finally:
            _current.reset(token)

    def free(self) -> None:
        """Delete its tables. Frames that read them stop working."""
        while self.paths:
            file_system, path = _hadoop_path(self.spark, self.paths.pop())
            file_system.delete(path, True)


_current: ContextVar[Scope | None] = ContextVar("blobtide_scope", default=None)


@contextmanager
def scope(spark: SparkSession) -> Iterator[Scope]:
    """Tables made inside are deleted at the end, also after an error."""
    own = Scope(spark)
    try:
        with own.open():
            yield own
    finally:
        own.free()


@contextmanager
def _shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """A write inside deletes its shuffle files when it ends, not when the driver next collects garbage."""
    before = spark.conf.get(_CLEANUP_CONF, "false")
    spark.conf.set(_CLEANUP_CONF, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP_CONF, before)


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write `df` to a scratch table and return a frame that reads it.

    The table is deleted with the scope it was made in or by `drop_scratch`, and at the latest when the
    driver's JVM exits.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    owner = _current.get()
    if owner is not None:
        owner.paths.append(path)
    with _shuffles_deleted(spark):
        df.write.parquet(path)
    root = scratch_root(spark)
    if root not in _delete_on_exit:
        file_system, root_path = _hadoop_path(spark, root)
        file_system.deleteOnExit(root_path)
        _delete_on_exit.add(root)
    return spark.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, build: Callable[[], DataFrame], label: str = "table") -> DataFrame:
    """The frame that `build` returns, stored; every table made on the way is deleted."""
    own = Scope(spark)
    try:
        with own.open():
            df = build()
        return materialize(df, label)
    finally:
        own.free()


def _hadoop_path(spark: SparkSession, path: str):
    """Hadoop file system and path object of a folder."""
    context = spark.sparkContext
    hadoop_path = context._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(context._jsc.hadoopConfiguration()), hadoop_path


def drop_scratch(spark: SparkSession) -> None:
    """Delete every scratch table of this application. Frames built on them stop working."""
    file_system, root_path = _hadoop_path(spark, scratch_root(spark))
    file_system.delete(root_path, True)
