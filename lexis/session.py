"""Session construction and a few plan helpers shared by all operators."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, app: str = "lexis",
              shuffle_partitions: int | None = None) -> SparkSession:
    """Build (or reuse) a session tuned for the engine.

    On a cluster, the master and most settings come from spark-submit; only
    the SQL knobs the plans rely on are set here, and only if unset.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    spark = builder.getOrCreate()
    conf = spark.conf
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # JDK case mapping (same Unicode full mapping, several times faster
        # than the ICU path on non-ASCII text)
        "spark.sql.icu.caseMappings.enabled": "false",
    }
    for k, v in defaults.items():
        if conf.get(k, None) is None:
            conf.set(k, v)
    if shuffle_partitions is not None:
        conf.set("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for lineage cuts and model state: ``spark.checkpoint.dir``.

    Only a single-machine run (``local[...]``, as in tests, but not ``local-cluster[...]``) may leave it unset;
    a private temporary folder is then chosen.  On a cluster every executor
    would write its own disk, so a missing setting is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="lexis-ckpt-")
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def workers_find_package(spark: SparkSession) -> None:
    """Python workers started from now on find this package where the driver does
    (on a cluster it is installed, or shipped with the job)."""
    home = str(Path(__file__).resolve().parents[1])
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if home not in paths:
        env["PYTHONPATH"] = os.pathsep.join([home, *paths])


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


_scopes = threading.local()


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Tables that ``once`` writes inside (in this thread) are deleted at the end.  For work
    that writes its result itself: no plan made inside may be used after it."""
    stack = _scopes.__dict__.setdefault("stack", [])
    stack.append([])
    try:
        yield
    finally:
        for end in stack.pop():
            end()


def at_scope_end(calls: list[Callable[[], None]]) -> None:
    """``calls`` are made when the innermost ``scratch_scope`` of this thread ends; outside of any, never."""
    if stack := _scopes.__dict__.get("stack"):
        stack[-1] += calls


_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of writes made inside are deleted as each write ends: what it wrote is read from then on.
    Otherwise they lie on the executors' disks until the driver's JVM collects its garbage."""
    before = spark.conf.get(_FREE_SHUFFLES, "false")
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(_FREE_SHUFFLES, before)


def once(df: DataFrame, label: str = "once") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: it runs once, its
    lineage is cut, and joins see its true size, so that Spark itself decides
    whether to broadcast it.  A ``scratch_scope`` deletes the table."""
    path = scratch_path(df.sparkSession, label)
    at_scope_end([lambda: delete_path(df.sparkSession, path)])
    with shuffles_freed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_if_written(spark: SparkSession, path: str) -> DataFrame | None:
    """A Parquet table, or None where nothing was written yet.  Any other
    failure to read is raised."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    return spark.read.parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
