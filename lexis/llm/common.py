"""Helpers shared by the operators: the shared folder, lineage cuts, batching."""

from __future__ import annotations

import ctypes
import functools
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def importable(run):
    """Decorator for functions of (spark, ...): Python workers started for them
    find this package where the driver does (on a cluster it is installed, or
    shipped with the job), and are handed whole texts 8 MB at a time where the session has Spark's own 64 MB."""
    home = str(Path(__file__).resolve().parents[2])

    @functools.wraps(run)
    def ready(spark: SparkSession, *args):
        env = spark.sparkContext.environment
        paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
        if home not in paths:
            env["PYTHONPATH"] = os.pathsep.join([home, *paths])
        if (spark.conf.get(_BATCH, None) or "").rstrip("bB") == str(64 << 20):  # not set by the user
            spark.conf.set(_BATCH, str(8 << 20))
        return run(spark, *args)

    return ready


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only where that is unset (a
    single-machine run, as in tests) a new temporary folder is set as it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="lexis-llm-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path for one intermediate table in the shared folder."""
    return f"{shared_root(spark).rstrip('/')}/llm/{tag}-{uuid.uuid4().hex}"


def cut(df: DataFrame, tag: str, codec: str = "snappy") -> DataFrame:
    """Cut lineage: write ``df`` as a table in the shared folder and reread it."""
    path = scratch(df.sparkSession, tag)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Delete tables made by ``cut`` that no later plan reads."""
    for df in tables:
        spark = df.sparkSession
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for place in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/llm/" in place:
                path = jvm.org.apache.hadoop.fs.Path(place)
                path.getFileSystem(conf).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished steps now; otherwise they
    stay until the driver happens to collect its garbage."""
    gc.collect()
    spark._jvm.System.gc()


_caches: dict[str, Callable[[], None]] = {}
_entered = ""


def keeps(operator: str, clear: Callable[[], None]) -> None:
    """Register what frees an operator's caches in a Python worker."""
    _caches[operator] = clear


def entering(operator: str) -> None:
    """Called as a task begins.  Workers are reused: a task of another operator frees what the last
    one kept there, and gives the memory back to the system."""
    global _entered
    if operator == _entered:
        return
    for name, clear in _caches.items():
        if name != operator:
            clear()
    _entered = operator
    gc.collect()
    give_back()


def give_back() -> None:
    """Return memory that is free in this process to the system; called as a task that used much ends."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # a C library without it
        pass


def slices(texts: list[str | None], most_chars: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows holding about ``most_chars`` characters each (one row at least)."""
    lo = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most_chars:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that ``df`` doesn't have, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def doc_hash(text_col: str = "text"):
    """64 bits of a text (null counts as empty), to tell apart rows that share an id."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
