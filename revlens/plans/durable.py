"""Session set-up and durable cuts of lineage."""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
_written: list[tuple[SparkSession, str]] = []

#: Spark (4.1 on) removes what an execution shuffled when it ends; else files stay until the driver collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Share of its limit that the driver's heap may take before it is collected after a write.
HEAP = 0.5

#: Rows an Arrow batch carries at most; texts are long, and Spark's default of 10,000 could hold gigabytes.
ARROW_ROWS = 512


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from any working folder, and keep Arrow batches of long texts small."""
    env = spark.sparkContext.environment
    if _REPO not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (_REPO, env.get("PYTHONPATH", "")) if x)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where a local session names none (tests), a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='revlens-')}")
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


@contextmanager
def unshuffled(spark: SparkSession) -> Iterator[None]:
    """What is executed meanwhile leaves no shuffle files."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def written(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder: lineage is cut, and losing an executor loses nothing.

    The folder is removed when the driver's Python ends, or by `settled`; what was shuffled for it goes at once.
    """
    spark = df.sparkSession
    if not _written:
        atexit.register(_remove)
    path = f"{shared_dir(spark)}/revlens-{uuid.uuid4().hex}"
    _written.append((spark, path))
    with unshuffled(spark):
        df.write.option("compression", "zstd").parquet(path)
    _relieve(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def _relieve(spark: SparkSession) -> None:
    """Plans of many rounds are garbage of the driver, and its heap would grow to its limit before it gives any back."""
    heap = spark._jvm.java.lang.Runtime.getRuntime()
    if heap.totalMemory() > HEAP * heap.maxMemory():
        gc.collect()  # plans that Python still refers to
        spark._jvm.java.lang.System.gc()


def settled(make: Callable[[], DataFrame], *before: DataFrame) -> DataFrame:
    """What `make` returns, written; the tables that it wrote on the way go at once, and so do those of `before`."""
    first = len(_written)
    out = written(make())
    paths = {getattr(df, "_written_path", None) for df in before}
    for x in [x for x in _written[:first] if x[1] in paths] + _written[first:-1]:
        _written.remove(x)
        _delete(*x)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _remove() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session has ended before the interpreter: nothing can be removed any more
            return
