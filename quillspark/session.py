"""Session defaults and the shared scratch area.

``scratch`` is where operators cut lineage: a Parquet table below the folder
named by ``spark.checkpoint.dir`` (shared by all executors), so that a lost
executor never costs more than the stages after the last written table.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build(master: str = "local[8]", app: str = "quillspark", **conf: str) -> SparkSession:
    """A session for scripts and tests; on a cluster the caller brings its own."""
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, or a local one where none is set (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    local = os.path.join(tempfile.gettempdir(), f"quillspark-{os.getuid()}")
    os.makedirs(local, exist_ok=True)
    return f"file://{local}"


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, removed when the driver exits."""
    path = f"{shared_dir(spark)}/quillspark/{label}-{uuid.uuid4().hex[:12]}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder; errors are ignored at shutdown."""
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001 - the JVM may be gone already
        pass


def scratch(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_LOADED: dict[tuple[str, str], DataFrame] = {}
_LOADING = threading.Lock()


def once(spark: SparkSession, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A table that is built once per application, however many threads ask for it.

    Later calls read what the first one wrote; a build that fails is not kept.
    """
    key = (spark.sparkContext.applicationId, name)
    with _LOADING:
        if key not in _LOADED:
            _LOADED[key] = scratch(build(), "once")
        return _LOADED[key]


def forget(spark: SparkSession, name: str) -> None:
    """Let the next call of ``once`` build anew."""
    _LOADED.pop((spark.sparkContext.applicationId, name), None)


def secret(path: str | None, *variables: str) -> str | None:
    """A provider's key: the trimmed content of a file, else the first environment
    variable that holds one, else nothing.  For provider settings on the driver;
    a secret is never a column."""
    if path and os.path.isfile(path):
        with open(path, encoding="utf-8") as file:
            text = file.read().strip()
        if text:
            return text
    return next((v for v in (os.environ.get(x, "").strip() for x in variables) if v), None)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame, key: str | None = None, max_bytes: int = 1 << 30) -> DataFrame:
    """A narrow plan over at least as many partitions as there are cores.

    A few small files would leave costly per-row work to a few tasks.  Only plans
    that Catalyst estimates at no more than ``max_bytes`` are redistributed;
    larger ones, and those with a shuffle of their own, are left as they are
    (their scan splits by ``spark.sql.files.maxPartitionBytes``).  With a ``key``
    rows go by its hash, so that a later grouping by it does not move them again.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if bounded_bytes(df) > max_bytes or "AdaptiveSparkPlan" in df._jdf.queryExecution().executedPlan().toString():
        return df
    planned = df._jdf.queryExecution().toRdd().getNumPartitions()
    if planned >= cores:
        return df
    return df.repartition(cores) if key is None else df.repartition(cores, key)


def broadcast_small(df: DataFrame, max_rows: int = 10_000) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``max_rows`` rows.

    The rows are counted (no more than ``max_rows + 1`` of them), so the hint is
    only given for a side of checked size; beyond it the plain plan shuffles.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
