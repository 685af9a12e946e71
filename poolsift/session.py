"""Session construction and shared-folder helpers.

Everything that must outlive a task (checkpoints, written round tables,
scratch outputs of source/sink round trips) goes under the folder the
cluster names in ``spark.checkpoint.dir``.  We only choose a folder of our
own when none is configured, which happens in local tests.
"""

from __future__ import annotations

import os
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # checkpoints of dropped DataFrames are removed from the shared folder
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # streaming state (dedupe keys, running counts) on local disk, not the JVM heap
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # keep Arrow batches moderate so a Python worker never holds a huge batch
    "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app: str = "poolsift", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting a local one only if unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="poolsift-ckpt-"))
    return sc.getCheckpointDir()


_SHIPPED: set = set()
_SHIP_LOCK = threading.Lock()


def ship_package(spark: SparkSession) -> None:
    """Make ``poolsift`` importable in every Python worker (once per context).

    Worker-side code (``mapInArrow`` kernels, pandas UDFs) refers to helpers of
    this package by module name, so the package is zipped on the driver and
    distributed with ``addPyFile``, the standard way to ship Python code.
    """
    sc = spark.sparkContext
    key = sc.applicationId
    with _SHIP_LOCK:
        if key not in _SHIPPED:
            _ship(sc)
            _SHIPPED.add(key)


def _ship(sc) -> None:
    import zipfile

    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    out = os.path.join(tempfile.mkdtemp(prefix="poolsift-pyfiles-"), "poolsift.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as zf:
        for d, dirs, files in os.walk(pkg):
            dirs[:] = [x for x in dirs if x != "__pycache__"]
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    zf.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)


def prepare(spark: SparkSession) -> SparkSession:
    """Checkpoint folder + package shipping; call once on any session."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/poolsift-scratch/{name}-{uuid.uuid4().hex}"


def committed(spark: SparkSession, path: str) -> bool:
    """Whether Spark finished writing ``path`` (its ``_SUCCESS`` file is there), in whatever store it lies."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint into the shared folder (never a local checkpoint)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def local_path(path: str) -> str:
    """Strip a ``file:`` scheme for code that needs a plain local path (tests)."""
    return path[5:] if path.startswith("file:") else path
