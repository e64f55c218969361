"""Spark session helpers.

The library never creates a session behind the caller's back; these helpers
are for tests, the bench and command-line use.  On a cluster the caller's
session (and its ``spark.checkpoint.dir``) is used unchanged.
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int = 8,
              app_name: str = "tessera", driver_memory: str = "8g",
              extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session configured for the library.

    ``spark.checkpoint.dir`` is set only when the environment does not
    already name one (local runs and tests); see :func:`checkpoint_dir`.
    """
    master = master or os.environ.get("TESSERA_MASTER", "local[8]")
    builder = (SparkSession.builder.master(master).appName(app_name)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", driver_memory))
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    ship_package(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared folder (HDFS/object store) in
    ``spark.checkpoint.dir``; that is read from the session and used as is.
    Only a local master gets a scratch folder where it is unset (tests, bench);
    anywhere else executors could not see one another's files, so that raises.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = sc.getConf().get("spark.checkpoint.dir", None)
    if not conf:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that all executors share")
        conf = tempfile.mkdtemp(prefix="tessera-ckpt-")
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, which applications share
    (each one's checkpoints are in a folder of their own below it)."""
    own = checkpoint_dir(spark)
    return (spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or own).rstrip("/")


def _hadoop_path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, at = _hadoop_path(spark, path)
    return bool(fs.exists(at))


def save_whole(spark: SparkSession, path: str, write) -> None:
    """``write(folder)`` into a folder that appears at ``path`` only when it is
    complete; of several writers the first one's stays."""
    import uuid

    fs, at = _hadoop_path(spark, path)
    part = f"{path}.{uuid.uuid4().hex[:12]}"
    write(part)
    fs.mkdirs(at.getParent())
    if fs.exists(at) or not fs.rename(_hadoop_path(spark, part)[1], at):
        fs.delete(_hadoop_path(spark, part)[1], True)


def materialize(df, name: str, partition_by=None):
    """Write ``df`` once as parquet under the shared checkpoint folder and
    return a frame reading it back.

    Cuts lineage like ``checkpoint()`` but computes the plan once (an eager
    checkpoint of an unpersisted plan runs it twice) and later readers get
    column pruning, filter pushdown and, with ``partition_by``, partition
    pruning.  The folder is the cluster's shared one, so the table survives
    executor loss.  :func:`discard` deletes it.
    """
    import uuid

    spark = df.sparkSession
    base = checkpoint_dir(spark).rstrip("/")
    path = f"{base}/tables/{name}-{uuid.uuid4().hex[:12]}"
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.parquet(path)
    out._tessera_path = path
    return out


class few_rows_a_batch:
    """While a table is written: Arrow batches of few rows, as one line may be very long."""

    NAME, ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "1000"

    def __init__(self, spark):
        self.spark = spark

    def __enter__(self):
        self.old = self.spark.conf.get(self.NAME, None)
        self.spark.conf.set(self.NAME, str(min(int(self.ROWS), int(self.old or self.ROWS))))

    def __exit__(self, *exc):
        if self.old is None:
            self.spark.conf.unset(self.NAME)
        else:
            self.spark.conf.set(self.NAME, self.old)


def discard(*tables) -> None:
    """Delete tables that :func:`materialize` returned and nothing reads any
    more; frames without such a table are left alone."""
    for df in tables:
        path = getattr(df, "_tessera_path", None)
        if path:
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Tables:
    """Tables that belong to one computation: ``with Tables() as t:
    t.keep(df, "name")`` writes them, leaving the block deletes them."""

    def __init__(self):
        self._kept = []

    def keep(self, df, name: str, partition_by=None):
        out = materialize(df, name, partition_by)
        self._kept.append(out)
        return out

    def replace(self, old, df, name: str, partition_by=None):
        """Write a new version of a kept table and delete the one before."""
        out = self.keep(df, name, partition_by)
        self._kept = [t for t in self._kept if t is not old]
        discard(old)
        return out

    def __enter__(self):
        return self

    def __exit__(self, *exc):
        discard(*self._kept)
        self._kept.clear()


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``tessera`` importable in the Python workers of this application.

    UDFs and ``mapInPandas`` functions are pickled by reference to their
    module; executors that did not install the package get it as a zip via
    ``addPyFile`` (once per application).
    """
    import zipfile

    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    fd, path = tempfile.mkstemp(prefix="tessera-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as zf:
        for dirpath, dirnames, filenames in os.walk(pkg):
            dirnames[:] = [d for d in dirnames if d != "__pycache__"]
            for fn in filenames:
                if fn.endswith(".py"):
                    full = os.path.join(dirpath, fn)
                    zf.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    _SHIPPED.add(app)
