"""Session helpers: shared checkpoint folder and shipping the package to executors."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


#: Bytes of one Arrow batch between the JVM and a Python worker, where the session sets none: a
#: batch of the default 10,000 rows has no bound on its bytes.
BATCH_BYTES = "4m"


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of the session, once per application, and bound its Arrow batches."""
    sc = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) in (None, "67108864b"):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    name = os.path.basename(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="ship-")), f"{name}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(os.path.join(root, name)):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named in spark.checkpoint.dir. Where none is named, a local one serves a local master (tests); on a cluster that is an error, since executors don't share local folders."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "loomtext-checkpoints"))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in the file system that its path names."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def give_back(collect: bool = True) -> None:
    """Return this process's freed memory to the system: many small arrays, once freed, otherwise stay with the C library."""
    if collect:
        gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):
        pass  # only glibc has it


def tidy(spark: SparkSession) -> None:
    """Let Spark remove the shuffle and checkpoint files of steps that nothing refers to any more: its cleaner acts when the JVM collects garbage, which a driver with little to do puts off. Both processes of the driver give memory back."""
    give_back()
    spark.sparkContext._jvm.System.gc()


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where it lies in fewer partitions than there are cores: a small input only, large ones stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
