"""Session construction and shared scratch locations.

Jobs that write (sinks, the scoring stream, the read-through store) put their
files under the folder the cluster names in ``spark.checkpoint.dir``; a private
temporary folder, gone when the process ends, is used only when that setting is
absent and the master is local (local runs and tests).
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, app: str = "churnlens",
                shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """Build (or reuse) a session with the settings every operator assumes."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULT_CONF.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


# The folder made for an application whose session names none (local runs and tests only).
_PRIVATE: dict[str, str] = {}


def is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local") and "local-cluster" not in spark.sparkContext.master


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``, read from the session).

    Only in local mode is a private folder created when the setting is unset; on a
    cluster a machine-local folder would be invisible to executors, so the setting is
    required.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not is_local(spark):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _PRIVATE:
        _PRIVATE[app] = tempfile.mkdtemp(prefix="churnlens-")
        atexit.register(shutil.rmtree, _PRIVATE[app], ignore_errors=True)
    return _PRIVATE[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, never-reused location under the shared folder."""
    return f"{shared_dir(spark)}/churnlens/{name}-{uuid.uuid4().hex}"


def list_path(spark: SparkSession, path: str) -> list[str]:
    """Entries of a folder (none if it does not exist)."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [s.getPath().toString() for s in fs.listStatus(hpath)] if fs.exists(hpath) else []


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a directory this process created itself (a private temporary copy)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def input_bytes(spark: SparkSession, paths: list[str]) -> int:
    """Total size of the files under ``paths``; they are listed by a Spark job, not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    return files.agg({"length": "sum"}).first()[0] or 0


def tune_for_input(spark: SparkSession, paths: list[str], target_bytes: int = 128 << 20) -> int:
    """Opt-in sizing for a job over ``paths``: initial shuffle partitions of about
    ``target_bytes`` of input each, at least two per core; AQE coalesces small
    partitions back to the advisory size; scan splits use the same size.  Returns the
    shuffle-partition count set."""
    wanted = -(-input_bytes(spark, paths) // target_bytes)
    parts = max(2 * spark.sparkContext.defaultParallelism, wanted)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(target_bytes))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(target_bytes))
    return parts
