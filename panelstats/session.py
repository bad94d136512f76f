"""Spark session helpers.

The library never creates its own cluster settings on top of an existing
session: it reads what the cluster already set (``spark.checkpoint.dir``,
shuffle partitions) and only fills in values that are missing, which is the
case in local tests.
"""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import threading
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "panelstats") -> SparkSession:
    """Return the active session or build a local one with sane defaults."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return ready(active)
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(master or f"local[{cpus}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("PANELSTATS_DRIVER_MEMORY", "8g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ready(spark)


_SHIPPED: set = set()
_ZIP: list[str] = []
_LOCK = threading.Lock()


def _package_zip() -> str:
    """Zip this package (Python sources only) once per driver process."""
    if _ZIP:
        return _ZIP[0]
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    out_dir = tempfile.mkdtemp(prefix="panelstats-pyfiles-")
    path = os.path.join(out_dir, "panelstats.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg_dir)))
    _ZIP.append(path)
    return path


def ship_package(spark: SparkSession) -> None:
    """Make ``panelstats`` importable in the Python workers.

    Arrow UDFs and ``applyInPandas`` functions are pickled by reference to this
    package; the workers import it from a zip that Spark distributes with every
    task (``addPyFile``; ``addArtifacts`` on Spark Connect). Once per context;
    thread-safe; sessions sharing a context share the registration.
    """
    with _LOCK:
        try:
            sc = spark.sparkContext
            key = ("sc", sc.applicationId)
        except Exception:  # Spark Connect has no SparkContext
            sc, key = None, ("connect", id(spark))
        if key in _SHIPPED:
            return
        path = _package_zip()
        try:
            if sc is not None:
                sc.addPyFile(path)
            else:
                spark.addArtifacts(path, pyfile=True)
        except Exception as e:  # registered before (e.g. by another session): fine
            if "already" not in str(e).lower():
                raise
        _SHIPPED.add(key)


def ready(spark: SparkSession) -> SparkSession:
    """Checkpoint folder + package shipped: call before building a query."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir``; set a local one only if unset."""
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: no SparkContext; checkpoint() reads the conf
        sc = None
    if conf_dir:
        if sc is not None and sc.getCheckpointDir() is None:
            sc.setCheckpointDir(conf_dir)
        return conf_dir
    current = sc.getCheckpointDir() if sc is not None else None
    if current:
        return current
    if sc is not None and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    # Only reached in local runs/tests where no shared folder is configured.
    local_dir = tempfile.mkdtemp(prefix="panelstats-ckpt-")
    spark.conf.set("spark.checkpoint.dir", local_dir)
    if sc is not None:
        sc.setCheckpointDir(local_dir)
    return local_dir


_WRITTEN: dict[str, SparkSession] = {}


def delete_table(spark: SparkSession, path: str) -> None:
    """Delete a table written by ``cut_lineage``; nothing else is touched. Readers may
    name it with another scheme, so its unique folder name decides."""
    name = path.rpartition("/")[2]
    path = next((p for p in _WRITTEN if p.rpartition("/")[2] == name), None)
    if path is not None:
        del _WRITTEN[path]
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _delete_written() -> None:
    """Tables of this process go when it ends, if its session still answers."""
    for path, spark in list(_WRITTEN.items()):
        try:
            delete_table(spark, path)
        except Exception:  # the session is gone: the folder's owner cleans it
            return


def cut_lineage(df: DataFrame, name: str = "table") -> DataFrame:
    """Materialise ``df`` once as a Parquet table under the shared checkpoint
    folder and return a plan that reads it (survives executor loss; later
    reads get column pruning, filter pushdown and real size statistics). The
    tables are deleted when the process ends."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared checkpoint folder, deleted when the process ends."""
    path = os.path.join(ensure_checkpoint_dir(spark), "tables", f"{name}-{uuid.uuid4().hex}")
    _WRITTEN[path] = spark
    return path
