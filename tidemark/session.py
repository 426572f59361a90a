"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


# Folders made for local sessions that name none, by application.
_LOCAL_FOLDERS: dict[str, str] = {}
# Applications whose executors have the package.
_SHIPPED: set[str] = set()
# Tables written by ``materialize``, by application.
_STAGES: dict[str, list[str]] = {}


def local_session(cpus: str | int = "*", app: str = "tidemark") -> SparkSession:
    """A single-JVM session for tests and the benchmark."""
    parts = "8" if cpus == "*" else str(cpus)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", parts)
        .config("spark.sql.adaptive.enabled", "true")
        # Small local inputs still use every core.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where it is unset a local session gets a folder of its own; a cluster must name one, since a
    machine-local path is not visible to the other executors.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="tidemark-")
    return _LOCAL_FOLDERS[app]


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application.

    Functions that run in Python workers are pickled by module name, so the workers must be able to
    import the package even where only the driver has it on its path.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    if root.is_dir():  # else the package already came as an archive
        target = Path(tempfile.mkdtemp(prefix="tidemark-")) / "tidemark.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
            for path in sorted(root.rglob("*.py")):
                out.write(path, path.relative_to(root.parent))
        spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Use it where several passes follow (ranks, reports): later passes scan only the columns they
    need, and a lost executor costs a re-read instead of a recomputation of the whole lineage.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/stage-{uuid.uuid4().hex}"
    app = spark.sparkContext.applicationId
    if app not in _STAGES:
        _STAGES[app] = []
        atexit.register(_release_at_exit, spark)
    _STAGES[app].append(path)
    df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete the tables that ``materialize`` wrote for this application; returns their number.

    Results that still read one of them are gone afterwards, so call it when a study is done. A driver
    that ends in order does it by itself.
    """
    paths = _STAGES.pop(spark.sparkContext.applicationId, [])
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        stage = jvm.org.apache.hadoop.fs.Path(path)
        stage.getFileSystem(conf).delete(stage, True)
    return len(paths)


def _release_at_exit(spark: SparkSession) -> None:
    """Best effort: a session that was stopped before leaves its tables to the folder's owner."""
    if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
        release(spark)
