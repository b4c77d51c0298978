"""Session, shared-folder and broadcast helpers used by every operator."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Estimated bytes up to which a side may be broadcast by an explicit hint.
BROADCAST_BYTES = 8 << 20


def build_session(app: str = "presswork", master: str = "local[*]", partitions: int = 8) -> SparkSession:
    """A local session with the settings that the queries expect (UTC, AQE, Arrow)."""
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the cluster's spark.checkpoint.dir.

    Only a local session without the setting gets a temporary folder; a cluster without it is an error.
    """
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not told:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        told = tempfile.mkdtemp(prefix="presswork-")
        spark.sparkContext.setCheckpointDir(told)
        told = spark.sparkContext.getCheckpointDir() or told
    return told


def _file_system(spark: SparkSession, path: str) -> tuple:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


_scratch: dict[str, str] = {}


def scratch_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder; it is removed when the driver's JVM ends."""
    app = spark.sparkContext.applicationId
    if app not in _scratch:
        path = os.path.join(shared_folder(spark), f"presswork-{app}")
        fs, at = _file_system(spark, path)
        fs.mkdirs(at)
        fs.deleteOnExit(at)
        _scratch[app] = path
    return _scratch[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path of that name in the scratch folder."""
    return os.path.join(scratch_folder(spark), f"{name}-{uuid.uuid4().hex}")


def modified(spark: SparkSession, path: str) -> int:
    """When a table was last changed."""
    fs, at = _file_system(spark, path)
    return fs.getFileStatus(at).getModificationTime()


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write df as a table in the shared folder and read it back.

    Unlike a local checkpoint, the table survives the loss of executors; unlike an RDD
    checkpoint, it is compressed and its columns can be pruned.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared file system, if it is there."""
    fs, at = _file_system(spark, path)
    fs.delete(at, True)


def forget(*dfs: DataFrame) -> None:
    """Remove tables made by :func:`written` that no later plan reads."""
    for df in dfs:
        for name in df.inputFiles()[:1]:
            remove_folder(df.sparkSession, os.path.dirname(name))


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only if Catalyst's own size estimate is below limit bytes."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return F.broadcast(df) if int(str(size)) <= limit else df


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application: their workers unpickle by name."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="presswork-")) / "presswork.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent).as_posix())
    sc.addPyFile(str(path))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given folder."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
