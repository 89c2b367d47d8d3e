"""Session and shared-folder settings."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, app: str = "tamarack") -> SparkSession:
    """A session for one machine; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores if str(cores).isdigit() else 8))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TAMARACK_DRIVER_MEMORY", "12g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where the session names none (tests on one machine) a local one is made.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    return "file://" + tempfile.mkdtemp(prefix="tamarack-")


_FOLDERS: set[str] = set()


def _remove(spark: SparkSession, folder: str) -> None:
    """At the driver's end; where the context is gone already the folder stays."""
    try:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001
        pass


def cut_lineage(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again.

    The files outlive lost executors; later plans start from them. They go when the driver ends.
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/tamarack-{spark.sparkContext.applicationId}"
    if folder not in _FOLDERS:
        _FOLDERS.add(folder)
        atexit.register(_remove, spark, folder)
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(rows: DataFrame) -> DataFrame:
    """A scan with fewer partitions than there are cores (so a small one) dealt out to all of them."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows._jdf.queryExecution().toRdd().getNumPartitions() < cores else rows


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each context.

    The archive is made on the driver, whose file server hands it to the executors.
    """
    context = spark.sparkContext
    if any(os.path.basename(p).startswith("tamarack-code") for p in getattr(context, "_python_includes", [])):
        return
    import shutil

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp()
    context.addPyFile(shutil.make_archive(os.path.join(folder, "tamarack-code"), "zip", root, "tamarack"))
