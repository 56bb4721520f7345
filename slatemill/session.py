"""Session helpers: a local session for tests, shared intermediate tables, code for the workers."""
from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

PACKAGE = os.path.dirname(os.path.abspath(__file__))


def local_session(cpus: str = "8") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("slatemill")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for intermediate tables, in `spark.checkpoint.dir`. Only a session on one
    machine (tests, the bench) may leave it out and gets a fresh scratch directory for the session; on a
    cluster a folder of the driver's own would lose rows, so that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def cut_lineage(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Write an intermediate result once as a table in the shared folder and read it back. Survives
    lost executors, and unlike a cached plan it gives later stages a size and column pruning."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}-tables/{uuid.uuid4().hex}"
    (df.write.option("compression", compression) if compression else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._table_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables that `cut_lineage` wrote, once nothing will read them again; other frames are left alone."""
    for t in tables:
        path = getattr(t, "_table_path", None)
        if path is not None:
            _delete(t.sparkSession, path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_tables(spark: SparkSession) -> None:
    """Delete this application's intermediate tables. Frames built from them can no longer be read."""
    _delete(spark, f"{shared_folder(spark)}/{spark.sparkContext.applicationId}-tables")


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a context, so that they need no copy of their own."""
    sc = spark.sparkContext
    if getattr(sc, "_slatemill_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="spark-"), "slatemill.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(PACKAGE):
            for n in sorted(x for x in names if x.endswith(".py")):
                full = os.path.join(folder, n)
                z.write(full, os.path.relpath(full, os.path.dirname(PACKAGE)))
    sc.addPyFile(path)
    sc._slatemill_shipped = True
