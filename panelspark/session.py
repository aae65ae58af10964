"""Session settings and the shared work folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


PARTITIONS = "panelspark.partitions"


def _one_process(spark: SparkSession) -> bool:
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def build_session(name: str = "panelspark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and skew-join splitting switched on.

    ``master`` is left to spark-submit on a cluster.  Anything in ``conf`` wins
    over the defaults below.
    """
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # split a hot key even where the split costs one more exchange
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update(conf)
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    if spark.conf.get(PARTITIONS, None) is None and _one_process(spark):
        spark.conf.set(PARTITIONS, str(spark.sparkContext.defaultParallelism))
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application.

    Needed wherever the package is not installed on every machine: functions that
    run in Arrow tasks are pickled by reference to their module.
    """
    context = spark.sparkContext
    if getattr(context, "_panelspark_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="panelspark-package-")  # on the driver, which serves the file itself
    archive = shutil.make_archive(os.path.join(folder, "panelspark"), "zip", os.path.dirname(package), os.path.basename(package))
    context.addPyFile(archive)
    context._panelspark_shipped = True


def work_folder(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder, because there the
    driver and the executors are one process.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not _one_process(spark):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="panelspark-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


def work_root(spark: SparkSession) -> str:
    """This application's part of the work folder."""
    return f"{work_folder(spark).rstrip('/')}/panelspark/{spark.sparkContext.applicationId}"


def clear_work(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application.

    For when the results built on them have been written: a DataFrame that still
    reads them can no longer be computed.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(work_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, name: str, **options: int | str) -> DataFrame:
    """Write ``df`` once to the work folder, with Spark's write ``options``, and read it back.

    Cuts the lineage, survives the loss of any executor, and gives the next
    stages a columnar scan with known size instead of a recomputation.
    """
    spark = df.sparkSession
    path = f"{work_root(spark)}/{uuid.uuid4().hex}/{name}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Deal the rows over ``partitions`` tasks; without a number the rows stay where they are.

    The session setting ``panelspark.partitions`` is the number where none is
    given.  It is for tables that come in fewer pieces than there are cores;
    ``build_session`` sets it for local sessions only.
    """
    partitions = partitions or int(df.sparkSession.conf.get(PARTITIONS, "0"))
    return df.repartition(partitions) if partitions else df
