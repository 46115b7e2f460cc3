"""Session settings and the one way this package cuts lineage."""

from __future__ import annotations

import sys
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "auditweave", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on; ``conf`` overrides."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_folder(spark: SparkSession) -> str:
    """This application's folder below the one shared folder that the session names.

    That is ``spark.checkpoint.dir``, or what ``setCheckpointDir`` was given; there is no
    fallback, since a folder of one machine is invisible to executors elsewhere. Hadoop
    removes the application's folder when the driver's JVM ends.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    own = f"{folder.rstrip('/')}/{context.applicationId}"
    path = context._jvm.org.apache.hadoop.fs.Path(own)
    files = path.getFileSystem(context._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return own


def durable(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` as Parquet to the work folder and read it back.

    Used where a result must not be computed twice (range partition ids) or where
    an iteration would grow its plan without end. The files survive lost executors,
    are compressed, and later steps read only the columns they use. ``by`` names
    columns of few values that later steps ask for: each value has a folder of its own.
    """
    spark = df.sparkSession
    target = f"{work_folder(spark)}/{uuid.uuid4().hex}"
    (df.hint("rebalance", *by) if by else df).write.partitionBy(*by).parquet(target)
    return spark.read.schema(df.schema).parquet(target)


def send_with_tasks(module: str) -> None:
    """Send the functions of ``module`` inside the task, so workers need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def forget(df: DataFrame) -> None:
    """Delete the files of a table that ``durable`` wrote, once all that reads it has itself been written."""
    spark = df.sparkSession
    own = work_folder(spark).split("://")[-1].rstrip("/") + "/"
    for name in {str(f).rsplit("/", 1)[0] for f in df.inputFiles()}:
        if own in name:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
