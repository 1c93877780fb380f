"""A session with the settings the engine expects, and the folder that its executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "findara", **settings: str) -> SparkSession:
    """Adaptive execution and UTC; whatever a running session or ``settings`` says goes first."""
    builder = SparkSession.builder.appName(name)
    for key, value in ({"spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC"} | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: ``spark.checkpoint.dir``.

    Where that is unset, a local session (tests, a single machine) gets a folder of its own; on a cluster it is an
    error, as executors do not see the driver's disk.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="findara-")
        spark.conf.set("spark.checkpoint.dir", folder)
        _until_the_end(spark, folder)
    return folder.rstrip("/")


def _until_the_end(spark: SparkSession, path: str) -> None:
    """Make a folder that is deleted when the application ends."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(where)  # what does not exist yet cannot be marked
    store.deleteOnExit(where)


def new_path(spark: SparkSession, tag: str) -> str:
    """A new place in the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/findara/{tag}-{uuid.uuid4().hex[:12]}"
    _until_the_end(spark, path)
    return path


def written(df: DataFrame, tag: str, path: str | None = None, by: list[str] | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back.

    Cuts the lineage: a lost executor costs at most the tasks of the running stage, as the files outlive it.
    """
    spark = df.sparkSession
    path = path or new_path(spark, tag)
    df.write.mode("overwrite").partitionBy(*by or []).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
