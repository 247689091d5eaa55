"""Tables written to the folder that driver and executors share, and reports of the driver."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; on a local master a new temporary folder stands in for it, on a cluster it has to be set."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="quillcount-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet and read again: computed once, whoever reads it how often, and safe from lost executors.

    The files are deleted when the session's file systems close.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/staged/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(there)
    return spark.read.schema(df.schema).parquet(path)


def write_atomic(path: str, text: str) -> None:
    """A report of the driver, whole or not at all: written beside its place and then moved there."""
    folder = os.path.dirname(os.path.abspath(path))
    handle, beside = tempfile.mkstemp(dir=folder, prefix=".report-")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as file:
            file.write(text)
        os.replace(beside, path)
    except BaseException:
        os.unlink(beside)
        raise
