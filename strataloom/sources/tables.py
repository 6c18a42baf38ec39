"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``. Where that is unset, a local one, but on one machine only: executors elsewhere
    could not read it."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='strataloom-')}"
    return f"{at.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` written to a folder of its own and read back: its lineage is cut, its size is known, lost executors cost nothing."""
    spark, at = df.sparkSession, folder(df.sparkSession)
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def forget(df: DataFrame) -> None:
    """Deletes the folder of a table from ``written`` that nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if re.search("/[0-9a-f]{32}$", path):
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
