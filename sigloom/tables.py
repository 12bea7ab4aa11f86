"""Tables written once between the steps of an operator, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared one: spark.checkpoint.dir; in local mode, a folder of our own where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="sigloom-")
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> str:
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return path


def once(df: DataFrame) -> DataFrame:
    """df, computed once however often the result is read."""
    return df.sparkSession.read.schema(df.schema).parquet(written(df))
