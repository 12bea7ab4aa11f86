"""Writers, and tables kept by key."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scans import Sources


def partitioned(df: DataFrame, path: str, *by: str) -> None:
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def as_csv(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, so that the rows fit into CSV."""
    nested = [f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "map", "struct")]
    return df.withColumns({c: F.to_json(c) for c in nested})


def write_csv(df: DataFrame, path: str) -> None:
    as_csv(df).write.mode("overwrite").option("header", True).csv(path)


def ingest(spark: SparkSession, sources: Sources, root: str, checks: dict[str, Callable[[DataFrame], None]] | None = None) -> dict[str, str]:
    """Writes each source's table to root/name after its check; returns the paths."""
    paths = {}
    for name, make in sources.items():
        df = make(spark)
        if checks and name in checks:
            checks[name](df)
        paths[name] = f"{root}/{name}"
        df.write.mode("overwrite").parquet(paths[name])
    return paths


def kept(spark: SparkSession, root: str, key: str, make: Callable[[], DataFrame], ttl_hours: float = 12.0) -> DataFrame:
    """The table written under the key within the last ttl_hours, else a new one."""
    path = f"{root}/{hashlib.sha1(key.encode()).hexdigest()}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    fresh = fs.exists(hadoop) and time.time() * 1000 - fs.getFileStatus(hadoop).getModificationTime() < ttl_hours * 3.6e6
    if not fresh:
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def csv_per_key(df: DataFrame, path: str, key: str, **options) -> None:
    """One CSV per value of a key, named by it; Spark writes a folder per value and the driver renames its one file."""
    spark = df.sparkSession
    made = f"{path.rstrip('/')}/_by_key"
    df.withColumn("_file", F.col(key)).drop(key).repartition("_file").write.partitionBy("_file").options(header=True, **options).csv(made)
    jvm = spark._jvm.org.apache.hadoop.fs.Path
    store = jvm(made).getFileSystem(spark._jsc.hadoopConfiguration())
    for folder in store.listStatus(jvm(made)):
        name = folder.getPath().getName()
        if name.startswith("_file="):
            files = [f.getPath() for f in store.listStatus(folder.getPath()) if f.getPath().getName().endswith(".csv")]
            for i, file in enumerate(files):
                store.rename(file, jvm(f"{path.rstrip('/')}/{name[6:]}{f'-{i}' if i else ''}.csv"))
    store.delete(jvm(made), True)
