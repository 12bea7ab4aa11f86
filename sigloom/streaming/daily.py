"""Streams over a folder that exchange files drop into."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

BARS = "date date, ticker string, open double, high double, low double, close double, volume double"


def once_each(rows: DataFrame, late: str) -> DataFrame:
    """Each (date, ticker) once within the time that rows may be late; what comes later still is left out."""
    rows = rows.selectExpr("*", "cast(date as timestamp) as _at").withWatermark("_at", late)
    return rows.dropDuplicatesWithinWatermark(["date", "ticker"]).drop("_at")


def bars(spark: SparkSession, path: str, late: str = "10 days", files: str = "csv") -> DataFrame:
    """New files as bars, each (date, ticker) once within the time that files may be late."""
    reader = spark.readStream.schema(BARS)
    rows = reader.option("header", True).csv(path) if files == "csv" else reader.parquet(path)
    return once_each(rows, late)


def into_panel(rows: DataFrame, panel: str, checkpoint: str) -> StreamingQuery:
    """Appends what is there to a panel partitioned by year, then stops."""

    def add(batch: DataFrame, _: int) -> None:
        batch.selectExpr("*", "year(date) as year").write.mode("append").partitionBy("year").parquet(panel)

    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
