"""Forward-return labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import by_ticker, div, lead


def label_excess(df: DataFrame, horizon: int = 10, thresh: float = 0.015) -> DataFrame:
    """Forward return, mean of the sector's other tickers that day, the difference, and whether it reaches thresh."""
    out = df.withColumn("fwd_ret", div(lead("close", horizon), "close") - 1)
    w = Window.partitionBy("date", "sector")
    n, total = F.count("fwd_ret").over(w), F.sum("fwd_ret").over(w)
    others = F.when(n > 1, (total - F.col("fwd_ret")) / F.nullif(n - 1, F.lit(0))).otherwise(F.col("fwd_ret"))
    out = out.withColumn("sector_fwd", others).withColumn("excess_fwd", F.col("fwd_ret") - F.col("sector_fwd"))
    return out.withColumn("label", F.coalesce((F.col("excess_fwd") >= thresh).cast("int"), F.lit(0)))


def label_triple_barrier(df: DataFrame, take: float = 0.04, stop: float = 0.02, horizon: int = 10, reference_na: bool = False) -> DataFrame:
    """1 if close rises by `take` before it falls by `stop` within the next rows, else 0; NULL without enough rows.

    With reference_na only the rows that hit `take` first have a label.
    """
    ahead = F.collect_list("close").over(by_ticker().rowsBetween(1, horizon))
    out = df.withColumn("_a", ahead)
    up = F.array_position(F.transform("_a", lambda x: x / F.col("close") - 1 >= take), True)
    down = F.array_position(F.transform("_a", lambda x: x / F.col("close") - 1 <= -stop), True)
    first = (up > 0) & ((down == 0) | (up < down))
    label = F.when(first, 1).otherwise(F.lit(None) if reference_na else F.lit(0))
    out = out.withColumn("label", F.when(F.size("_a") == horizon, label))
    return out.withColumn("fwd_ret", F.when(F.size("_a") == horizon, F.element_at("_a", -1) / F.col("close") - 1)).drop("_a")


def label_meta(df: DataFrame, success: float = 0.02, min_proba: float | None = None) -> DataFrame:
    out = df if min_proba is None else df.where(F.col("proba") >= min_proba)
    return out.withColumn("meta_label", F.when(F.col("fwd_ret").isNotNull(), (F.col("fwd_ret") >= success).cast("int")))


def permute_rows(df: DataFrame, *key: str, column: str = "label", seed: int = 42) -> DataFrame:
    """The column's values dealt to other rows by hash order.

    Ranks come from two global sorts by position, zipped by rank; only for tests of leakage.
    """
    order = df.select(*key).orderBy(F.xxhash64(*key, F.lit(seed)), *key).rdd.zipWithIndex().map(lambda x: (*x[0], x[1]))
    donors = df.select(column, *key).orderBy(F.xxhash64(*key, F.lit(seed + 1)), *key).rdd.zipWithIndex().map(lambda x: (x[0][0], x[1]))
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    spark = df.sparkSession
    left = spark.createDataFrame(order, ", ".join(f"`{k}` {types[k]}" for k in key) + ", _n long")
    right = spark.createDataFrame(donors, f"`{column}` {types[column]}, _n long")
    return df.drop(column).join(left, list(key)).join(right, "_n").drop("_n")


def permute_dates(df: DataFrame, column: str = "label", seed: int = 42) -> DataFrame:
    """Each date takes another date's values in ticker order, tiled to its own length."""
    days = df.select("date").distinct()
    a = days.withColumn("_i", F.row_number().over(Window.orderBy("date")))
    b = days.select(F.col("date").alias("donor")).withColumn("_i", F.row_number().over(Window.orderBy(F.xxhash64("donor", F.lit(seed)), "donor")))
    pairs = a.join(b, "_i").drop("_i")  # one row per date
    w = Window.partitionBy("date")
    rows = df.drop(column).withColumn("_k", F.row_number().over(w.orderBy("ticker"))).join(F.broadcast(pairs), "date")
    d = df.select(F.col("date").alias("donor"), F.col(column), (F.row_number().over(w.orderBy("ticker")) - 1).alias("_k"), F.count("*").over(w).alias("_n"))
    sizes = d.select("donor", "_n").distinct()
    rows = rows.join(F.broadcast(sizes), "donor").withColumn("_k", (F.col("_k") - 1) % F.col("_n")).drop("_n")
    return rows.join(d.drop("_n"), ["donor", "_k"]).drop("_k", "donor")
