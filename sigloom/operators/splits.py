"""Time splits and folds. A fold is a row (fold, train_start, train_end, test_start, test_end) of a small table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def day(text: str):
    return F.lit(text).cast("date")


def date_at(share: float):
    """Aggregate: the date at a share of the sorted rows."""
    return F.expr(f"date_from_unix_date(cast(percentile_disc({share}) within group (order by unix_date(date)) as int))")


def split_time(df: DataFrame, valid_start: str, test_start: str, embargo: int = 5, horizon: int = 10) -> DataFrame:
    """Adds split: train, valid, test, or NULL in the gaps of max(embargo, horizon) days before valid and test."""
    gap = max(embargo, horizon)
    d = F.col("date")
    split = F.when(d >= day(test_start), "test").when((d >= day(valid_start)) & (d < F.date_sub(day(test_start), gap)), "valid").when(d < F.date_sub(day(valid_start), gap), "train")
    return df.withColumn("split", split)


def require_splits(df: DataFrame, *names: str) -> None:
    got = {r["split"] for r in df.select("split").distinct().collect()}
    if set(names) - got:
        raise ValueError(f"empty splits: {sorted(set(names) - got)}")


def split_dynamic(df: DataFrame, train: float = 0.6, valid: float = 0.8) -> DataFrame:
    """Splits at the dates that stand at two shares of the sorted rows."""
    cuts = df.agg(date_at(train).alias("_a"), date_at(valid).alias("_b"))
    out = df.join(F.broadcast(cuts))
    return out.withColumn("split", F.when(F.col("date") < F.col("_a"), "train").when(F.col("date") < F.col("_b"), "valid").otherwise("test")).drop("_a", "_b")


def folds_purged(df: DataFrame, n: int = 5, embargo: int = 5, horizon: int = 10) -> DataFrame:
    """n runs of dates, the last with the rest; training is what lies before the run and its gap."""
    dates = df.select("date").distinct().withColumn("i", F.row_number().over(Window.orderBy("date")) - 1)
    sized = dates.join(F.broadcast(dates.agg(F.count("*").alias("n"), F.min("date").alias("first"))))
    fold = F.least(F.floor(F.col("i") / F.floor(F.col("n") / n)).cast("int"), F.lit(n - 1)) + 1
    out = sized.groupBy(fold.alias("fold"), "first").agg(F.min("date").alias("test_start"), F.max("date").alias("test_end"))
    return out.select("fold", F.col("first").alias("train_start"), F.date_sub("test_start", max(embargo, horizon) + 1).alias("train_end"), "test_start", "test_end")


def folds_expanding(df: DataFrame, first_days: int = 730, step_days: int = 30, embargo: int = 5) -> DataFrame:
    """From the first date first_days on, one fold per step: train up to the step less the embargo, test the step."""
    span = df.agg(F.min("date").alias("a"), F.max("date").alias("b"))
    steps = span.select("a", "b", F.explode(F.expr(f"sequence(date_add(a, {first_days}), b, interval {step_days} days)")).alias("cur"))
    fold = F.row_number().over(Window.orderBy("cur"))
    return steps.where("cur < b").select(fold.alias("fold"), F.col("a").alias("train_start"), F.date_sub("cur", embargo).alias("train_end"), F.date_add("cur", 1).alias("test_start"), F.least("b", F.date_add("cur", step_days)).alias("test_end"))


def folds_rolling(df: DataFrame, train_years: int = 2, test_months: int = 3) -> DataFrame:
    span = df.agg(F.min("date").alias("a"), F.max("date").alias("b"))
    steps = span.select("b", F.explode(F.expr(f"sequence(a, add_months(b, -{12 * train_years}), interval {test_months} months)")).alias("cur"))
    end = F.add_months("cur", 12 * train_years)
    fold = F.row_number().over(Window.orderBy("cur"))
    return steps.select(fold.alias("fold"), F.col("cur").alias("train_start"), F.date_sub(end, 1).alias("train_end"), end.alias("test_start"), F.least("b", F.date_sub(F.add_months(end, test_months), 1)).alias("test_end"))


def folds_anchored(df: DataFrame, train_days: int = 365, valid_days: int = 180, test_days: int = 180, step_days: int = 90, embargo: int = 5, horizon: int = 10) -> DataFrame:
    """Training from the first date on, then gap, validation, gap, test; the next fold starts step_days later."""
    gap = embargo + horizon
    span = df.agg(F.min("date").alias("a"), F.max("date").alias("b"))
    steps = span.select("a", "b", F.explode(F.expr(f"sequence(date_add(a, {train_days}), b, interval {step_days} days)")).alias("cur"))
    out = steps.select("a", "b", "cur", F.date_add("cur", gap).alias("valid_start"), F.date_add("cur", gap + valid_days).alias("valid_end"))
    out = out.withColumn("test_start", F.date_add("valid_end", gap)).withColumn("test_end", F.date_add("test_start", test_days)).where("test_end <= b")
    return out.select(F.row_number().over(Window.orderBy("cur")).alias("fold"), F.col("a").alias("train_start"), F.col("cur").alias("train_end"), "valid_start", "valid_end", "test_start", "test_end")


def in_fold(df: DataFrame, folds: DataFrame, part: str = "test") -> DataFrame:
    """Rows of each fold's part, with the fold's number; the fold table is small."""
    return df.join(F.broadcast(folds.select("fold", f"{part}_start", f"{part}_end")), F.col("date").between(F.col(f"{part}_start"), F.col(f"{part}_end"))).drop(f"{part}_start", f"{part}_end")


def split_reversed(df: DataFrame, share: float = 0.3) -> DataFrame:
    """Trains on the last share of dates."""
    cut = df.select("date").distinct().agg(date_at(1 - share).alias("_c"))
    return df.join(F.broadcast(cut)).withColumn("split", F.when(F.col("date") > F.col("_c"), "train").otherwise("test")).drop("_c")


def split_gap(df: DataFrame, share: float = 0.4, gap_days: int = 180) -> DataFrame:
    cut = df.select("date").distinct().agg(date_at(share).alias("_c"))
    d = F.col("date")
    return df.join(F.broadcast(cut)).withColumn("split", F.when(d <= F.col("_c"), "train").when(d > F.date_add("_c", gap_days), "test")).drop("_c")


def split_random(df: DataFrame, *key: str, share: float = 0.7, seed: int = 42) -> DataFrame:
    return df.withColumn("split", F.when(F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(1_000_000)) < int(share * 1e6), "train").otherwise("test"))
