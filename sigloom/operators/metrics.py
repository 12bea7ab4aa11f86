"""Signal and trade metrics over rows with a score, a label and a return."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from ..functions.windows import EPS, corr, corr_of
from ..tables import once
from .order_statistics import cumulated_in_ranges, exact_quantiles, ranked_in_ranges

YEAR = 252.0


def ranked(df: DataFrame, columns: dict[str, str], *keys: str) -> DataFrame:
    """Adds average-tie ranks (out -> in) within the keys, each of which one task sorts; without keys over all rows, in ranges.

    For a few keys with many rows each, ranked_in_ranges.
    """
    if not keys:
        return ranked_in_ranges(df, columns)
    out = df
    for name, x in columns.items():
        w = Window.partitionBy(*keys)
        first = F.rank().over(w.orderBy(F.col(x).asc_nulls_last()))
        out = out.withColumn(name, F.when(F.col(x).isNotNull(), first + (F.count("*").over(Window.partitionBy(*keys, x)) - 1) / 2))
    return out


def cumulated(df: DataFrame, order: str, columns: list[str], descending: bool = False) -> DataFrame:
    """Adds <column>_before, the sum over all rows that come earlier in the order, without one task for all rows."""
    df = once(df)
    out = cumulated_in_ranges(df, order, columns, stored=True)
    if descending:
        totals = F.broadcast(df.agg(*[F.sum(c).alias(f"_t_{c}") for c in columns]))
        out = out.join(totals).withColumns({f"{c}_before": F.col(f"_t_{c}") - F.col(f"{c}_before") - F.col(c) for c in columns}).drop(*[f"_t_{c}" for c in columns])
    return out


def ic(x: str, y: str, least: int = 10) -> Column:
    """Aggregate: Pearson correlation of complete pairs."""
    return corr(x, y, least)


def rank_ic(df: DataFrame, x: str, y: str, *keys: str, least: int = 10) -> DataFrame:
    """Spearman correlation of complete pairs, per keys or over all rows."""
    rows = ranked(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()), {"_rx": x, "_ry": y}, *keys)
    return (rows.groupBy(*keys) if keys else rows).agg(corr("_rx", "_ry", least).alias("rank_ic"), F.count("*").alias("n"))


def ic_contribution(df: DataFrame, signal: str = "proba", size: str = "size", ret: str = "excess_fwd") -> DataFrame:
    return df.withColumn("_s", F.col(signal) * F.col(size)).agg(corr("_s", ret, 10).alias("ic_contribution"))


def ic_daily(df: DataFrame, x: str = "proba", y: str = "excess_fwd", least: int = 10) -> DataFrame:
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy("date").agg(F.count("*").alias("n"), corr(x, y).alias("ic")).where(F.col("n") >= least)


def ic_by_period(df: DataFrame, x: str = "proba", y: str = "excess_fwd", period: str = "month", least: int = 10) -> DataFrame:
    """Mean, deviation, their ratio and the positive share of the daily coefficients in each period."""
    g = ic_daily(df, x, y, least).groupBy(F.date_trunc(period, "date").cast("date").alias("period"))
    out = g.agg(F.avg("ic").alias("ic_mean"), F.stddev_samp("ic").alias("ic_std"), F.avg((F.col("ic") > 0).cast("double")).alias("positive_rate"))
    return out.withColumn("ic_sharpe", F.col("ic_mean") / (F.col("ic_std") + EPS))


def ic_rolling_rows(df: DataFrame, window: int = 50, x: str = "proba", y: str = "excess_fwd") -> DataFrame:
    """Correlation over the `window` rows before each row of a ticker."""
    w = Window.partitionBy("ticker").orderBy("date").rowsBetween(-window, -1)
    a, b = F.when(F.col(y).isNotNull(), F.col(x)), F.when(F.col(x).isNotNull(), F.col(y))
    value = corr_of(F.covar_pop(a, b).over(w), F.stddev_pop(a).over(w), F.stddev_pop(b).over(w))
    return df.withColumn("ic", F.when(F.count(a).over(w) >= 10, value))


def quantile_buckets(df: DataFrame, x: str, n: int = 10, name: str = "bucket") -> DataFrame:
    """1..n by the exact quantiles of x, edges that coincide dropped; a bucket holds its upper edge, the first both."""
    found = exact_quantiles(df, x, [i / n for i in range(n + 1)]).collect()
    edges = F.array(*[F.lit(e) for e in dict.fromkeys(found[0]["q"] if found else ())]).cast("array<double>")
    out = df.withColumn("_e", edges)
    below = F.size(F.filter("_e", lambda e: e < F.col(x)))
    return out.withColumn(name, F.when(F.col(x).isNotNull(), F.greatest(below, F.lit(1)))).drop("_e")


def decile_stats(df: DataFrame, x: str = "proba", y: str = "excess_fwd", n: int = 10) -> DataFrame:
    rows = quantile_buckets(once(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y)), x, n, "decile")
    out = rows.groupBy("decile").agg(F.count("*").alias("n"), F.avg(y).alias("mean_ret"), F.stddev_samp(y).alias("std_ret"), F.min(x).alias("min_signal"), F.max(x).alias("max_signal"))
    return out.withColumn("sharpe", F.col("mean_ret") / (F.col("std_ret") + EPS)).withColumn("annual_sharpe", F.col("sharpe") * F.sqrt(F.lit(YEAR)))


def decile_ic(df: DataFrame, x: str = "proba", y: str = "excess_fwd", n: int = 10) -> DataFrame:
    """Spread of the outer deciles' means over the deviation of all returns."""
    rows = once(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y))
    ends = decile_stats(rows, x, y, n).agg((F.max_by("mean_ret", "decile") - F.min_by("mean_ret", "decile")).alias("_spread"))
    return ends.join(F.broadcast(rows.agg(F.stddev_samp(y).alias("_std")))).select((F.col("_spread") / (F.col("_std") + EPS)).alias("decile_ic"))


def monotonic(deciles: DataFrame) -> DataFrame:
    w = Window.orderBy("decile")  # ten rows
    rising = F.coalesce(F.col("mean_ret") >= F.lag("mean_ret").over(w), F.lit(True))
    return deciles.withColumn("_up", rising).agg(F.bool_and("_up").alias("monotonic"), F.count_if(~F.col("_up")).alias("breaks"))


def trade_stats(df: DataFrame, ret: str = "net_ret", *keys: str) -> DataFrame:
    """Hit rate, profit factor (NULL without a loss), expected value and its parts."""
    x = F.col(ret)
    win, loss = F.when(x > 0, x), F.when(x < 0, -x)
    out = (df.groupBy(*keys) if keys else df).agg(
        F.count(ret).alias("trades"), F.avg((x > 0).cast("double")).alias("hit_rate"), F.coalesce(F.avg(win), F.lit(0.0)).alias("avg_win"), F.coalesce(F.avg(loss), F.lit(0.0)).alias("avg_loss"),
        F.try_divide(F.coalesce(F.sum(win), F.lit(0.0)), F.coalesce(F.sum(loss), F.lit(0.0))).alias("profit_factor"),
    )
    return out.withColumn("expected_value", F.col("hit_rate") * F.col("avg_win") - (1 - F.col("hit_rate")) * F.col("avg_loss"))


def risk_stats(daily: DataFrame, ret: str = "ret", *keys: str) -> DataFrame:
    """Sharpe (population deviation), Sortino, worst drawdown, growth a year and Calmar of a daily return series."""
    w = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    rows = daily.withColumn("_eq", F.product(1 + F.col(ret)).over(w))
    rows = rows.withColumn("_dd", F.col("_eq") / F.max("_eq").over(w) - 1)
    out = (rows.groupBy(*keys) if keys else rows).agg(
        F.count("*").alias("days"), (F.avg(ret) / (F.stddev_pop(ret) + 1e-12) * F.sqrt(F.lit(YEAR))).alias("sharpe"),
        (F.avg(ret) / (F.coalesce(F.stddev_samp(F.when(F.col(ret) < 0, F.col(ret))), F.lit(0.0)) + 1e-12) * F.sqrt(F.lit(YEAR))).alias("sortino"),
        F.min("_dd").alias("max_drawdown"), F.max_by("_eq", "date").alias("final_equity"),
    )
    out = out.withColumn("cagr", F.pow("final_equity", YEAR / F.col("days")) - 1)
    return out.withColumn("calmar", F.try_divide("cagr", F.abs("max_drawdown")))


def exposure(signals: DataFrame, top_k: int = 10, hold_days: int = 10) -> DataFrame:
    per = signals.groupBy("date").agg(F.count("*").alias("n"))
    return per.agg(F.avg("n").alias("avg_positions"), F.max("n").alias("max_positions"), (F.avg("n") / top_k).alias("exposure"), (F.avg("n") * hold_days).alias("capacity"))


def roc_auc(df: DataFrame, score: str = "proba", label: str = "label") -> DataFrame:
    """From counts per distinct score: ties count half."""
    rows = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    per = cumulated(rows.groupBy(score).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.sum(1 - F.col(label).cast("long")).alias("neg")), score, ["neg"])
    sums = per.agg(F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2)).alias("u"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return sums.select(F.try_divide("u", F.col("p") * F.col("n")).alias("roc_auc"))


def pr_auc(df: DataFrame, score: str = "proba", label: str = "label") -> DataFrame:
    """Trapezoids under precision over recall by descending score, from the point (0, 1)."""
    rows = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    per = rows.groupBy(score).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.count("*").alias("n"))
    per = cumulated(per, score, ["pos", "n"], descending=True)
    tp0, n0, tp, n = F.col("pos_before"), F.col("n_before"), F.col("pos_before") + F.col("pos"), F.col("n_before") + F.col("n")
    before = F.when(n0 == 0, 1.0).otherwise(F.try_divide(tp0, n0))
    area = F.col("pos") * (before + tp / n) / 2
    return per.agg(F.try_divide(F.sum(area), F.sum("pos")).alias("pr_auc"))


def precision_at_k(df: DataFrame, k: int, score: str = "proba", label: str = "label", *tie: str) -> DataFrame:
    return df.orderBy(F.col(score).desc(), *tie).limit(k).agg(F.avg(F.col(label).cast("double")).alias("precision"))


def hit_curve(df: DataFrame, score: str = "proba", label: str = "label") -> DataFrame:
    """For thresholds 0.50 to 0.90: hits and covered rows as shares of all rows, precision above the threshold."""
    steps = df.sparkSession.range(10, 19).select((F.col("id") / 20).alias("threshold"))
    rows = df.select(F.col(score).alias("s"), F.col(label).alias("y")).join(F.broadcast(steps))  # nine thresholds
    over = F.col("s") >= F.col("threshold")
    return rows.groupBy("threshold").agg(F.avg((over & (F.col("y") == 1)).cast("double")).alias("hit_rate"), F.avg(over.cast("double")).alias("coverage"), F.avg(F.when(over, F.col("y").cast("double"))).alias("precision"))


def topk_per_date(df: DataFrame, k: int | None, score: str = "proba") -> DataFrame:
    """The k best rows of each date with their rank; all rows if k is None."""
    w = Window.partitionBy("date").orderBy(F.col(score).desc(), "ticker")
    ranked = df.withColumn("rank", F.row_number().over(w))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def precision_by_day(df: DataFrame, k: int = 10) -> DataFrame:
    return topk_per_date(df, k).groupBy("date").agg(F.avg(F.col("label").cast("double")).alias("p")).agg(F.avg("p").alias("precision_by_day"), F.count("*").alias("days"))


def fold_stability(per_fold: DataFrame, metric: str = "metric", value: str = "value") -> DataFrame:
    out = per_fold.groupBy(metric).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    out = out.withColumn("cv", F.try_divide("std", F.abs("mean")))
    return out.withColumn("score", 1 / (1 + F.coalesce("cv", F.lit(0.0)))).withColumn("stable", F.coalesce(F.col("cv") < 0.2, F.lit(False)))


def importance_by_block(importance: DataFrame) -> DataFrame:
    """Sum, share and number of zero importances per feature block (the name before __)."""
    block = F.split("feature", "__")[0]
    out = importance.groupBy(block.alias("block")).agg(F.sum("importance").alias("importance"), F.count_if(F.col("importance") == 0).alias("zeros"))
    return out.withColumn("share", F.try_divide("importance", F.sum("importance").over(Window.partitionBy())))


def importance_stability(per_fold: DataFrame) -> DataFrame:
    cv = per_fold.groupBy("feature").agg(F.try_divide(F.stddev_pop("importance"), F.avg("importance")).alias("cv"))
    return cv.agg((1 / (1 + F.avg("cv"))).alias("stability"))


def ensemble_combine(scores: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """Mean, median, weighted mean and deviation of the models' scores per (date, ticker); weights (model, weight)."""
    rows = scores.withColumn("weight", F.lit(1.0)) if weights is None else scores.join(F.broadcast(weights), "model")
    return rows.groupBy("date", "ticker").agg(F.avg("proba").alias("mean"), F.percentile("proba", F.lit(0.5)).alias("median"), F.try_divide(F.sum(F.col("proba") * F.col("weight")), F.sum("weight")).alias("weighted"), F.stddev_pop("proba").alias("uncertainty"))


def ensemble_diversity(scores: DataFrame) -> DataFrame:
    """Mean pairwise correlation of the models, mean deviation per row, and a score from both."""
    a, b = scores.select("date", "ticker", F.col("model").alias("a"), F.col("proba").alias("pa")), scores.select("date", "ticker", F.col("model").alias("b"), F.col("proba").alias("pb"))
    pairs = a.join(b, ["date", "ticker"]).where("a < b").groupBy("a", "b").agg(corr("pa", "pb").alias("r"))
    spread = scores.groupBy("date", "ticker").agg(F.stddev_pop("proba").alias("s")).agg(F.avg("s").alias("avg_std"))
    return pairs.agg(F.avg("r").alias("avg_corr"), F.count("*").alias("pairs")).join(F.broadcast(spread))
