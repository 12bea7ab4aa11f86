"""Ranked holding-period backtests, costs, sweeps and scenario changes of prices, all as single jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.windows import by_ticker, div, lag, last_rows
from .metrics import YEAR, topk_per_date
from .panel import calendar
from .regimes import risk_flags


def cost_model(spark: SparkSession, models: dict[str, dict]) -> DataFrame:
    """name, per_side_bps in all (base and components) and slippage_bps; a total that is not positive is an error."""
    rows = []
    for name, m in models.items():
        total = float(m.get("per_side_bps", 0.0)) + sum(float(x) for x in m.get("components", {}).values())
        if total <= 0:
            raise ValueError(f"cost model {name}: total of {total} bps")
        rows.append((name, total, float(m.get("slippage_bps", 0.0))))
    return spark.createDataFrame(rows, "name string, total_bps double, slippage_bps double")


def sticky_topk(ranks: DataFrame, k: int, max_drop: int = 20) -> DataFrame:
    """Per date k tickers: those of the previous processed date's best k that fell by max_drop ranks at most, then the best.

    ranks: (date, ticker, rank). Only ranks up to k + max_drop matter.
    """
    near = ranks.where(F.col("rank") <= k + max_drop)
    days = ranks.select("date").distinct().withColumn("_i", F.row_number().over(Window.orderBy("date")))
    now = near.join(F.broadcast(days), "date")
    before = now.where(F.col("rank") <= k).select("ticker", (F.col("_i") + 1).alias("_i"), F.col("rank").alias("_prev"))
    both = now.join(before, ["ticker", "_i"], "left")
    keep = F.coalesce(F.col("rank") <= F.col("_prev") + max_drop, F.lit(False))
    w = Window.partitionBy("date").orderBy(keep.desc(), "rank")
    return both.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).select("date", "ticker", "rank")


def backtest_topk(preds: DataFrame, prices: DataFrame, top_k: int = 10, hold: int = 5, slippage_bps: float = 12.0, fee_bps: float = 26.1, gate: bool = True, sticky: bool = False, min_meta: float | None = None, **risk) -> DataFrame:
    """Trades: on allowed dates the best k by proba, out `hold` market dates later; a missing price drops the trade."""
    days = F.broadcast(calendar(prices))  # one row per date
    cost = (slippage_bps + fee_bps) / 1e4
    rows = preds.where("proba is not null").select("date", "ticker", "proba", *(["meta_proba"] if min_meta is not None else []))
    if min_meta is not None:
        rows = rows.where(F.col("meta_proba") >= min_meta)
    if gate:
        rows = rows.join(F.broadcast(risk_flags(prices, **risk).where("allow").select("date")), "date", "left_semi")
    if sticky:
        picks = sticky_topk(topk_per_date(rows, top_k + 20).select("date", "ticker", "rank"), top_k)
    else:
        picks = topk_per_date(rows, top_k).select("date", "ticker", "rank")
    bars = prices.groupBy("date", "ticker").agg(F.avg("close").alias("close")).join(days, "date")
    entry = picks.join(bars, ["date", "ticker"])
    out = bars.select("ticker", (F.col("idx") - hold).alias("idx"), F.col("date").alias("date_out"), F.col("close").alias("_out"))
    trades = entry.join(out, ["ticker", "idx"])
    trades = trades.select(F.col("date").alias("date_in"), "date_out", "ticker", (F.col("close") * (1 + cost)).alias("entry_px"), (F.col("_out") * (1 - cost)).alias("exit_px"))
    return trades.withColumn("gross_ret", div("exit_px", "entry_px") - 1).withColumn("net_ret", F.col("gross_ret"))


def equity_curve(trades: DataFrame, prices: DataFrame) -> DataFrame:
    """Mean return of the trades entered per date of the calendar, 0 without any, and their compounded product."""
    per = trades.groupBy(F.col("date_in").alias("date")).agg(F.avg("net_ret").alias("_r"))
    out = prices.select("date").distinct().join(per, "date", "left").select("date", F.coalesce("_r", F.lit(0.0)).alias("ret"))
    return out.withColumn("equity", F.product(1 + F.col("ret")).over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)))


def backtest_summary(trades: DataFrame, curve: DataFrame) -> DataFrame:
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    c = curve.withColumn("_dd", F.col("equity") / F.max("equity").over(w) - 1)
    a = c.agg(F.count("*").alias("days"), F.max_by("equity", "date").alias("final_equity"), (F.avg("ret") / (F.stddev_pop("ret") + 1e-12) * F.sqrt(F.lit(YEAR))).alias("sharpe"), F.min("_dd").alias("max_drawdown"))
    t = trades.agg(F.count("*").alias("trades"), F.avg((F.col("net_ret") > 0).cast("double")).alias("win_rate"), F.count_distinct("date_in").alias("_d"))
    out = a.join(F.broadcast(t))
    return out.select("days", "trades", "final_equity", (F.pow("final_equity", YEAR / F.col("days")) - 1).alias("cagr"), "sharpe", "max_drawdown", "win_rate", (F.col("trades") / F.col("days")).alias("turnover"), F.try_divide("trades", "_d").alias("avg_positions"))


def open_positions(trades: DataFrame) -> DataFrame:
    """Positions open after each date on which one opens or closes."""
    steps = trades.select(F.col("date_in").alias("date"), F.lit(1).alias("_d")).unionByName(trades.select(F.col("date_out").alias("date"), F.lit(-1).alias("_d")))
    per = steps.groupBy("date").agg(F.sum("_d").alias("_d"))
    return per.select("date", F.sum("_d").over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)).alias("open_positions"))


def yearly_metrics(trades: DataFrame, curve: DataFrame) -> DataFrame:
    w = Window.partitionBy("year").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    c = curve.withColumn("year", F.year("date")).withColumn("_eq", F.product(1 + F.col("ret")).over(w))
    c = c.withColumn("_dd", F.col("_eq") / F.max("_eq").over(w) - 1)
    a = c.groupBy("year").agg(F.count("*").alias("days"), F.max_by("_eq", "date").alias("growth"), (F.avg("ret") / (F.stddev_pop("ret") + 1e-12) * F.sqrt(F.lit(YEAR))).alias("sharpe"), F.min("_dd").alias("max_drawdown"))
    t = trades.groupBy(F.year("date_in").alias("year")).agg(F.count("*").alias("trades"), F.avg((F.col("net_ret") > 0).cast("double")).alias("win_rate"), F.avg("net_ret").alias("avg_ret"))
    return a.withColumn("cagr", F.pow("growth", YEAR / F.col("days")) - 1).join(t, "year", "left")


def regime_trade_metrics(trades: DataFrame, regimes: DataFrame) -> DataFrame:
    """Count, win rate, mean and compounded return by trend, by volatility and by both; NULL means all.

    Trades of dates without a regime count under "unknown". A loss of everything compounds to -1, whatever else was won.
    """
    rows = trades.join(F.broadcast(regimes), trades["date_in"] == regimes["date"], "left")
    rows = rows.select(F.coalesce("trend", F.lit("unknown")).alias("trend"), F.coalesce("vol", F.lit("unknown")).alias("vol"), "net_ret")
    rows = rows.withColumn("_log", F.when(F.col("net_ret") > -1, F.log1p("net_ret")))
    grown = F.when(F.min("net_ret") <= -1, F.lit(-1.0)).otherwise(F.exp(F.sum("_log")) - 1)
    out = rows.groupingSets([["trend"], ["vol"], ["trend", "vol"]], "trend", "vol")
    return out.agg(F.count("*").alias("trades"), F.avg((F.col("net_ret") > 0).cast("double")).alias("win_rate"), F.avg("net_ret").alias("avg_ret"), grown.alias("compounded"))


def cost_after_the_fact(trades: DataFrame, extra: float = 0.002) -> DataFrame:
    rows = trades.select(F.col("net_ret").alias("before"), (F.col("net_ret") - extra).alias("after")).unpivot([], ["before", "after"], "stage", "ret")
    return rows.groupBy("stage").agg(F.avg("ret").alias("avg_ret"), (F.avg("ret") / (F.stddev_samp("ret") + 1e-12) * F.sqrt(F.lit(YEAR))).alias("sharpe"), F.avg((F.col("ret") > 0).cast("double")).alias("win_rate"))


def sweep_metrics(trades: DataFrame, days: DataFrame, *keys: str) -> DataFrame:
    """Sharpe, growth a year and worst drawdown per scenario over the full calendar; trades carry the scenario keys."""
    per = trades.groupBy(*keys, F.col("date_in").alias("date")).agg(F.avg("net_ret").alias("_r"))
    grid = trades.select(*keys).distinct().join(F.broadcast(days.select("date").distinct()))  # scenarios x calendar
    rows = grid.join(per, [*keys, "date"], "left").withColumn("ret", F.coalesce("_r", F.lit(0.0)))
    w = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_eq", F.product(1 + F.col("ret")).over(w))
    rows = rows.withColumn("_dd", F.col("_eq") / F.max("_eq").over(w) - 1)
    out = rows.groupBy(*keys).agg(F.count("*").alias("days"), (F.avg("ret") / (F.stddev_pop("ret") + 1e-12) * F.sqrt(F.lit(YEAR))).alias("sharpe"), F.max_by("_eq", "date").alias("final_equity"), F.min("_dd").alias("max_drawdown"))
    return out.withColumn("cagr", F.pow("final_equity", YEAR / F.col("days")) - 1)


def cost_sweep(trades: DataFrame, prices: DataFrame, costs: list[float]) -> DataFrame:
    """trades before costs; each cost is taken per side. One job for all costs."""
    table = trades.sparkSession.createDataFrame([(float(c),) for c in costs], "cost_bps double")
    c = F.col("cost_bps") / 1e4
    rows = trades.join(F.broadcast(table)).withColumn("net_ret", (1 + F.col("gross_ret")) * (1 - c) / (1 + c) - 1)
    return sweep_metrics(rows, prices, "cost_bps")


def param_sweep(preds: DataFrame, prices: DataFrame, top_ks: list[int], holds: list[int], cost: float = 0.0) -> DataFrame:
    """All pairs of top_k and hold_days in one job: picks are ranked once, exits joined by index."""
    spark = preds.sparkSession
    ks, hs = spark.createDataFrame([(k,) for k in top_ks], "top_k int"), spark.createDataFrame([(h,) for h in holds], "hold_days int")
    days = F.broadcast(calendar(prices))
    bars = prices.groupBy("date", "ticker").agg(F.avg("close").alias("close")).join(days, "date")
    picks = topk_per_date(preds.where("proba is not null"), max(top_ks)).select("date", "ticker", "rank")
    entry = picks.join(bars, ["date", "ticker"]).join(F.broadcast(hs)).withColumn("_at", F.col("idx") + F.col("hold_days"))
    exits = bars.select(F.col("ticker"), F.col("idx").alias("_at"), F.col("close").alias("_out"))
    trades = entry.join(exits, ["ticker", "_at"]).withColumn("net_ret", F.col("_out") * (1 - cost) / (F.col("close") * (1 + cost)) - 1)
    trades = trades.join(F.broadcast(ks), F.col("rank") <= F.col("top_k")).withColumnRenamed("date", "date_in")
    return sweep_metrics(trades, prices, "top_k", "hold_days")


# Scenario changes of prices


def shock_volatility(df: DataFrame, factor: float = 2.0) -> DataFrame:
    """Each ticker's path from its first close with all returns multiplied."""
    r = F.coalesce(div("close", lag("close")) - 1, F.lit(0.0))
    out = df.withColumn("_r", r)
    path = F.first("close").over(by_ticker().rowsBetween(Window.unboundedPreceding, 0)) * F.product(1 + factor * F.col("_r")).over(last_rows(None))
    return out.withColumn("close", path).drop("_r")


def shock_crash(df: DataFrame, size: float = -0.2, share: float = 1.0, recovery: int | None = None, seed: int = 7) -> DataFrame:
    """Closes from the middle date on change by `size`, recovering linearly over `recovery` dates (never, if None)."""
    days = calendar(df)
    mid = days.agg(F.floor((F.max("idx") + 1) / 2).alias("_mid"))
    rows = df.join(F.broadcast(days), "date").join(F.broadcast(mid))
    hit = F.pmod(F.xxhash64("ticker", F.lit(seed)), F.lit(1_000_000)) < int(share * 1e6)
    since = F.col("idx") - F.col("_mid")
    left = F.lit(1.0) if recovery is None else F.greatest(F.lit(0.0), 1 - since / recovery)
    return rows.withColumn("close", F.when(hit & (since >= 0), F.col("close") * (1 + size * left)).otherwise(F.col("close"))).drop("idx", "_mid")


def shock_correlation(df: DataFrame, start: str, end: str) -> DataFrame:
    """Within the window every ticker moves with the market's mean growth since its last close before it."""
    inside = F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    base = F.last(F.when(F.col("date") < F.lit(start).cast("date"), F.col("close")), ignorenulls=True).over(last_rows(None))
    rows = df.withColumn("_b", base).withColumn("_g", F.when(inside, div("close", "_b")))
    mean_growth = F.avg("_g").over(Window.partitionBy("date"))
    return rows.withColumn("close", F.when(inside & F.col("_b").isNotNull(), F.col("_b") * mean_growth).otherwise(F.col("close"))).drop("_b", "_g")


def shock_tail(df: DataFrame, share: float = 0.02, size: float = -0.1, seed: int = 7) -> DataFrame:
    hit = F.pmod(F.xxhash64("date", "ticker", F.lit(seed)), F.lit(1_000_000)) < int(share * 1e6)
    return df.withColumn("close", F.when(hit, F.col("close") * (1 + size)).otherwise(F.col("close")))


def block_bootstrap(curve: DataFrame, replicates: int = 100, block: int = 20, seed: int = 7) -> DataFrame:
    """Distribution of the mean return and Sharpe over replicates of blocks drawn with replacement.

    The curve has a row per date; replicates times blocks rows are drawn and joined, each replicate with its own id.
    """
    rows = curve.withColumn("_i", F.row_number().over(Window.orderBy("date")) - 1).withColumn("_b", F.floor(F.col("_i") / block))
    n = rows.agg((F.max("_b") + 1).alias("n")).first()["n"]
    draws = curve.sparkSession.range(replicates * n).select(F.floor(F.col("id") / n).alias("replicate"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).alias("_b"))
    per = draws.join(F.broadcast(rows.select("_b", "ret")), "_b").groupBy("replicate").agg(F.avg("ret").alias("mean_ret"), (F.avg("ret") / (F.stddev_pop("ret") + 1e-12) * F.sqrt(F.lit(YEAR))).alias("sharpe"))
    long = per.unpivot(["replicate"], ["mean_ret", "sharpe"], "metric", "value")
    return long.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.percentile("value", F.lit(0.05)).alias("p5"), F.percentile("value", F.lit(0.95)).alias("p95"))


def stress_acceptance(scenarios: DataFrame) -> DataFrame:
    """Per scenario whether Sharpe, drawdown and win rate hold, with reasons."""
    ok = {"sharpe": F.col("sharpe") >= 0.5, "max_drawdown": F.col("max_drawdown") >= -0.30, "win_rate": F.col("win_rate") >= 0.45}
    reasons = F.array_compact(F.array(*[F.when(~v, F.lit(f"{k} below bound")) for k, v in ok.items()]))
    out = scenarios.withColumn("reasons", reasons)
    return out.withColumn("passed", F.size("reasons") == 0)
