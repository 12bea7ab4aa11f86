"""Market regimes per date, from an equal-weight index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.windows import div, expanding_pct_rank, last_rows, mean, pct, std
from .features import market

VOLATILITY = {"low_vol": 20, "medium_vol": 10, "high_vol": -15, "extreme_vol": -30}
TREND = {"strong_uptrend": 25, "weak_uptrend": 10, "sideways": 0, "weak_down": -10, "strong_downtrend": -25}
BREADTH = {"strong_breadth": 15, "neutral_breadth": 0, "weak_breadth": -15}


def _series(df: DataFrame) -> DataFrame:
    """The index as one series; as long as the calendar."""
    return market(df).withColumn("ticker", F.lit(0)).withColumn("_r", pct("close"))


def index_frame(df: DataFrame) -> DataFrame:
    """date, index close, annual volatility, trend and drawdown."""
    m = _series(df).withColumn("vol", std("_r", 20) * F.sqrt(F.lit(252.0)))
    m = m.withColumns({"_m50": mean("close", 50, 1), "_m200": mean("close", 200, 1)}).withColumn("_spread", div(F.col("_m50") - F.col("_m200"), "_m200"))
    v = F.col("vol")
    fast, slow, t = div("close", "_m50") - 1, div("close", "_m200") - 1, 0.02
    spread = F.col("_spread")
    trend = F.when((fast > t) & (slow > t) & (spread > t), "strong_uptrend").when((fast > 0) & (slow > 0), "weak_uptrend")
    trend = trend.when((fast < -t) & (slow < -t) & (spread < -t), "strong_downtrend").when((fast < 0) & (slow < 0), "weak_down").otherwise("sideways")
    return m.select(
        "date", "close", "vol",
        F.when(v < 0.15, "low_vol").when(v < 0.25, "medium_vol").when(v < 0.40, "high_vol").when(v.isNotNull(), "extreme_vol").otherwise("medium_vol").alias("volatility_regime"),
        trend.alias("trend_regime"), (F.col("close") / F.max("close").over(last_rows(None)) - 1).alias("drawdown"),
    )


def breadth(df: DataFrame) -> DataFrame:
    """Share of tickers above their own 20-row mean."""
    flags = df.withColumn("_up", (F.col("close") > mean("close", 20, 1)).cast("double"))
    out = flags.groupBy("date").agg(F.avg("_up").alias("breadth"))
    return out.withColumn("breadth_regime", F.when(F.col("breadth") >= 0.6, "strong_breadth").when(F.col("breadth") <= 0.4, "weak_breadth").otherwise("neutral_breadth"))


def composite(df: DataFrame, least_dates: int = 200) -> DataFrame:
    """One row per date: the regimes, an overall name, allow_entry and a score of 0 to 100.

    With fewer than least_dates dates, neutral values throughout.
    """
    out = index_frame(df).join(breadth(df), "date").withColumn("_n", F.lit(df.select("date").distinct().count()))
    calm = F.col("volatility_regime").isin("low_vol", "medium_vol")
    trend, wide = F.col("trend_regime"), F.col("breadth_regime")
    name = F.when(~calm, F.concat(F.lit("high_vol_"), trend)).when((trend == "strong_uptrend") & (wide == "strong_breadth"), "bull_market")
    name = name.when((trend == "strong_downtrend") | (wide == "weak_breadth"), "bear_market").otherwise(F.concat_ws("_", "volatility_regime", trend))
    entry = calm & (F.col("trend_regime") != "strong_downtrend") & (F.col("drawdown") > -0.10) & (F.col("breadth_regime") != "weak_breadth")
    points = lambda table, c: F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.col(c))
    score = 50 + points(VOLATILITY, "volatility_regime") + points(TREND, "trend_regime") + points(BREADTH, "breadth_regime") - 100 * F.abs("drawdown")
    enough = F.col("_n") >= least_dates
    return out.select(
        "date", *[F.when(enough, F.col(c)).otherwise(F.lit(d)).alias(c) for c, d in (("volatility_regime", "medium_vol"), ("trend_regime", "sideways"), ("breadth_regime", "neutral_breadth"))],
        F.when(enough, F.col("drawdown")).otherwise(0.0).alias("drawdown"), F.when(enough, name).otherwise("neutral").alias("composite_regime"),
        F.when(enough, entry).otherwise(True).alias("allow_entry"), F.when(enough, F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))).otherwise(50.0).alias("regime_score"),
    )


def summary(regimes: DataFrame) -> DataFrame:
    """Days and their share per kind and value of regime."""
    kinds = ["volatility_regime", "trend_regime", "breadth_regime", "composite_regime"]
    long = regimes.unpivot(["date", "regime_score", "drawdown"], kinds, "kind", "value")
    days = F.broadcast(regimes.agg(F.count("*").alias("_days")))
    return long.join(days).groupBy("kind", "value", "_days").agg(F.count("*").alias("days"), F.avg("regime_score").alias("avg_score"), F.min("drawdown").alias("worst_drawdown")).withColumn("share", F.col("days") / F.col("_days")).drop("_days")


def signal_filter(signals: DataFrame, regimes: DataFrame, least_score: float = 30.0) -> DataFrame:
    """Signals of dates that allow entry and reach the score."""
    ok = regimes.where(F.col("allow_entry") & (F.col("regime_score") >= least_score)).select("date")
    return signals.join(F.broadcast(ok), "date", "left_semi")


def risk_flags(df: DataFrame, allow_downtrend: bool = False, allow_high_vol: bool = False, most_vol: float = 0.04) -> DataFrame:
    m = _series(df)
    trend_ok = F.coalesce(mean("close", 50) > mean("close", 200), F.lit(False))
    vol = F.coalesce(std("_r", 20), F.lit(0.0))
    out = m.select("date", trend_ok.alias("trend_ok"), vol.alias("vol"), (vol < most_vol).alias("vol_ok"))
    return out.withColumn("allow", (F.col("trend_ok") | F.lit(allow_downtrend)) & (F.col("vol_ok") | F.lit(allow_high_vol)))


def vol_buckets(df: DataFrame) -> DataFrame:
    """Per date: bull or bear by trend_ok, and the third of its history that the index volatility is in."""
    trend_ok = F.coalesce(mean("close", 50) > mean("close", 200), F.lit(False))
    m = expanding_pct_rank(_series(df).withColumns({"_v": std("_r", 20), "_up": trend_ok}), {"_p": ("_v", 20)})
    p = F.col("_p")
    return m.select("date", F.when(F.col("_up"), "bull").otherwise("bear").alias("trend"), F.when(p <= 33, "low").when(p <= 67, "mid").when(p.isNotNull(), "high").otherwise("unknown").alias("vol"))
