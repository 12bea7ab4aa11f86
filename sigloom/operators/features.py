"""Feature blocks: DataFrame in, the same rows with columns `block__name` added.

A block is left out where its inputs are missing. Missing values stay NULL until sanitize() fills them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import EPS, beta, col, div, ewm, expanding_pct_rank, high, in_order, lag, last_rows, low, mean, median, pct, rolling_corr, std, total, xs_pct_rank, xs_zscore
from . import fundamentals

BAR = ("open", "high", "low", "close", "volume")


def named(df: DataFrame, block: str, **columns) -> DataFrame:
    return df.withColumns({f"{block}__{k}": v for k, v in columns.items()})


def returns(df: DataFrame) -> DataFrame:
    """Adds _r, the one-row return, once for all blocks that need it."""
    return df if "_r" in df.columns else df.withColumn("_r", pct("close"))


def momentum(df: DataFrame) -> DataFrame:
    out = named(df, "momentum", **{f"price_ret_{k}d": pct("close", k) for k in (1, 3, 5, 10, 20)}, **{f"price_mom_{k}": pct("close", k) for k in (5, 10, 20)})
    return named(out, "momentum", momentum_ratio_10_30=div(mean("close", 10), mean("close", 30)) - 1, pct_from_120d_high=div("close", high("close", 120, 20)) - 1)


def volatility(df: DataFrame) -> DataFrame:
    out = returns(df)
    short, long = std("_r", 5), std("_r", 20)
    return named(out, "volatility", vol_5d=short, price_vol_10=std("_r", 10), price_vol_20=long, downside_vol_10d=std(F.when(col("_r").isNotNull(), F.least("_r", F.lit(0.0))), 10), vol_ratio_short_long=short / (long + EPS))


def atr(df: DataFrame) -> DataFrame:
    before = lag("close")
    out = df.withColumn("_tr", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))
    out = named(out, "atr", atr_14=mean("_tr", 14))
    return named(out, "atr", atr_pct_14=div("atr__atr_14", "close")).drop("_tr")


def turnover(df: DataFrame) -> DataFrame:
    v, m20, s20 = F.col("volume"), mean("volume", 20), std("volume", 20)
    return named(df, "turnover", volume_mean_20=m20, volume_spike=v / (m20 + EPS), turnover_z_20=(v - m20) / (s20 + EPS), turnover_trend_20=pct("volume", 20), volume_ratio_5_20=mean("volume", 5) / (m20 + EPS))


def ownership(df: DataFrame) -> DataFrame:
    fii, dii = F.col("fii_hold"), F.col("dii_hold")
    return named(df, "ownership", fii_change_5d=pct(fii, 5), dii_change_5d=pct(dii, 5), ownership_spread=fii - dii, ownership_trend_20d=pct(fii + dii, 20), fii_to_dii_ratio=div(fii, dii))


def delivery(df: DataFrame) -> DataFrame:
    out = returns(df)
    given = "delivery_ratio" in df.columns
    ratio = F.col("delivery_ratio") if given else F.col("delivery_qty") / (F.col("volume") + EPS)
    out = out.withColumn("_d", ratio).withColumn("_value", (F.col("delivery_qty") if "delivery_qty" in df.columns else F.col("_d") * F.col("volume")) * F.col("close"))
    with_price = F.when(F.row_number().over(last_rows(None)) >= 5, rolling_corr("_d", "_r", 10, 5))
    out = named(
        out, "delivery", deliv_ratio=F.col("_d"), deliv_ratio_mean_5=mean("_d", 5), deliv_ratio_mean_10=mean("_d", 10), deliv_ratio_mean_20=mean("_d", 20), deliv_ratio_change_10=mean("_d", 10) - mean("_d", 20),
        deliv_value=F.col("_value"), deliv_value_mean_20=mean("_value", 20), deliv_value_spike=F.col("_value") / (mean("_value", 20) + EPS), deliv_vs_price_corr_10=with_price, deliv_vs_price_mom_10=with_price,
    )
    if given:
        out = named(out, "delivery", delivery_z=(F.col("_d") - mean("_d", 20)) / (std("_d", 20) + EPS), delivery_spike=F.col("_d") / (mean("_d", 20) + EPS), delivery_trend_5d=pct("_d", 5), delivery_ratio_5_20=mean("_d", 5) / (mean("_d", 20) + EPS))
    return out.drop("_d", "_value")


def narrative(df: DataFrame) -> DataFrame:
    """Over rows (ticker, date, event_id, sentiment)."""
    w = Window.partitionBy("ticker").orderBy("date", "event_id")
    out = named(df, "narrative", sentiment_mean=F.avg("sentiment").over(w.rowsBetween(-4, 0)))
    return named(out, "narrative", sentiment_change=F.col("narrative__sentiment_mean") - F.lag("narrative__sentiment_mean").over(w))


def _sector_inputs(df: DataFrame) -> DataFrame:
    return returns(df).withColumns({"_m10": pct("close", 10), "_v20": std("_r", 20), "_r5": pct("close", 5)})


def _sector_relative(df: DataFrame) -> DataFrame:
    keys = ("date", "sector")
    z = {"sector_mom_10_z": "_m10", "sector_vol_20_z": "_v20", "sector_ret_10d_z": "_m10", "sector_ret_z": "_r5"}
    out = named(df, "sector_relative", **{k: F.coalesce(xs_zscore(v, *keys), F.lit(0.0)) for k, v in z.items()})
    close = F.avg("close").over(Window.partitionBy(*keys))
    return named(out, "sector_relative", sector_rank_pct=xs_pct_rank("_r5", *keys), sector_rel_close=F.col("close") / (close + EPS) - 1)


def sector_relative(df: DataFrame) -> DataFrame:
    return _sector_relative(_sector_inputs(df)).drop("_m10", "_v20", "_r5")


def market(df: DataFrame) -> DataFrame:
    """Equal-weight mean close per date, as one series."""
    return df.groupBy("date").agg(F.avg("close").alias("close"))


def market_frame(df: DataFrame) -> DataFrame:
    """Market close, return and volatilities per date; the series is as long as the calendar."""
    m = market(df).withColumn("ticker", F.lit(0))
    m = m.withColumn("mkt_r", pct("close")).withColumn("mkt_vol_20", std("mkt_r", 20))
    return m.drop("ticker").withColumnRenamed("close", "mkt_close")


def regime(df: DataFrame, bars: DataFrame | None = None) -> DataFrame:
    """Market-wide columns, joined to each row by date; the market is that of `bars`, or of the rows."""
    m = market_frame(bars or df).withColumn("ticker", F.lit(0))
    w = last_rows(None)
    vol = F.col("mkt_vol_20")
    m = m.withColumns({
        "regime__market_vol_20d": vol,
        "regime__index_vol_spike": vol / (F.when(F.count(vol).over(w) >= 20, F.percentile(vol, F.lit(0.5)).over(w)) + EPS),
        "regime__vix_equivalent_30d": std("mkt_r", 30),
        "regime__vol_of_vol_20d": std("mkt_vol_20", 20),
        "regime__vol_term_structure_5_20": std("mkt_r", 5) / (vol + EPS),
    })
    m = expanding_pct_rank(m, {"regime__index_vol_pct": ("mkt_vol_20", 20)})
    names = ["market_vol_20d", "index_vol_pct", "index_vol_spike", "vix_equivalent_30d", "vol_of_vol_20d", "vol_term_structure_5_20"]
    return df.join(F.broadcast(m.select("date", *[f"regime__{n}" for n in names])), "date", "left")  # one row per date


def regime_adaptive(df: DataFrame, bars: DataFrame | None = None) -> DataFrame:
    out = returns(df).join(F.broadcast(market_frame(bars or df).select("date", "mkt_r")), "date", "left")
    s20, m20 = std("_r", 20), std("mkt_r", 20)
    cols = {}
    for k in (5, 10, 20):
        cols[f"market_alpha_{k}"] = total("_r", k) - total("mkt_r", k)
    out = named(out, "regime_adaptive", **cols)
    out = named(out, "regime_adaptive", **{f"market_adj_mom_{k}": F.col(f"regime_adaptive__market_alpha_{k}") / (s20 + EPS) for k in (5, 10, 20)}, beta_estimate_20d=rolling_corr("_r", "mkt_r", 20) * s20 / (m20 + EPS))
    out = expanding_pct_rank(out.withColumn("_s20", s20), {"_volpct": ("_s20", 1)}).withColumn("_volpct", F.col("_volpct") / 100)
    v = F.col("volume")
    return named(out, "regime_adaptive", regime_adj_volume=v / (mean("volume", 20) * (1 + F.col("_volpct")) + EPS), volume_surprise_vol_adj=(v / (mean("volume", 20) + EPS) - 1) / (1 + F.col("_volpct"))).drop("mkt_r", "_s20", "_volpct")


def orthogonal(df: DataFrame, bars: DataFrame | None = None) -> DataFrame:
    m = market_frame(bars or df).withColumn("ticker", F.lit(0)).withColumn("mkt_r10", pct("mkt_close", 10)).select("date", "mkt_r", "mkt_r10", "mkt_vol_20")
    out = returns(df).join(F.broadcast(m), "date", "left").withColumns({"_r10": pct("close", 10), "_v20": std("_r", 20)})
    b, bv = F.coalesce(beta("_r", "mkt_r", 60), F.lit(1.0)), F.coalesce(beta("_v20", "mkt_vol_20", 60), F.lit(1.0))
    return named(out, "orthogonal", idio_ret_10d=F.col("_r10") - b * F.col("mkt_r10"), idio_vol_20=F.col("_v20") - bv * F.col("mkt_vol_20")).drop("mkt_r", "mkt_r10", "mkt_vol_20", "_r10", "_v20")


def momentum_enhanced(df: DataFrame) -> DataFrame:
    c = F.col("close")
    r10, r20 = pct("close", 10), pct("close", 20)
    busy = (F.col("volume") > mean("volume", 20)).cast("double")
    return named(df, "momentum_enhanced", **{f"ma{n}_ratio": div(c, mean("close", n)) - 1 for n in (5, 20, 60)}, mom_accel=r10 - r20, mom_quality=r10 * busy)


def mean_reversion_enhanced(df: DataFrame) -> DataFrame:
    c, hi, lo = F.col("close"), high("close", 20), low("close", 20)
    at = F.coalesce(div(c - lo, hi - lo), F.lit(0.5))
    return named(df, "mean_reversion_enhanced", dist_to_max_20d=div(c, hi) - 1, dist_to_min_20d=div(c, lo) - 1, range_position_20d=at, recent_extreme_ratio=div(hi - c, c - lo + EPS))


def volume_enhanced(df: DataFrame) -> DataFrame:
    out = returns(df).withColumn("_dv", pct("volume"))
    v, m20 = F.col("volume"), mean("volume", 20)
    return named(out, "volume_enhanced", pv_corr_10d=rolling_corr("_r", "_dv", 10), pv_corr_20d=rolling_corr("_r", "_dv", 20), vol_trend=mean("volume", 5) / (m20 + EPS) - 1, vol_spike=(v - m20) / (std("volume", 20) + EPS)).drop("_dv")


def _rank_inputs(df: DataFrame) -> DataFrame:
    return returns(df).withColumns({"_r20": pct("close", 20), "_v20": std("_r", 20), "_m5": mean("volume", 5)})


def _ranking(df: DataFrame) -> DataFrame:
    half = F.lit(0.5)
    return named(df, "ranking", ret_20d_rank=F.coalesce(xs_pct_rank("_r20", "date"), half), vol_20_rank=F.coalesce(xs_pct_rank("_v20", "date"), half), volume_rank=F.coalesce(xs_pct_rank("_m5", "date"), half))


def ranking(df: DataFrame) -> DataFrame:
    return _ranking(_rank_inputs(df)).drop("_r20", "_v20", "_m5")


def _rsi_parts(df: DataFrame, change, gain: str = "_gain", loss: str = "_loss") -> DataFrame:
    out = df.withColumn("_change", change)
    return out.withColumns({gain: F.when(col("_change").isNotNull(), F.greatest("_change", F.lit(0.0))), loss: F.when(col("_change").isNotNull(), F.greatest(-F.col("_change"), F.lit(0.0)))}).drop("_change")


def baseline(df: DataFrame) -> DataFrame:
    """The block that stands in when no other fires."""
    out = _rsi_parts(returns(df), F.col("close") - lag("close"))
    out = ewm(out, {"baseline__ema_10": ("close", 2 / 11), "baseline__ema_30": ("close", 2 / 31), "_g": ("_gain", 1 / 14), "_l": ("_loss", 1 / 14)})
    v = F.col("volume")
    return named(out, "baseline", ret_1d=F.col("_r"), rsi_14=100 - 100 / (1 + div("_g", "_l")), vol_z=div(v - mean("volume", 20), std("volume", 20))).drop("_gain", "_loss", "_g", "_l")


def _gain(x: str) -> Callable:
    return lambda values: np.maximum(values(x), 0.0)


def _loss(x: str) -> Callable:
    return lambda values: np.maximum(-values(x), 0.0)


def _technical_inputs(df: DataFrame) -> DataFrame:
    return df.withColumn("_change", F.col("close") - lag("close"))


#: Exponential averages of the prices, the signal line of two of them too.
_TECHNICAL = {"technical__ema_20": ("close", 2 / 21), "technical__ema_50": ("close", 2 / 51), "_e12": ("close", 2 / 13), "_e26": ("close", 2 / 27), "_g": (_gain("_change"), 1 / 14), "_l": (_loss("_change"), 1 / 14), "technical__macd_signal": (("_e12", "_e26"), 2 / 10)}


def _technical_rest(df: DataFrame) -> DataFrame:
    z = div(F.col("close") - mean("close", 20), std("close", 20))
    return named(df, "technical", macd=F.col("_e12") - F.col("_e26"), boll_z=z, rsi_14=100 - 100 / (1 + div("_g", "_l"))).drop("_e12", "_e26", "_g", "_l")


def technical(df: DataFrame) -> DataFrame:
    return ordered(df, ("technical",))


def _mean_reversion_inputs(df: DataFrame) -> DataFrame:
    return df.withColumn("_step", pct("close"))


def _from_200(values: Callable) -> np.ndarray:
    """The close's distance from the mean of 200 rows, missing where that is zero, as div() has it."""
    ma200 = values("_ma200")
    with np.errstate(all="ignore"):
        return np.where(ma200 == 0, np.nan, (values("close") - ma200) / ma200)


#: The mean of 200 rows is made in the pass too: over a window, each row would add up 200.
_MEAN_REVERSION_MEANS = {"_ma200": ("close", 200, 50)}
_MEAN_REVERSION = {"_u": (_gain("_step"), 1 / 14), "_w": (_loss("_step"), 1 / 14)}
_MEAN_REVERSION_RANKS = {"_from_200_pct": (_from_200, 50)}


def _mean_reversion_rest(df: DataFrame) -> DataFrame:
    c, ma200, ma50 = F.col("close"), F.col("_ma200"), mean("close", 50, 20)
    m20, s20 = mean("close", 20), std("close", 20)
    out = df.withColumn("_rsi", 100 - 100 / (1 + F.col("_u") / (F.col("_w") + EPS))).withColumn("_bw", 4 * s20 / (m20 + EPS))
    out = named(out, "mean_reversion", dist_from_200ma=div(c - ma200, ma200), dist_from_200ma_pct=F.col("_from_200_pct"), dist_from_50ma=div(c - ma50, ma50), price_vs_ma_ratio_50=div(c, ma50), price_vs_ma_ratio_200=div(c, ma200), bollinger_position=(c - m20) / (s20 + EPS))
    d, rsi, b = (F.col(x) for x in ("mean_reversion__dist_from_200ma", "_rsi", "mean_reversion__bollinger_position"))
    flag = lambda c: c.cast("double")
    return named(
        out, "mean_reversion", rsi_extreme_low=flag(rsi < 30), rsi_extreme_high=flag(rsi > 70), rsi_distance_from_50=rsi - 50,
        bollinger_squeeze=F.col("_bw") / (median("_bw", 60, 20) + EPS), oversold_signal=flag(d < -0.1) * flag(rsi < 35) * flag(b < -1.5),
    ).drop("_u", "_w", "_rsi", "_bw", "_ma200", "_from_200_pct")


def mean_reversion(df: DataFrame) -> DataFrame:
    return ordered(df, ("mean_reversion",))


#: blocks with a pass in Python: block -> (its inputs, means, averages, ranks, inputs used up by the pass, what follows);
#: the pass that adds the fewest columns comes first
IN_ORDER = {
    "mean_reversion": (_mean_reversion_inputs, _MEAN_REVERSION_MEANS, _MEAN_REVERSION, _MEAN_REVERSION_RANKS, ("_step",), _mean_reversion_rest),
    "technical": (_technical_inputs, {}, _TECHNICAL, {}, ("_change",), _technical_rest),
}


def ordered(df: DataFrame, blocks: tuple[str, ...]) -> DataFrame:
    """Blocks of IN_ORDER: the windows that their passes need, the passes in Python, then the windows that follow, so that
    rows are exchanged by ticker once before the passes and once after them."""
    steps = [IN_ORDER[b] for b in blocks]
    out = df
    for inputs, *_ in steps:
        out = inputs(out)
    for _, means, averages, ranks, used, _ in steps:
        out = in_order(out, averages, ranks, means=means, used=used)
    for *_, rest in steps:
        out = rest(out)
    return out


def fundamental(df: DataFrame, statements: DataFrame) -> DataFrame:
    """The second input is joined as of each row's date; see fundamentals.block."""
    return fundamentals.block(df, statements)


#: cross sections: block -> (its inputs, which are windows per ticker, and what is over dates); the wider key first, whose exchange serves the other
CROSS = {"ranking": (_rank_inputs, _ranking), "sector_relative": (_sector_inputs, _sector_relative)}
#: block -> (function, columns it needs)
BLOCKS: dict[str, tuple[Callable[[DataFrame], DataFrame], tuple[str, ...]]] = {
    "technical": (technical, ("close",)),
    "mean_reversion": (mean_reversion, ("close",)),
    "fundamental": (fundamental, ("ticker", "date")),
    "momentum": (momentum, ("close",)),
    "volatility": (volatility, ("close",)),
    "atr": (atr, ("high", "low", "close")),
    "turnover": (turnover, ("volume",)),
    "ownership": (ownership, ("fii_hold", "dii_hold")),
    "delivery": (delivery, ("delivery_qty", "volume", "close")),
    "orthogonal": (orthogonal, ("close",)),
    "momentum_enhanced": (momentum_enhanced, ("close", "volume")),
    "mean_reversion_enhanced": (mean_reversion_enhanced, ("close",)),
    "volume_enhanced": (volume_enhanced, ("close", "volume")),
    "sector_relative": (sector_relative, ("close", "sector")),
    "ranking": (ranking, ("close", "volume")),
    "regime": (regime, ("close",)),
    "regime_adaptive": (regime_adaptive, ("close", "volume")),
}
OF_MARKET = ("orthogonal", "regime", "regime_adaptive")
#: blocks with a table of their own beside the bars, which fire only if it is given: block -> name in build_features' tables
OF_TABLE = {"fundamental": "statements"}
DEFAULT = tuple(b for b in BLOCKS if not b.startswith("regime"))


def sanitize(df: DataFrame, columns: list[str]) -> DataFrame:
    """NaN, infinities and NULL become 0."""
    def clean(c: str):
        x = F.col(f"`{c}`").cast("double")
        return F.when(F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(F.coalesce(x, F.lit(0.0)))

    return df.withColumns({c: clean(c) for c in columns})


def build_features(df: DataFrame, blocks: tuple[str, ...] = DEFAULT, fill: bool = True, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """Key columns and all columns of the blocks whose inputs are there; baseline if none is.

    tables: further inputs, such as statements (ticker, date, sector, measures) for the fundamental block. The blocks with
    a pass in Python come first, while rows are narrow; windows per ticker come next, those that the cross sections need
    too, and cross sections last, so rows are exchanged by ticker and then once by date.
    """
    keys = [c for c in df.columns]
    given = tables or {}
    fired = [b for b, (_, needs) in BLOCKS.items() if b in blocks and (given.get(OF_TABLE[b]) is not None if b in OF_TABLE else all(c in df.columns for c in needs))]
    in_python, across = (tuple(b for b in part if b in fired) for part in (IN_ORDER, CROSS))
    out = ordered(df, in_python) if in_python else df
    for name in fired:
        if name not in in_python and name not in across:
            others = [given[OF_TABLE[name]]] if name in OF_TABLE else [df] if name in OF_MARKET else []  # the market comes from the bars alone
            out = BLOCKS[name][0](out, *others)
    for step in (0, 1):
        for name in across:
            out = CROSS[name][step](out)
    if not fired:
        out = baseline(out)
    place = {b: i for i, b in enumerate(BLOCKS)}
    made = sorted((c for c in out.columns if "__" in c and c not in keys), key=lambda c: place.get(c.split("__")[0], -1))
    out = out.select(*keys, *made)
    return sanitize(out, made) if fill else out
