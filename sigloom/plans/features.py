"""Registered queries of the feature blocks and kernels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import windows as w
from ..operators import features as f
from .base import QUERIES, SQL, beta_roll, corr_roll, ew, exp_rank, lagged, m, med, mn, mx, pc, query, roll, rounded, s, select, tot, win, xs_rank, xs_z
from .fixtures import NARRATIVE_SQL, STATEMENTS_SQL, narrative, panel, panel_sql, statements

P = panel_sql()
R = f"r AS (SELECT *, {pc('close')} AS ret FROM panel)"


def _block(name: str, fn, block: str, ctes: list[str], columns: dict[str, str], source: str, digits: int = 6) -> None:
    names = [f"{block}__{c}" for c in columns]
    QUERIES[name] = lambda spark, d: rounded(fn(panel(spark, d)), names, "date", "ticker", digits=digits)
    SQL[name] = select([P, *ctes], "date, ticker", dict(zip(names, columns.values(), strict=True)), source, digits=digits)


_block("feat_momentum", f.momentum, "momentum", [], {
    **{f"price_ret_{k}d": pc("close", k) for k in (1, 3, 5, 10, 20)}, **{f"price_mom_{k}": pc("close", k) for k in (5, 10, 20)},
    "momentum_ratio_10_30": f"{m('close', 10)} / NULLIF({m('close', 30)}, 0) - 1", "pct_from_120d_high": f"close / NULLIF({mx('close', 120, 20)}, 0) - 1",
}, "panel")
_block("feat_volatility", f.volatility, "volatility", [R, "q AS (SELECT *, CASE WHEN ret IS NOT NULL THEN LEAST(ret, 0.0) END AS neg FROM r)"], {
    "vol_5d": s("ret", 5), "price_vol_10": s("ret", 10), "price_vol_20": s("ret", 20), "downside_vol_10d": s("neg", 10), "vol_ratio_short_long": f"{s('ret', 5)} / ({s('ret', 20)} + 1e-9)",
}, "q")
_block("feat_atr", f.atr, "atr", [f"q AS (SELECT *, {lagged('close')} AS pre FROM panel)", "t AS (SELECT *, GREATEST(high - low, ABS(high - pre), ABS(low - pre)) AS tr FROM q)"], {
    "atr_14": m("tr", 14), "atr_pct_14": f"{m('tr', 14)} / NULLIF(close, 0)",
}, "t")
_block("feat_turnover", f.turnover, "turnover", [], {
    "volume_mean_20": m("volume", 20), "volume_spike": f"volume / ({m('volume', 20)} + 1e-9)", "turnover_z_20": f"(volume - {m('volume', 20)}) / ({s('volume', 20)} + 1e-9)",
    "turnover_trend_20": pc("volume", 20), "volume_ratio_5_20": f"{m('volume', 5)} / ({m('volume', 20)} + 1e-9)",
}, "panel")
_block("feat_ownership", f.ownership, "ownership", ["q AS (SELECT *, fii_hold + dii_hold AS fd FROM panel)"], {
    "fii_change_5d": pc("fii_hold", 5), "dii_change_5d": pc("dii_hold", 5), "ownership_spread": "fii_hold - dii_hold", "ownership_trend_20d": pc("fd", 20), "fii_to_dii_ratio": "fii_hold / NULLIF(dii_hold, 0)",
}, "q", 7)
_PRICE = f"CASE WHEN ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY date) >= 5 THEN {corr_roll('d', 'ret', 10, 5)} END"
_block("feat_delivery", f.delivery, "delivery", [R, "q AS (SELECT *, delivery_qty / (volume + 1e-9) AS d, delivery_qty * close AS v FROM r)"], {
    "deliv_ratio": "d", "deliv_ratio_mean_5": m("d", 5), "deliv_ratio_mean_10": m("d", 10), "deliv_ratio_mean_20": m("d", 20), "deliv_ratio_change_10": f"{m('d', 10)} - {m('d', 20)}",
    "deliv_value": "v", "deliv_value_mean_20": m("v", 20), "deliv_value_spike": f"v / ({m('v', 20)} + 1e-9)", "deliv_vs_price_corr_10": _PRICE, "deliv_vs_price_mom_10": _PRICE,
}, "q")
_SECTOR = f"q AS (SELECT *, {pc('close', 10)} AS m10, {s('ret', 20)} AS v20, {pc('close', 5)} AS r5 FROM r)"
_DS = ("date", "sector")
_block("feat_sector_relative", f.sector_relative, "sector_relative", [R, _SECTOR], {
    "sector_mom_10_z": f"COALESCE({xs_z('m10', *_DS)}, 0)", "sector_vol_20_z": f"COALESCE({xs_z('v20', *_DS)}, 0)", "sector_ret_10d_z": f"COALESCE({xs_z('m10', *_DS)}, 0)", "sector_ret_z": f"COALESCE({xs_z('r5', *_DS)}, 0)",
    "sector_rank_pct": xs_rank("r5", *_DS), "sector_rel_close": "close / (AVG(close) OVER (PARTITION BY date, sector) + 1e-9) - 1",
}, "q")
_MARKET = [
    "m0 AS (SELECT date, AVG(close) AS mc, 0 AS ticker FROM panel GROUP BY date)",
    f"m1 AS (SELECT *, {pc('mc')} AS mr, {pc('mc', 10)} AS mr10 FROM m0)",
    f"mkt AS (SELECT *, {s('mr', 20)} AS mv FROM m1)",
]
_block("feat_regime", f.regime, "regime", [*_MARKET, f"""g AS (SELECT date, mv AS a, {exp_rank('mv', 20)} AS b,
 mv / ((CASE WHEN COUNT(mv) OVER {win(None)} >= 20 THEN QUANTILE_CONT(mv, 0.5) OVER {win(None)} END) + 1e-9) AS c, {s('mr', 30)} AS e, {s('mv', 20)} AS f, {s('mr', 5)} / (mv + 1e-9) AS h FROM mkt)"""], {
    "market_vol_20d": "a", "index_vol_pct": "b", "index_vol_spike": "c", "vix_equivalent_30d": "e", "vol_of_vol_20d": "f", "vol_term_structure_5_20": "h",
}, "panel LEFT JOIN g USING (date)")
_ADAPT = [R, *_MARKET, "j AS (SELECT r.*, mkt.mr FROM r LEFT JOIN mkt USING (date))", f"k AS (SELECT *, {s('ret', 20)} AS s20, {m('volume', 20)} AS mv20 FROM j)", f"v AS (SELECT *, {exp_rank('s20')} / 100 AS vp FROM k)"]
_ALPHA = {k: f"({tot('ret', k)} - {tot('mr', k)})" for k in (5, 10, 20)}
_block("feat_regime_adaptive", f.regime_adaptive, "regime_adaptive", _ADAPT, {
    **{f"market_alpha_{k}": a for k, a in _ALPHA.items()}, **{f"market_adj_mom_{k}": f"{a} / (s20 + 1e-9)" for k, a in _ALPHA.items()},
    "beta_estimate_20d": f"{corr_roll('ret', 'mr', 20)} * s20 / ({s('mr', 20)} + 1e-9)", "regime_adj_volume": "volume / (mv20 * (1 + vp) + 1e-9)", "volume_surprise_vol_adj": "(volume / (mv20 + 1e-9) - 1) / (1 + vp)",
}, "v")
_ORTH = [R, *_MARKET, f"j AS (SELECT r.*, mkt.mr, mkt.mr10, mkt.mv, {pc('close', 10)} AS r10 FROM r LEFT JOIN mkt USING (date))".replace("PARTITION BY ticker ORDER BY date", "PARTITION BY r.ticker ORDER BY r.date"), f"k AS (SELECT *, {s('ret', 20)} AS v20 FROM j)"]
_block("feat_orthogonal", f.orthogonal, "orthogonal", _ORTH, {
    "idio_ret_10d": f"r10 - COALESCE({beta_roll('ret', 'mr', 60)}, 1) * mr10", "idio_vol_20": f"v20 - COALESCE({beta_roll('v20', 'mv', 60)}, 1) * mv",
}, "k")
_block("feat_momentum_enhanced", f.momentum_enhanced, "momentum_enhanced", [], {
    **{f"ma{n}_ratio": f"close / NULLIF({m('close', n)}, 0) - 1" for n in (5, 20, 60)}, "mom_accel": f"{pc('close', 10)} - {pc('close', 20)}", "mom_quality": f"{pc('close', 10)} * CAST(volume > {m('volume', 20)} AS DOUBLE)",
}, "panel")
_HI, _LO = mx("close", 20), mn("close", 20)
_block("feat_mean_reversion_enhanced", f.mean_reversion_enhanced, "mean_reversion_enhanced", [], {
    "dist_to_max_20d": f"close / NULLIF({_HI}, 0) - 1", "dist_to_min_20d": f"close / NULLIF({_LO}, 0) - 1", "range_position_20d": f"COALESCE((close - {_LO}) / NULLIF({_HI} - {_LO}, 0), 0.5)", "recent_extreme_ratio": f"({_HI} - close) / (close - {_LO} + 1e-9)",
}, "panel")
_block("feat_volume_enhanced", f.volume_enhanced, "volume_enhanced", [R, f"q AS (SELECT *, {pc('volume')} AS dv FROM r)"], {
    "pv_corr_10d": corr_roll("ret", "dv", 10), "pv_corr_20d": corr_roll("ret", "dv", 20), "vol_trend": f"{m('volume', 5)} / ({m('volume', 20)} + 1e-9) - 1", "vol_spike": f"(volume - {m('volume', 20)}) / ({s('volume', 20)} + 1e-9)",
}, "q")
_block("feat_ranking", f.ranking, "ranking", [R, f"q AS (SELECT *, {pc('close', 20)} AS r20, {s('ret', 20)} AS v20, {m('volume', 5)} AS m5 FROM r)"], {
    "ret_20d_rank": f"COALESCE({xs_rank('r20', 'date')}, 0.5)", "vol_20_rank": f"COALESCE({xs_rank('v20', 'date')}, 0.5)", "volume_rank": f"COALESCE({xs_rank('m5', 'date')}, 0.5)",
}, "q")
_DIFF = f"d AS (SELECT *, close - {lagged('close')} AS ch0 FROM r)"
_GAIN = "g AS (SELECT *, CASE WHEN ch0 IS NOT NULL THEN GREATEST(ch0, 0.0) END AS gain, CASE WHEN ch0 IS NOT NULL THEN GREATEST(-ch0, 0.0) END AS loss FROM d)"
_block("feat_baseline", f.baseline, "baseline", [R, _DIFF, _GAIN, f"e AS (SELECT *, {ew('close', 2 / 11)} AS e10, {ew('close', 2 / 31)} AS e30, {ew('gain', 1 / 14)} AS eg, {ew('loss', 1 / 14)} AS el FROM g)"], {
    "ema_10": "e10", "ema_30": "e30", "ret_1d": "ret", "rsi_14": "100 - 100 / (1 + eg / NULLIF(el, 0))", "vol_z": f"(volume - {m('volume', 20)}) / NULLIF({s('volume', 20)}, 0)",
}, "e")
_block("feat_technical", f.technical, "technical", [R, _DIFF, _GAIN, f"e AS (SELECT *, {ew('close', 2 / 21)} AS e20, {ew('close', 2 / 51)} AS e50, {ew('close', 2 / 13)} - {ew('close', 2 / 27)} AS macd, {ew('gain', 1 / 14)} AS eg, {ew('loss', 1 / 14)} AS el FROM g)"], {
    "ema_20": "e20", "ema_50": "e50", "macd": "macd", "macd_signal": ew("macd", 2 / 10), "boll_z": f"(close - {m('close', 20)}) / NULLIF({s('close', 20)}, 0)", "rsi_14": "100 - 100 / (1 + eg / NULLIF(el, 0))",
}, "e")
_M20, _S20 = m("close", 20), s("close", 20)
_REV = [R, _GAIN.replace("ch0", "ret").replace("FROM d", "FROM r"), f"""e AS (SELECT *, 100 - 100 / (1 + {ew('gain', 1 / 14)} / ({ew('loss', 1 / 14)} + 1e-9)) AS rsi, {m('close', 200, 50)} AS ma200, {m('close', 50, 20)} AS ma50,
 4 * {_S20} / ({_M20} + 1e-9) AS bw, (close - {_M20}) / ({_S20} + 1e-9) AS bp FROM g)""", "h AS (SELECT *, (close - ma200) / NULLIF(ma200, 0) AS d200 FROM e)"]
_block("feat_mean_reversion", f.mean_reversion, "mean_reversion", _REV, {
    "dist_from_200ma": "d200", "dist_from_50ma": "(close - ma50) / NULLIF(ma50, 0)", "price_vs_ma_ratio_50": "close / NULLIF(ma50, 0)", "price_vs_ma_ratio_200": "close / NULLIF(ma200, 0)", "bollinger_position": "bp",
    "dist_from_200ma_pct": exp_rank("d200", 50), "rsi_extreme_low": "CAST(rsi < 30 AS DOUBLE)", "rsi_extreme_high": "CAST(rsi > 70 AS DOUBLE)", "rsi_distance_from_50": "rsi - 50",
    "bollinger_squeeze": f"bw / ({med('bw', 60, 20)} + 1e-9)", "oversold_signal": "CAST(d200 < -0.1 AS DOUBLE) * CAST(rsi < 35 AS DOUBLE) * CAST(bp < -1.5 AS DOUBLE)",
}, "h")

_NW = "(PARTITION BY ticker ORDER BY date, event_id"


@query("feat_narrative", f"""WITH {NARRATIVE_SQL}, q AS (SELECT *, AVG(sentiment) OVER {_NW} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS sm FROM narrative)
 SELECT ticker, event_id, ROUND(sm, 6) + 0.0 AS narrative__sentiment_mean, ROUND(sm - LAG(sm) OVER {_NW}), 6) + 0.0 AS narrative__sentiment_change FROM q""")
def _narrative(spark, d):
    return rounded(f.narrative(narrative(spark, d)), ["narrative__sentiment_mean", "narrative__sentiment_change"], "ticker", "event_id")


# Kernels


def _kernel(name: str, columns: dict, sql: dict[str, str], ctes: list[str] = (), source: str = "panel", prepare=lambda df: df, digits: int = 6) -> None:
    QUERIES[name] = lambda spark, d: rounded(prepare(panel(spark, d)).withColumns({k: v() for k, v in columns.items()}), list(columns), "date", "ticker", digits=digits)
    SQL[name] = select([P, *ctes], "date, ticker", sql, source, digits=digits)


_kernel("ts_lag_return", {"pct_1": lambda: w.pct("close"), "pct_5": lambda: w.pct("close", 5), "diff_1": lambda: F.col("close") - w.lag("close")}, {"pct_1": pc("close"), "pct_5": pc("close", 5), "diff_1": f"close - {lagged('close')}"})
_kernel("ts_forward_return", {"fwd_10": lambda: w.div(w.lead("close", 10), "close") - 1}, {"fwd_10": "LEAD(close, 10) OVER (PARTITION BY ticker ORDER BY date) / NULLIF(close, 0) - 1"})
_kernel(
    "ts_rolling_stats",
    {"mean_10": lambda: w.mean("close", 10), "std_10": lambda: w.std("close", 10), "max_10": lambda: w.high("close", 10), "min_10": lambda: w.low("close", 10), "sum_10": lambda: w.total("volume", 10), "var_10": lambda: w.rolling(F.var_samp, "close", 10)},
    {"mean_10": m("close", 10), "std_10": s("close", 10), "max_10": mx("close", 10), "min_10": mn("close", 10), "sum_10": tot("volume", 10), "var_10": roll("VAR_SAMP", "close", 10)},
)
_kernel("ts_rolling_median", {"median_60": lambda: w.median("close", 60, 20)}, {"median_60": med("close", 60, 20)})
_kernel("ts_rolling_corr", {"corr_20": lambda: w.rolling_corr("_r", "volume", 20)}, {"corr_20": corr_roll("ret", "volume", 20)}, [R], "r", f.returns)
_kernel("ts_rolling_cov_beta", {"beta_60": lambda: w.beta("_r", "volume", 60)}, {"beta_60": beta_roll("ret", "volume", 60)}, [R], "r", f.returns)
_kernel("ts_expanding", {"max_so_far": lambda: F.max("close").over(w.last_rows(None)), "median_so_far": lambda: F.percentile("close", F.lit(0.5)).over(w.last_rows(None))}, {"max_so_far": f"MAX(close) OVER {win(None)}", "median_so_far": f"QUANTILE_CONT(close, 0.5) OVER {win(None)}"})
_kernel("ts_expanding_pct_rank", {"pct_rank": lambda: F.col("pct_rank")}, {"pct_rank": exp_rank("close")}, prepare=lambda df: w.expanding_pct_rank(df, {"pct_rank": ("close", 1)}))
_kernel("ts_linear_trend", {"slope_4": lambda: w.trend("close", 4)}, {"slope_4": f"CASE WHEN COUNT(close) OVER {win(4)} >= 4 THEN REGR_SLOPE(close, i) OVER {win(4)} END"}, ["q AS (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY date) AS DOUBLE) AS i FROM panel)"], "q", digits=3)
_kernel("ts_ffill", {"ffill": lambda: F.last("_x", ignorenulls=True).over(w.last_rows(None)), "bfill": lambda: F.first("_x", ignorenulls=True).over(w.by_ticker().rowsBetween(0, Window.unboundedFollowing))},
        {"ffill": f"LAST_VALUE(x IGNORE NULLS) OVER {win(None)}", "bfill": "FIRST_VALUE(x IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"},
        ["q AS (SELECT *, CASE WHEN volume > 30 THEN close END AS x FROM panel)"], "q", lambda df: df.withColumn("_x", F.when(F.col("volume") > 30, F.col("close"))))
_kernel("ts_cumprod", {"growth": lambda: F.product(1 + F.coalesce("_r", F.lit(0.0)) / 100).over(w.last_rows(None)), "peak": lambda: F.max("close").over(w.last_rows(None))}, {"growth": f"PRODUCT(1 + COALESCE(ret, 0) / 100) OVER {win(None)}", "peak": f"MAX(close) OVER {win(None)}"}, [R], "r", f.returns)
_kernel("xs_zscore", {"z": lambda: w.xs_zscore("close", "date", "sector")}, {"z": xs_z("close", *_DS)})
_kernel("xs_pct_rank", {"rank": lambda: w.xs_pct_rank("volume", "date")}, {"rank": xs_rank("volume", "date")})
_kernel("xs_relative_mean", {"rel": lambda: w.xs_relative_mean("close", "date", "sector")}, {"rel": "close / NULLIF(AVG(close) OVER (PARTITION BY date, sector), 0) - 1"})


@query("ts_ewm", select([P], "date, ticker", {"ema_20": ew("close", 2 / 21)}, "panel"))
def _ewm(spark, d):
    return rounded(w.ewm(panel(spark, d), {"ema_20": ("close", 2 / 21)}), ["ema_20"], "date", "ticker")


@query("build_features", select([P, R, f"q AS (SELECT *, {pc('close', 10)} AS m10, {s('ret', 20)} AS v20, {pc('close', 20)} AS r20 FROM r)"], "date, ticker", {
    "momentum__price_ret_10d": "COALESCE(m10, 0)", "volatility__price_vol_20": "COALESCE(v20, 0)", "turnover__volume_mean_20": f"COALESCE({m('volume', 20)}, 0)",
    "sector_relative__sector_mom_10_z": f"COALESCE({xs_z('m10', *_DS)}, 0)", "ranking__ret_20d_rank": f"COALESCE({xs_rank('r20', 'date')}, 0.5)"}, "q"))
def _build(spark, d):
    """All default blocks in one plan; some columns of several blocks are compared."""
    out = f.build_features(panel(spark, d))
    return rounded(out, ["momentum__price_ret_10d", "volatility__price_vol_20", "turnover__volume_mean_20", "sector_relative__sector_mom_10_z", "ranking__ret_20d_rank"], "date", "ticker")


_ST = [P, STATEMENTS_SQL,
       "st0 AS (SELECT *, CASE WHEN equity > 0 THEN 4 * net_income / equity END AS roe, CASE WHEN revenue > 0 THEN net_income / revenue END AS net_margin, CASE WHEN equity > 0 THEN debt / equity END AS dte, CASE WHEN assets > 0 THEN (net_income - operating_cf) / assets END AS accruals FROM statements)",
       f"st1 AS (SELECT ticker, CAST(date + INTERVAL 45 DAY AS DATE) AS out_, roe, dte, accruals, {xs_z('net_margin', *_DS)} AS margin_z, {xs_rank('roe', *_DS)} AS roe_rank, {pc('revenue', 4)} AS growth FROM st0)",
       "fb AS (SELECT panel.date, panel.ticker, roe, dte, accruals, margin_z, roe_rank, growth FROM panel ASOF LEFT JOIN st1 ON panel.ticker = st1.ticker AND panel.date >= st1.out_)"]
_FUND = {"roe": "roe", "debt_to_equity": "dte", "accruals": "accruals", "net_margin_sector_z": "margin_z", "roe_sector_rank": "roe_rank", "revenue_growth": "growth"}


@query("feat_fundamental", select(_ST, "date, ticker", {f"fundamental__{k}": v for k, v in _FUND.items()}, "fb"))
def _fundamental(spark, d):
    """Statements joined as of each bar's date by the block registry."""
    out = f.build_features(panel(spark, d), ("fundamental",), fill=False, tables={"statements": statements(spark, d)})
    return rounded(out, [f"fundamental__{k}" for k in _FUND], "date", "ticker")


@query("build_features_with_statements", select([*_ST, R, f"q AS (SELECT date, ticker, {pc('close', 10)} AS m10 FROM r)"], "date, ticker", {"momentum__price_ret_10d": "COALESCE(m10, 0)", "fundamental__roe": "COALESCE(roe, 0)", "fundamental__revenue_growth": "COALESCE(growth, 0)"}, "fb JOIN q USING (date, ticker)"))
def _build_with_statements(spark, d):
    """All default blocks and the fundamental one in one plan."""
    out = f.build_features(panel(spark, d), tables={"statements": statements(spark, d)})
    return rounded(out, ["momentum__price_ret_10d", "fundamental__roe", "fundamental__revenue_growth"], "date", "ticker")


@query("sanitize_features", select([P, R], "date, ticker", {"x": "COALESCE(ret, 0)", "y": "COALESCE(1 / NULLIF(fii_hold, 0), 0)"}, "r"))
def _sanitize(spark, d):
    df = f.returns(panel(spark, d)).withColumns({"x": F.col("_r"), "y": w.div(F.lit(1.0), "fii_hold")})
    return rounded(f.sanitize(df, ["x", "y"]), ["x", "y"], "date", "ticker")
