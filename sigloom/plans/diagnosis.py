"""Registered queries of fundamentals, diagnostics, drift and leakage checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.windows import mean, pct, std, xs_pct_rank
from ..operators import diagnostics as dg
from ..operators import fundamentals as fu
from ..operators import labels as lab
from ..operators import regimes as reg
from ..operators import splits as sp
from ..streaming import daily, drift
from ..tables import once, scratch, written
from .base import corr_agg, lagged, m, pc, query, rounded, s, select, win, xs_rank, xs_z
from .core import BUCKETS, FLAGS, LABEL_CTES, P, PREDS, preds
from .evaluation import FOLDS
from .fixtures import FUNDAMENTALS_SQL, fundamentals, panel

# Fundamentals: the quarterly figures as statements; assets and equity stand in from what there is.

Q = [FUNDAMENTALS_SQL, "q AS (SELECT symbol AS ticker, report_date AS date, sector, revenue, net_income, eps, revenue * 3 AS assets, revenue * 2 - net_income AS equity, net_income * 0.8 + n_orders AS operating_cf, revenue - net_income AS debt, n_orders FROM fundamentals)"]
METRICS = ["fm AS (SELECT *, CASE WHEN equity > 0 THEN 4 * net_income / equity END AS roe, CASE WHEN assets > 0 THEN 4 * net_income / assets END AS roa, CASE WHEN revenue > 0 THEN net_income / revenue END AS net_margin, CASE WHEN equity > 0 THEN debt / equity END AS debt_to_equity, CASE WHEN debt > 0 THEN n_orders * 1000.0 / debt END AS cash_to_debt, CASE WHEN net_income > 0 THEN operating_cf / net_income END AS cf_to_ni, CASE WHEN assets > 0 THEN (net_income - operating_cf) / assets END AS accruals FROM q)"]
KEY = "date, ticker"
DS = ("date", "sector")


def statements(spark, d):
    q = fundamentals(spark, d).select(F.col("symbol").alias("ticker"), F.col("report_date").alias("date"), "sector", "revenue", "net_income", "eps", "n_orders")
    q = q.withColumns({"assets": F.col("revenue") * 3, "equity": F.col("revenue") * 2 - F.col("net_income"), "operating_cf": F.col("net_income") * 0.8 + F.col("n_orders"), "debt": F.col("revenue") - F.col("net_income"), "cash": F.col("n_orders") * 1000.0})
    return fu.metrics(q)


_FM = ["roe", "roa", "net_margin", "debt_to_equity", "cash_to_debt", "cf_to_ni", "accruals"]


@query("fund_metrics", select([*Q, *METRICS], KEY, {c: c for c in _FM}, "fm"))
def _(spark, d):
    return rounded(statements(spark, d), _FM, "date", "ticker")


_VAL = [*Q, "v AS (SELECT *, CASE WHEN eps > 0 THEN revenue / eps END AS pe, CASE WHEN revenue > 0 THEN eps / revenue END AS pb FROM q)"]


@query("fund_valuation", select(_VAL, KEY, {"fundamental__pe_ratio_sector_z": xs_z("pe", *DS), "fundamental__pe_ratio_sector_rank": xs_rank("pe", *DS), "fundamental__pe_ratio_sector_rel": "pe / NULLIF(AVG(pe) OVER (PARTITION BY date, sector), 0) - 1", "fundamental__value_composite": f"(-({xs_z('pe', *DS)}) - ({xs_z('pb', *DS)})) / 2"}, "v"))
def _(spark, d):
    df = statements(spark, d).withColumns({"pe_ratio": fu.ratio("revenue", "eps"), "pb_ratio": fu.ratio("eps", "revenue")})
    return rounded(fu.valuation(df), ["fundamental__pe_ratio_sector_z", "fundamental__pe_ratio_sector_rank", "fundamental__pe_ratio_sector_rel", "fundamental__value_composite"], "date", "ticker")


_I = "pr0 AS (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY date) AS DOUBLE) AS i FROM fm)"


@query("fund_profitability", select([*Q, *METRICS, _I], KEY, {"fundamental__roe_sector_z": xs_z("roe", *DS), "fundamental__roe_sector_rank": xs_rank("roe", *DS), "fundamental__roe_trend_4q": f"CASE WHEN COUNT(roe) OVER {win(4)} >= 4 THEN REGR_SLOPE(roe, i) OVER {win(4)} END", "fundamental__margin_expansion_4q": f"net_margin - {lagged('net_margin', 4)}", "fundamental__profitability_composite": f"({xs_z('roe', *DS)} + {xs_z('net_margin', *DS)}) / 2"}, "pr0"))
def _(spark, d):
    return rounded(fu.profitability(statements(spark, d)), ["fundamental__roe_sector_z", "fundamental__roe_sector_rank", "fundamental__roe_trend_4q", "fundamental__margin_expansion_4q", "fundamental__profitability_composite"], "date", "ticker")


_G = [*Q, f"g AS (SELECT *, {pc('revenue', 4)} AS rg FROM q)"]


@query("fund_growth", select(_G, KEY, {"fundamental__revenue_growth": "rg", "fundamental__eps_growth": pc("eps", 4), "fundamental__revenue_growth_acceleration": f"rg - {lagged('rg')}", "fundamental__revenue_growth_stability": s("rg", 8), "fundamental__revenue_growth_sector_z": xs_z("rg", *DS)}, "g"))
def _(spark, d):
    return rounded(fu.growth(statements(spark, d)), ["fundamental__revenue_growth", "fundamental__eps_growth", "fundamental__revenue_growth_acceleration", "fundamental__revenue_growth_stability", "fundamental__revenue_growth_sector_z"], "date", "ticker")


@query("fund_balance_sheet", select([*Q, *METRICS], KEY, {"fundamental__debt_to_equity_sector_z": xs_z("debt_to_equity", *DS), "fundamental__cash_to_debt_sector_z": xs_z("cash_to_debt", *DS)}, "fm"))
def _(spark, d):
    return rounded(fu.balance_sheet(statements(spark, d)), ["fundamental__debt_to_equity_sector_z", "fundamental__cash_to_debt_sector_z"], "date", "ticker")


@query("fund_quality", select([*Q, *METRICS], KEY, {"fundamental__accruals": "accruals", "fundamental__quality_score": f"-({xs_z('accruals', *DS)})"}, "fm"))
def _(spark, d):
    return rounded(fu.quality(statements(spark, d)), ["fundamental__accruals", "fundamental__quality_score"], "date", "ticker")


@query("fund_sector_relative", select(Q, KEY, {"a": "eps / NULLIF(AVG(eps) OVER (PARTITION BY date, sector), 0) - 1", "b": xs_z("eps", *DS), "c": xs_rank("eps", *DS)}, "q"))
def _(spark, d):
    out = statements(spark, d).withColumns({"a": fu.sector_relative("eps", "relative_mean"), "b": fu.sector_relative("eps", "zscore"), "c": fu.sector_relative("eps", "rank_pct")})
    return rounded(out, ["a", "b", "c"], "date", "ticker")


# Diagnostics

FEATURES = ["momentum__a", "momentum__b", "volatility__v", "turnover__t"]
WIDE = [P, *LABEL_CTES, f"w0 AS (SELECT *, {pc('close')} AS ret FROM labelled)", f"w1 AS (SELECT *, {pc('close', 5)} AS momentum__a, {pc('close', 10)} AS momentum__b, {s('ret', 10)} AS volatility__v, volume / ({m('volume', 10)} + 1e-9) AS turnover__t FROM w0)", "wide AS (SELECT * FROM w1 WHERE excess_fwd IS NOT NULL)"]
LONG = [*WIDE, "lng AS (" + " UNION ALL ".join(f"SELECT date, ticker, excess_fwd, '{f}' AS feature, {f} AS value FROM wide" for f in FEATURES) + ")"]
RANKS = "rkd AS (SELECT *, RANK() OVER (PARTITION BY {k} ORDER BY value) + (COUNT(*) OVER (PARTITION BY {k}, value) - 1) / 2.0 AS rx, RANK() OVER (PARTITION BY {k} ORDER BY excess_fwd) + (COUNT(*) OVER (PARTITION BY {k}, excess_fwd) - 1) / 2.0 AS ry FROM {t} WHERE value IS NOT NULL AND excess_fwd IS NOT NULL)"
ICS = [*LONG, RANKS.format(k="feature", t="lng"), f"ics AS (SELECT feature, COUNT(*) AS n, {corr_agg('value', 'excess_fwd', 10)} AS ic, {corr_agg('rx', 'ry', 10)} AS rank_ic FROM rkd GROUP BY feature)"]


def _labelled(spark, d):
    """All windows per ticker before the cross sections of the label, so that rows are exchanged by ticker and then by date."""
    df = panel(spark, d).withColumn("_r", pct("close"))
    df = df.withColumns({"momentum__a": pct("close", 5), "momentum__b": pct("close", 10), "volatility__v": std("_r", 10), "turnover__t": F.col("volume") / (mean("volume", 10) + 1e-9)})
    return lab.label_excess(df).drop("_r")


def wide(spark, d):
    return _labelled(spark, d).where("excess_fwd is not null")


def long(spark, d):
    return dg.unpivot(wide(spark, d), FEATURES, "date", "ticker", "excess_fwd")


def long_once(spark, d):
    """The same of a written table, for queries that read it several times."""
    return dg.unpivot(once(wide(spark, d).select("date", "excess_fwd", *FEATURES)), FEATURES, "date", "excess_fwd")


def by_regime(spark, d):
    """The figures per regime; the panel is read once for the features and for the market."""
    bars = once(_labelled(spark, d).select("date", "close", "excess_fwd", *FEATURES))
    return dg.ic_by_regime(dg.unpivot(bars.where("excess_fwd is not null"), FEATURES, "date", "excess_fwd"), reg.vol_buckets(bars), stored=True)


@query("unpivot_features", select(LONG, "date, ticker, feature", {"value": "value"}, "lng"))
def _(spark, d):
    return rounded(long(spark, d), ["value"], "date", "ticker", "feature")


@query("feature_ics", select(ICS, "feature, n", {"ic": "ic", "rank_ic": "rank_ic"}, "ics"))
def _(spark, d):
    return rounded(dg.feature_ics(long_once(spark, d), stored=True), ["ic", "rank_ic"], "feature", "n")


@query("ic_by_block", select(ICS, "SPLIT_PART(feature, '__', 1) AS block, COUNT(*) AS features, COUNT(*) FILTER (WHERE ic > 0) AS positive, COUNT(*) FILTER (WHERE ABS(ic) > 0.1) AS strong, MAX_BY(feature, ABS(ic)) AS top_feature", {"mean_ic": "AVG(ic)", "median_ic": "QUANTILE_CONT(ic, 0.5)", "std_ic": "STDDEV_POP(ic)", "mean_rank_ic": "AVG(rank_ic)"}, "ics", "GROUP BY 1"))
def _(spark, d):
    return rounded(dg.ic_by_block(long_once(spark, d), stored=True), ["mean_ic", "median_ic", "std_ic", "mean_rank_ic"], "block", "features", "positive", "strong", "top_feature")


WINS = ["sp AS (SELECT MIN(date) AS a, MAX(date) AS b FROM lng)", "st AS (SELECT UNNEST(GENERATE_SERIES(a::TIMESTAMP, (b - 252)::TIMESTAMP, INTERVAL 21 DAY))::DATE AS start FROM sp)", f"wn AS (SELECT feature, start, COUNT(*) AS n, {corr_agg('value', 'excess_fwd', 50)} AS ic FROM lng JOIN st ON date >= start AND date < start + 252 GROUP BY 1, 2)"]


@query("ic_rolling_windows", select([*LONG, *WINS], "feature, start, n", {"ic": "ic"}, "wn"))
def _(spark, d):
    return rounded(dg.ic_rolling_windows(long(spark, d)), ["ic"], "feature", "start", "n")


_BK = "bk AS (SELECT *, AVG(ic) OVER (PARTITION BY feature ORDER BY start ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS bef, AVG(ic) OVER (PARTITION BY feature ORDER BY start ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS aft, COUNT(ic) OVER (PARTITION BY feature ORDER BY start ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS nb, COUNT(ic) OVER (PARTITION BY feature ORDER BY start ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS na FROM wn)"


@query("ic_breakpoints", select([*LONG, *WINS, _BK], "feature, start", {"before": "bef", "after": "aft"}, "bk", "WHERE nb = 3 AND na = 3 AND ABS(aft - bef) >= 0.05"))
def _(spark, d):
    return rounded(dg.ic_breakpoints(dg.ic_rolling_windows(long(spark, d))), ["before", "after"], "feature", "start")


REG = [*LONG, *FLAGS, BUCKETS, "lr AS (SELECT lng.*, trend, vol FROM lng JOIN buckets USING (date))", RANKS.format(k="feature, trend, vol", t="lr"), f"ri AS (SELECT feature, trend, vol, COUNT(*) AS n, {corr_agg('value', 'excess_fwd', 100)} AS ic, {corr_agg('rx', 'ry', 100)} AS rank_ic FROM rkd GROUP BY ALL)"]


@query("ic_by_regime", select([*REG, "rs AS (SELECT feature, trend, vol, AVG(value) AS mean, STDDEV_SAMP(value) AS std, QUANTILE_CONT(value, 0.5) AS median FROM lr GROUP BY ALL)"], "feature, trend, vol, n", {"ic": "ic", "rank_ic": "rank_ic", "mean": "mean", "std": "std", "median": "median"}, "ri JOIN rs USING (feature, trend, vol)", digits=4))
def _(spark, d):
    return rounded(by_regime(spark, d), ["ic", "rank_ic", "mean", "std", "median"], "feature", "trend", "vol", "n", digits=4)


_AUDIT = ["au AS (SELECT feature, AVG(ic) AS mean_ic, STDDEV_SAMP(ic) AS std_ic, MAX_BY(trend || '_' || vol, ic) AS best_regime, MIN_BY(trend || '_' || vol, ic) AS worst_regime, COUNT(ic) AS regimes FROM ri GROUP BY feature)"]


@query("feature_audit_regime", select([*REG, *_AUDIT], "feature, trend, vol, n, best_regime, worst_regime, regimes", {"ic": "ic", "mean_ic": "mean_ic", "std_ic": "std_ic", "ic_gap": "ic - mean_ic"}, "ri JOIN au USING (feature)", digits=4))
def _(spark, d):
    """The figures per regime with each feature's summary joined back."""
    out = dg.audit_by_regime(by_regime(spark, d))
    return rounded(out, ["ic", "mean_ic", "std_ic", "ic_gap"], "feature", "trend", "vol", "n", "best_regime", "worst_regime", "regimes", digits=4)


@query("regime_sign_flip", select(REG, "feature, COALESCE(STDDEV_SAMP(ic), 0) > 0.1 AS unstable", {"mean_ic": "AVG(ic)", "std_ic": "STDDEV_SAMP(ic)", "min_ic": "MIN(ic)", "max_ic": "MAX(ic)"}, "ri", "GROUP BY feature"))
def _(spark, d):
    return rounded(dg.regime_sign_flip(by_regime(spark, d)), ["mean_ic", "std_ic", "min_ic", "max_ic"], "feature", "unstable")


_TR = ["pd AS (SELECT feature, date, COUNT(*) AS n, SUM(value) AS sx, SUM(excess_fwd) AS sy, SUM(value * value) AS sxx, SUM(excess_fwd * excess_fwd) AS syy, SUM(value * excess_fwd) AS sxy FROM lng WHERE value IS NOT NULL AND excess_fwd IS NOT NULL GROUP BY 1, 2)",
       "tw AS (SELECT feature, date, SUM(n) OVER t AS n, SUM(sx) OVER t AS sx, SUM(sy) OVER t AS sy, SUM(sxx) OVER t AS sxx, SUM(syy) OVER t AS syy, SUM(sxy) OVER t AS sxy FROM pd WINDOW t AS (PARTITION BY feature ORDER BY date RANGE BETWEEN INTERVAL 252 DAYS PRECEDING AND CURRENT ROW))"]


@query("feature_audit_stability", select([*LONG, *_TR], "feature, date, CAST(n AS BIGINT) AS n", {"ic": "CASE WHEN n >= 50 THEN (sxy / n - sx * sy / (n * n)) / SQRT((sxx / n - sx * sx / (n * n)) * (syy / n - sy * sy / (n * n))) END"}, "tw", digits=4))
def _(spark, d):
    return rounded(dg.trailing_ic(long(spark, d)), ["ic"], "feature", "date", "n", digits=4)


PAIRS = [(a, b) for i, a in enumerate(FEATURES) for b in FEATURES[i + 1 :]]
CORR = [*WIDE, "ct AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {corr_agg(a, b)} AS r FROM wide" for a, b in PAIRS) + ")"]


_RANKED = lambda f: f"RANK() OVER (ORDER BY {f}) + (COUNT(*) OVER (PARTITION BY {f}) - 1) / 2.0 AS {f}"
RANK_CORR = ["cw AS (SELECT " + ", ".join(_RANKED(f) for f in FEATURES) + " FROM wide WHERE " + " AND ".join(f"{f} IS NOT NULL" for f in FEATURES) + ")",
             "ck AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {corr_agg(a, b)} AS r FROM cw" for a, b in PAIRS) + ")"]


@query("corr_matrix", select([*CORR, *RANK_CORR], "ct.a, ct.b", {"r": "ct.r", "rank_r": "ck.r"}, "ct JOIN ck ON ct.a = ck.a AND ct.b = ck.b"))
def _(spark, d):
    """Pearson and Spearman."""
    df = once(wide(spark, d).select("date", "ticker", *FEATURES))
    ranks = dg.rank_corr_table(df, FEATURES).withColumnRenamed("r", "rank_r")
    return rounded(dg.corr_table(df, FEATURES).join(ranks, ["a", "b"]), ["r", "rank_r"], "a", "b")


@query("corr_pairs", select(CORR, "a, b, CASE WHEN ABS(r) > 0.95 THEN 'high' ELSE 'medium' END AS severity", {"r": "r"}, "ct", "WHERE ABS(r) >= 0.3"))
def _(spark, d):
    return rounded(dg.corr_pairs(dg.corr_table(wide(spark, d), FEATURES), 0.3), ["r"], "a", "b", "severity")


for _name, _fn in (("corr_clusters_greedy", lambda t: dg.corr_clusters(t, 0.3)), ("corr_clusters_hier", lambda t: dg.corr_clusters_average(t, 0.7)), ("vif", dg.vif), ("orthogonal_select", lambda t: dg.orthogonal_select(t, 0.5))):
    query(_name)(lambda spark, d, fn=_fn: fn(dg.corr_table(wide(spark, d), FEATURES)))


_Z = lambda f: f"COALESCE(({f} - (SELECT AVG({f}) FROM wide)) / NULLIF((SELECT STDDEV_SAMP({f}) FROM wide), 0), 0)"


@query("factor_composites", select(WIDE, KEY, {"factor__momentum": f"({_Z('momentum__a')} + {_Z('momentum__b')}) / 2", "factor__risk": _Z("volatility__v")}, "wide"))
def _(spark, d):
    return rounded(dg.factor_composites(wide(spark, d), {"momentum": ["momentum__a", "momentum__b"], "risk": ["volatility__v"]}), ["factor__momentum", "factor__risk"], "date", "ticker")


@query("incremental_ic", select([*WIDE, f"ii AS (SELECT {corr_agg('momentum__a', 'excess_fwd', 10)} AS c, {corr_agg('turnover__t', 'excess_fwd', 10)} AS b FROM wide)"], "ABS(c) - ABS(b) > 0.01 AS adds", {"candidate_ic": "c", "base_ic": "b", "gain": "ABS(c) - ABS(b)"}, "ii"))
def _(spark, d):
    return rounded(dg.incremental_ic(wide(spark, d), "momentum__a", "turnover__t"), ["candidate_ic", "base_ic", "gain"], "adds")


@query("feature_validate", select(LONG, "feature, CAST(0 AS BIGINT) AS infinite, true AS prefixed, GREATEST(ABS(MIN(value)), ABS(MAX(value))) > 1e6 AS huge", {"null_share": "AVG(CAST(value IS NULL AS DOUBLE))", "mean": "AVG(value)", "std": "STDDEV_SAMP(value)", "min": "MIN(value)", "max": "MAX(value)", "median": "QUANTILE_CONT(value, 0.5)"}, "lng", "GROUP BY feature"))
def _(spark, d):
    return rounded(dg.feature_validate(long_once(spark, d)), ["null_share", "mean", "std", "min", "max", "median"], "feature", "infinite", "prefixed", "huge")


@query("select_by_ic_cap", f"WITH {', '.join(ICS)} SELECT feature FROM ics ORDER BY ABS(rank_ic) DESC, feature LIMIT 2")
def _(spark, d):
    return dg.select_by_ic(dg.feature_ics(long_once(spark, d), stored=True), 2).select("feature")


@query("importance_by_block", select([*ICS, "im AS (SELECT SPLIT_PART(feature, '__', 1) AS block, SUM(ABS(ic)) AS imp, COUNT(*) FILTER (WHERE ic = 0) AS zeros FROM ics GROUP BY 1)"], "block, zeros", {"importance": "imp", "share": "imp / SUM(imp) OVER ()"}, "im"))
def _(spark, d):
    from ..operators.metrics import importance_by_block

    imp = dg.feature_ics(long_once(spark, d), stored=True).select("feature", F.abs("ic").alias("importance"))
    return rounded(importance_by_block(imp), ["importance", "share"], "block", "zeros")


@query("importance_keyword_flag", f"WITH {', '.join(ICS)} SELECT feature, NOT regexp_matches(feature, 'mom|vol') AS unexpected FROM ics")
def _(spark, d):
    imp = dg.feature_ics(long_once(spark, d), stored=True).select("feature", F.abs("ic").alias("importance"))
    return dg.importance_keyword_flag(imp, "mom|vol").select("feature", "unexpected")




def _fold_importance(spark, d):
    rows = sp.in_fold(long(spark, d), sp.folds_purged(wide(spark, d)))
    return dg.feature_ics(rows, "excess_fwd", "fold").select("feature", "fold", F.abs("ic").alias("importance"))


_WF = [*LONG, FOLDS.replace("preds", "wide"), f"fim AS (SELECT feature, fold, ABS({corr_agg('value', 'excess_fwd', 10)}) AS importance FROM lng JOIN fd USING (date) GROUP BY 1, 2)"]


@query("importance_history_mean", select(_WF, "feature", {"importance": "AVG(importance)"}, "fim", "GROUP BY feature"))
def _(spark, d):
    return rounded(_fold_importance(spark, d).groupBy("feature").agg(F.avg("importance").alias("importance")), ["importance"], "feature")


@query("importance_stability", select([*_WF, "cvs AS (SELECT STDDEV_POP(importance) / NULLIF(AVG(importance), 0) AS cv FROM fim GROUP BY feature)"], "", {"stability": "1 / (1 + AVG(cv))"}, "cvs"))
def _(spark, d):
    from ..operators.metrics import importance_stability

    return rounded(importance_stability(_fold_importance(spark, d)), ["stability"])


_GQ = ["gs AS (SELECT feature, AVG(value) AS mu, STDDEV_SAMP(value) AS sd FROM lng GROUP BY feature)", "gq AS (SELECT feature, AVG(CAST(value IS NULL AS DOUBLE)) AS null_share, COUNT(DISTINCT value) AS distinct_values, COALESCE(AVG(CAST(ABS(value - mu) > 5 * sd AS DOUBLE)), 0) AS far_share FROM lng JOIN gs USING (feature) GROUP BY feature)"]


@query("gate_quality", select([*LONG, *_GQ], "feature, distinct_values, null_share <= 0.2 AND distinct_values > 1 AND far_share <= 0.05 AS passed", {"null_share": "null_share", "far_share": "far_share"}, "gq"))
def _(spark, d):
    return rounded(dg.gate_quality(long_once(spark, d)), ["null_share", "far_share"], "feature", "distinct_values", "passed")


@query("gate_univariate_ic", select(ICS, "feature, n, n >= 100 AND ABS(rank_ic) >= 0.02 AS passed", {"rank_ic": "rank_ic"}, "ics"))
def _(spark, d):
    return rounded(dg.gate_univariate(dg.feature_ics(long_once(spark, d), stored=True)), ["rank_ic"], "feature", "n", "passed")


@query("gate_existing_corr", select([*WIDE, *RANK_CORR], "MAX_BY(CASE WHEN a = 'momentum__b' THEN b ELSE a END, ABS(r)) AS closest, MAX(ABS(r)) < 0.85 AS passed", {"max_corr": "MAX(ABS(r))"}, "ck", "WHERE a = 'momentum__b' OR b = 'momentum__b'"))
def _(spark, d):
    return rounded(dg.gate_existing(dg.rank_corr_table(wide(spark, d), FEATURES), "momentum__b"), ["max_corr"], "closest", "passed")


_GF = [*LONG, FOLDS.replace("preds", "wide"), "lf AS (SELECT lng.*, fold FROM lng JOIN fd USING (date))", RANKS.format(k="feature, fold", t="lf"), f"gf AS (SELECT feature, fold, {corr_agg('rx', 'ry', 10)} AS ric FROM rkd GROUP BY 1, 2)"]


@query("gate_oos_ic", select(_GF, "feature, ABS(AVG(ric)) >= 0.02 AND STDDEV_POP(ric) < 0.10 AS passed", {"mean_ic": "AVG(ric)", "std_ic": "STDDEV_POP(ric)"}, "gf", "GROUP BY feature"))
def _(spark, d):
    return rounded(dg.gate_folds(long(spark, d), sp.folds_purged(wide(spark, d))), ["mean_ic", "std_ic"], "feature", "passed")


SIDE = [*LONG, "sd AS (SELECT *, CASE WHEN date < DATE '1995-06-01' THEN 0 ELSE 1 END AS side FROM lng WHERE value IS NOT NULL)"]
KS = ["kc AS (SELECT feature, value, COUNT(*) FILTER (WHERE side = 0) AS a, COUNT(*) FILTER (WHERE side = 1) AS b FROM sd GROUP BY 1, 2)",
      "kg AS (SELECT feature, a, b, ABS(SUM(a) OVER (PARTITION BY feature ORDER BY value)::DOUBLE / SUM(a) OVER (PARTITION BY feature) - SUM(b) OVER (PARTITION BY feature ORDER BY value)::DOUBLE / SUM(b) OVER (PARTITION BY feature)) AS gap FROM kc)",
      "ksd AS (SELECT feature, MAX(gap) AS ks, CAST(SUM(a) AS BIGINT) AS na, CAST(SUM(b) AS BIGINT) AS nb FROM kg GROUP BY feature)"]
PSI = ["pe AS (SELECT feature, LIST_DISTINCT(QUANTILE_CONT(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS e FROM sd WHERE side = 0 GROUP BY feature)",
       "pb AS (SELECT feature, LEN(LIST_FILTER(e, lambda x: x <= value)) AS bin, COUNT(*) FILTER (WHERE side = 0) AS a, COUNT(*) FILTER (WHERE side = 1) AS b FROM sd JOIN pe USING (feature) GROUP BY 1, 2)",
       "ps AS (SELECT feature, GREATEST(a::DOUBLE / SUM(a) OVER (PARTITION BY feature), 1e-6) AS x, GREATEST(b::DOUBLE / SUM(b) OVER (PARTITION BY feature), 1e-6) AS y FROM pb)",
       "psid AS (SELECT feature, ABS(SUM((y - x) * LN(y / x))) AS psi FROM ps GROUP BY feature)"]


def sided(spark, d):
    return long_once(spark, d).withColumn("side", (F.col("date") >= F.lit("1995-06-01").cast("date")).cast("int"))


@query("ks_two_sample", select([*SIDE, *KS], "feature, na AS n_reference, nb AS n_current", {"ks": "ks"}, "ksd"))
def _(spark, d):
    return rounded(dg.ks(sided(spark, d)), ["ks"], "feature", "n_reference", "n_current")


@query("psi", select([*SIDE, *PSI], "feature", {"psi": "psi"}, "psid"))
def _(spark, d):
    return rounded(dg.psi(sided(spark, d), stored=True), ["psi"], "feature")


_PD = ["c4 AS (SELECT QUANTILE_DISC(date, 0.4) AS lo, QUANTILE_DISC(date, 0.6) AS hi FROM wide)", "sd AS (SELECT lng.*, CASE WHEN date <= lo THEN 0 WHEN date > hi THEN 1 END AS side FROM lng, c4 WHERE value IS NOT NULL)"]


@query("gate_period_drift", select([*LONG, *_PD, *KS], "feature, ks < 0.2 AS passed", {"ks": "ks"}, "ksd"))
def _(spark, d):
    df = wide(spark, d)
    cuts = df.agg(sp.date_at(0.4).alias("lo"), sp.date_at(0.6).alias("hi"))
    rows = dg.unpivot(df, FEATURES, "date", "ticker").join(F.broadcast(cuts)).withColumn("side", F.when(F.col("date") <= F.col("lo"), 0).when(F.col("date") > F.col("hi"), 1))
    return rounded(dg.ks(rows).withColumn("passed", F.col("ks") < 0.2), ["ks"], "feature", "passed")


DRIFT = [*SIDE, *KS, *PSI, "mn AS (SELECT feature, AVG(CASE WHEN side = 0 THEN value END) AS rm, AVG(CASE WHEN side = 1 THEN value END) AS cm FROM sd GROUP BY feature)", "dr AS (SELECT feature, ks, psi, rm, cm, ks > 0.15 OR psi > 0.20 AS drifted FROM ksd JOIN psid USING (feature) JOIN mn USING (feature))"]


@query("feature_drift", select(DRIFT, "feature, drifted", {"ks": "ks", "psi": "psi", "reference_mean": "rm", "current_mean": "cm"}, "dr"))
def _(spark, d):
    return rounded(dg.feature_drift(sided(spark, d), stored=True), ["ks", "psi", "reference_mean", "current_mean"], "feature", "drifted")


_ALERT = "al AS (SELECT CASE WHEN ks > 0.4 OR psi > 0.5 THEN 'critical' WHEN ks > 0.25 OR psi > 0.35 THEN 'high' WHEN drifted THEN 'medium' END AS s FROM dr), ag AS (SELECT COUNT(*) FILTER (WHERE s = 'critical') AS critical, COUNT(*) FILTER (WHERE s = 'high') AS high, COUNT(*) FILTER (WHERE s = 'medium') AS medium FROM al), ah AS (SELECT *, GREATEST(0, 100 - 40 * critical - 20 * high - 10 * medium) AS health FROM ag)"


@query("drift_alerts", f"WITH {', '.join(DRIFT)}, {_ALERT} SELECT critical, high, medium, health, CASE WHEN health >= 80 THEN 'healthy' WHEN health >= 60 THEN 'warning' ELSE 'critical' END AS status, critical > 0 OR health < 60 AS should_retrain FROM ah")
def _(spark, d):
    return dg.drift_alerts(dg.feature_drift(sided(spark, d), stored=True))


_PRD = [*PREDS, "sd AS (SELECT 'proba' AS feature, proba AS value, CASE WHEN date < DATE '1995-06-01' THEN 0 ELSE 1 END AS side FROM preds)", *KS, *PSI]


@query("prediction_drift", select(_PRD, "feature", {"ks": "ks", "psi": "psi", "reference_extreme": "(SELECT AVG(CASE WHEN side = 0 THEN CAST(value NOT BETWEEN 0.05 AND 0.95 AS DOUBLE) END) FROM sd)", "current_extreme": "(SELECT AVG(CASE WHEN side = 1 THEN CAST(value NOT BETWEEN 0.05 AND 0.95 AS DOUBLE) END) FROM sd)"}, "ksd JOIN psid USING (feature)"))
def _(spark, d):
    df = preds(spark, d).withColumn("side", (F.col("date") >= F.lit("1995-06-01").cast("date")).cast("int"))
    return rounded(dg.prediction_drift(df), ["ks", "psi", "reference_extreme", "current_extreme"], "feature")


_PF = [*PREDS, f"pf AS (SELECT CASE WHEN date < DATE '1995-06-01' THEN 0 ELSE 1 END AS side, {corr_agg('proba', 'excess_fwd', 10)} AS ic, AVG(CAST(excess_fwd > 0 AS DOUBLE)) AS hit FROM preds GROUP BY 1)",
       "pl AS (SELECT 'rank_ic' AS metric, MAX(CASE WHEN side = 0 THEN ic END) AS reference, MAX(CASE WHEN side = 1 THEN ic END) AS cur FROM pf UNION ALL SELECT 'hit_rate', MAX(CASE WHEN side = 0 THEN hit END), MAX(CASE WHEN side = 1 THEN hit END) FROM pf)"]


@query("performance_drift", select(_PF, "metric, (cur - reference) / NULLIF(ABS(reference), 0) < CASE metric WHEN 'rank_ic' THEN -0.3 ELSE -0.2 END AS degraded", {"reference": "reference", "current": "cur", "change": "(cur - reference) / NULLIF(ABS(reference), 0)"}, "pl", digits=4))
def _(spark, d):
    from ..operators.metrics import ic

    df = preds(spark, d).withColumn("side", F.when(F.col("date") < F.lit("1995-06-01").cast("date"), "reference").otherwise("current"))
    per = df.groupBy("side").agg(ic("proba", "excess_fwd").alias("rank_ic"), F.avg((F.col("excess_fwd") > 0).cast("double")).alias("hit_rate"))
    both = per.unpivot(["side"], ["rank_ic", "hit_rate"], "metric", "v").groupBy("metric").pivot("side", ["reference", "current"]).agg(F.first("v"))
    return rounded(dg.performance_drift(both), ["reference", "current", "change"], "metric", "degraded", digits=4)


@query("verify_forward_alignment", f"WITH {P}, {', '.join(LABEL_CTES)} SELECT COUNT(fwd_ret) AS n, true AS aligned FROM labelled")
def _(spark, d):
    return dg.verify_forward_alignment(lab.label_excess(panel(spark, d))).select("n", "aligned")


_FC = [*LONG[:-1], "ld AS (SELECT *, LEAD(excess_fwd, 20) OVER (PARTITION BY ticker ORDER BY date) AS later FROM wide)", "lng AS (" + " UNION ALL ".join(f"SELECT later AS excess_fwd, '{f}' AS feature, {f} AS value FROM ld" for f in FEATURES) + ")", RANKS.format(k="feature", t="lng")]


@query("future_corr_test", select(_FC, f"feature, COUNT(*) AS n, ABS({corr_agg('rx', 'ry', 100)}) > 0.1 AS suspicious", {"rank_ic": corr_agg("rx", "ry", 100)}, "rkd", "GROUP BY feature"))
def _(spark, d):
    return rounded(dg.future_corr(wide(spark, d), FEATURES), ["rank_ic"], "feature", "n", "suspicious")


@query("new_feature_gate", f"WITH {', '.join([*ICS, *_GQ])} SELECT feature, null_share <= 0.2 AND distinct_values > 1 AND far_share <= 0.05 AND n >= 100 AND ABS(rank_ic) >= 0.02 AS passed FROM gq JOIN ics USING (feature)")
def _(spark, d):
    """The gates of quality and univariate strength, joined by feature."""
    rows = long_once(spark, d)
    a, b = dg.gate_quality(rows).select("feature", F.col("passed").alias("q")), dg.gate_univariate(dg.feature_ics(rows, stored=True)).select("feature", F.col("passed").alias("u"))
    return a.join(b, "feature").select("feature", (F.col("q") & F.col("u")).alias("passed"))


_BINS = ["pc_ AS (SELECT feature, SUM(a) OVER (PARTITION BY feature ORDER BY bin)::DOUBLE / SUM(a) OVER (PARTITION BY feature) AS x, SUM(b) OVER (PARTITION BY feature ORDER BY bin)::DOUBLE / SUM(b) OVER (PARTITION BY feature) AS y FROM pb)",
         "kb AS (SELECT feature, MAX(ABS(x - y)) AS ks FROM pc_ GROUP BY feature)", "cn AS (SELECT feature, COUNT(*) AS rows FROM sd WHERE side = 1 GROUP BY feature)",
         "st AS (SELECT feature, rows, psi, ks, CASE WHEN ks > 0.4 OR psi > 0.5 THEN 'critical' WHEN ks > 0.25 OR psi > 0.35 THEN 'high' WHEN ks > 0.15 OR psi > 0.2 THEN 'medium' ELSE 'none' END AS severity FROM psid JOIN kb USING (feature) JOIN cn USING (feature))"]


@query("stream_drift", select([*SIDE, *PSI, *_BINS], "feature, rows, severity", {"psi": "psi", "ks": "ks"}, "st"))
def _(spark, d):
    """The later half dropped as files twice, in several batches; where the state of each feature stands at the end."""
    df = spark.read.parquet(written(wide(spark, d).select("date", "ticker", *FEATURES)))
    reference, later = df.where("date < '1995-06-01'"), df.where("date >= '1995-06-01'")
    drop, alerts, marks = scratch(spark), scratch(spark), scratch(spark)
    for _ in range(2):
        later.repartition(3).write.mode("append").parquet(drop)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(drop)
    drift.watch(daily.once_each(stream, "5000 days"), reference, FEATURES, alerts, marks).awaitTermination()
    return rounded(drift.latest(spark.read.parquet(alerts)), ["psi", "ks"], "feature", "rows", "severity")
