"""Registered queries of metrics, backtests and scenarios."""

from __future__ import annotations

from pyspark.sql import functions as F


from ..operators import backtest as bt
from ..operators import metrics as mt
from ..operators import regimes as reg
from ..operators import splits as sp
from ..operators.order_statistics import ranked_in_ranges
from .base import QUERIES, SQL, corr_agg, corr_roll, query, rounded, select
from .core import BUCKETS, FLAGS, PREDS, P, preds
from .fixtures import panel

RANK = "(RANK() OVER (ORDER BY {x}) + (COUNT(*) OVER (PARTITION BY {x}) - 1) / 2.0)"


@query("ic_pearson", select(PREDS, "", {"ic": corr_agg("proba", "excess_fwd", 10)}, "preds"))
def _(spark, d):
    return rounded(preds(spark, d).agg(mt.ic("proba", "excess_fwd").alias("ic")), ["ic"])


@query("ic_spearman", select([*PREDS, f"rk AS (SELECT {RANK.format(x='proba')} AS a, {RANK.format(x='excess_fwd')} AS b FROM preds)"], "COUNT(*) AS n", {"rank_ic": corr_agg("a", "b", 10)}, "rk"))
def _(spark, d):
    return rounded(mt.rank_ic(preds(spark, d), "proba", "excess_fwd"), ["rank_ic"], "n")


@query("ic_contribution", select(PREDS, "", {"ic_contribution": corr_agg("proba * volume", "excess_fwd", 10)}, "preds"))
def _(spark, d):
    return rounded(mt.ic_contribution(preds(spark, d), size="volume"), ["ic_contribution"])


DAILY = f"daily AS (SELECT date, COUNT(*) AS n, {corr_agg('proba', 'excess_fwd')} AS ic FROM preds GROUP BY date HAVING COUNT(*) >= 10)"


@query("ic_daily", select([*PREDS, DAILY], "date, n", {"ic": "ic"}, "daily"))
def ic_daily(spark, d):
    return rounded(mt.ic_daily(preds(spark, d)), ["ic"], "date", "n")


def flagship(spark, d):
    """Daily coefficients of the momentum score; small data has few tickers a date."""
    return rounded(mt.ic_daily(preds(spark, d), least=3), ["ic"], "date", "n")


@query("ic_by_period", select([*PREDS, DAILY], "CAST(date_trunc('month', date) AS DATE) AS period", {"ic_mean": "AVG(ic)", "ic_std": "STDDEV_SAMP(ic)", "positive_rate": "AVG(CAST(ic > 0 AS DOUBLE))", "ic_sharpe": "AVG(ic) / (STDDEV_SAMP(ic) + 1e-9)"}, "daily", "GROUP BY 1"))
def _(spark, d):
    return rounded(mt.ic_by_period(preds(spark, d)), ["ic_mean", "ic_std", "positive_rate", "ic_sharpe"], "period")


@query("ic_rolling_rows", select(PREDS, "date, ticker", {"ic": corr_roll("proba", "excess_fwd", 50, 10).replace("49 PRECEDING AND CURRENT ROW", "50 PRECEDING AND 1 PRECEDING")}, "preds"))
def _(spark, d):
    return rounded(mt.ic_rolling_rows(preds(spark, d)), ["ic"], "date", "ticker")


EDGES = "LIST_DISTINCT(QUANTILE_CONT(proba, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))"
DECILES = [*PREDS, f"ed AS (SELECT {EDGES} AS e FROM preds)", "dc AS (SELECT *, GREATEST(LEN(LIST_FILTER(e, lambda x: x < proba)), 1) AS decile FROM preds, ed)",
           "ds AS (SELECT decile, COUNT(*) AS n, AVG(excess_fwd) AS mean_ret, STDDEV_SAMP(excess_fwd) AS std_ret, MIN(proba) AS min_signal, MAX(proba) AS max_signal FROM dc GROUP BY decile)"]


@query("decile_stats", select(DECILES, "decile, n", {"mean_ret": "mean_ret", "std_ret": "std_ret", "min_signal": "min_signal", "max_signal": "max_signal", "sharpe": "mean_ret / (std_ret + 1e-9)"}, "ds"))
def _(spark, d):
    return rounded(mt.decile_stats(preds(spark, d)), ["mean_ret", "std_ret", "min_signal", "max_signal", "sharpe"], "decile", "n")


@query("sharpe_by_decile", select(DECILES, "decile", {"annual_sharpe": "mean_ret / (std_ret + 1e-9) * SQRT(252.0)"}, "ds"))
def _(spark, d):
    return rounded(mt.decile_stats(preds(spark, d)), ["annual_sharpe"], "decile")


@query("decile_ic", select(DECILES, "", {"decile_ic": "(MAX_BY(mean_ret, decile) - MIN_BY(mean_ret, decile)) / ((SELECT STDDEV_SAMP(excess_fwd) FROM preds) + 1e-9)"}, "ds"))
def _(spark, d):
    return rounded(mt.decile_ic(preds(spark, d)), ["decile_ic"])


@query("decile_monotonicity", f"WITH {', '.join(DECILES)}, u AS (SELECT COALESCE(mean_ret >= LAG(mean_ret) OVER (ORDER BY decile), true) AS up FROM ds) SELECT BOOL_AND(up) AS monotonic, COUNT(*) FILTER (WHERE NOT up) AS breaks FROM u")
def _(spark, d):
    return mt.monotonic(mt.decile_stats(preds(spark, d)))


TS = {"hit_rate": "AVG(CAST(excess_fwd > 0 AS DOUBLE))", "avg_win": "COALESCE(AVG(CASE WHEN excess_fwd > 0 THEN excess_fwd END), 0)", "avg_loss": "COALESCE(AVG(CASE WHEN excess_fwd < 0 THEN -excess_fwd END), 0)", "profit_factor": "COALESCE(SUM(CASE WHEN excess_fwd > 0 THEN excess_fwd END), 0) / NULLIF(COALESCE(SUM(CASE WHEN excess_fwd < 0 THEN -excess_fwd END), 0), 0)"}
TS["expected_value"] = f"{TS['hit_rate']} * {TS['avg_win']} - (1 - {TS['hit_rate']}) * {TS['avg_loss']}"

for _name, _cols in (("trade_hit_rate", ["hit_rate"]), ("trade_profit_factor", ["profit_factor", "avg_win", "avg_loss"]), ("trade_expected_value", ["expected_value", "hit_rate", "avg_win", "avg_loss"])):
    SQL[_name] = select(PREDS, "sector, COUNT(excess_fwd) AS trades", {c: TS[c] for c in _cols}, "preds", "GROUP BY sector")
    QUERIES[_name] = lambda spark, d, cols=_cols: rounded(mt.trade_stats(preds(spark, d), "excess_fwd", "sector"), cols, "sector", "trades")


@query("exposure_capacity", select([*PREDS, "ps AS (SELECT date, COUNT(*) AS n FROM preds WHERE proba > 0.8 GROUP BY date)"], "", {"avg_positions": "AVG(n)", "max_positions": "MAX(n)", "exposure": "AVG(n) / 10", "capacity": "AVG(n) * 10"}, "ps"))
def _(spark, d):
    return rounded(mt.exposure(preds(spark, d).where("proba > 0.8")), ["avg_positions", "max_positions", "exposure", "capacity"])


@query("exposure_metrics", select([*PREDS, "ps AS (SELECT sector, date, COUNT(*) AS n FROM preds WHERE proba > 0.8 GROUP BY sector, date)"], "sector", {"avg_positions": "AVG(n)", "max_positions": "MAX(n)"}, "ps", "GROUP BY sector"))
def _(spark, d):
    per = preds(spark, d).where("proba > 0.8").groupBy("sector", "date").agg(F.count("*").alias("n"))
    return rounded(per.groupBy("sector").agg(F.avg("n").alias("avg_positions"), F.max("n").alias("max_positions")), ["avg_positions", "max_positions"], "sector")


AUC = "(SUM(CASE WHEN label = 1 THEN rk END) - SUM(label) * (SUM(label) + 1) / 2.0) / NULLIF(SUM(label) * (COUNT(*) - SUM(label)), 0)"


@query("roc_auc", select([*PREDS, f"rr AS (SELECT label, {RANK.format(x='proba')} AS rk FROM preds)"], "", {"roc_auc": AUC}, "rr"))
def _(spark, d):
    return rounded(mt.roc_auc(preds(spark, d)), ["roc_auc"])


PR = ["sc AS (SELECT proba, SUM(label) AS pos, COUNT(*) AS n FROM preds GROUP BY proba)", "cu AS (SELECT *, SUM(pos) OVER (ORDER BY proba DESC) AS tp, SUM(n) OVER (ORDER BY proba DESC) AS nn FROM sc)"]


@query("pr_auc", select([*PREDS, *PR], "", {"pr_auc": "SUM(pos * ((CASE WHEN nn = n THEN 1.0 ELSE (tp - pos)::DOUBLE / NULLIF(nn - n, 0) END) + tp::DOUBLE / nn) / 2) / SUM(pos)"}, "cu"))
def _(spark, d):
    return rounded(mt.pr_auc(preds(spark, d)), ["pr_auc"])


@query("precision_at_k", select([*PREDS, "tk AS (SELECT label FROM preds ORDER BY proba DESC, date, ticker LIMIT 200)"], "", {"precision": "AVG(label)"}, "tk"))
def _(spark, d):
    return rounded(mt.precision_at_k(preds(spark, d), 200, "proba", "label", "date", "ticker"), ["precision"])


@query("hit_rate_at_threshold", select([*PREDS, "th AS (SELECT i / 20.0 AS threshold FROM RANGE(10, 19) t(i))"], "CAST(threshold AS DOUBLE) AS threshold", {"hit_rate": "AVG(CAST(proba >= threshold AND label = 1 AS DOUBLE))", "coverage": "AVG(CAST(proba >= threshold AS DOUBLE))", "precision": "AVG(CASE WHEN proba >= threshold THEN label END)"}, "preds, th", "GROUP BY 1"))
def _(spark, d):
    return rounded(mt.hit_curve(preds(spark, d)), ["hit_rate", "coverage", "precision"], "threshold")


TOP = "tp AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY date ORDER BY proba DESC, ticker) AS rank FROM preds)"


@query("topk_per_date", f"WITH {', '.join(PREDS)}, {TOP} SELECT date, ticker, rank FROM tp WHERE rank <= 5")
def _(spark, d):
    return mt.topk_per_date(preds(spark, d), 5).select("date", "ticker", "rank")


@query("precision_by_day", select([*PREDS, TOP, "pd AS (SELECT date, AVG(label) AS p FROM tp WHERE rank <= 10 GROUP BY date)"], "COUNT(*) AS days", {"precision_by_day": "AVG(p)"}, "pd"))
def _(spark, d):
    return rounded(mt.precision_by_day(preds(spark, d)), ["precision_by_day"], "days")


@query("rank_signals", f"WITH {', '.join(PREDS)} SELECT date, ticker, ROW_NUMBER() OVER (ORDER BY proba DESC, date, ticker) AS rank FROM preds")
def _(spark, d):
    """A global rank without one task for all rows: ties of a score are ranked by key, scores are counted in ranges."""
    df = preds(spark, d)
    from pyspark.sql import Window

    per = mt.cumulated(df.groupBy("proba").agg(F.count("*").alias("n")), "proba", ["n"], descending=True).select("proba", F.col("n_before"))
    within = F.row_number().over(Window.partitionBy("proba").orderBy("date", "ticker"))
    return df.join(per, "proba").select("date", "ticker", (F.col("n_before") + within).cast("long").alias("rank"))


@query("topk_global", f"WITH {', '.join(PREDS)} SELECT date, ticker, label FROM preds ORDER BY proba DESC, date, ticker LIMIT 50")
def _(spark, d):
    return preds(spark, d).orderBy(F.desc("proba"), "date", "ticker").limit(50).select("date", "ticker", "label")


@query("topk_latest_date", f"WITH {', '.join(PREDS)} SELECT date, ticker FROM preds WHERE date = (SELECT MAX(date) FROM preds) AND proba >= 0.5 ORDER BY proba DESC, ticker LIMIT 20")
def _(spark, d):
    df = preds(spark, d)
    last = df.agg(F.max("date").alias("date"))
    return df.join(F.broadcast(last), "date").where("proba >= 0.5").orderBy(F.desc("proba"), "ticker").limit(20).select("date", "ticker")


@query("signal_window_filter", f"WITH {', '.join(PREDS)} SELECT date, ticker FROM preds WHERE date >= (SELECT MAX(date) FROM preds) - 60 AND proba >= 0.6 AND sector IN (0, 2)")
def _(spark, d):
    df = preds(spark, d)
    last = df.agg(F.date_sub(F.max("date"), 60).alias("_from"))
    return df.join(F.broadcast(last)).where("date >= _from and proba >= 0.6 and sector in (0, 2)").select("date", "ticker")


EVAL = ["ev AS (SELECT *, CASE WHEN date < DATE '1997-01-01' THEN 'in' ELSE 'out' END AS split FROM preds)"]


@query("is_oos_comparison", select([*PREDS, *EVAL, f"g AS (SELECT split, {corr_agg('proba', 'excess_fwd', 10)} AS ic, AVG(CAST(excess_fwd > 0 AS DOUBLE)) AS hit FROM ev GROUP BY split)", "w AS (SELECT MAX(CASE WHEN split = 'in' THEN ic END) AS a, MAX(CASE WHEN split = 'out' THEN ic END) AS b, MAX(CASE WHEN split = 'in' THEN hit END) AS c, MAX(CASE WHEN split = 'out' THEN hit END) AS dd FROM g)", "l AS (SELECT 'ic' AS metric, a AS i, b AS o FROM w UNION ALL SELECT 'hit_rate', c, dd FROM w)"], "metric", {"in_sample": "i", "out_sample": "o", "gap": "i - o", "gap_pct": "(i - o) / NULLIF(ABS(i), 0)"}, "l", digits=4))
def _(spark, d):
    df = preds(spark, d).withColumn("split", F.when(F.col("date") < F.lit("1997-01-01").cast("date"), "in_sample").otherwise("out_sample"))
    per = df.groupBy("split").agg(mt.ic("proba", "excess_fwd").alias("ic"), F.avg((F.col("excess_fwd") > 0).cast("double")).alias("hit_rate"))
    wide = per.unpivot(["split"], ["ic", "hit_rate"], "metric", "v").groupBy("metric").pivot("split", ["in_sample", "out_sample"]).agg(F.first("v"))
    out = wide.withColumn("gap", F.col("in_sample") - F.col("out_sample")).withColumn("gap_pct", F.try_divide("gap", F.abs("in_sample")))
    return rounded(out, ["in_sample", "out_sample", "gap", "gap_pct"], "metric", digits=4)


@query("evaluate_predictions", select([*PREDS, *EVAL, "rr AS (SELECT *, RANK() OVER (PARTITION BY split ORDER BY proba) + (COUNT(*) OVER (PARTITION BY split, proba) - 1) / 2.0 AS rk FROM ev)"], "split, COUNT(*) AS n", {"roc_auc": AUC, "ic": corr_agg("proba", "excess_fwd", 10), "hit_rate": "AVG(CAST(proba >= 0.5 AND label = 1 AS DOUBLE))"}, "rr", "GROUP BY split"))
def _(spark, d):
    """All metrics per split in one pass; ranks within the split give the area under the curve."""
    df = preds(spark, d).withColumn("split", F.when(F.col("date") < F.lit("1997-01-01").cast("date"), "in").otherwise("out"))
    rows = ranked_in_ranges(df.select("split", "proba", "label", "excess_fwd"), {"rk": "proba"}, "split")
    pos = F.sum("label")
    auc = F.try_divide(F.sum(F.when(F.col("label") == 1, F.col("rk"))) - pos * (pos + 1) / 2, pos * (F.count("*") - pos))
    out = rows.groupBy("split").agg(F.count("*").alias("n"), auc.alias("roc_auc"), mt.ic("proba", "excess_fwd").alias("ic"), F.avg(((F.col("proba") >= 0.5) & (F.col("label") == 1)).cast("double")).alias("hit_rate"))
    return rounded(out, ["roc_auc", "ic", "hit_rate"], "split", "n")


FOLDS = """f0 AS (SELECT date, ROW_NUMBER() OVER (ORDER BY date) - 1 AS i, COUNT(*) OVER () AS n FROM (SELECT DISTINCT date FROM preds)),
 fd AS (SELECT date, CAST(LEAST(i // (n // 5), 4) + 1 AS INT) AS fold FROM f0)"""
FOLD_IC = f"fi AS (SELECT fold, {corr_agg('proba', 'excess_fwd', 10)} AS ic, AVG(label) AS base FROM preds JOIN fd USING (date) GROUP BY fold)"


def _fold_metrics(spark, d):
    df = preds(spark, d)
    per = sp.in_fold(df, sp.folds_purged(df)).groupBy("fold").agg(mt.ic("proba", "excess_fwd").alias("ic"), F.avg(F.col("label").cast("double")).alias("base"))
    return per


@query("fold_summary", select([*PREDS, FOLDS, FOLD_IC], "fold", {"ic": "ic", "base": "base"}, "fi"))
def _(spark, d):
    return rounded(_fold_metrics(spark, d), ["ic", "base"], "fold")


@query("fold_stability", select([*PREDS, FOLDS, FOLD_IC, "l AS (SELECT 'ic' AS metric, ic AS v FROM fi UNION ALL SELECT 'base', base FROM fi)"], "metric", {"mean": "AVG(v)", "std": "STDDEV_POP(v)", "min": "MIN(v)", "max": "MAX(v)", "cv": "STDDEV_POP(v) / NULLIF(ABS(AVG(v)), 0)", "score": "1 / (1 + COALESCE(STDDEV_POP(v) / NULLIF(ABS(AVG(v)), 0), 0))"}, "l", "GROUP BY metric", digits=4))
def _(spark, d):
    out = mt.fold_stability(_fold_metrics(spark, d).unpivot(["fold"], ["ic", "base"], "metric", "value"))
    return rounded(out, ["mean", "std", "min", "max", "cv", "score"], "metric", digits=4)


@query("wf_ic_sharpe", select([*PREDS, FOLDS, FOLD_IC], "", {"ic_sharpe": "AVG(ic) / STDDEV_SAMP(ic) * SQRT(4.0)"}, "fi", digits=4))
def _(spark, d):
    return rounded(_fold_metrics(spark, d).agg((F.avg("ic") / F.stddev_samp("ic") * F.sqrt(F.lit(4.0))).alias("ic_sharpe")), ["ic_sharpe"], digits=4)


MODELS = ["md AS (SELECT date, ticker, proba AS p1, (proba + RANK() OVER (PARTITION BY date ORDER BY volume) / 100.0) / 2 AS p2, 1 - proba * proba AS p3 FROM preds)", "sc AS (SELECT date, ticker, 'p1' AS model, p1 AS proba FROM md UNION ALL SELECT date, ticker, 'p2', p2 FROM md UNION ALL SELECT date, ticker, 'p3', p3 FROM md)"]


def _scores(spark, d):
    from pyspark.sql import Window

    df = preds(spark, d)
    rank = F.rank().over(Window.partitionBy("date").orderBy("volume"))
    wide = df.select("date", "ticker", F.col("proba").alias("p1"), ((F.col("proba") + rank / 100) / 2).alias("p2"), (1 - F.col("proba") * F.col("proba")).alias("p3"))
    return wide.unpivot(["date", "ticker"], ["p1", "p2", "p3"], "model", "proba")


@query("ensemble_combine", select([*PREDS, *MODELS], "date, ticker", {"mean": "AVG(proba)", "median": "QUANTILE_CONT(proba, 0.5)", "weighted": "SUM(proba * CASE model WHEN 'p1' THEN 0.5 WHEN 'p2' THEN 0.3 ELSE 0.2 END)", "uncertainty": "STDDEV_POP(proba)"}, "sc", "GROUP BY date, ticker"))
def _(spark, d):
    weights = spark.createDataFrame([("p1", 0.5), ("p2", 0.3), ("p3", 0.2)], "model string, weight double")
    return rounded(mt.ensemble_combine(_scores(spark, d), weights), ["mean", "median", "weighted", "uncertainty"], "date", "ticker")


@query("ensemble_diversity", select([*PREDS, *MODELS, f"pa AS (SELECT a.model AS ma, b.model AS mb, {corr_agg('a.proba', 'b.proba')} AS rr FROM sc a JOIN sc b ON a.date = b.date AND a.ticker = b.ticker AND a.model < b.model GROUP BY 1, 2)", "sd AS (SELECT STDDEV_POP(proba) AS s FROM sc GROUP BY date, ticker)"], "COUNT(*) AS pairs", {"avg_corr": "AVG(rr)", "avg_std": "(SELECT AVG(s) FROM sd)"}, "pa"))
def _(spark, d):
    return rounded(mt.ensemble_diversity(_scores(spark, d)), ["avg_corr", "avg_std"], "pairs")


# Backtests

K, HOLD, COST = 10, 4, (12.0 + 26.1) / 1e4
CAL = "cal AS (SELECT date, ROW_NUMBER() OVER (ORDER BY date) AS i FROM (SELECT DISTINCT date FROM panel))"


def trades_sql(k: int = K, hold: int = HOLD, cost: float = COST) -> list[str]:
    return [*PREDS, TOP, CAL, "bars AS (SELECT date, ticker, close, i FROM panel JOIN cal USING (date))",
            f"tr0 AS (SELECT t.date AS date_in, y.date AS date_out, t.ticker, x.close * (1 + {cost!r}) AS entry_px, y.close * (1 - {cost!r}) AS exit_px FROM tp t JOIN bars x ON t.date = x.date AND t.ticker = x.ticker JOIN bars y ON y.ticker = t.ticker AND y.i = x.i + {hold} WHERE t.rank <= {k})",
            "trades AS (SELECT *, exit_px / NULLIF(entry_px, 0) - 1 AS net_ret FROM tr0)"]


CURVE = ["dr AS (SELECT date, COALESCE(AVG(net_ret), 0) AS ret FROM (SELECT DISTINCT date FROM panel) LEFT JOIN trades ON date_in = date GROUP BY date)", "curve AS (SELECT *, PRODUCT(1 + ret) OVER (ORDER BY date) AS equity FROM dr)"]
T = trades_sql()


def trades(spark, d, **kw):
    return bt.backtest_topk(preds(spark, d), panel(spark, d), K, HOLD, gate=False, **kw)


@query("backtest_topk", select(T, "date_in, date_out, ticker", {"entry_px": "entry_px", "exit_px": "exit_px", "net_ret": "net_ret"}, "trades"))
def _(spark, d):
    return rounded(trades(spark, d), ["entry_px", "exit_px", "net_ret"], "date_in", "date_out", "ticker")


@query("backtest_gated", select([*T, *FLAGS], "date_in, date_out, ticker", {"net_ret": "net_ret"}, "trades", "WHERE date_in IN (SELECT date FROM g2 WHERE trend_ok AND vol < 0.5)"))
def _(spark, d):
    out = bt.backtest_topk(preds(spark, d), panel(spark, d), K, HOLD, most_vol=0.5)
    return rounded(out, ["net_ret"], "date_in", "date_out", "ticker")


_STICKY = ["dy AS (SELECT date, ROW_NUMBER() OVER (ORDER BY date) AS i FROM (SELECT DISTINCT date FROM tp))", "nw AS (SELECT tp.date, ticker, rank, i FROM tp JOIN dy USING (date) WHERE rank <= 30)",
           "st AS (SELECT a.date, a.ticker, a.rank, ROW_NUMBER() OVER (PARTITION BY a.date ORDER BY COALESCE(a.rank <= b.rank + 20, false) DESC, a.rank) AS n FROM nw a LEFT JOIN (SELECT * FROM nw WHERE rank <= 10) b ON a.ticker = b.ticker AND b.i = a.i - 1)"]


@query("sticky_topk", f"WITH {', '.join([*PREDS, TOP, *_STICKY])} SELECT date, ticker, rank FROM st WHERE n <= 10")
def _(spark, d):
    return bt.sticky_topk(mt.topk_per_date(preds(spark, d), 30).select("date", "ticker", "rank"), 10)


@query("equity_curve", select([*T, *CURVE], "date", {"ret": "ret", "equity": "equity"}, "curve"))
def _(spark, d):
    return rounded(bt.equity_curve(trades(spark, d), panel(spark, d)), ["ret", "equity"], "date")


DD = "ddn AS (SELECT *, equity / MAX(equity) OVER (ORDER BY date) - 1 AS dd FROM curve)"
_SUM = {"final_equity": "MAX_BY(equity, date)", "cagr": "POW(MAX_BY(equity, date), 252.0 / COUNT(*)) - 1", "sharpe": "AVG(ret) / (STDDEV_POP(ret) + 1e-12) * SQRT(252.0)", "max_drawdown": "MIN(dd)"}


@query("backtest_summary", select([*T, *CURVE, DD], "COUNT(*) AS days, (SELECT COUNT(*) FROM trades) AS trades", {**_SUM, "win_rate": "(SELECT AVG(CAST(net_ret > 0 AS DOUBLE)) FROM trades)", "turnover": "(SELECT COUNT(*) FROM trades)::DOUBLE / COUNT(*)", "avg_positions": "(SELECT COUNT(*)::DOUBLE / COUNT(DISTINCT date_in) FROM trades)"}, "ddn"))
def _(spark, d):
    t, prices = trades(spark, d), panel(spark, d)
    return rounded(bt.backtest_summary(t, bt.equity_curve(t, prices)), ["final_equity", "cagr", "sharpe", "max_drawdown", "win_rate", "turnover", "avg_positions"], "days", "trades")


@query("risk_ratios", select([*T, *CURVE, DD], "COUNT(*) AS days", {"sharpe": _SUM["sharpe"], "sortino": "AVG(ret) / (COALESCE(STDDEV_SAMP(CASE WHEN ret < 0 THEN ret END), 0) + 1e-12) * SQRT(252.0)", "max_drawdown": "MIN(dd)", "final_equity": _SUM["final_equity"], "cagr": _SUM["cagr"], "calmar": f"({_SUM['cagr']}) / NULLIF(ABS(MIN(dd)), 0)"}, "ddn"))
def _(spark, d):
    return rounded(mt.risk_stats(bt.equity_curve(trades(spark, d), panel(spark, d))), ["sharpe", "sortino", "max_drawdown", "final_equity", "cagr", "calmar"], "days")


@query("open_positions", f"WITH {', '.join(T)}, e AS (SELECT date_in AS date, 1 AS x FROM trades UNION ALL SELECT date_out, -1 FROM trades), g AS (SELECT date, SUM(x) AS x FROM e GROUP BY date) SELECT date, CAST(SUM(x) OVER (ORDER BY date) AS BIGINT) AS open_positions FROM g")
def _(spark, d):
    return bt.open_positions(trades(spark, d))


_YEAR = ["yc AS (SELECT *, EXTRACT(year FROM date) AS year, PRODUCT(1 + ret) OVER (PARTITION BY EXTRACT(year FROM date) ORDER BY date) AS eq FROM curve)", "yd AS (SELECT *, eq / MAX(eq) OVER (PARTITION BY year ORDER BY date) - 1 AS dd FROM yc)",
         "yt AS (SELECT EXTRACT(year FROM date_in) AS year, COUNT(*) AS trades, AVG(CAST(net_ret > 0 AS DOUBLE)) AS win_rate, AVG(net_ret) AS avg_ret FROM trades GROUP BY 1)",
         "ya AS (SELECT year, COUNT(*) AS days, MAX_BY(eq, date) AS growth, AVG(ret) / (STDDEV_POP(ret) + 1e-12) * SQRT(252.0) AS sharpe, MIN(dd) AS max_drawdown FROM yd GROUP BY year)"]


@query("yearly_metrics", select([*T, *CURVE, *_YEAR], "CAST(ya.year AS INT) AS year, days, trades", {"growth": "growth", "sharpe": "sharpe", "max_drawdown": "max_drawdown", "cagr": "POW(growth, 252.0 / days) - 1", "win_rate": "win_rate", "avg_ret": "avg_ret"}, "ya LEFT JOIN yt ON ya.year = yt.year", digits=4))
def _(spark, d):
    t = trades(spark, d)
    out = bt.yearly_metrics(t, bt.equity_curve(t, panel(spark, d)))
    return rounded(out, ["growth", "sharpe", "max_drawdown", "cagr", "win_rate", "avg_ret"], "year", "days", "trades", digits=4)


@query("regime_trade_metrics", select([*T, *FLAGS, BUCKETS], "trend, vol, COUNT(*) AS trades", {"win_rate": "AVG(CAST(net_ret > 0 AS DOUBLE))", "avg_ret": "AVG(net_ret)", "compounded": "EXP(SUM(LN(1 + net_ret))) - 1"}, "trades LEFT JOIN buckets ON date_in = date", "GROUP BY GROUPING SETS ((trend), (vol), (trend, vol))", digits=4))
def _(spark, d):
    return rounded(bt.regime_trade_metrics(trades(spark, d), reg.vol_buckets(panel(spark, d))), ["win_rate", "avg_ret", "compounded"], "trend", "vol", "trades", digits=4)


@query("cost_after_the_fact", select([*T, "u AS (SELECT 'before' AS stage, net_ret AS x FROM trades UNION ALL SELECT 'after', net_ret - 0.002 FROM trades)"], "stage", {"avg_ret": "AVG(x)", "sharpe": "AVG(x) / (STDDEV_SAMP(x) + 1e-12) * SQRT(252.0)", "win_rate": "AVG(CAST(x > 0 AS DOUBLE))"}, "u", "GROUP BY stage"))
def _(spark, d):
    return rounded(bt.cost_after_the_fact(trades(spark, d)), ["avg_ret", "sharpe", "win_rate"], "stage")


T0 = trades_sql(cost=0.0)
_SWEEP = ["sw AS (SELECT c.cost_bps, date_in, AVG((1 + net_ret) * (1 - cost_bps / 1e4) / (1 + cost_bps / 1e4) - 1) AS x FROM trades, (SELECT UNNEST([0.0, 10.0, 25.0, 50.0, 100.0])::DOUBLE AS cost_bps) c GROUP BY 1, 2)",
          "gr AS (SELECT cost_bps, date, COALESCE(x, 0) AS ret FROM (SELECT DISTINCT cost_bps FROM sw) CROSS JOIN (SELECT DISTINCT date FROM panel) LEFT JOIN sw ON sw.cost_bps = gr0.cost_bps AND date_in = date)"]
_SWEEP[1] = "gr AS (SELECT a.cost_bps, b.date, COALESCE(x, 0) AS ret FROM (SELECT DISTINCT cost_bps FROM sw) a CROSS JOIN (SELECT DISTINCT date FROM panel) b LEFT JOIN sw ON sw.cost_bps = a.cost_bps AND sw.date_in = b.date)"


def _sweep_tail(keys: str) -> list[str]:
    return [f"ge AS (SELECT *, PRODUCT(1 + ret) OVER (PARTITION BY {keys} ORDER BY date) AS equity FROM gr)", f"gd AS (SELECT *, equity / MAX(equity) OVER (PARTITION BY {keys} ORDER BY date) - 1 AS dd FROM ge)"]


@query("cost_sweep", select([*T0, *_SWEEP, *_sweep_tail("cost_bps")], "cost_bps, COUNT(*) AS days", _SUM, "gd", "GROUP BY cost_bps", digits=4))
def _(spark, d):
    t = bt.backtest_topk(preds(spark, d), panel(spark, d), K, HOLD, 0.0, 0.0, gate=False)
    return rounded(bt.cost_sweep(t, panel(spark, d), [0.0, 10.0, 25.0, 50.0, 100.0]), list(_SUM), "cost_bps", "days", digits=4)


_PS = [*PREDS, TOP, CAL, "bars AS (SELECT date, ticker, close, i FROM panel JOIN cal USING (date))", "kk AS (SELECT UNNEST([5, 10, 20])::INT AS top_k)", "hh AS (SELECT UNNEST([2, 4])::INT AS hold_days)",
       "sw AS (SELECT top_k, hold_days, t.date AS date_in, AVG(y.close / x.close - 1) AS x FROM tp t JOIN bars x ON t.date = x.date AND t.ticker = x.ticker CROSS JOIN hh JOIN bars y ON y.ticker = t.ticker AND y.i = x.i + hold_days JOIN kk ON t.rank <= top_k GROUP BY 1, 2, 3)",
       "gr AS (SELECT a.top_k, a.hold_days, b.date, COALESCE(x, 0) AS ret FROM (SELECT DISTINCT top_k, hold_days FROM sw) a CROSS JOIN (SELECT DISTINCT date FROM panel) b LEFT JOIN sw ON sw.top_k = a.top_k AND sw.hold_days = a.hold_days AND sw.date_in = b.date)"]


@query("param_sweep", select([*_PS, *_sweep_tail("top_k, hold_days")], "top_k, hold_days, COUNT(*) AS days", {k: v for k, v in _SUM.items()}, "gd", "GROUP BY top_k, hold_days", digits=3))
def _(spark, d):
    return rounded(bt.param_sweep(preds(spark, d), panel(spark, d), [5, 10, 20], [2, 4]), list(_SUM), "top_k", "hold_days", "days", digits=3)


@query("stress_acceptance", select([*T0, *_SWEEP, *_sweep_tail("cost_bps")], "cost_bps", {"sharpe": _SUM["sharpe"], "max_drawdown": "MIN(dd)"}, "gd", "GROUP BY cost_bps", digits=4).replace(" FROM raw_", ", sharpe >= 0.5 AND max_drawdown >= -0.30 AS passed FROM raw_"))
def _(spark, d):
    t = bt.backtest_topk(preds(spark, d), panel(spark, d), K, HOLD, 0.0, 0.0, gate=False)
    out = bt.stress_acceptance(bt.cost_sweep(t, panel(spark, d), [0.0, 10.0, 25.0, 50.0, 100.0]).withColumn("win_rate", F.lit(1.0)))
    return rounded(out, ["sharpe", "max_drawdown"], "cost_bps", "passed", digits=4)


@query("block_bootstrap")
def _(spark, d):
    return rounded(bt.block_bootstrap(bt.equity_curve(trades(spark, d), panel(spark, d))), ["mean", "std", "p5", "p95"], "metric")


@query("cost_model")
def _(spark, d):
    """Cost models applied to the trades: mean return per model."""
    models = bt.cost_model(spark, {"delivery": {"per_side_bps": 5.0, "components": {"tax": 10.0, "stamp": 1.5}, "slippage_bps": 12.0}, "intraday": {"components": {"tax": 2.5, "fee": 3.0}, "slippage_bps": 5.0}})
    c = (F.col("total_bps") + F.col("slippage_bps")) / 1e4
    t = bt.backtest_topk(preds(spark, d), panel(spark, d), K, HOLD, 0.0, 0.0, gate=False).join(F.broadcast(models))
    return rounded(t.groupBy("name", "total_bps").agg(F.avg((1 + F.col("net_ret")) * (1 - c) / (1 + c) - 1).alias("avg_ret")), ["avg_ret"], "name", "total_bps")


# Scenarios

RET0 = "r0 AS (SELECT *, COALESCE(close / NULLIF(LAG(close) OVER (PARTITION BY ticker ORDER BY date), 0) - 1, 0) AS ret FROM panel)"
_W = "(PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@query("shock_volatility", select([P, RET0], "date, ticker", {"close": f"FIRST_VALUE(close) OVER {_W} * PRODUCT(1 + 0.001 * ret) OVER {_W}"}, "r0", digits=3))
def _(spark, d):
    return rounded(bt.shock_volatility(panel(spark, d), 0.001), ["close"], "date", "ticker", digits=3)


@query("shock_crash", select([P, CAL, "md AS (SELECT FLOOR((MAX(i) + 1) / 2) AS mid FROM cal)"], "date, ticker", {"close": "CASE WHEN i >= mid THEN close * (1 - 0.2 * GREATEST(0, 1 - (i - mid) / 20.0)) ELSE close END"}, "panel JOIN cal USING (date), md", digits=4))
def _(spark, d):
    return rounded(bt.shock_crash(panel(spark, d), recovery=20), ["close"], "date", "ticker", digits=4)


@query("shock_correlation", select([P, f"b AS (SELECT *, LAST_VALUE(CASE WHEN date < DATE '1996-06-01' THEN close END IGNORE NULLS) OVER {_W} AS base FROM panel)", "g AS (SELECT *, CASE WHEN date BETWEEN DATE '1996-06-01' AND DATE '1996-12-31' THEN close / base END AS growth FROM b)"], "date, ticker", {"close": "CASE WHEN date BETWEEN DATE '1996-06-01' AND DATE '1996-12-31' AND base IS NOT NULL THEN base * AVG(growth) OVER (PARTITION BY date) ELSE close END"}, "g", digits=4))
def _(spark, d):
    return rounded(bt.shock_correlation(panel(spark, d), "1996-06-01", "1996-12-31"), ["close"], "date", "ticker", digits=4)


@query("shock_tail")
def _(spark, d):
    return rounded(bt.shock_tail(panel(spark, d)), ["close"], "date", "ticker")


