"""Registered queries of sources, sinks, models, cards and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as mt
from ..operators import ml
from ..operators import panel as pn
from ..operators import regimes as reg
from ..operators import splits as sp
from ..sources import scans as sc
from ..sources import sinks as sk
from ..streaming import daily
from ..tables import once, scratch, written
from .base import corr_roll, lagged, m, mn, mx, pc, query, rounded, s, select, win
from .core import OHLC, P, PREDS, preds, rows_sql
from .diagnosis import FEATURES, WIDE, wide
from .fixtures import MEMBERSHIP_SQL, membership, panel, table


# Sources


@query("scan_price_parquet", rows_sql([P, MEMBERSHIP_SQL], "panel", "WHERE date BETWEEN DATE '1995-01-01' AND DATE '1997-12-31' AND (ticker NOT IN (SELECT ticker FROM membership) OR EXISTS (SELECT 1 FROM membership AS mm WHERE mm.ticker = panel.ticker AND panel.date >= mm.start_date AND panel.date <= COALESCE(mm.end_date, DATE '9999-12-31')))", "date, CAST(ticker AS VARCHAR) AS ticker"))
def _(spark, d):
    path = written(panel(spark, d).withColumnsRenamed({"close": " Close", "ticker": "Ticker"}))
    members = membership(spark, d).withColumn("ticker", F.col("ticker").cast("string"))
    return rounded(sc.price_parquet(spark, path, "1995-01-01", "1997-12-31", members=members), OHLC, "date", "ticker")


@query("scan_multi_parquet", rows_sql([P], "(SELECT * FROM panel UNION ALL SELECT * FROM panel WHERE volume > 50)"))
def _(spark, d):
    df = panel(spark, d)
    return rounded(sc.multi_parquet(spark, written(df), written(df.where("volume > 50"))), OHLC, "date", "ticker")


@query("scan_delivery", select([P], "date, ticker", {"delivery_qty": "delivery_qty", "delivery_ratio": "delivery_qty / (NULLIF(volume, 0) + 1e-9)"}, "panel"))
def _(spark, d):
    df = panel(spark, d).select("date", "ticker", F.col("delivery_qty").alias("DeliveryQty"), F.col("volume").alias("TradedQty"))
    return rounded(sc.delivery(df), ["delivery_qty", "delivery_ratio"], "date", "ticker")


@query("scan_ownership", select([P], "date, ticker", {"fii_hold": "fii_hold", "dii_hold": "dii_hold"}, "panel", digits=8))
def _(spark, d):
    return rounded(sc.ownership(panel(spark, d)), ["fii_hold", "dii_hold"], "date", "ticker", digits=8)


@query("scan_bhavcopy", rows_sql([P], "panel", keys="date, 'S' || CAST(ticker AS VARCHAR) AS ticker"))
def _(spark, d):
    """The panel in an exchange's layout: other names, dates spelled out, numbers with commas."""
    df = panel(spark, d)
    commas = lambda c: F.when(F.col(c) == F.floor(c), F.format_string("%,d", F.floor(c).cast("long"))).otherwise(F.col(c).cast("string"))
    raw = df.select(
        F.concat(F.lit(" s"), F.col("ticker").cast("string")).alias("SYMBOL "), F.upper(F.date_format("date", "dd-MMM-yyyy")).alias("DATE1"), commas("open").alias(" OPEN_PRICE"), commas("high").alias("HIGH_PRICE"),
        commas("low").alias("LOW_PRICE"), commas("close").alias("CLOSE_PRICE"), F.concat(commas("volume"), F.lit(" ")).alias("TTL_TRD_QNTY"), commas("delivery_qty").alias("DELIV_QTY"),
    )
    return rounded(sc.exchange_file(raw), OHLC, "date", "ticker")


@query("scan_security_csv", select([P], "date, CAST(ticker AS VARCHAR) AS ticker, 'Unknown' AS sector", {"close": "close", "delivery_qty": "CASE WHEN volume > 30 THEN delivery_qty ELSE 0 END"}, "panel"))
def _(spark, d):
    df = panel(spark, d)
    raw = df.select(F.col("ticker").cast("string").alias("Symbol "), F.date_format("date", "dd-MMM-yyyy").alias("Date"), F.col("close").cast("string").alias("Close Price"), F.col("volume").cast("string").alias("Total Traded Quantity"), F.when(F.col("volume") > 30, F.col("delivery_qty").cast("string")).alias("Deliverable Qty"))
    return rounded(sc.security_file(raw), ["close", "delivery_qty"], "date", "ticker", "sector")


@query("scan_universe", "SELECT CASE CAST(s_suppkey AS VARCHAR) WHEN '7' THEN 'SEVEN' ELSE CAST(s_suppkey AS VARCHAR) END AS ticker_nse, CASE CAST(s_suppkey AS VARCHAR) WHEN '7' THEN 'SEVEN' ELSE CAST(s_suppkey AS VARCHAR) END AS ticker_yf, n_name AS sector FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def _(spark, d):
    u = table(spark, d, "supplier").join(F.broadcast(table(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    return sc.universe(u.select(F.col("s_suppkey").cast("string").alias("Ticker"), F.col("n_name").alias("sector")), {"7": "SEVEN"})


@query("scan_membership", f"WITH {MEMBERSHIP_SQL} SELECT ticker, start_date, end_date FROM membership")
def _(spark, d):
    text = membership(spark, d).select(F.col("ticker").alias("TICKER"), F.col("start_date").cast("string").alias("start_date"), F.col("end_date").cast("string").alias("end_date"))
    return sc.membership(text)


@query("html_page_cells")
def _(spark, d):
    """The labelled list items and table rows of every page."""
    return sc.page_cells(table(spark, d, "pages")).select("page_id", "row", "label", F.size("texts").alias("n_texts"))


# Sinks


@query("sink_partition_parquet", rows_sql([P], "panel"))
def _(spark, d):
    path = scratch(spark)
    sk.partitioned(panel(spark, d), path, "sector")
    return rounded(spark.read.parquet(path), OHLC, "date", "ticker")


@query("ingest_sources", f"WITH {P} SELECT COUNT(*) AS n FROM panel WHERE volume > 20")
def _(spark, d):
    paths = sk.ingest(spark, {"prices": lambda s_: panel(s_, d).where("volume > 20")}, scratch(spark), {"prices": lambda df: pn.assert_panel(df, 2, 0.1)})
    return spark.read.parquet(paths["prices"]).agg(F.count("*").alias("n"))


@query("cached_materialize", rows_sql([P], "panel"))
def _(spark, d):
    root = scratch(spark)
    sk.kept(spark, root, "panel", lambda: panel(spark, d))
    return rounded(sk.kept(spark, root, "panel", lambda: panel(spark, d).limit(0)), OHLC, "date", "ticker")


@query("sink_csv_json", f"WITH {', '.join(PREDS)} SELECT date, ticker, label FROM preds WHERE proba > 0.9")
def _(spark, d):
    path = scratch(spark)
    df = preds(spark, d).where("proba > 0.9").select("date", "ticker", "label", F.array(F.struct("proba", "close")).alias("detail"))
    sk.write_csv(df, path)
    back = spark.read.option("header", True).csv(path)
    return back.select(F.col("date").cast("date").alias("date"), F.col("ticker").cast("long").alias("ticker"), F.col("label").cast("int").alias("label"))


# Models

def _rows(spark, d):
    return wide(spark, d).select("date", "ticker", "label", "excess_fwd", *FEATURES).fillna(0.0, FEATURES)


def _split(spark, d):
    """Written once, as fits and scores read it many times."""
    return once(sp.split_time(_rows(spark, d), "1996-06-01", "1997-06-01"))


@query("fit_classifier")
def _(spark, d):
    df = _split(spark, d)
    model = ml.fit(df.where("split = 'train'"), FEATURES)
    return rounded(ml.score(model, df.where("split = 'test'")), ["proba"], "date", "ticker", "label")


@query("compare_baseline")
def _(spark, d):
    df = _split(spark, d)
    return ml.compare_baseline(df.where("split = 'train'"), df.where("split = 'test'"), FEATURES)


def _regimes(spark, d):
    return reg.composite(panel(spark, d)).select("date", F.col("composite_regime").alias("regime"))


@query("train_split_report")
def _(spark, d):
    """Metrics per split of the model of all rows and of each regime's, and purged cross-validation."""
    df = _split(spark, d).join(F.broadcast(_regimes(spark, d)), "date", "left")
    return ml.train_report(df, FEATURES, sp.folds_purged(df, 3), kind="logistic")


@query("fit_linear_baseline")
def _(spark, d):
    return ml.linear_baseline(_split(spark, d).where("split = 'train'"), FEATURES)


@query("train_wfo")
def _(spark, d):
    df = once(wide(spark, d).fillna(0.0, FEATURES))
    folds = sp.folds_expanding(df, 730, 365)
    return rounded(ml.walk_forward(df, folds, FEATURES, "logistic")[0], ["proba"], "date", "ticker", "fold")


@query("walk_forward_eval")
def _(spark, d):
    df = once(wide(spark, d).fillna(0.0, FEATURES))
    out, _ = ml.walk_forward(df, sp.folds_anchored(df, step_days=365), FEATURES, "logistic")
    return rounded(out.groupBy("fold").agg(F.count("*").alias("n"), mt.ic("proba", "excess_fwd").alias("ic")), ["ic"], "fold", "n")


@query("train_ensemble")
def _(spark, d):
    df = _split(spark, d)
    return mt.ensemble_combine(ml.ensemble(df.where("split = 'train'"), df.where("split = 'test'"), FEATURES))


@query("param_search_stability")
def _(spark, d):
    df = once(wide(spark, d).fillna(0.0, FEATURES))
    return ml.param_search(df, sp.folds_expanding(df, 1095, 730), FEATURES, [{"kind": "logistic", "regParam": x} for x in (0.01, 0.1)])


@query("permutation_importance")
def _(spark, d):
    df = _split(spark, d)
    return ml.permutation_importance(ml.fit(df.where("split = 'train'"), FEATURES, kind="logistic"), df.where("split = 'test'"), FEATURES)


@query("null_label_test")
def _(spark, d):
    df = _split(spark, d)
    return ml.null_label_test(df.where("split = 'train'"), df.where("split = 'test'"), FEATURES)


for _name, _fn in (("reversed_time_test", sp.split_reversed), ("gap_split_test", sp.split_gap), ("random_split_test", lambda df: sp.split_random(df, "date", "ticker"))):
    query(_name)(lambda spark, d, fn=_fn: ml.split_test(fn(once(_rows(spark, d))), FEATURES))


@query("score_signals")
def _(spark, d):
    """Features on the full history, a model per market regime; the last 60 days scored and ranked within the date."""
    out = ml.score_signals(wide(spark, d).fillna(0.0, FEATURES), _regimes(spark, d), FEATURES, kind="logistic")
    return rounded(out, ["proba"], "date", "ticker", "rank", "model")


COEF = {"momentum__a": 0.4, "momentum__b": -0.2, "volatility__v": 0.1, "turnover__t": 0.3}
_MEANS = "mns AS (SELECT " + ", ".join(f"AVG({f}) AS m_{f}" for f in COEF) + " FROM wide)"
_C = lambda f: f"{COEF[f]!r} * (COALESCE({f}, m_{f}) - m_{f})"


@query("attribute_signals", select([*WIDE, _MEANS, "cb AS (SELECT date, ticker, LIST_REVERSE_SORT([" + ", ".join(f"{{'a': ABS({_C(f)}), 'f': '{f}', 'c': {_C(f)}}}" for f in COEF) + "]) AS l FROM wide, mns)"], "date, ticker, l[1].f AS top_feature", {"contribution": "l[1].c"}, "cb"))
def _(spark, d):
    out = ml.attribute_linear(wide(spark, d), COEF)
    top = F.col("top_features")[0]
    return rounded(out.select("date", "ticker", top["feature"].alias("top_feature"), top["contribution"].alias("contribution")), ["contribution"], "date", "ticker", "top_feature")


@query("attribute_occlusion")
def _(spark, d):
    df = _split(spark, d)
    out = ml.attribute_occlusion(ml.fit(df.where("split = 'train'"), FEATURES), df.where("split = 'test'").select("date", "ticker", *FEATURES), FEATURES, 3)
    return out.select("date", "ticker", "proba", F.col("top_features")[0]["feature"].alias("top_feature"))


@query("topn_struct_per_row", select([*WIDE, "ab AS (SELECT date, ticker, LIST_REVERSE_SORT([" + ", ".join(f"{{'a': COALESCE(ABS({f}), 0), 'f': '{f}'}}" for f in FEATURES) + "]) AS l FROM wide)"], "date, ticker, l[1].f AS first_feature, l[2].f AS second_feature", {"size": "l[1].a"}, "ab"))
def _(spark, d):
    df = wide(spark, d).fillna(0.0, FEATURES)
    top = ml.topn_struct(FEATURES, 2, "")
    out = df.withColumn("top", top).select("date", "ticker", F.col("top")[0]["feature"].alias("first_feature"), F.col("top")[1]["feature"].alias("second_feature"), F.col("top")[0]["abs_contribution"].alias("size"))
    return rounded(out, ["size"], "date", "ticker", "first_feature", "second_feature")


@query("signal_cards", select(PREDS, "date, ticker, CASE WHEN proba >= 0.75 THEN 'high' WHEN proba >= 0.60 THEN 'medium' ELSE 'low' END AS confidence, CASE WHEN proba < 0.55 THEN 1 ELSE 0 END AS n_warnings", {"percentile": "PERCENT_RANK() OVER (PARTITION BY date ORDER BY proba) * 100"}, "preds"))
def _(spark, d):
    out = ml.signal_cards(preds(spark, d)).select("date", "ticker", "confidence", F.size("warnings").alias("n_warnings"), "percentile")
    return rounded(out, ["percentile"], "date", "ticker", "confidence", "n_warnings")


_MF = ["mf0 AS (SELECT date, AVG(close) AS mc, 0 AS ticker FROM panel GROUP BY date)", f"mf1 AS (SELECT *, {pc('mc')} AS mr FROM mf0)", f"mf2 AS (SELECT date, {s('mr', 20)} AS mv, {m('mc', 50, 1)} / {m('mc', 200, 1)} - 1 AS mt FROM mf1)", f"mf3 AS (SELECT *, {pc('close')} AS ret FROM panel)"]


@query("meta_features", select([P, *_MF, f"mf4 AS (SELECT date, ticker, {pc('close', 5)} AS r5, {s('ret', 20)} AS v20, close / MAX(close) OVER {win(20)} - 1 AS dd FROM mf3)"], "x.date, x.ticker", {"ret_5d": "r5", "vol_20": "v20", "drawdown_20": "dd", "market_vol_20": "mv", "market_trend_50_200": "mt"}, "mf4 x LEFT JOIN mf2 USING (date)"))
def _(spark, d):
    return rounded(ml.meta_features(panel(spark, d)), ["ret_5d", "vol_20", "drawdown_20", "market_vol_20", "market_trend_50_200"], "date", "ticker")


_RISK = [P, "rm0 AS (SELECT date, AVG(close) AS close, 0 AS ticker FROM panel GROUP BY date)", f"rm1 AS (SELECT *, {pc('close')} AS mr FROM rm0)", f"rm AS (SELECT date, mr, {s('mr', 10)} / NULLIF({s('mr', 60)}, 0) AS stress FROM rm1)",
         f"rf0 AS (SELECT panel.*, mr, stress, {pc('close')} AS ret, {lagged('close', 10)} / NULLIF({lagged('close', 20)}, 0) - 1 AS r10 FROM panel LEFT JOIN rm USING (date))",
         f"rf1 AS (SELECT *, close / {mx('close', 60)} - 1 AS dd, {s('ret', 20)} AS v, {pc('close', 5)} AS r5, COALESCE(CAST(r10 > 0.015 AS DOUBLE), 0) AS ok FROM rf0)",
         f"rf AS (SELECT date, ticker, dd AS drawdown_60d, GREATEST(0, -dd) AS drawdown_severity, r5 AS ret_5d, r10 AS ret_10d_lag, (v - {m('v', 60, 20)}) / ({s('v', 60, 20)} + 1e-9) AS vol_regime_z, r5 / ({s('ret', 5)} + 1e-9) AS momentum_quality, {m('ok', 20)} AS rolling_win_rate, "
         f"({mx('close', 20)} - close) / NULLIF(close, 0) / ((close - {mn('close', 20)}) / NULLIF(close, 0) + 0.01) AS risk_reward, stress AS market_stress, AVG(CAST(ret > 0 AS DOUBLE)) OVER (PARTITION BY date) AS market_breadth, {corr_roll('ret', 'mr', 20)} AS market_correlation, CAST(ok AS INT) AS success_lag FROM rf1)"]  # fmt: skip
_RF = ["drawdown_60d", "ret_5d", "ret_10d_lag", "vol_regime_z", "momentum_quality", "rolling_win_rate", "risk_reward", "market_stress", "market_breadth", "market_correlation"]


@query("meta_risk_features", select(_RISK, "date, ticker, success_lag", {**{c: c for c in _RF}, "drawdown_severity": "CASE WHEN drawdown_60d IS NOT NULL THEN drawdown_severity ELSE 0 END"}, "rf", digits=4))
def _(spark, d):
    out = ml.meta_risk_features(panel(spark, d)).withColumn("success_lag", F.col("success_lag").cast("int"))
    return rounded(out, [*_RF, "drawdown_severity"], "date", "ticker", "success_lag", digits=4)


_GATES = "COALESCE(drawdown_60d, 0) > -0.95 AND COALESCE(market_stress, 0) < 2 AND COALESCE(rolling_win_rate, 0) > 0.3 AND COALESCE(risk_reward, 0) > 0.5 AND COALESCE(ret_5d, 0) > -0.5 AND COALESCE(market_breadth, 0) > 0.3"


@query("meta_risk_filter", select(_RISK, "date, ticker", {"risk_reward": "risk_reward"}, "rf", f"WHERE {_GATES}", digits=4))
def _(spark, d):
    """All six gates, with bounds for the panel's large weekly moves."""
    kept = ml.meta_risk_filter(ml.meta_risk_features(panel(spark, d)), {"drawdown": -0.95, "win_rate": 0.3, "risk_reward": 0.5, "falling": -0.5})
    return rounded(kept, ["risk_reward"], "date", "ticker", digits=4)


@query("meta_risk_gates", f"WITH {', '.join(_RISK)} SELECT gate, COUNT(*) AS blocked FROM (SELECT UNNEST([CASE WHEN COALESCE(drawdown_60d, 0) <= -0.15 THEN 'drawdown' END, CASE WHEN COALESCE(market_stress, 0) >= 2 THEN 'market_stress' END, CASE WHEN COALESCE(rolling_win_rate, 0) <= 0.5 THEN 'win_rate' END, CASE WHEN COALESCE(risk_reward, 0) <= 1.5 THEN 'risk_reward' END, CASE WHEN COALESCE(ret_5d, 0) <= -0.05 THEN 'falling' END, CASE WHEN COALESCE(market_breadth, 0) <= 0.3 THEN 'breadth' END]) AS gate FROM rf) WHERE gate IS NOT NULL GROUP BY gate")
def _(spark, d):
    """How many rows each gate blocks, at its default bound."""
    rows = ml.meta_risk_gates(ml.meta_risk_features(panel(spark, d)))
    return rows.select(F.explode("blocked_by").alias("gate")).groupBy("gate").agg(F.count("*").alias("blocked"))


@query("kelly_size", select(PREDS, "date, ticker", {"size": "LEAST(0.05, GREATEST(0.0, (proba * 1.5 - (1 - proba)) / 1.5)) / (1 + 10 * fii_hold)"}, "preds"))
def _(spark, d):
    df = preds(spark, d).withColumns({"avg_win": F.lit(0.03), "avg_loss": F.lit(0.02), "vol_20": F.col("fii_hold")})
    return rounded(ml.kelly_size(df), ["size"], "date", "ticker")


@query("stream_daily_files", rows_sql([P], "panel", keys="date, CAST(ticker AS VARCHAR) AS ticker"))
def _(spark, d):
    """The panel dropped as files twice, read as a stream: each bar arrives in the panel once."""
    drop, target, marks = scratch(spark), scratch(spark), scratch(spark)
    rows = panel(spark, d).select("date", F.col("ticker").cast("string").alias("ticker"), *OHLC)
    rows.write.mode("append").parquet(drop)
    rows.write.mode("append").parquet(drop)
    query_ = daily.into_panel(daily.bars(spark, drop, late="5000 days", files="parquet"), target, marks)
    query_.awaitTermination()
    return rounded(spark.read.parquet(target), OHLC, "date", "ticker")


