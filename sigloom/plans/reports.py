"""Registered queries of scorecards, gates, alignment checks, report readers and feature selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.windows import cummax
from ..operators import diagnostics as dg
from ..operators import labels as lab
from ..operators import ml, reports, selection
from ..operators import splits as sp
from ..sources import scans as sc
from ..sources import sinks as sk
from ..sources.csv_folder import csv_report
from ..sources.fundamental_pages import page_fundamentals
from ..tables import scratch, written
from .base import QUERIES, SQL, corr_agg, query, rounded, select, win
from .core import LABEL_CTES, OHLC, P, PREDS, preds, rows_sql
from .diagnosis import FEATURES, WIDE, wide
from .evaluation import CURVE, T, TS, trades
from .fixtures import FUNDAMENTALS_SQL, fundamentals, panel, table

CARD = [
    *PREDS,
    "ranks AS (SELECT sector, RANK() OVER (PARTITION BY sector ORDER BY proba) + (COUNT(*) OVER (PARTITION BY sector, proba) - 1) / 2.0 AS a, "
    "RANK() OVER (PARTITION BY sector ORDER BY excess_fwd) + (COUNT(*) OVER (PARTITION BY sector, excess_fwd) - 1) / 2.0 AS b FROM preds)",
    f"ranked AS (SELECT sector, {corr_agg('a', 'b', 10)} AS rank_ic FROM ranks GROUP BY sector)",
    "card AS (SELECT sector, COUNT(excess_fwd) AS trades, " + ", ".join(f"{v} AS {k}" for k, v in TS.items()) + f", {corr_agg('proba', 'excess_fwd', 10)} AS return_ic, "
    f"{corr_agg('proba * volume', 'excess_fwd', 10)} AS contribution_ic, ANY_VALUE(rank_ic) AS rank_ic FROM preds JOIN ranked USING (sector) GROUP BY sector)",
]
CARD_COLUMNS = [*TS, "return_ic", "contribution_ic", "rank_ic"]


def card(spark, d):
    return reports.trading_scorecard(preds(spark, d), "sector", size="volume")


@query("trading_scorecard", select(CARD, "sector, trades", {c: c for c in CARD_COLUMNS}, "card"))
def _(spark, d):
    return rounded(card(spark, d), CARD_COLUMNS, "sector", "trades")


_REASON = "CASE WHEN expected_value < 0.001 THEN 'expected_value' WHEN profit_factor < 1.0 THEN 'profit_factor' WHEN hit_rate < 0.55 THEN 'hit_rate' ELSE 'pass' END AS decision"


@query("decision_gate", select(CARD, f"sector, {_REASON}", {"hit_rate": "hit_rate"}, "card"))
def _(spark, d):
    return rounded(reports.decision_gate(card(spark, d)), ["hit_rate"], "sector", "decision")


_BAND = "CASE WHEN return_ic IS NULL THEN NULL WHEN return_ic < 0.02 THEN 'noise' WHEN return_ic < 0.05 THEN 'marginal' WHEN return_ic < 0.08 THEN 'viable' ELSE 'strong' END AS band"


@query("target_gap", select(CARD, f"sector, {_BAND}", {"gap": "0.08 - return_ic", "needed": "(0.08 - return_ic) / NULLIF(return_ic, 0)"}, "card", digits=4))
def _(spark, d):
    return rounded(reports.target_gap(card(spark, d), "return_ic"), ["gap", "needed"], "sector", "band", digits=4)


@query("pred_truth_join", select([*PREDS, "truth AS (SELECT date, ticker, excess_fwd FROM labelled WHERE volume > 20)"], "preds.date, preds.ticker", {"proba": "proba", "excess_fwd": "truth.excess_fwd"}, "preds JOIN truth ON preds.date = truth.date AND preds.ticker = truth.ticker"))
def _(spark, d):
    truth = lab.label_excess(panel(spark, d)).where("volume > 20").select("date", "ticker", "excess_fwd")
    return rounded(reports.pred_truth_join(preds(spark, d), truth), ["proba", "excess_fwd"], "date", "ticker")


_AGAIN = [P, *LABEL_CTES, "again AS (SELECT date, ticker, LEAD(close, 10) OVER (PARTITION BY ticker ORDER BY date) / NULLIF(close, 0) - 1 AS recomputed FROM panel)",
          "kept AS (SELECT date, ticker, fwd_ret + CASE WHEN ticker % 7 = 0 THEN 0.01 ELSE 0 END AS stored FROM labelled)"]


def _stored(spark, d):
    """Forward returns as they might lie in a file, those of every seventh ticker off by a percent."""
    off = F.when(F.col("ticker") % 7 == 0, 0.01).otherwise(0.0)
    return lab.label_excess(panel(spark, d)).withColumn("fwd_ret", F.col("fwd_ret") + off)


@query("fwd_alignment_join", select(_AGAIN, "date, ticker", {"stored": "stored", "recomputed": "recomputed", "distance": "ABS(stored - recomputed)"}, "kept LEFT JOIN again USING (date, ticker)"))
def _(spark, d):
    return rounded(reports.fwd_alignment_join(_stored(spark, d), panel(spark, d)), ["stored", "recomputed", "distance"], "date", "ticker")


@query("verify_misalignment", "WITH " + ", ".join(_AGAIN) + " SELECT COUNT(stored) AS n, MAX(ABS(stored - recomputed)) <= 1e-6 AS aligned FROM kept JOIN again USING (date, ticker)")
def _(spark, d):
    """The check of forward returns on a table where some are off."""
    return dg.verify_forward_alignment(_stored(spark, d)).select("n", "aligned")


_OWN = ", ".join(f"ABS({corr_agg(f, 'excess_fwd', 10)}) < 0.05 AS t_{f}" for f in FEATURES)


@query("leakage_verdict", f"WITH {', '.join(WIDE)}, one AS (SELECT {_OWN} FROM wide), tests AS (" + " UNION ALL ".join(f"SELECT '{f}' AS test, COALESCE(t_{f}, true) AS passed FROM one" for f in FEATURES) + ") SELECT COUNT(*) AS tests, COUNT(*) FILTER (WHERE passed) AS passed, CASE WHEN COUNT(*) FILTER (WHERE passed) = COUNT(*) THEN 'clean' WHEN COUNT(*) FILTER (WHERE passed) >= COUNT(*) - 1 THEN 'review' ELSE 'leak' END AS verdict FROM tests")
def _(spark, d):
    """A feature passes whose correlation with the label is below 0.05."""
    ics = dg.feature_ics(dg.unpivot(wide(spark, d), FEATURES, "date", "ticker", "excess_fwd"))
    return dg.leakage_verdict(ics.select(F.col("feature").alias("test"), F.coalesce(F.abs("ic") < 0.05, F.lit(True)).alias("passed")))


_READY = ", ".join(f"{k} AS ({SQL[v]})" for k, v in {"ra": "roc_auc", "rb": "backtest_summary", "rc": "stress_acceptance", "rd": "drift_alerts", "re": "ic_daily"}.items())
_CHECKS = {"roc_auc": ("(SELECT roc_auc FROM ra)", 0.55), "sharpe": ("(SELECT sharpe FROM rb)", 0.5), "max_drawdown": ("(SELECT max_drawdown FROM rb)", -0.25), "stress_pass_rate": ("(SELECT AVG(CAST(passed AS DOUBLE)) FROM rc)", 0.5), "health": ("(SELECT CAST(health AS DOUBLE) FROM rd)", 60.0)}
_READY += ", rv AS (" + " UNION ALL ".join(f"SELECT '{k}' AS name, CAST(COALESCE({v}, 0) AS DOUBLE) AS value, CAST({b} AS DOUBLE) AS bound, COALESCE({v}, 0) > {b} AS passed" for k, (v, b) in _CHECKS.items())
_READY += " UNION ALL SELECT 'plausible', COALESCE((SELECT AVG(ic) FROM re), 0), 0.03, NOT ((SELECT sharpe FROM rb) > 3 AND (SELECT AVG(ic) FROM re) < 0.03))"


@query("readiness_checks", select([_READY], "name, passed, CASE WHEN BOOL_AND(passed) OVER () THEN 'approved' ELSE 'not ready' END AS verdict", {"value": "value", "bound": "bound"}, "rv", digits=4))
def _(spark, d):
    """The verdict on the metric tables of the other queries: AUC, backtest, stress, drift, daily IC."""
    tables = [QUERIES[q](spark, d) for q in ("roc_auc", "backtest_summary", "stress_acceptance", "drift_alerts", "ic_daily")]
    return rounded(reports.readiness_checks(*tables), ["value", "bound"], "name", "passed", "verdict", digits=4)


@query("ts_cummax", select([P], "date, ticker", {"peak": f"MAX(close) OVER {win(None)}", "drawdown": f"close / MAX(close) OVER {win(None)} - 1"}, "panel"))
def _(spark, d):
    out = panel(spark, d).withColumn("peak", cummax("close"))
    return rounded(out.withColumn("drawdown", F.col("close") / F.col("peak") - 1), ["peak", "drawdown"], "date", "ticker")


# Readers


def _bars(spark, d):
    return panel(spark, d).select("date", *OHLC, F.concat(F.lit("t"), F.col("ticker").cast("string")).alias("ticker"))


def _commas(c):
    """A whole number as text with thousands separators."""
    return F.format_string("%,d", F.floor(c).cast("long"))


def _three_layouts(spark, rows, number):
    """Files of a key each, in three layouts: plain; columns in another order, all quoted, with commas and one more
    column; names in upper case with blanks around them."""
    path = scratch(spark)
    kind = number % 3
    figures = [c for c in rows.columns if c not in ("date", "ticker", "sector", "volume")]
    sk.csv_per_key(rows.where(kind == 0), path, "ticker")
    turned = rows.where(kind == 1).select("ticker", F.lit("a, b").alias("note"), _commas("volume").alias("volume"), *figures[::-1], "date", *[c for c in ("sector",) if c in rows.columns])
    sk.csv_per_key(turned, path, "ticker", quoteAll=True)
    loud = rows.where(kind == 2)
    sk.csv_per_key(loud.toDF(*[c if c == "ticker" else f" {c.upper()} " for c in loud.columns]), path, "ticker", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return path


@query("scan_csv_per_ticker", rows_sql([P], "panel", keys="date, 'T' || CAST(ticker AS VARCHAR) AS ticker, CAST(sector AS VARCHAR) AS sector"))
def _(spark, d):
    """Bars written as one CSV per ticker in three layouts, and read by file name."""
    bars = panel(spark, d).select("date", *OHLC, "sector", F.concat(F.lit("t"), F.col("ticker").cast("string")).alias("ticker"))
    path = _three_layouts(spark, bars, F.substring("ticker", 2, 20).cast("long"))
    return rounded(sc.csv_per_ticker(spark, path), OHLC, "date", "ticker", "sector")


@query("scan_csv_fallback", rows_sql([P], "panel", keys="date, CASE WHEN ticker % 2 = 0 THEN 'T' || CAST(ticker AS VARCHAR) ELSE 't' || CAST(ticker AS VARCHAR) END AS ticker"))
def _(spark, d):
    """Files per ticker without a ticker column, in three layouts, and other files with one."""
    rows, code = _bars(spark, d), F.substring("ticker", 2, 20).cast("long")
    path = _three_layouts(spark, rows.where(code % 2 == 0), code)
    rows.where(code % 2 == 1).write.option("header", True).mode("append").csv(path)
    return rounded(sc.csv_fallback(spark, path), OHLC, "date", "ticker")


def _delivery_files(spark, d):
    """Delivery files per sector in two layouts; those of sector 3 lack the traded quantity."""
    df = panel(spark, d).select("sector", F.date_format("date", "dd-MMM-yyyy").alias("DATE"), F.concat(F.lit("S"), F.col("ticker").cast("string")).alias("TradingSymbol"), _commas("delivery_qty").alias("DeliveryQty"), _commas("volume").alias(" TradedQty"))
    path = scratch(spark)
    for keep, columns in (("sector < 2", ["DATE", "TradingSymbol", "DeliveryQty", " TradedQty"]), ("sector in (2, 4)", [" TradedQty", "TradingSymbol", "DATE", "DeliveryQty"]), ("sector = 3", ["TradingSymbol", "DATE", "DeliveryQty"])):
        df.where(keep).select(*columns).write.option("header", True).option("ignoreLeadingWhiteSpace", False).mode("append").csv(path)
    return path


@query("scan_delivery_csv", select([P], "date, 'S' || CAST(ticker AS VARCHAR) AS ticker", {"delivery_qty": "delivery_qty", "traded_qty": "volume", "delivery_ratio": "delivery_qty / NULLIF(volume, 0)"}, "panel", "WHERE sector <> 3"))
def _(spark, d):
    return rounded(sc.delivery_csv(spark, _delivery_files(spark, d)), ["delivery_qty", "traded_qty", "delivery_ratio"], "date", "ticker")


@query("scan_csv_report", f"WITH {P} SELECT sector = 3 AS left_out, CASE WHEN sector = 3 THEN 'tradedqty' ELSE '' END AS missing, COUNT(*) AS rows FROM panel GROUP BY 1, 2")
def _(spark, d):
    """What the delivery reader leaves out, and why."""
    report = csv_report(spark, _delivery_files(spark, d), sc.DELIVERY)
    return report.groupBy("left_out", F.array_join("missing", ",").alias("missing")).agg(F.sum("rows").alias("rows"))


@query("scan_ownership_csv", select([P], "date, CAST(ticker AS VARCHAR) AS ticker", {"fii_hold": "fii_hold", "dii_hold": "CASE WHEN sector > 1 THEN dii_hold END", "mcap": "CASE WHEN sector > 1 THEN FLOOR(volume * 1000) END"}, "panel", digits=8))
def _(spark, d):
    """Holdings in two files of differing columns, order and quoting."""
    df, path = panel(spark, d), scratch(spark)
    df.where("sector <= 1").select(F.col("fii_hold").alias("FII_HOLD"), "ticker", "date").write.option("header", True).csv(path)
    rich = df.where("sector > 1").select("ticker", "date", _commas(F.col("volume") * 1000).alias("mcap"), "dii_hold", "fii_hold")
    rich.write.option("header", True).option("quoteAll", True).mode("append").csv(path)
    return rounded(sc.ownership_csv(spark, path), ["fii_hold", "dii_hold", "mcap"], "date", "ticker", digits=8)


@query("scan_fundamental_csv", select([FUNDAMENTALS_SQL], "CAST(symbol AS VARCHAR) AS ticker, report_date", {"eps": "FLOOR(eps)", "revenue": "FLOOR(revenue + 0.005)", "pe": "CASE WHEN sector > 2 THEN n_orders END"}, "fundamentals"))
def _(spark, d):
    df, path = fundamentals(spark, d).withColumns({"eps": F.floor("eps").cast("long"), "revenue": _commas(F.col("revenue") + 0.005)}), scratch(spark)
    df.where("sector <= 2").select(F.col("symbol").alias("Ticker"), "report_date", "revenue", "eps").write.option("header", True).csv(path)
    df.where("sector > 2").select("eps", F.col("n_orders").alias("PE"), "revenue", F.date_format("report_date", "dd-MMM-yyyy").alias("Report_Date"), F.col("symbol").alias(" ticker")).write.option("header", True).mode("append").csv(path)
    return rounded(sc.fundamental_csv(spark, path), ["eps", "revenue", "pe"], "ticker", "report_date")


QUARTERS = """q AS (SELECT symbol, last_day(CAST(report_date + INTERVAL 2 MONTH AS DATE)) AS report_date, FLOOR(revenue + 0.005) AS revenue, FLOOR(net_income + 0.005) AS net_income, CAST(FLOOR(eps + 0.0037) AS DOUBLE) AS eps, CAST(n_orders AS DOUBLE) AS operating_profit, ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY report_date DESC) AS k FROM fundamentals),
all_ AS (SELECT 'N' || CAST(symbol AS VARCHAR) AS symbol, report_date, revenue, operating_profit, net_income, eps, CASE WHEN k = 1 THEN revenue * 1e7 END AS market_cap, CASE WHEN k = 1 THEN eps END AS book_value_per_share, CASE WHEN k = 1 THEN operating_profit END AS roe, NULL AS pe_ratio FROM q
UNION ALL SELECT 'S' || CAST(s_suppkey AS VARCHAR), NULL, NULL, NULL, NULL, NULL, FLOOR(s_acctbal) * 1e7, NULL, NULL, CASE WHEN s_acctbal >= 0 THEN CAST(s_nationkey AS DOUBLE) END FROM supplier)"""
PAGE_FIGURES = ["revenue", "operating_profit", "net_income", "eps", "market_cap", "book_value_per_share", "roe", "pe_ratio"]


@query("html_fundamentals_extract", select([FUNDAMENTALS_SQL, QUARTERS], "symbol, report_date", {c: c for c in PAGE_FIGURES}, "all_"))
def _(spark, d):
    """Company pages drawn from the figures, with tables of quarters and lists of ratios, and read again."""
    q = fundamentals(spark, d).select(
        "symbol", "report_date", F.date_format(F.add_months("report_date", 2), "MMM yyyy").alias("head"), _commas(F.col("revenue") + 0.005).alias("sales"),
        _commas(F.col("net_income") + 0.005).alias("net"), F.floor(F.col("eps") + 0.0037).cast("long").cast("string").alias("eps"), F.col("n_orders").cast("string").alias("op"),
    )
    q = q.groupBy("symbol").agg(F.reverse(F.array_sort(F.collect_list(F.struct("report_date", "head", "sales", "net", "eps", "op")))).alias("q"))
    row = lambda label, c: F.concat(F.lit(f"<tr><td>{label}</td><td>"), F.array_join(F.col(f"q.{c}"), "</td>\n<td>"), F.lit("</td></tr>"))
    item = lambda name, value: F.concat(F.lit(f'<li class="flex flex-space-between"><span class="name">\n {name} </span><span class="nowrap"><span class="number">'), value, F.lit("</span></span></li>"))
    first = F.col("q")[0]
    table_ = F.concat(F.lit('<section id="quarters"><h2>Quarters</h2><table class="data-table x"><thead><tr><th></th><th>'), F.array_join("q.head", "</th><th>"), F.lit("</th></tr></thead><tbody>"), row("Sales", "sales"), row("Expenses", "op"), row(" Operating Profit ", "op"), row("Net Profit", "net"), row("EPS in Rs", "eps"), F.lit("</tbody></table></section>"))
    ratios = F.concat(F.lit("<ul>"), item("Market Cap", F.concat(first["sales"], F.lit(" Cr."))), item("Book Value", first["eps"]), item("ROE", F.concat(first["op"], F.lit(" %"))), item("Stock P/E", F.lit("-")), F.lit("</ul>"))
    drawn = q.select(F.concat(F.lit("N"), F.col("symbol").cast("string")).alias("symbol"), F.concat(F.lit("<html><body><main>"), ratios, table_, F.lit("</main></body></html>")).alias("html"))
    cap = item("Market Cap", F.concat(_commas("s_acctbal"), F.lit(" Cr.")))
    pe = F.when(F.col("s_acctbal") >= 0, item("Stock P/E", F.col("s_nationkey").cast("string"))).otherwise(F.lit("<li>Stock P/E 5</li>"))
    bare = table(spark, d, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("symbol"), F.concat(F.lit("<ul>"), cap, pe, F.lit("</ul>")).alias("html"))
    return rounded(page_fundamentals(drawn.unionByName(bare)), PAGE_FIGURES, "symbol", "report_date")


@query("scan_wide_csv", rows_sql([P], "panel", keys="date, CAST(ticker AS VARCHAR) AS ticker"))
def _(spark, d):
    """A CSV with canonical columns, thousands separators and a bad row."""
    path = scratch(spark)
    commas = lambda c: F.concat(F.expr(f"regexp_replace(format_string('%d', cast(floor({c}) as bigint)), '(?<=\\\\d)(?=(\\\\d{{3}})+$)', ',')"), F.expr(f"substring(cast({c} - floor({c}) as string), 2)"))
    rows = panel(spark, d).select(F.col("date").cast("string").alias(" Date"), F.col("ticker").cast("string").alias("Ticker"), commas("volume").alias("Volume"), *[F.col(c).cast("string").alias(c.title()) for c in OHLC if c != "volume"])
    bad = rows.limit(1).withColumn(" Date", F.lit("no date"))
    rows.unionByName(bad).write.option("header", True).csv(path)
    return rounded(sc.wide_csv(spark, path, OHLC), OHLC, "date", "ticker")


@query("scan_predictions", select(PREDS, "date, ticker, label", {"proba": "proba"}, "preds"))
def _(spark, d):
    path = scratch(spark)
    sk.write_csv(preds(spark, d).select("date", "ticker", "proba", "label"), path)
    return rounded(sc.report_csv(spark, path, "date date, ticker long, proba double, label int"), ["proba"], "date", "ticker", "label")


@query("scan_trades", select(T, "date_in, date_out, ticker", {"net_ret": "net_ret"}, "trades"))
def _(spark, d):
    path = scratch(spark)
    sk.write_csv(trades(spark, d).select("date_in", "date_out", "ticker", "net_ret"), path)
    return rounded(sc.report_csv(spark, path, "date_in date, date_out date, ticker long, net_ret double"), ["net_ret"], "date_in", "date_out", "ticker")


@query("scan_equity", select([*T, *CURVE], "date", {"ret": "ret"}, "curve"))
def _(spark, d):
    from ..operators import backtest as bt

    path = scratch(spark)
    sk.write_csv(bt.equity_curve(trades(spark, d), panel(spark, d)).select("date", "ret"), path)
    return rounded(sc.report_csv(spark, path, "date date, ret double"), ["ret"], "date")


# Selection and meta models, which refit per feature and fold


def _frame(spark, d):
    """The wide panel, written once, since every fit reads it, and its folds."""
    path = written(wide(spark, d).select("date", "ticker", "label", "excess_fwd", *FEATURES).fillna(0.0, FEATURES))
    df = spark.read.parquet(path)
    return df, sp.folds_expanding(df, 1095, 730)


@query("oos_ic_filter")
def _(spark, d):
    return selection.oos_ic_filter(*_frame(spark, d), FEATURES)


@query("group_selection")
def _(spark, d):
    return selection.group_selection(*_frame(spark, d), FEATURES)


@query("backward_elimination")
def _(spark, d):
    return selection.backward_elimination(*_frame(spark, d), FEATURES)


@query("gate_incremental")
def _(spark, d):
    return selection.gate_incremental(*_frame(spark, d), FEATURES[:3], FEATURES[3])


META = ["ret_5d", "vol_20", "drawdown_20", "market_vol_20", "market_trend_50_200"]


@query("meta_model")
def _(spark, d):
    """A model of which signals pay, from those before 1997; the later signals that it keeps."""
    context = ml.meta_features(panel(spark, d)).select("date", "ticker", *META)
    signals = preds(spark, d).where("proba > 0.7").select("date", "ticker", "proba", "excess_fwd").join(context, ["date", "ticker"]).fillna(0.0, META)
    signals = spark.read.parquet(written(signals))
    model = selection.meta_model(signals.where("date < '1997-01-01'"), META)
    return rounded(selection.meta_filter(model, signals.where("date >= '1997-01-01'")), ["meta_proba"], "date", "ticker")
