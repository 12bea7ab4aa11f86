"""Registered queries of cleaning, joins, labels, regimes and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.windows import pct, xs_pct_rank
from ..operators import features as feat
from ..operators import joins as j
from ..operators import labels as lab
from ..operators import panel as p
from ..operators import regimes as reg
from ..operators import splits as sp
from .base import exp_rank, m, near, pc, query, r, rounded, s, select, win, xs_rank
from .fixtures import FUNDAMENTALS_SQL, MEMBERSHIP_SQL, fundamentals, membership, panel, panel_sql, table

P = panel_sql()
OHLC = ["open", "high", "low", "close", "volume"]


def rows_sql(ctes: list[str], source: str, tail: str = "", keys: str = "date, ticker", cols: list[str] = OHLC) -> str:
    return select(ctes, keys, {c: c for c in cols}, source, tail)


# Cleaning and filtering


@query("coerce_schema", "SELECT CAST(l_orderkey AS VARCHAR) AS ticker, CAST(l_shipdate AS DATE) AS date, CAST(l_extendedprice AS DOUBLE) AS close, TRY_CAST(l_returnflag AS DOUBLE) AS flag FROM lineitem")
def _(spark, d):
    df = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("ticker"), F.col("l_shipdate").alias("date"), F.col("l_extendedprice").alias("close"), F.col("l_returnflag").alias("flag"))
    return p.coerce_schema(df, {"ticker": "string", "date": "date", "close": "double", "flag": "double"}, strict=False)


@query("normalize_names", "SELECT n_nationkey, n_name FROM nation")
def _(spark, d):
    return p.normalize_names(table(spark, d, "nation").select(F.col("n_nationkey").alias(" N_NATIONKEY"), F.col("n_name").alias("N_Name ")))


_SYM = "upper(trim('  ' || c_name || CASE WHEN c_custkey % 2 = 0 THEN '_S3' ELSE '.NS' END || ' '))"


def _symbols(spark: SparkSession, d: str) -> DataFrame:
    tail = F.when(F.col("c_custkey") % 2 == 0, "_S3").otherwise(".NS")
    return table(spark, d, "customer").select("c_custkey", F.concat(F.lit("  "), "c_name", tail, F.lit(" ")).alias("ticker"))


@query("normalize_ticker", f"SELECT c_custkey, {_SYM} AS ticker FROM customer")
def _(spark, d):
    return _symbols(spark, d).withColumn("ticker", p.normalize_ticker(F.col("ticker")))


_CLEAN = f"regexp_replace(regexp_replace(regexp_replace({_SYM}, '_S[0-9]+$', ''), '\\.NS$', ''), '[^A-Z0-9&-]', '', 'g')"


@query("clean_symbol", f"SELECT c_custkey, {_CLEAN} AS ticker FROM customer")
def _(spark, d):
    return _symbols(spark, d).withColumn("ticker", p.clean_symbol(F.col("ticker")))


@query("symbol_override", "SELECT n_nationkey, CASE n_name WHEN 'FRANCE' THEN 'FR' WHEN 'CHINA' THEN 'CN' ELSE n_name END AS symbol FROM nation")
def _(spark, d):
    return table(spark, d, "nation").select("n_nationkey", p.symbol_override(F.col("n_name"), {"FRANCE": "FR", "CHINA": "CN"}).alias("symbol"))


@query("clean_universe", f"SELECT DISTINCT ticker FROM (SELECT {_CLEAN} AS ticker FROM customer UNION ALL SELECT regexp_replace(upper(trim(n_name)), '[^A-Z0-9&-]', '', 'g') FROM nation) WHERE length(ticker) > 0")
def _(spark, d):
    return p.clean_universe(_symbols(spark, d), table(spark, d, "nation").select(F.col("n_name").alias("ticker")))


@query("validate_universe", "SELECT n_regionkey AS sector, COUNT(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def _(spark, d):
    s_, n = table(spark, d, "supplier"), table(spark, d, "nation")
    u = s_.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey"))
    return p.validate_universe(u.select(F.col("s_suppkey").alias("ticker_nse"), F.col("s_suppkey").alias("ticker_yf"), F.col("n_regionkey").alias("sector")))


@query("sector_counts", f"WITH {P} SELECT sector, COUNT(*) AS n FROM panel GROUP BY sector")
def _(spark, d):
    return p.sector_counts(panel(spark, d))


def _holes(spark: SparkSession, d: str) -> DataFrame:
    df = panel(spark, d)
    return df.withColumns({"close": F.when(F.col("volume") > 30, F.col("close")), "open": F.when(F.col("volume") < 60, F.col("open")), "volume": F.when(F.col("volume") > 10, F.col("volume"))})


_HOLES = "holes AS (SELECT date, ticker, CASE WHEN volume > 30 THEN close END AS close, CASE WHEN volume < 60 THEN open END AS open, high, low, CASE WHEN volume > 10 THEN volume END AS volume FROM panel)"
_FILLED = f"f AS (SELECT *, LAST_VALUE(close IGNORE NULLS) OVER {win(None)} AS c FROM holes)"


@query("price_gap_fill", select([P, _HOLES, _FILLED], "date, ticker", {"close": "c", "open": "COALESCE(open, c)", "high": "COALESCE(high, c)", "low": "COALESCE(low, c)", "volume": "COALESCE(volume, 0)"}, "f"))
def _(spark, d):
    return rounded(p.price_gap_fill(_holes(spark, d)), OHLC, "date", "ticker")


@query("valid_ohlcv_filter", rows_sql([P, _HOLES], "holes", "WHERE open > 0 AND high > 0 AND low > 0 AND close > 0 AND volume >= 0"))
def _(spark, d):
    return rounded(p.valid_ohlcv(_holes(spark, d)), OHLC, "date", "ticker")


_DUP = "SELECT l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS date, l_orderkey, l_linenumber, l_partkey, l_extendedprice AS close FROM lineitem"


@query("dedupe_panel", f"SELECT date, ticker, close, l_orderkey FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY date, ticker ORDER BY l_orderkey, l_linenumber, l_partkey) AS n FROM ({_DUP})) WHERE n = 1")
def _(spark, d):
    df = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("ticker"), F.col("l_shipdate").cast("date").alias("date"), "l_orderkey", "l_linenumber", "l_partkey", F.col("l_extendedprice").alias("close"))
    return p.dedupe_panel(df, F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")).select("date", "ticker", "close", "l_orderkey")


@query("min_history_filter", rows_sql([P], "(SELECT *, COUNT(*) OVER (PARTITION BY ticker) AS n FROM panel)", "WHERE n >= 285"))
def _(spark, d):
    return rounded(p.min_history(panel(spark, d), 285), OHLC, "date", "ticker")


@query("date_range_filter", rows_sql([P], "panel", "WHERE date BETWEEN DATE '1996-01-01' AND DATE '1997-06-30'"))
def _(spark, d):
    return rounded(p.date_range(panel(spark, d), "1996-01-01", "1997-06-30"), OHLC, "date", "ticker")


@query("ticker_subset_filter", rows_sql([P], "panel", "WHERE ticker IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)"))
def _(spark, d):
    return rounded(p.ticker_subset(panel(spark, d), table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("ticker"))), OHLC, "date", "ticker")


@query("random_ticker_sample")
def _(spark, d):
    """Bars of 20 tickers drawn by hash; the sample size is the feature."""
    df = panel(spark, d)
    return rounded(p.ticker_subset(df, p.hash_sample(df.select("ticker").distinct(), 20, "ticker")), OHLC, "date", "ticker")


@query("sample_rows")
def _(spark, d):
    """1000 background rows by hash; the sample size is the feature."""
    return rounded(p.hash_sample(panel(spark, d), 1000, "date", "ticker"), OHLC, "date", "ticker")


@query("calendar_index", f"WITH {P} SELECT date, ROW_NUMBER() OVER (ORDER BY date) AS idx FROM (SELECT DISTINCT date FROM panel)")
def _(spark, d):
    return p.calendar(panel(spark, d))


@query("drop_null_rows", rows_sql([P, _HOLES], "holes", "WHERE open IS NOT NULL AND close IS NOT NULL"))
def _(spark, d):
    return rounded(_holes(spark, d).dropna(subset=["open", "close"]), OHLC, "date", "ticker")


@query("select_reindex_columns", select([P], "date, ticker", {"close": "close", "alpha": "0"}, "panel"))
def _(spark, d):
    df = panel(spark, d)
    return rounded(df.select("date", "ticker", "close", "volume").transform(lambda x: p.reindex_columns(x, ["date", "ticker", "close", "alpha"])), ["close", "alpha"], "date", "ticker")


@query("sector_fill", f"WITH {P} SELECT date, ticker, COALESCE(CASE WHEN ticker % 3 = 0 THEN CAST(sector AS VARCHAR) END, CASE WHEN ticker % 2 = 0 THEN 'S' || CAST(s_nationkey AS VARCHAR) END, 'Unknown') AS sector FROM panel JOIN supplier ON ticker = s_suppkey")
def _(spark, d):
    df = panel(spark, d).withColumn("sector", F.when(F.col("ticker") % 3 == 0, F.col("sector").cast("string")))
    lookup = table(spark, d, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("ticker"), F.concat(F.lit("S"), F.col("s_nationkey").cast("string")).alias("sector"))
    return p.sector_fill(df, lookup).select("date", "ticker", "sector")


_MISS = "(SELECT ticker, 1 - COUNT(DISTINCT date) / (SELECT COUNT(DISTINCT date) FROM panel)::DOUBLE AS missing FROM panel GROUP BY ticker)"


@query("panel_quality_assert", f"""WITH {P}, a AS (SELECT COUNT(*) AS n_rows, COUNT(DISTINCT ticker) AS tickers, MIN(date) AS first_date, MAX(date) AS last_date, COUNT(*) FILTER (WHERE open <= 0 OR high <= 0 OR low <= 0 OR close <= 0) AS bad_prices,
 COUNT(*) FILTER (WHERE volume < 0) AS bad_volumes, COUNT(*) FILTER (WHERE sector IS NULL) AS no_sector, COUNT(*) - COUNT(DISTINCT (date, ticker)) AS repeated_keys FROM panel),
 q AS (SELECT QUANTILE_CONT(missing, 0.5) AS p50, QUANTILE_CONT(missing, 0.9) AS p90 FROM {_MISS})
 SELECT a.*, {r('p50')} AS missing_p50, {r('p90')} AS missing_p90 FROM a, q""")
def _(spark, d):
    out = p.panel_quality(panel(spark, d))
    return out.withColumns({c: near(F.col(c)) for c in ("missing_p50", "missing_p90")})


@query("data_quality_report", f"WITH {P}, {_HOLES}, x AS (SELECT AVG(CAST(open IS NULL AS DOUBLE)) AS o, AVG(CAST(close IS NULL AS DOUBLE)) AS c, AVG(CAST(volume IS NULL AS DOUBLE)) AS v FROM holes) SELECT 'open' AS \"column\", {r('o')} AS null_share FROM x UNION ALL SELECT 'close', {r('c')} FROM x UNION ALL SELECT 'volume', {r('v')} FROM x")
def _(spark, d):
    return rounded(p.null_shares(_holes(spark, d), ["open", "close", "volume"]), ["null_share"], "column")


_COV = f"cov AS (SELECT ticker, MIN(date) AS first_date, MAX(date) AS last_date, COUNT(DISTINCT date) AS num_days, AVG(CAST(close IS NULL AS DOUBLE)) AS ns FROM holes GROUP BY ticker)"


@query("coverage_report", f"WITH {P}, {_HOLES}, {_COV} SELECT ticker, first_date, last_date, num_days, {r('ns')} AS null_share FROM cov")
def _(spark, d):
    return rounded(p.coverage(_holes(spark, d)), ["null_share"], "ticker", "first_date", "last_date", "num_days")


@query("coverage_summary", f"WITH {P}, {_HOLES}, {_COV}, t AS (SELECT QUANTILE_CONT(num_days, 0.5) AS md FROM cov) SELECT COUNT(*) AS tickers, MIN(md) AS median_days, COUNT(*) FILTER (WHERE num_days < md) AS below FROM cov, t")
def _(spark, d):
    return p.coverage_summary(p.coverage(_holes(spark, d)))


@query("fundamental_coverage", f"WITH {FUNDAMENTALS_SQL}, x AS (SELECT symbol, AVG(CAST(net_income > 0 AS DOUBLE)) AS a, AVG(CAST(n_orders > 20 AS DOUBLE)) AS b FROM fundamentals GROUP BY symbol) SELECT symbol, {r('a')} AS net_income, {r('b')} AS n_orders, {r('(a + b) / 2')} AS coverage FROM x")
def _(spark, d):
    df = fundamentals(spark, d).withColumns({"net_income": F.when(F.col("net_income") > 0, F.col("net_income")), "n_orders": F.when(F.col("n_orders") > 20, F.col("n_orders"))})
    out = df.groupBy("symbol").agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in ("net_income", "n_orders")])
    return rounded(out.withColumn("coverage", (F.col("net_income") + F.col("n_orders")) / 2), ["net_income", "n_orders", "coverage"], "symbol")


@query("universe_snapshot", f"WITH {P} SELECT DISTINCT date, ticker FROM panel")
def _(spark, d):
    return panel(spark, d).select("date", "ticker").distinct()


@query("market_series", select([P], "date", {"close": "AVG(close)"}, "panel", "GROUP BY date"))
def _(spark, d):
    return rounded(feat.market(panel(spark, d)), ["close"], "date")


@query("union_all", "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT n_name FROM nation")
def _(spark, d):
    n, g = table(spark, d, "nation").select(F.col("n_name").alias("name")), table(spark, d, "region").select(F.col("r_name").alias("name"))
    return n.unionByName(g).unionByName(n)


@query("union_distinct", "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region")
def _(spark, d):
    return table(spark, d, "nation").select(F.col("n_regionkey").alias("k")).unionByName(table(spark, d, "region").select(F.col("r_regionkey").alias("k"))).distinct()


@query("intersect_columns", "SELECT DISTINCT l_suppkey AS k FROM lineitem INTERSECT SELECT user_id FROM events")
def _(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k")).intersect(table(spark, d, "events").select(F.col("user_id").alias("k")))


@query("except_columns", "SELECT user_id AS k FROM events EXCEPT SELECT l_suppkey FROM lineitem")
def _(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("k")).subtract(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k")))


# Joins


@query("pit_membership_filter", rows_sql([P, MEMBERSHIP_SQL], "panel", "WHERE ticker NOT IN (SELECT ticker FROM membership) OR EXISTS (SELECT 1 FROM membership AS mm WHERE mm.ticker = panel.ticker AND panel.date >= mm.start_date AND panel.date <= COALESCE(mm.end_date, DATE '9999-12-31'))"))
def _(spark, d):
    return rounded(j.pit_membership(panel(spark, d), membership(spark, d)), OHLC, "date", "ticker")


@query("pit_universe_slice", f"WITH {MEMBERSHIP_SQL} SELECT DISTINCT ticker FROM membership WHERE start_date <= DATE '1996-12-31' AND COALESCE(end_date, DATE '2100-01-01') >= DATE '1996-01-01'")
def _(spark, d):
    return j.pit_universe(membership(spark, d), start="1996-01-01", end="1996-12-31")


@query("pit_universe_as_of", f"WITH {MEMBERSHIP_SQL} SELECT DISTINCT ticker FROM membership WHERE start_date <= DATE '1998-06-01' AND COALESCE(end_date, DATE '2100-01-01') >= DATE '1998-06-01'")
def _(spark, d):
    return j.pit_universe(membership(spark, d), as_of="1998-06-01")


_HIST = "h AS (SELECT ticker, start_date, end_date, 'S' || CAST(ticker % 7 AS VARCHAR) AS sec FROM membership)"


@query("pit_sector_attach", f"""WITH {P}, {MEMBERSHIP_SQL}, {_HIST}, x AS (SELECT p.date, p.ticker, h.sec FROM panel p LEFT JOIN h ON p.ticker = h.ticker AND p.date >= h.start_date AND p.date <= COALESCE(h.end_date, DATE '9999-12-31')),
 y AS (SELECT date, ticker, COALESCE(LAST_VALUE(sec IGNORE NULLS) OVER {win(None)}, FIRST_VALUE(sec IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS sector FROM x) SELECT * FROM y WHERE sector IS NOT NULL""")
def _(spark, d):
    history = membership(spark, d).withColumn("sector", F.concat(F.lit("S"), (F.col("ticker") % 7).cast("string")))
    return j.pit_sector(panel(spark, d), history).select("date", "ticker", "sector")


@query("enhanced_panel", select([P], "p.date, p.ticker", {"close": "p.close", "delivery_qty": "q.delivery_qty", "close_delivery": "q.close", "fii_hold": "o.fii_hold"}, "panel p LEFT JOIN (SELECT * FROM panel WHERE volume > 40) q ON p.date = q.date AND p.ticker = q.ticker LEFT JOIN (SELECT * FROM panel WHERE volume < 90) o ON p.date = o.date AND p.ticker = o.ticker"))
def _(spark, d):
    df = panel(spark, d)
    out = j.enhanced_panel(df.select("date", "ticker", "close", "volume"), df.where("volume > 40").select("date", "ticker", "delivery_qty", "close"), df.where("volume < 90").select("date", "ticker", "fii_hold"))
    return rounded(out, ["close", "delivery_qty", "close_delivery", "fii_hold"], "date", "ticker")


_DAILY = "days AS (SELECT CAST(ticker % 25 AS INT) AS symbol, date, ticker FROM panel)"


@query("asof_fundamentals", select([P, FUNDAMENTALS_SQL, _DAILY], "days.date, days.ticker", {"revenue": "f.revenue", "eps": "f.eps"}, "days ASOF LEFT JOIN fundamentals f ON days.symbol = f.symbol AND days.date >= f.report_date"))
def _(spark, d):
    days = panel(spark, d).select((F.col("ticker") % 25).cast("int").alias("symbol"), "date", "ticker")
    f = fundamentals(spark, d).withColumn("symbol", F.col("symbol").cast("int"))
    return rounded(j.asof(days, f, "symbol", "date", "report_date", ["revenue", "eps"]), ["revenue", "eps"], "date", "ticker")


@query("reporting_delay", select([P, FUNDAMENTALS_SQL, _DAILY, "late AS (SELECT *, CAST(report_date + 45 AS DATE) AS available_date FROM fundamentals)"], "days.date, days.ticker", {"eps": "f.eps"}, "days ASOF JOIN late f ON days.symbol = f.symbol AND days.date >= f.available_date"))
def _(spark, d):
    days = panel(spark, d).select((F.col("ticker") % 25).cast("int").alias("symbol"), "date", "ticker")
    f = j.with_reporting_delay(fundamentals(spark, d)).withColumn("symbol", F.col("symbol").cast("int"))
    out = j.asof(days, f, "symbol", "date", "available_date", ["eps"])
    return rounded(j.known_only(out), ["eps"], "date", "ticker")


@query("fundamental_join", select([P, FUNDAMENTALS_SQL], "p.date, p.ticker", {"eps": "f.eps"}, "panel p LEFT JOIN fundamentals f ON p.ticker % 25 = f.symbol AND p.date = f.report_date"))
def _(spark, d):
    f = fundamentals(spark, d).select(F.col("symbol").cast("long").alias("symbol"), F.col("report_date").alias("date"), "eps")
    return rounded(panel(spark, d).withColumn("symbol", F.col("ticker") % 25).join(f, ["symbol", "date"], "left"), ["eps"], "date", "ticker")


@query("market_factor_join", select([P, f"mk AS (SELECT date, AVG(close) AS mc FROM panel GROUP BY date)"], "p.date, p.ticker", {"close": "p.close", "market": "mk.mc"}, "panel p LEFT JOIN mk USING (date)"))
def _(spark, d):
    df = panel(spark, d)
    return rounded(j.by_date(df, feat.market(df).withColumnRenamed("close", "market")), ["close", "market"], "date", "ticker")


@query("market_factor_asof", select([P, "mk AS (SELECT date, AVG(close) AS mc, 0 AS k FROM panel WHERE EXTRACT(month FROM date) % 2 = 0 GROUP BY date)", "q AS (SELECT *, 0 AS k FROM panel)"], "p.date, p.ticker", {"market": "mk.mc"}, "q p ASOF LEFT JOIN mk ON p.k = mk.k AND p.date >= mk.date"))
def _(spark, d):
    """A market table with gaps, carried forward over the calendar first; rows then join by date."""
    df = panel(spark, d)
    days = df.select("date").distinct().withColumn("ticker", F.lit(0))
    sparse = feat.market(df.where(F.month("date") % 2 == 0)).withColumnsRenamed({"date": "at", "close": "market"}).withColumn("ticker", F.lit(0))
    return rounded(j.by_date(df, j.asof(days, sparse, "ticker", "date", "at", ["market"]).select("date", "market")), ["market"], "date", "ticker")


@query("prev_day_self_join", select([P, "c AS (SELECT date, ROW_NUMBER() OVER (ORDER BY date) AS i FROM (SELECT DISTINCT date FROM panel))", "b AS (SELECT panel.*, i FROM panel JOIN c USING (date))"], "x.date, x.ticker", {"close": "x.close", "prev_close": "y.close"}, "b x LEFT JOIN b y ON x.ticker = y.ticker AND y.i = x.i - 1"))
def _(spark, d):
    df = panel(spark, d)
    return rounded(j.previous_day(df, p.calendar(df)), ["close", "prev_close"], "date", "ticker")


@query("semi_anti_join", rows_sql([P, MEMBERSHIP_SQL], "panel", "WHERE ticker NOT IN (SELECT ticker FROM membership)"))
def _(spark, d):
    return rounded(panel(spark, d).join(membership(spark, d).select("ticker"), "ticker", "left_anti"), OHLC, "date", "ticker")


# Labels

FWD = "(LEAD(close, {h}) OVER (PARTITION BY ticker ORDER BY date) / NULLIF(close, 0) - 1)"
LABEL_CTES = [
    "l0 AS (SELECT *, " + FWD.format(h=10) + " AS fwd_ret FROM panel)",
    "l1 AS (SELECT *, CASE WHEN COUNT(fwd_ret) OVER (PARTITION BY date, sector) > 1 THEN (SUM(fwd_ret) OVER (PARTITION BY date, sector) - fwd_ret) / NULLIF(COUNT(fwd_ret) OVER (PARTITION BY date, sector) - 1, 0) ELSE fwd_ret END AS sector_fwd FROM l0)",
    "labelled AS (SELECT *, fwd_ret - sector_fwd AS excess_fwd, CASE WHEN fwd_ret - sector_fwd >= 0.015 THEN 1 ELSE 0 END AS label FROM l1)",
]


@query("label_excess", select([P, *LABEL_CTES], "date, ticker, label", {"fwd_ret": "fwd_ret", "sector_fwd": "sector_fwd", "excess_fwd": "excess_fwd"}, "labelled"))
def _(spark, d):
    return rounded(lab.label_excess(panel(spark, d)), ["fwd_ret", "sector_fwd", "excess_fwd"], "date", "ticker", "label")


@query("label_triple_barrier", select([P, "q AS (SELECT *, LIST(close) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) AS a FROM panel)",
    "u AS (SELECT *, LIST_POSITION(LIST_TRANSFORM(a, lambda x: x / close - 1 >= 0.04), true) AS up, LIST_POSITION(LIST_TRANSFORM(a, lambda x: x / close - 1 <= -0.02), true) AS dn FROM q)"],
    "date, ticker, CASE WHEN LEN(a) = 10 THEN CASE WHEN COALESCE(up, 0) > 0 AND (COALESCE(dn, 0) = 0 OR up < dn) THEN 1 ELSE 0 END END AS label", {"fwd_ret": "CASE WHEN LEN(a) = 10 THEN a[10] / close - 1 END"}, "u"))
def _(spark, d):
    return rounded(lab.label_triple_barrier(panel(spark, d)), ["fwd_ret"], "date", "ticker", "label")


@query("label_meta", f"WITH {P}, {', '.join(LABEL_CTES)} SELECT date, ticker, CASE WHEN fwd_ret IS NOT NULL THEN CAST(fwd_ret >= 0.02 AS INT) END AS meta_label FROM labelled")
def _(spark, d):
    return lab.label_meta(lab.label_excess(panel(spark, d))).select("date", "ticker", "meta_label")


@query("label_permute_rows")
def _(spark, d):
    df = lab.label_excess(panel(spark, d)).select("date", "ticker", "label")
    return lab.permute_rows(df, "date", "ticker").select("date", "ticker", "label")


@query("label_permute_dates")
def _(spark, d):
    return lab.permute_dates(lab.label_excess(panel(spark, d)).select("date", "ticker", "label")).select("date", "ticker", "label")


# Regimes

INDEX = ["i0 AS (SELECT date, AVG(close) AS close, 0 AS ticker FROM panel GROUP BY date)", f"i1 AS (SELECT *, {pc('close')} AS ret FROM i0)",
         f"i2 AS (SELECT *, {s('ret', 20)} AS v20, {m('close', 50, 1)} AS m50, {m('close', 200, 1)} AS m200, close / MAX(close) OVER {win(None)} - 1 AS dd FROM i1)",
         "i3 AS (SELECT *, v20 * SQRT(252.0) AS vol, close / m50 - 1 AS fast, close / m200 - 1 AS slow, (m50 - m200) / NULLIF(m200, 0) AS spread FROM i2)",
         """idx AS (SELECT date, close, vol, dd AS drawdown, CASE WHEN vol < 0.15 THEN 'low_vol' WHEN vol < 0.25 THEN 'medium_vol' WHEN vol < 0.4 THEN 'high_vol' WHEN vol IS NOT NULL THEN 'extreme_vol' ELSE 'medium_vol' END AS volatility_regime,
 CASE WHEN fast > 0.02 AND slow > 0.02 AND spread > 0.02 THEN 'strong_uptrend' WHEN fast > 0 AND slow > 0 THEN 'weak_uptrend' WHEN fast < -0.02 AND slow < -0.02 AND spread < -0.02 THEN 'strong_downtrend' WHEN fast < 0 AND slow < 0 THEN 'weak_down' ELSE 'sideways' END AS trend_regime FROM i3)"""]  # fmt: skip
BREADTH = [f"b0 AS (SELECT *, CAST(close > {m('close', 20, 1)} AS DOUBLE) AS up FROM panel)", "b1 AS (SELECT date, AVG(up) AS breadth FROM b0 GROUP BY date)",
           "br AS (SELECT *, CASE WHEN breadth >= 0.6 THEN 'strong_breadth' WHEN breadth <= 0.4 THEN 'weak_breadth' ELSE 'neutral_breadth' END AS breadth_regime FROM b1)"]
COMPOSITE = [*INDEX, *BREADTH, """regimes AS (SELECT date, volatility_regime, trend_regime, breadth_regime, drawdown,
 CASE WHEN volatility_regime IN ('high_vol', 'extreme_vol') THEN 'high_vol_' || trend_regime WHEN trend_regime = 'strong_uptrend' AND breadth_regime = 'strong_breadth' THEN 'bull_market'
 WHEN trend_regime = 'strong_downtrend' OR breadth_regime = 'weak_breadth' THEN 'bear_market' ELSE volatility_regime || '_' || trend_regime END AS composite_regime,
 volatility_regime IN ('low_vol', 'medium_vol') AND trend_regime <> 'strong_downtrend' AND drawdown > -0.10 AND breadth_regime <> 'weak_breadth' AS allow_entry,
 GREATEST(0.0, LEAST(100.0, 50 + CASE volatility_regime WHEN 'low_vol' THEN 20 WHEN 'medium_vol' THEN 10 WHEN 'high_vol' THEN -15 ELSE -30 END
 + CASE trend_regime WHEN 'strong_uptrend' THEN 25 WHEN 'weak_uptrend' THEN 10 WHEN 'sideways' THEN 0 WHEN 'weak_down' THEN -10 ELSE -25 END
 + CASE breadth_regime WHEN 'strong_breadth' THEN 15 WHEN 'weak_breadth' THEN -15 ELSE 0 END - 100 * ABS(drawdown))) AS regime_score FROM idx JOIN br USING (date))"""]  # fmt: skip


@query("regime_volatility", select([P, *INDEX], "date, volatility_regime", {"vol": "vol"}, "idx"))
def _(spark, d):
    return rounded(reg.index_frame(panel(spark, d)), ["vol"], "date", "volatility_regime")


@query("regime_trend", f"WITH {P}, {', '.join(INDEX)} SELECT date, trend_regime FROM idx")
def _(spark, d):
    return reg.index_frame(panel(spark, d)).select("date", "trend_regime")


@query("regime_breadth", select([P, *BREADTH], "date, breadth_regime", {"breadth": "breadth"}, "br"))
def _(spark, d):
    return rounded(reg.breadth(panel(spark, d)), ["breadth"], "date", "breadth_regime")


@query("regime_drawdown", select([P, *INDEX], "date", {"drawdown": "drawdown"}, "idx"))
def _(spark, d):
    return rounded(reg.index_frame(panel(spark, d)), ["drawdown"], "date")


@query("regime_composite", select([P, *COMPOSITE], "date, volatility_regime, trend_regime, breadth_regime, composite_regime, allow_entry", {"drawdown": "drawdown", "regime_score": "regime_score"}, "regimes"))
def _(spark, d):
    return rounded(reg.composite(panel(spark, d)), ["drawdown", "regime_score"], "date", "volatility_regime", "trend_regime", "breadth_regime", "composite_regime", "allow_entry")


_KINDS = " UNION ALL ".join(f"SELECT '{k}' AS kind, {k} AS value, regime_score, drawdown FROM regimes" for k in ("volatility_regime", "trend_regime", "breadth_regime", "composite_regime"))


@query("regime_summary", select([P, *COMPOSITE, f"long AS ({_KINDS})"], "kind, value, COUNT(*) AS days", {"avg_score": "AVG(regime_score)", "worst_drawdown": "MIN(drawdown)", "share": "COUNT(*)::DOUBLE / (SELECT COUNT(*) FROM regimes)"}, "long", "GROUP BY kind, value"))
def _(spark, d):
    return rounded(reg.summary(reg.composite(panel(spark, d))), ["avg_score", "worst_drawdown", "share"], "kind", "value", "days")


@query("regime_signal_filter", rows_sql([P, *COMPOSITE], "panel", "WHERE date IN (SELECT date FROM regimes WHERE allow_entry AND regime_score >= 30)"))
def _(spark, d):
    df = panel(spark, d)
    return rounded(reg.signal_filter(df, reg.composite(df)), OHLC, "date", "ticker")


@query("regime_join", f"WITH {P}, {', '.join(COMPOSITE)} SELECT date, ticker, composite_regime FROM panel LEFT JOIN regimes USING (date)")
def _(spark, d):
    df = panel(spark, d)
    return j.by_date(df, reg.composite(df).select("date", "composite_regime")).select("date", "ticker", "composite_regime")


FLAGS = ["g0 AS (SELECT date, AVG(close) AS close, 0 AS ticker FROM panel GROUP BY date)", f"g1 AS (SELECT *, {pc('close')} AS ret FROM g0)",
         f"g2 AS (SELECT date, COALESCE({m('close', 50)} > {m('close', 200)}, false) AS trend_ok, COALESCE({s('ret', 20)}, 0) AS vol, {s('ret', 20)} AS v20, ticker FROM g1)", "flags AS (SELECT date, trend_ok, vol, vol < 0.04 AS vol_ok, trend_ok AND vol < 0.04 AS allow FROM g2)"]


@query("risk_flags", select([P, *FLAGS], "date, trend_ok, vol_ok, allow", {"vol": "vol"}, "flags"))
def _(spark, d):
    return rounded(reg.risk_flags(panel(spark, d)), ["vol"], "date", "trend_ok", "vol_ok", "allow")


BUCKETS = f"buckets AS (SELECT date, CASE WHEN trend_ok THEN 'bull' ELSE 'bear' END AS trend, CASE WHEN p <= 33 THEN 'low' WHEN p <= 67 THEN 'mid' WHEN p IS NOT NULL THEN 'high' ELSE 'unknown' END AS vol FROM (SELECT *, {exp_rank('v20', 20)} AS p FROM g2))"


@query("vol_bucket_regime", f"WITH {P}, {', '.join(FLAGS)}, {BUCKETS} SELECT * FROM buckets")
def _(spark, d):
    return reg.vol_buckets(panel(spark, d))


# Splits


@query("split_time", f"WITH {P} SELECT date, ticker, CASE WHEN date >= DATE '1998-01-01' THEN 'test' WHEN date >= DATE '1997-01-01' AND date < DATE '1998-01-01' - 10 THEN 'valid' WHEN date < DATE '1997-01-01' - 10 THEN 'train' END AS split FROM panel")
def _(spark, d):
    return sp.split_time(panel(spark, d), "1997-01-01", "1998-01-01").select("date", "ticker", "split")


@query("split_dynamic", f"WITH {P}, c AS (SELECT QUANTILE_DISC(date, 0.6) AS a, QUANTILE_DISC(date, 0.8) AS b FROM panel) SELECT date, ticker, CASE WHEN date < a THEN 'train' WHEN date < b THEN 'valid' ELSE 'test' END AS split FROM panel, c")
def _(spark, d):
    return sp.split_dynamic(panel(spark, d)).select("date", "ticker", "split")


_PURGED = """f0 AS (SELECT date, ROW_NUMBER() OVER (ORDER BY date) - 1 AS i, COUNT(*) OVER () AS n, MIN(date) OVER () AS first FROM (SELECT DISTINCT date FROM panel)),
 folds AS (SELECT CAST(LEAST(i // (n // 5), 4) + 1 AS INT) AS fold, first AS train_start, CAST(MIN(date) - 11 AS DATE) AS train_end, MIN(date) AS test_start, MAX(date) AS test_end FROM f0 GROUP BY 1, 2)"""


@query("fold_purged", f"WITH {P}, {_PURGED} SELECT * FROM folds")
def _(spark, d):
    return sp.folds_purged(panel(spark, d))


@query("fold_purged_rows", f"WITH {P}, {_PURGED} SELECT fold, COUNT(*) AS n FROM folds JOIN panel ON date BETWEEN train_start AND train_end GROUP BY fold")
def _(spark, d):
    df = panel(spark, d)
    return sp.in_fold(df, sp.folds_purged(df), "train").groupBy("fold").agg(F.count("*").alias("n"))


_SPAN = "sp AS (SELECT MIN(date) AS a, MAX(date) AS b FROM panel)"


@query("fold_wfo", f"WITH {P}, {_SPAN}, st AS (SELECT a, b, UNNEST(GENERATE_SERIES(a + INTERVAL 730 DAY, b::TIMESTAMP, INTERVAL 30 DAY))::DATE AS cur FROM sp) SELECT CAST(ROW_NUMBER() OVER (ORDER BY cur) AS INT) AS fold, a AS train_start, CAST(cur - 5 AS DATE) AS train_end, CAST(cur + 1 AS DATE) AS test_start, LEAST(b, CAST(cur + 30 AS DATE)) AS test_end FROM st WHERE cur < b")
def _(spark, d):
    return sp.folds_expanding(panel(spark, d))


@query("fold_rolling", f"WITH {P}, {_SPAN}, st AS (SELECT b, UNNEST(GENERATE_SERIES(a::TIMESTAMP, b::TIMESTAMP - INTERVAL 24 MONTH, INTERVAL 3 MONTH))::DATE AS cur FROM sp) SELECT CAST(ROW_NUMBER() OVER (ORDER BY cur) AS INT) AS fold, cur AS train_start, CAST(cur + INTERVAL 24 MONTH - INTERVAL 1 DAY AS DATE) AS train_end, CAST(cur + INTERVAL 24 MONTH AS DATE) AS test_start, LEAST(b, CAST(CAST(cur + INTERVAL 24 MONTH AS DATE) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE)) AS test_end FROM st")
def _(spark, d):
    return sp.folds_rolling(panel(spark, d))


@query("fold_anchored", f"WITH {P}, {_SPAN}, st AS (SELECT a, b, UNNEST(GENERATE_SERIES(a + INTERVAL 365 DAY, b::TIMESTAMP, INTERVAL 90 DAY))::DATE AS cur FROM sp) SELECT CAST(ROW_NUMBER() OVER (ORDER BY cur) AS INT) AS fold, a AS train_start, cur AS train_end, CAST(cur + 15 AS DATE) AS valid_start, CAST(cur + 195 AS DATE) AS valid_end, CAST(cur + 210 AS DATE) AS test_start, CAST(cur + 390 AS DATE) AS test_end FROM st WHERE cur + 390 <= b")
def _(spark, d):
    return sp.folds_anchored(panel(spark, d))


_DAYS = "dd AS (SELECT DISTINCT date FROM panel)"


@query("split_reversed", f"WITH {P}, {_DAYS}, c AS (SELECT QUANTILE_DISC(date, 0.7) AS c FROM dd) SELECT date, ticker, CASE WHEN date > c THEN 'train' ELSE 'test' END AS split FROM panel, c")
def _(spark, d):
    return sp.split_reversed(panel(spark, d)).select("date", "ticker", "split")


@query("split_gap", f"WITH {P}, {_DAYS}, c AS (SELECT QUANTILE_DISC(date, 0.4) AS c FROM dd) SELECT date, ticker, CASE WHEN date <= c THEN 'train' WHEN date > c + 180 THEN 'test' END AS split FROM panel, c")
def _(spark, d):
    return sp.split_gap(panel(spark, d)).select("date", "ticker", "split")


@query("split_random")
def _(spark, d):
    return sp.split_random(panel(spark, d), "date", "ticker").select("date", "ticker", "split")


def preds(spark: SparkSession, d: str) -> DataFrame:
    """A score without a model: the rank of 10-row momentum within the date, with label and excess return."""
    df = lab.label_excess(panel(spark, d)).withColumn("_m", pct("close", 10))
    return df.withColumn("proba", xs_pct_rank("_m", "date")).where("proba is not null and excess_fwd is not null").drop("_m")


PREDS = [P, *LABEL_CTES, f"pm AS (SELECT *, {pc('close', 10)} AS mom FROM labelled)", f"pr AS (SELECT *, {xs_rank('mom', 'date')} AS proba FROM pm)", "preds AS (SELECT * FROM pr WHERE proba IS NOT NULL AND excess_fwd IS NOT NULL)"]
