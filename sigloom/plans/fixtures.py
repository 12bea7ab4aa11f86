"""The input tables of the operators, derived from the star schema, as DataFrames and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = "(l_orderkey * 10 + l_linenumber) * 100000 + l_partkey"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def panel(spark: SparkSession, sf_dir: str, weekly: bool = True) -> DataFrame:
    """Price bars: ticker = supplier, sector = its region, bar = ship date or its week.

    The lines are exchanged by ticker once, before they are summed up; the join and windows per ticker that follow need no other.
    """
    lines, suppliers, nations = (table(spark, sf_dir, t) for t in ("lineitem", "supplier", "nation"))
    day = F.date_trunc("week", "l_shipdate") if weekly else F.col("l_shipdate")
    of = suppliers.join(F.broadcast(nations), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_regionkey").alias("sector"))  # 25 nations
    delivered = F.when(F.col("l_returnflag") == "N", F.col("l_quantity")).otherwise(0.0)
    lines = lines.select(
        F.col("l_suppkey").alias("ticker"), day.cast("date").alias("date"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("_price"), F.expr(KEY).alias("_order"),
        "l_quantity", delivered.alias("_delivered"), "l_discount", "l_tax",
    )
    price, order = F.col("_price"), F.col("_order")
    bars = lines.repartition("ticker").groupBy("ticker", "date").agg(
        F.min_by(price, order).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, order).alias("close"),
        F.sum("l_quantity").alias("volume"),
        F.sum("_delivered").alias("delivery_qty"),
        F.avg("l_discount").alias("fii_hold"),
        F.avg("l_tax").alias("dii_hold"),
    )
    return bars.join(of.hint("shuffle_hash"), bars["ticker"] == of["s_suppkey"]).drop("s_suppkey")


def panel_sql(weekly: bool = True) -> str:
    day = "CAST(date_trunc('week', l_shipdate) AS DATE)" if weekly else "CAST(l_shipdate AS DATE)"
    return f"""panel AS (SELECT l_suppkey AS ticker, {day} AS date, n_regionkey AS sector,
 MIN_BY(l_extendedprice / l_quantity, {KEY}) AS open, MAX(l_extendedprice / l_quantity) AS high,
 MIN(l_extendedprice / l_quantity) AS low, MAX_BY(l_extendedprice / l_quantity, {KEY}) AS close,
 SUM(l_quantity) AS volume, SUM(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END) AS delivery_qty,
 AVG(l_discount) AS fii_hold, AVG(l_tax) AS dii_hold
 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
 GROUP BY l_suppkey, {day}, n_regionkey)"""


def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").where("s_suppkey % 10 <> 7")
    start = F.expr("date_add(DATE'1995-01-01', cast(s_suppkey * 37 % 1500 as int))")
    end = F.expr("case when s_suppkey % 3 <> 0 then date_add(DATE'1999-06-01', cast(s_suppkey * 53 % 900 as int)) end")
    return s.select(F.col("s_suppkey").alias("ticker"), start.alias("start_date"), end.alias("end_date"))


MEMBERSHIP_SQL = """membership AS (SELECT s_suppkey AS ticker, CAST(DATE '1995-01-01' + CAST((s_suppkey * 37) % 1500 AS INT) AS DATE) AS start_date,
 CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE CAST(DATE '1999-06-01' + CAST((s_suppkey * 53) % 900 AS INT) AS DATE) END AS end_date
 FROM supplier WHERE s_suppkey % 10 <> 7)"""


def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly figures: symbol = customer nation, sector = its region."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    price = F.col("o_totalprice")
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    out = rows.groupBy(F.col("c_nationkey").alias("symbol"), F.date_trunc("quarter", "o_orderdate").cast("date").alias("report_date")).agg(
        F.sum(price).alias("revenue"), F.sum(F.when(F.col("o_orderstatus") == "F", price).otherwise(0.0)).alias("net_income"), F.avg(price).alias("eps"), F.count("*").alias("n_orders")
    )
    return out.join(F.broadcast(n), F.col("symbol") == F.col("n_nationkey")).select("symbol", F.col("n_regionkey").alias("sector"), "report_date", "revenue", "net_income", "eps", "n_orders")


FUNDAMENTALS_SQL = """fundamentals AS (SELECT c_nationkey AS symbol, n_regionkey AS sector, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS report_date,
 SUM(o_totalprice) AS revenue, SUM(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END) AS net_income, AVG(o_totalprice) AS eps, COUNT(*) AS n_orders
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
 GROUP BY c_nationkey, n_regionkey, CAST(date_trunc('quarter', o_orderdate) AS DATE))"""


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly statements per supplier, dated by the quarter's last day."""
    lines, suppliers, nations = (table(spark, sf_dir, t) for t in ("lineitem", "supplier", "nation"))
    day = F.last_day(F.add_months(F.date_trunc("quarter", "l_shipdate").cast("date"), 2))
    sums = lines.groupBy(F.col("l_suppkey").alias("ticker"), day.alias("date")).agg(F.sum("l_extendedprice").alias("revenue"), F.sum(F.col("l_extendedprice") * F.col("l_discount")).alias("net_income"), F.count("*").alias("_n"))
    of = suppliers.join(F.broadcast(nations), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("ticker"), F.col("n_regionkey").alias("sector"))  # 25 nations
    r, n = F.col("revenue"), F.col("net_income")
    return sums.join(of, "ticker").select("ticker", "date", "sector", "revenue", "net_income", (r * 2 - n).alias("equity"), (r * 3).alias("assets"), (n * 0.8 + F.col("_n")).alias("operating_cf"), (r - n).alias("debt"))


STATEMENTS_SQL = """statements AS (SELECT l_suppkey AS ticker, last_day(CAST(date_trunc('quarter', l_shipdate) + INTERVAL 2 MONTH AS DATE)) AS date, n_regionkey AS sector,
 SUM(l_extendedprice) AS revenue, SUM(l_extendedprice * l_discount) AS net_income, SUM(l_extendedprice) * 2 - SUM(l_extendedprice * l_discount) AS equity, SUM(l_extendedprice) * 3 AS assets,
 SUM(l_extendedprice * l_discount) * 0.8 + COUNT(*) AS operating_cf, SUM(l_extendedprice) - SUM(l_extendedprice * l_discount) AS debt
 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2, 3)"""


def narrative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("ticker"), "event_id", F.col("ts").cast("date").alias("date"), (F.col("value") / 500.0).alias("sentiment"))


NARRATIVE_SQL = "narrative AS (SELECT user_id AS ticker, event_id, CAST(ts AS DATE) AS date, value / 500.0 AS sentiment FROM events)"
