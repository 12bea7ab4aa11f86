"""Readers of price, delivery, ownership, fundamental and universe files into canonical tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from ..operators.joins import pit_membership
from ..operators.panel import date_range, normalize_names, normalize_ticker, symbol_override, ticker_subset
from .csv_folder import csv_folder

EPS = 1e-9


def multi_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.parquet(*paths)


def price_parquet(spark: SparkSession, path: str, start: str | None = None, end: str | None = None, universe: DataFrame | None = None, members: DataFrame | None = None) -> DataFrame:
    """A price panel: lower-case names, dates and trimmed tickers, cut to dates (pushed to the files), universe and membership.

    A universe that matches nothing leaves the rows as they are.
    """
    df = normalize_names(spark.read.parquet(path))
    missing = [c for c in ("date", "ticker", "close") if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    df = date_range(df.withColumn("date", F.col("date").cast("date")), start, end).withColumn("ticker", F.trim(F.col("ticker").cast("string")))
    if universe is not None:
        cut = ticker_subset(df, universe)
        df = df if cut.isEmpty() else cut
    return pit_membership(df, members) if members is not None else df


PRICES = ("open", "high", "low", "close", "volume")


def csv_per_ticker(spark: SparkSession, path: str, required: tuple[str, ...] = ("date", *PRICES)) -> DataFrame:
    """One CSV per ticker, which is the file's name in upper case; a file without a required column is an error."""
    df = csv_folder(spark, path, list(dict.fromkeys(["date", *PRICES, "sector", *required])), required, "fail")
    return df.withColumns({c: number(F.col(c)) for c in PRICES} | {"date": a_date(F.col("date"))}).withColumnRenamed("file", "ticker")


def csv_fallback(spark: SparkSession, path: str) -> DataFrame:
    """Price CSVs of any layout; a file without a ticker column is one ticker's, named by the file. All need a date."""
    numbers = [*PRICES, "delivery_qty", "fii_hold", "dii_hold"]
    df = csv_folder(spark, path, ["date", "ticker", "sector", *numbers], ("date",), "fail", from_name="ticker")
    return df.select(a_date(F.col("date")).alias("date"), "ticker", "sector", *[number(F.col(c)).alias(c) for c in numbers])


DELIVERY = ("tradingsymbol", "deliveryqty", "tradedqty", "date")


def delivery_csv(spark: SparkSession, path: str) -> DataFrame:
    """Delivered and traded quantities of exchange files, with their ratio; files that lack one of the columns are left out.

    csv_report(spark, path, DELIVERY) names those.
    """
    df = csv_folder(spark, path, list(DELIVERY), DELIVERY)
    out = df.select(a_date(F.col("date")).alias("date"), F.col("tradingsymbol").alias("ticker"), number(F.col("deliveryqty")).alias("delivery_qty"), number(F.col("tradedqty")).alias("traded_qty"))
    return out.withColumn("delivery_ratio", F.col("delivery_qty") / F.nullif("traded_qty", F.lit(0.0)))


def ownership_csv(spark: SparkSession, path: str, wanted: tuple[str, ...] = ("fii_hold", "dii_hold", "promoter_hold", "pledged_shares", "free_float", "mcap")) -> DataFrame:
    """Holdings by (date, ticker), from a file or a folder; measures that no file has are NULL."""
    df = csv_folder(spark, path, ["date", "ticker", *wanted], ("date", "ticker"), "fail")
    return df.select(a_date(F.col("date")).alias("date"), "ticker", *[number(F.col(c)).alias(c) for c in wanted])


def fundamental_csv(spark: SparkSession, path: str, wanted: tuple[str, ...] = ("eps", "revenue", "pe")) -> DataFrame:
    """Figures by (ticker, report_date), from a file or a folder."""
    df = csv_folder(spark, path, ["ticker", "report_date", *wanted], ("ticker", "report_date"), "fail")
    return df.select("ticker", a_date(F.col("report_date")).alias("report_date"), *[number(F.col(c)).alias(c) for c in wanted])


def wide_csv(spark: SparkSession, path: str, numbers: list[str]) -> DataFrame:
    """A CSV with the canonical columns; numbers may hold thousands separators, rows without a date or ticker go."""
    df = normalize_names(spark.read.option("header", True).csv(path))
    figures = [F.regexp_replace(c, ",", "").try_cast("double").alias(c) for c in numbers if c in df.columns]
    return df.select(F.col("date").try_cast("date").alias("date"), F.trim("ticker").alias("ticker"), *figures).dropna(subset=["date", "ticker"])


def report_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Scores, trades or an equity curve as a report wrote them: the named columns in their types, whatever their order."""
    df = normalize_names(spark.read.option("header", True).csv(path))
    wanted = [field.split() for field in schema.split(",")]
    missing = [name for name, _ in wanted if name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df.select(*[F.col(name).try_cast(kind).alias(name) for name, kind in wanted])


def delivery(df: DataFrame) -> DataFrame:
    """Key, delivered quantity and its share of the volume; rows without a key go."""
    df = normalize_names(df).withColumnsRenamed({"deliveryqty": "delivery_qty", "tradedqty": "volume"})
    if "delivery_ratio" not in df.columns:
        df = df.withColumn("delivery_ratio", F.col("delivery_qty") / (F.nullif(F.col("volume"), F.lit(0.0)) + EPS))
    return df.select("date", "ticker", "delivery_qty", "delivery_ratio").dropna(subset=["date", "ticker"])


def ownership(df: DataFrame, wanted: tuple[str, ...] = ("fii_hold", "dii_hold", "promoter_hold", "pledged_shares", "free_float", "mcap")) -> DataFrame:
    """Key and those of the wanted columns that exist."""
    df = normalize_names(df)
    return df.select("date", "ticker", *[c for c in wanted if c in df.columns]).dropna(subset=["date", "ticker"])


# The names that exchange files use for the canonical columns.
EXCHANGE_NAMES = {
    "ticker": ("SYMBOL", "TRADINGSYMBOL", "TICKER"), "date": ("DATE1", "TIMESTAMP", "DATE"), "open": ("OPEN_PRICE", "OPEN"), "high": ("HIGH_PRICE", "HIGH"), "low": ("LOW_PRICE", "LOW"), "close": ("CLOSE_PRICE", "CLOSE"),
    "volume": ("TTL_TRD_QNTY", "TOTTRDQTY", "VOLUME"), "delivery_qty": ("DELIV_QTY", "DELIVERYQTY"),
}


def number(c: Column) -> Column:
    """A number with thousands commas or blanks."""
    return F.regexp_replace(F.trim(c.cast("string")), ",", "").try_cast("double")


def a_date(c: Column) -> Column:
    """A date in ISO form, 02-Jan-2024 or 02JAN2024."""
    text = F.trim(c.cast("string"))
    named = F.initcap(F.lower(text))
    return F.coalesce(text.try_cast("date"), F.try_to_timestamp(named, F.lit("dd-MMM-yyyy")).cast("date"), F.try_to_timestamp(named, F.lit("ddMMMyyyy")).cast("date"))


def exchange_file(df: DataFrame) -> DataFrame:
    """A daily exchange table, whatever its column names, as valid canonical rows, one per (date, ticker)."""
    have = {c.strip().upper(): c for c in df.columns}
    def pick(name: str) -> Column | None:
        found = [F.col(f"`{have[n]}`") for n in EXCHANGE_NAMES[name] if n in have]
        return F.coalesce(*[f.cast("string") for f in found]) if found else None

    cols = {}
    for name in EXCHANGE_NAMES:
        c = pick(name)
        if c is None:
            if name == "delivery_qty":
                continue
            raise ValueError(f"no column for {name}")
        cols[name] = a_date(c) if name == "date" else normalize_ticker(c) if name == "ticker" else number(c)
    out = df.select(*[c.alias(n) for n, c in cols.items()])
    ok = F.col("date").isNotNull() & F.col("ticker").isNotNull() & (F.col("volume") >= 0)
    for c in ("open", "high", "low", "close"):
        ok &= F.col(c) > 0
    return out.where(ok).dropDuplicates(["date", "ticker"])


def security_file(df: DataFrame) -> DataFrame:
    """A per-security history with spelled-out headers; missing delivery counts 0, sector Unknown."""
    names = {"symbol": "ticker", "date": "date", "open price": "open", "high price": "high", "low price": "low", "close price": "close", "total traded quantity": "volume", "deliverable qty": "delivery_qty"}
    df = normalize_names(df)
    out = df.select(*[F.col(f"`{a}`").alias(b) for a, b in names.items() if a in df.columns])
    numbers = [c for c in ("open", "high", "low", "close", "volume", "delivery_qty") if c in out.columns]
    out = out.withColumns({c: number(F.col(c)) for c in numbers} | {"date": a_date(F.col("date")), "ticker": normalize_ticker(F.col("ticker"))})
    if "delivery_qty" in out.columns:
        out = out.withColumn("delivery_qty", F.coalesce("delivery_qty", F.lit(0.0)))
    return out.dropna(subset=["date", "ticker", "close"]).dropDuplicates(["date", "ticker"]).withColumn("sector", F.lit("Unknown"))


def universe(df: DataFrame, renamed: dict[str, str] | None = None) -> DataFrame:
    """ticker_nse, ticker_yf and sector; a single ticker column serves for both."""
    df = normalize_names(df)
    if "ticker" in df.columns:
        df = df.withColumns({"ticker_nse": F.col("ticker"), "ticker_yf": F.col("ticker")})
    out = df.withColumns({c: symbol_override(normalize_ticker(F.col(c).cast("string")), renamed or {}) for c in ("ticker_nse", "ticker_yf")})
    return out.select("ticker_nse", "ticker_yf", "sector").dropna(subset=["ticker_yf"])


def membership(df: DataFrame) -> DataFrame:
    """(ticker, start_date, end_date); a missing start is an error."""
    out = normalize_names(df).select("ticker", F.col("start_date").try_cast("date").alias("start_date"), F.col("end_date").try_cast("date").alias("end_date"))
    if not out.where("start_date is null").isEmpty():
        raise ValueError("membership rows without a start_date")
    return out


#: source name -> table factory, for ingest()
Sources = dict[str, Callable[[SparkSession], DataFrame]]


# Figures from pages

LABELS = {  # fixed values: row labels of a fundamentals page
    "sales": "revenue", "revenue": "revenue", "operating profit": "operating_profit", "net profit": "net_income", "eps in rs": "eps", "stock p/e": "pe_ratio", "roe": "roe", "roce": "roce", "market cap": "market_cap", "book value": "book_value", "dividend yield": "dividend_yield", "debt to equity": "debt_to_equity", "current ratio": "current_ratio",
}


class _Cells(HTMLParser):
    """Texts of table rows and list items."""

    def __init__(self) -> None:
        super().__init__()
        self.rows: list[list[str]] = []

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in ("tr", "li"):
            self.rows.append([])
        elif tag in ("td", "th", "span", "a") and self.rows:
            self.rows[-1].append("")

    def handle_data(self, data: str) -> None:
        if self.rows and data.strip():
            if not self.rows[-1]:
                self.rows[-1].append("")
            self.rows[-1][-1] = f"{self.rows[-1][-1]} {data.strip()}".strip()


def page_cells(pages: DataFrame) -> DataFrame:
    """(page_id, row, label, texts) of the labelled rows and list items of each page."""

    def run(batches) -> Iterator:
        import pandas as pd

        for df in batches:
            out = []
            for page_id, html in zip(df["page_id"], df["html"], strict=True):
                p = _Cells()
                p.feed(html or "")
                out += [(page_id, i, r[0].rstrip(" +:").lower(), [x for x in r[1:]]) for i, r in enumerate(p.rows) if r]
            yield pd.DataFrame(out, columns=["page_id", "row", "label", "texts"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, row int, label string, texts array<string>")


def amount(c: Column) -> Column:
    """A figure with commas, a percent sign or a crore suffix (times 1e7)."""
    bare = F.regexp_replace(c, r"[,%₹\s]|Cr\.?", "").try_cast("double")
    return F.when(c.rlike(r"Cr\.?\s*$"), bare * 1e7).otherwise(bare)


def fundamentals_of_pages(pages: DataFrame) -> DataFrame:
    """One row per (page_id, column position) with the known measures of the page's rows."""
    pairs = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    cells = page_cells(pages).withColumn("measure", F.element_at(pairs, F.col("label"))).where("measure is not null")
    long = cells.select("page_id", "measure", F.posexplode("texts").alias("at", "text")).withColumn("value", amount(F.col("text")))
    return long.groupBy("page_id", "at").pivot("measure", sorted(set(LABELS.values()))).agg(F.first("value"))
