"""Cleaning, filtering and checking of price panels and universes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from ..functions.windows import last_rows

#: Column -> type of the canonical price panel.
PANEL_TYPES = {"date": "date", "ticker": "string", "open": "double", "high": "double", "low": "double", "close": "double", "volume": "double", "sector": "string"}


def coerce_schema(df: DataFrame, types: dict[str, str], strict: bool = True) -> DataFrame:
    """Casts the named columns; a missing column, or with strict a NULL after the cast, is an error."""
    missing = [c for c in types if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    out = df.withColumns({c: F.col(c).try_cast(t) for c, t in types.items()})
    if strict:
        bad = out.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in types]).first().asDict()
        if any(bad.values()):
            raise ValueError(f"NULL after coercion: { {c: n for c, n in bad.items() if n} }")
    return out


def normalize_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip().lower() for c in df.columns])


def normalize_ticker(c: Column) -> Column:
    return F.upper(F.trim(c))


def clean_symbol(c: Column) -> Column:
    """Without a series suffix (_S and digits) and the .NS ending, and of letters, digits, & and - alone."""
    bare = F.regexp_replace(normalize_ticker(c), r"_S\d+$", "")
    return F.regexp_replace(F.regexp_replace(bare, r"\.NS$", ""), r"[^A-Z0-9&-]", "")


def symbol_override(c: Column, renamed: dict[str, str]) -> Column:
    if not renamed:
        return c
    pairs = F.create_map(*[F.lit(x) for kv in renamed.items() for x in kv])
    return F.coalesce(F.element_at(pairs, c), c)


def clean_universe(*tables: DataFrame, symbol: str = "ticker") -> DataFrame:
    """Distinct cleaned symbols of all tables, without empty ones."""
    symbols = [t.select(clean_symbol(F.col(symbol)).alias(symbol)) for t in tables]
    return reduce(DataFrame.unionByName, symbols).where(F.length(symbol) > 0).distinct()


def validate_universe(df: DataFrame, key: str = "ticker_yf", required: tuple[str, ...] = ("ticker_nse", "ticker_yf", "sector")) -> DataFrame:
    """Rows per sector; NULLs in required columns or repeated keys are an error."""
    coerce_schema(df, {c: "string" for c in required})
    if not df.groupBy(key).count().where("count > 1").isEmpty():
        raise ValueError(f"{key} is not unique")
    return sector_counts(df)


def sector_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("sector").agg(F.count("*").alias("n"))


def price_gap_fill(df: DataFrame) -> DataFrame:
    """Volume NULL to 0; close carried forward within the ticker; open, high and low NULL to close."""
    out = df.withColumn("volume", F.coalesce("volume", F.lit(0.0))).withColumn("close", F.last("close", ignorenulls=True).over(last_rows(None)))
    return out.withColumns({c: F.coalesce(c, "close") for c in ("open", "high", "low")})


def valid_ohlcv(df: DataFrame) -> DataFrame:
    """Rows with positive prices and a volume that is not negative."""
    ok = reduce(lambda a, b: a & b, [F.col(c) > 0 for c in ("open", "high", "low", "close")])
    return df.where(ok & (F.col("volume") >= 0))


def dedupe_panel(df: DataFrame, *order: Column) -> DataFrame:
    """One row per (date, ticker): the first by the given order."""
    w = Window.partitionBy("date", "ticker").orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def min_history(df: DataFrame, days: int = 250) -> DataFrame:
    return df.withColumn("_n", F.count("*").over(Window.partitionBy("ticker"))).where(F.col("_n") >= days).drop("_n")


def date_range(df: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    if start:
        df = df.where(F.col("date") >= F.lit(start).cast("date"))
    return df.where(F.col("date") <= F.lit(end).cast("date")) if end else df


def ticker_subset(df: DataFrame, wanted: DataFrame) -> DataFrame:
    return df.join(wanted.select("ticker").distinct(), "ticker", "left_semi")


def hash_sample(df: DataFrame, n: int, *key: str, seed: int = 42) -> DataFrame:
    """n rows, the same for the same seed."""
    return df.orderBy(F.xxhash64(*key, F.lit(seed)), *key).limit(n)


def calendar(df: DataFrame) -> DataFrame:
    """Each date of the panel and its position among them, from 1. One row per date."""
    return df.select("date").distinct().withColumn("idx", F.row_number().over(Window.orderBy("date")))


def sector_fill(df: DataFrame, lookup: DataFrame) -> DataFrame:
    """NULL sectors from a (ticker, sector) table, else Unknown."""
    found = lookup.select("ticker", F.col("sector").alias("_s")).dropDuplicates(["ticker"])
    return df.join(found, "ticker", "left").withColumn("sector", F.coalesce("sector", "_s", F.lit("Unknown"))).drop("_s")


def reindex_columns(df: DataFrame, columns: list[str], fill: float = 0.0) -> DataFrame:
    """Exactly the named columns, missing ones filled."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(fill).alias(c) for c in columns])


def calendar_missingness(df: DataFrame) -> DataFrame:
    """Share of the calendar's dates that each ticker lacks."""
    days = df.agg(F.count_distinct("date").alias("_days"))
    own = df.groupBy("ticker").agg(F.count_distinct("date").alias("_own"))
    return own.join(F.broadcast(days)).select("ticker", (1 - F.col("_own") / F.col("_days")).alias("missing"))


def panel_quality(df: DataFrame) -> DataFrame:
    """One row of counts that a sound panel has at zero, its extent, and percentiles of the missing share per ticker."""
    bad = reduce(lambda a, b: a | b, [~(F.col(c) > 0) for c in ("open", "high", "low", "close")])
    one = df.agg(
        F.count("*").alias("n_rows"), F.count_distinct("ticker").alias("tickers"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.count_if(bad).alias("bad_prices"), F.count_if(F.col("volume") < 0).alias("bad_volumes"), F.count_if(F.col("sector").isNull()).alias("no_sector"),
        (F.count("*") - F.count_distinct("date", "ticker")).alias("repeated_keys"),
    )
    missing = calendar_missingness(df).agg(*[F.percentile("missing", F.lit(p)).alias(f"missing_p{int(p * 100)}") for p in (0.5, 0.9)])
    return one.join(F.broadcast(missing))


def assert_panel(df: DataFrame, tickers: int = 2, years: float = 1.0) -> None:
    q = panel_quality(df).first()
    span = (q["last_date"] - q["first_date"]).days / 365.25 if q["n_rows"] else 0
    faults = [c for c in ("bad_prices", "bad_volumes", "no_sector", "repeated_keys") if q[c]]
    if faults or q["tickers"] < tickers or span < years:
        raise ValueError(f"panel check failed: {faults or ''} {q['tickers']} tickers, {span:.1f} years")


def null_shares(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, null_share), one row per column."""
    one = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])
    return one.unpivot([], columns, "column", "null_share")


def coverage(df: DataFrame) -> DataFrame:
    """Per ticker: first and last date, distinct days, share of NULL closes."""
    return df.groupBy("ticker").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count_distinct("date").alias("num_days"), F.avg(F.col("close").isNull().cast("double")).alias("null_share"))


def coverage_summary(per_ticker: DataFrame, threshold: float | None = None) -> DataFrame:
    """Tickers, median days and how many are below the threshold (the median where it is None)."""
    mid = per_ticker.agg(F.percentile("num_days", F.lit(0.5)).alias("median_days"))
    rows = per_ticker.join(F.broadcast(mid))
    limit = F.col("median_days") if threshold is None else F.lit(threshold)
    return rows.agg(F.count("*").alias("tickers"), F.first("median_days").alias("median_days"), F.count_if(F.col("num_days") < limit).alias("below"))
