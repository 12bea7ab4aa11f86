"""Fundamental features, computed on quarterly rows before any as-of join. Rows: (ticker, date, sector, measures)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from ..functions.windows import div, lag, pct, std, trend, xs_pct_rank, xs_relative_mean, xs_zscore
from .joins import asof

KEYS = ("date", "sector")
P = "fundamental__"


def ratio(a: str, b: str, factor: float = 1.0) -> Column:
    """factor * a / b where b is positive."""
    return F.when(F.col(b) > 0, factor * F.col(a) / F.col(b))


def metrics(df: DataFrame) -> DataFrame:
    """Ratios of raw statement figures, as far as their inputs are there."""
    made = {
        "roe": ("net_income", "equity", 4.0), "roa": ("net_income", "assets", 4.0), "gross_margin": ("gross_profit", "revenue", 1.0), "operating_margin": ("operating_income", "revenue", 1.0), "net_margin": ("net_income", "revenue", 1.0),
        "debt_to_equity": ("debt", "equity", 1.0), "current_ratio": ("current_assets", "current_liabilities", 1.0), "quick_ratio": ("quick_assets", "current_liabilities", 1.0), "cash_to_debt": ("cash", "debt", 1.0), "cf_to_ni": ("operating_cf", "net_income", 1.0),
    }
    out = df.withColumns({k: ratio(a, b, f) for k, (a, b, f) in made.items() if a in df.columns and b in df.columns})
    if {"net_income", "operating_cf", "assets"} <= set(df.columns):
        out = out.withColumn("accruals", F.when(F.col("assets") > 0, (F.col("net_income") - F.col("operating_cf")) / F.col("assets")))
    return out


def sector_relative(x: str, how: str) -> Column:
    if how == "relative_mean":
        return xs_relative_mean(x, *KEYS)
    if how == "zscore":
        return xs_zscore(x, *KEYS)
    if how == "rank_pct":
        return xs_pct_rank(x, *KEYS)
    raise ValueError(f"unknown method {how}")


GROWTH = {"revenue": "revenue_growth", "net_income": "earnings_growth", "eps": "eps_growth"}


def over_time(df: DataFrame, profits: bool = True, growths: bool = True) -> DataFrame:
    """Windows over a ticker's statements, those that are not there yet. The cross sections of all groups follow them, so
    that statements are exchanged once by ticker and once by date and sector."""
    out = df
    if profits and "roe" in df.columns and P + "roe_trend_4q" not in df.columns:
        out = out.withColumn(P + "roe_trend_4q", trend("roe", 4))
    if profits and "net_margin" in df.columns and P + "margin_expansion_4q" not in df.columns:
        out = out.withColumn(P + "margin_expansion_4q", F.col("net_margin") - lag("net_margin", 4))
    new = {P + n: x for x, n in GROWTH.items() if growths and x in df.columns and P + n not in df.columns}
    out = out.withColumns({g: pct(x, 4) for g, x in new.items()})
    return out.withColumns({g + "_acceleration": F.col(g) - lag(g) for g in new} | {g + "_stability": std(g, 8) for g in new})


def valuation(df: DataFrame) -> DataFrame:
    cols = {}
    for x in ("pe_ratio", "pb_ratio", "ps_ratio"):
        if x in df.columns:
            cols |= {P + x: F.col(x), P + x[:2] + "_inverse": div(F.lit(1.0), x), P + x + "_sector_rel": sector_relative(x, "relative_mean"), P + x + "_sector_z": sector_relative(x, "zscore"), P + x + "_sector_rank": sector_relative(x, "rank_pct")}
    out = df.withColumns(cols)
    if {"pe_ratio", "pb_ratio"} <= set(df.columns):
        out = out.withColumn(P + "value_composite", (-F.col(P + "pe_ratio_sector_z") - F.col(P + "pb_ratio_sector_z")) / 2)
    return out


def profitability(df: DataFrame) -> DataFrame:
    have = [x for x in ("roe", "roa", "gross_margin", "operating_margin", "net_margin") if x in df.columns]
    out = over_time(df, growths=False).withColumns({P + x: F.col(x) for x in have} | {P + x + "_sector_z": sector_relative(x, "zscore") for x in have})
    if "roe" in have:
        out = out.withColumn(P + "roe_sector_rank", sector_relative("roe", "rank_pct"))
    if {"roe", "net_margin"} <= set(have):
        out = out.withColumn(P + "profitability_composite", (F.col(P + "roe_sector_z") + F.col(P + "net_margin_sector_z")) / 2)
    return out


def growth(df: DataFrame) -> DataFrame:
    made = [P + n for x, n in GROWTH.items() if x in df.columns]
    return over_time(df, profits=False).withColumns({g + "_sector_z": sector_relative(g, "zscore") for g in made})


def balance_sheet(df: DataFrame) -> DataFrame:
    have = [x for x in ("debt_to_equity", "current_ratio", "quick_ratio", "cash_to_debt") if x in df.columns]
    out = df.withColumns({P + x: F.col(x) for x in have} | {P + x + "_sector_z": sector_relative(x, "zscore") for x in have})
    if {"debt_to_equity", "current_ratio"} <= set(have):
        out = out.withColumn(P + "financial_strength", (-F.col(P + "debt_to_equity_sector_z") + F.col(P + "current_ratio_sector_z")) / 2)
    return out


def quality(df: DataFrame) -> DataFrame:
    z = sector_relative("accruals", "zscore")
    return df.withColumns({P + "accruals": F.col("accruals"), P + "cf_to_ni": F.col("cf_to_ni"), P + "accruals_sector_z": z, P + "quality_score": -z})


#: group of features -> measures of the statements, or ratios of metrics(), one of which it needs
GROUPS = {
    valuation: ("pe_ratio", "pb_ratio", "ps_ratio"), profitability: ("roe", "roa", "gross_margin", "operating_margin", "net_margin"), growth: ("revenue", "net_income", "eps"),
    balance_sheet: ("debt_to_equity", "current_ratio", "quick_ratio", "cash_to_debt"),
}


def features(statements: DataFrame) -> DataFrame:
    """All groups of features whose measures the statements (ticker, date, sector, measures) have."""
    out = over_time(metrics(statements))
    for group, needs in GROUPS.items():
        if any(c in out.columns for c in needs):
            out = group(out)
    return quality(out) if {"accruals", "cf_to_ni"} <= set(out.columns) else out


def block(df: DataFrame, statements: DataFrame, delay: int = 45) -> DataFrame:
    """Rows of df with the features of the ticker's latest statement that was out at their date, `delay` days after its own."""
    known = features(statements)
    made = [c for c in known.columns if c.startswith(P)]
    known = known.select("ticker", F.date_add("date", delay).alias("_out"), *made)
    return asof(df, known, "ticker", "date", "_out", made).drop("_out")
