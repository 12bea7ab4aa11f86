"""Point-in-time joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import last_rows


def enhanced_panel(prices: DataFrame, delivery: DataFrame | None = None, ownership: DataFrame | None = None) -> DataFrame:
    """Left joins on (date, ticker), exact matches only; clashing columns get a suffix."""
    out = prices
    for name, other in (("delivery", delivery), ("ownership", ownership)):
        if other is not None:
            clash = {c: f"{c}_{name}" for c in other.columns if c in out.columns and c not in ("date", "ticker")}
            out = out.join(other.withColumnsRenamed(clash), ["date", "ticker"], "left")
    return out


def pit_membership(prices: DataFrame, members: DataFrame) -> DataFrame:
    """Rows of tickers that membership does not know, and rows within one of a ticker's intervals; each row once."""
    span = F.struct("start_date", F.coalesce("end_date", F.lit("9999-12-31").cast("date")).alias("end"))
    spans = members.groupBy(F.col("ticker").alias("_t")).agg(F.collect_list(span).alias("_spans"))  # a few per ticker
    inside = F.exists("_spans", lambda s: F.coalesce((F.col("date") >= s["start_date"]) & (F.col("date") <= s["end"]), F.lit(False)))
    return prices.join(spans, F.col("ticker") == F.col("_t"), "left").where(F.col("_t").isNull() | inside).select(*prices.columns)


def pit_universe(members: DataFrame, as_of: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Tickers whose interval holds as_of, or overlaps [start, end]."""
    low, high = F.coalesce("start_date", F.lit("1900-01-01").cast("date")), F.coalesce("end_date", F.lit("2100-01-01").cast("date"))
    if as_of:
        hit = F.lit(as_of).cast("date").between(low, high)
    else:
        hit = (low <= F.lit(end or "2100-01-01").cast("date")) & (high >= F.lit(start or "1900-01-01").cast("date"))
    return members.where(hit).select("ticker").distinct()


def pit_sector(prices: DataFrame, history: DataFrame) -> DataFrame:
    """Sector valid at the date, else the nearest before, else the nearest after in the ticker; rows without one go."""
    h = history.select(F.col("ticker").alias("_t"), "start_date", F.coalesce("end_date", F.lit("9999-12-31").cast("date")).alias("_end"), F.col("sector").alias("_s"))
    base = prices.drop("sector")
    rows = base.join(h, (F.col("ticker") == F.col("_t")) & F.col("date").between(F.col("start_date"), F.col("_end")), "left")
    once = rows.groupBy(*base.columns).agg(F.min_by("_s", "start_date").alias("_s"))
    after = Window.partitionBy("ticker").orderBy("date").rowsBetween(0, Window.unboundedFollowing)
    filled = F.coalesce(F.last("_s", ignorenulls=True).over(last_rows(None)), F.first("_s", ignorenulls=True).over(after))
    return once.withColumn("sector", filled).where("sector is not null").drop("_s")


def asof(left: DataFrame, right: DataFrame, key: str, on: str, right_on: str, columns: list[str]) -> DataFrame:
    """For each left row the right row of the same key with the latest right_on at or before `on`.

    Both sides are stacked and the last right values carried forward: one exchange by key.
    """
    names = [f"_r_{c}" for c in (right_on, *columns)]
    types = {n: right.schema[c].dataType for n, c in zip(names, (right_on, *columns), strict=True)}
    marks = right.select(F.col(key), F.col(right_on).alias("_at"), F.lit(0).alias("_side"), F.struct(*[F.col(c).alias(n) for n, c in zip(names, (right_on, *columns), strict=True)]).alias("_right"))
    none = F.lit(None).cast("struct<" + ", ".join(f"{n}: {t.simpleString()}" for n, t in types.items()) + ">")
    rows = left.select(F.struct(*left.columns).alias("_left"), F.col(key), F.col(on).alias("_at"), F.lit(1).alias("_side"), none.alias("_right"))
    both = rows.unionByName(marks.withColumn("_left", F.lit(None).cast(rows.schema["_left"].dataType)))
    w = Window.partitionBy(key).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_right", F.last("_right", ignorenulls=True).over(w)).where("_side = 1")
    # The key's own column is passed on, so that windows over it that follow need no exchange.
    of_left = [F.col(key) if c == key else F.col(f"_left.`{c}`") for c in left.columns]
    return out.select(*of_left, *[F.col(f"_right.{n}").alias(c) for n, c in zip(names, (right_on, *columns), strict=True)])


def with_reporting_delay(fundamentals: DataFrame, days: int = 45) -> DataFrame:
    return fundamentals.withColumn("available_date", F.date_add("report_date", days))


def known_only(rows: DataFrame) -> DataFrame:
    """Rows whose report was out at their date."""
    return rows.where(F.col("date") >= F.col("available_date"))


def by_date(df: DataFrame, per_date: DataFrame) -> DataFrame:
    """Left join of a table with one row per date; its size is bounded by the calendar."""
    return df.join(F.broadcast(per_date), "date", "left")


def previous_day(df: DataFrame, calendar: DataFrame, column: str = "close") -> DataFrame:
    """Adds the ticker's value on the calendar's previous date (NULL if it did not trade then)."""
    days = F.broadcast(calendar)
    now = df.join(days, "date")
    before = now.select(F.col("ticker"), (F.col("idx") + 1).alias("idx"), F.col(column).alias(f"prev_{column}"))
    return now.join(before, ["ticker", "idx"], "left").drop("idx")
