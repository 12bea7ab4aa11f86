"""Company pages with a table of quarters and a list of ratios, as one row per (symbol, quarter)."""

from __future__ import annotations

import calendar
import datetime
import re
from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Labels of the rows of the quarters table and of the list of ratios, and their columns.
QUARTER_LABELS = {"sales": "revenue", "operating profit": "operating_profit", "net profit": "net_income", "eps in rs": "eps"}
RATIO_LABELS = {
    "market cap": "market_cap", "stock p/e": "pe_ratio", "book value": "book_value_per_share", "dividend yield": "dividend_yield", "roce": "roce", "roe": "roe", "face value": "face_value",
    "price to book value": "pb_ratio", "debt to equity": "debt_to_equity", "current ratio": "current_ratio", "sales growth": "sales_growth", "profit growth": "profit_growth", "return on equity": "roe",
}
CRORE = 1e7
MEASURES = [*QUARTER_LABELS.values(), *dict.fromkeys(RATIO_LABELS.values())]
SCHEMA = "report_date date, " + ", ".join(f"{m} double" for m in MEASURES)


class CompanyPage(HTMLParser):
    """The cells of the first data table in the section of quarters, and the (name, number) pairs of the ratio list."""

    def __init__(self, html: str):
        super().__init__()
        self.header: list[str] = []
        self.rows: list[list[str]] = []
        self.ratios: list[dict[str, str]] = []
        self.sections: list[bool] = []
        self.tables = 0
        self.in_table = self.in_head = self.in_item = False
        self.into: tuple[list | dict, int | str] | None = None
        self.feed(html)
        self.close()

    def handle_starttag(self, tag: str, attrs) -> None:
        given = dict(attrs)
        classes = set((given.get("class") or "").split())
        if tag == "section":
            self.sections.append(given.get("id") == "quarters")
        elif tag == "table" and any(self.sections) and "data-table" in classes and not self.tables:
            self.tables, self.in_table = 1, True
        elif tag == "li":
            self.in_item = {"flex", "flex-space-between"} <= classes
            if self.in_item:
                self.ratios.append({})
        elif self.in_item and tag == "span" and classes & {"name", "number"}:
            self._begin(self.ratios[-1], "name" if "name" in classes else "number")
        elif self.in_table:
            if tag == "thead":
                self.in_head = True
            elif tag == "tr" and not self.in_head:
                self.rows.append([])
            elif tag == "th" and self.in_head:
                self._begin(self.header, len(self.header))
            elif tag == "td" and self.rows:
                self._begin(self.rows[-1], len(self.rows[-1]))

    def handle_endtag(self, tag: str) -> None:
        if tag == "section" and self.sections:
            self.sections.pop()
        elif tag == "table":
            self.in_table = self.in_head = False
        elif tag == "thead":
            self.in_head = False
        elif tag == "li":
            self.in_item = False
        if tag in ("th", "td", "li", "tr") or (tag == "span" and self.in_item and isinstance(self.into and self.into[0], dict)):
            self.into = None

    def _begin(self, cells: list | dict, at: int | str) -> None:
        if isinstance(cells, list):
            cells.append("")
        elif at in cells:
            return  # the first of a kind counts
        else:
            cells[at] = ""
        self.into = (cells, at)

    def handle_data(self, data: str) -> None:
        if self.into is not None:
            cells, at = self.into
            cells[at] += data


def quarter_end(text: str) -> datetime.date | None:
    """The last day of a quarter's month, as in `Mar 2024`; the first of another month; None if it is no month."""
    try:
        day = datetime.datetime.strptime(text.strip(), "%b %Y").date()
    except ValueError:
        return None
    return day.replace(day=calendar.monthrange(day.year, day.month)[1]) if day.month % 3 == 0 else day


def figure(text: str) -> float | None:
    """A number with commas or a percent sign, or in crores; None for dashes and other texts."""
    bare = re.sub(r"[,%]", "", text).strip()
    factor = CRORE if "Cr." in bare else 1.0
    try:
        return float(bare.replace("Cr.", "").replace("₹", "").strip()) * factor
    except ValueError:
        return None


def page_rows(html: str | None) -> Iterator[dict]:
    """A row per quarter of a page, its ratios with the first; a page of ratios alone is one row without a date."""
    page = CompanyPage(html or "")
    dates = [d for d in map(quarter_end, page.header[1:]) if d is not None]
    rows: list[dict] = [{"report_date": d} for d in dates] or [{"report_date": None}]
    for cells in page.rows if dates else []:
        measure = QUARTER_LABELS.get(cells[0].strip().lower()) if cells else None
        for row, text in zip(rows, cells[1:], strict=False):
            value = figure(text)
            if measure and value is not None:
                row[measure] = value
    for item in page.ratios:
        measure = RATIO_LABELS.get(item.get("name", "").strip().lower())
        value = figure(item.get("number", ""))
        if measure and value is not None:
            rows[0][measure] = value
    return (row for row in rows if row["report_date"] is not None or len(row) > 1)


@F.udtf(returnType=SCHEMA)
class PageQuarters:
    """The rows of one page, as a table function."""

    def eval(self, html: str):
        for row in page_rows(html):
            yield (row["report_date"], *[row.get(m) for m in MEASURES])


def page_fundamentals(pages: DataFrame) -> DataFrame:
    """symbol, report_date and the measures of each page (symbol, html), by a lateral join; pages without figures have no row."""
    found = pages.select("symbol", "html").lateralJoin(PageQuarters(F.col("html").outer()))
    return found.select("symbol", "report_date", *MEASURES)
