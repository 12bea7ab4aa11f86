"""CSV folders whose files differ, and company pages."""

import datetime

import pytest

from sigloom.sources import csv_folder, scans
from sigloom.sources import fundamental_pages as pages


def put(folder, **files):
    for name, text in files.items():
        (folder / f"{name}.csv").write_text(text, encoding="utf-8")
    return f"file://{folder}"


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_each_file_has_its_own_header(spark, tmp_path):
    """The case that gave wrong prices: two files with columns in another order."""
    path = put(tmp_path, a="date,open,close,high,low,volume\n2024-01-01,1,4,5,0.5,10\n", b="﻿Volume, Close ,date,high,low,open\n\"1,234\",2,02-Jan-2024,3,1,\"1\"\n\n")
    got = scans.csv_per_ticker(spark, path)
    assert rows(got, "ticker", "date", "open", "close", "volume") == [("A", datetime.date(2024, 1, 1), 1.0, 4.0, 10.0), ("B", datetime.date(2024, 1, 2), 1.0, 2.0, 1234.0)]


def test_a_price_file_without_a_column_is_an_error(spark, tmp_path):
    path = put(tmp_path, a="date,open,high,low,close,volume\n", b="date,open,high,low,close\n2024-01-01,1,1,1,1\n")
    with pytest.raises(Exception, match=r"b\.csv: missing columns: \['volume'\]"):
        scans.csv_per_ticker(spark, path).collect()
    with pytest.raises(Exception, match="missing columns"):
        scans.csv_fallback(spark, put(tmp_path, a="close\n1\n", b="date,close\n2024-01-01,2\n")).collect()


def test_fallback_reads_quoted_cells_and_names_files_without_ticker(spark, tmp_path):
    path = put(tmp_path, inf="date,close,volume\n2024-01-01,2,\"1,234\"\n2024-01-02,,\n", many="ticker,date,close,extra\n\"a,b\",2024-01-01,3,\"x\ny\"\n,2024-01-02,4,z\n")
    got = scans.csv_fallback(spark, path)
    assert rows(got, "ticker", "close", "volume") == [("INF", 2.0, 1234.0), ("INF", None, None), ("a,b", 3.0, None), (None, 4.0, None)]


def test_delivery_leaves_out_and_reports_files(spark, tmp_path):
    path = put(
        tmp_path, a="TradingSymbol,DATE,DeliveryQty,TradedQty\nX,2024-01-01,5,10\nY,2024-01-01,5,0\n", b="date,tradingsymbol,deliveryqty\n2024-01-01,Z,1\n2024-01-02,Z,1\n", empty="",
        c=" TRADEDQTY , DELIVERYQTY,DATE,TRADINGSYMBOL\n\"2,000\",500,01-Jan-2024,W\n",
    )
    assert rows(scans.delivery_csv(spark, path), "ticker", "delivery_qty", "traded_qty", "delivery_ratio") == [("W", 500.0, 2000.0, 0.25), ("X", 5.0, 10.0, 0.5), ("Y", 5.0, 0.0, None)]
    report = {r["file"]: r for r in csv_folder.csv_report(spark, path, scans.DELIVERY).collect()}
    assert {k: (r["rows"], r["left_out"]) for k, r in report.items()} == {"A": (2, False), "B": (2, True), "C": (1, False), "EMPTY": (0, True)}
    assert report["B"]["missing"] == ["tradedqty"] and len(report["EMPTY"]["missing"]) == 4


def test_rows_of_other_lengths(spark, tmp_path):
    path = put(tmp_path, a="date,close,volume\n2024-01-01\n2024-01-02,2,3,,\n")
    got = csv_folder.csv_folder(spark, path, ["date", "volume"])
    assert rows(got, "date", "volume") == [("2024-01-01", None), ("2024-01-02", "3")]
    with pytest.raises(Exception, match="4 cells under 3 names"):
        csv_folder.csv_folder(spark, put(tmp_path, a="date,close,volume\n2024-01-01,1,2,3\n"), ["date"]).collect()


def test_partitions_and_missing_folders(spark, tmp_path):
    path = put(tmp_path, **{f"f{i}": "date\n" + "2024-01-01\n" * 10 for i in range(6)})
    assert csv_folder.csv_folder(spark, path, ["date"], partition_bytes=200).rdd.getNumPartitions() > 1
    assert csv_folder.csv_folder(spark, path, ["date"]).count() == 60
    assert csv_folder.csv_folder(spark, path + "/f1.csv", ["date"]).count() == 10
    with pytest.raises(Exception, match=r"(?i)no csv files|not exist|FileNotFound"):
        (tmp_path / "none").mkdir()
        csv_folder.csv_folder(spark, path + "/none", ["date"]).count()


PAGE = """<html><body><ul><li class="flex flex-space-between"><span class="name"> Market Cap
</span><span class="nowrap value">&#8377; <span class="number">1,234</span> Cr.</span></li>
<li class="flex flex-space-between"><span class="name">Stock P/E</span><span class="number">-</span></li>
<li class="flex flex-space-between extra"><span class="name">Debt to equity</span><span class="number">0.5 Cr.</span><span class="number">9</span></li>
<li class="flex"><span class="name">ROE</span><span class="number">12 %</span></li>
<li class="flex flex-space-between"><span class="name">ROCE</span><span class="number">12.5 %</span></li></ul>
<table class="data-table"><thead><tr><th></th><th>Mar 1999</th></tr></thead><tbody><tr><td>Sales</td><td>1</td></tr></tbody></table>
<section id="quarters"><table class="other"><tr><td>Sales</td><td>7</td></tr></table>
<table class="data-table x"><thead><tr><th></th><th>Mar 2024</th><th> Dec 2023 </th><th>Raw PDF</th><th>Oct 2023</th></tr></thead>
<tbody><tr><td class="text">Sales</td><td>1,000</td><td>-</td><td>3</td><td>9</td></tr><tr><td>Net Profit</td><td><b>5</b>%</td></tr>
<tr><td>EPS in Rs</td><td>1.5</td><td>2.5</td></tr><tr></tr></tbody></table></section>
<section id="more"><table class="data-table"><thead><tr><th></th><th>Jun 2020</th></tr></thead></table></section></body></html>"""


def test_company_pages(spark):
    df = spark.createDataFrame([("A", PAGE), ("B", "<li class='flex flex-space-between'><span class=name>ROE</span><span class=number>3%</span>"), ("C", "<p>none"), ("D", None), ("E", "")], "symbol string, html string")
    got = {(r["symbol"], r["report_date"]): r for r in pages.page_fundamentals(df).collect()}
    day = datetime.date
    assert set(got) == {("A", day(2024, 3, 31)), ("A", day(2023, 12, 31)), ("A", day(2023, 10, 1)), ("B", None)}
    first, second, third = got["A", day(2024, 3, 31)], got["A", day(2023, 12, 31)], got["A", day(2023, 10, 1)]
    assert (first["revenue"], first["net_income"], first["eps"], first["market_cap"], first["pe_ratio"], first["debt_to_equity"], first["roe"], first["roce"]) == (1000.0, 5.0, 1.5, 1234.0, None, 5e6, None, 12.5)
    assert (second["revenue"], second["eps"], second["market_cap"], third["revenue"], third["eps"]) == (None, 2.5, None, 3.0, None)
    assert got["B", None]["roe"] == 3.0 and got["B", None]["revenue"] is None
