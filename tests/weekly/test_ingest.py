"""Workbooks to panels on both paths, with the quality report."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests.weekly.books import book
from weftline.operators import ingest
from weftline.sources import workbook

START = dt.date(2020, 1, 6)
HEAD = ["구분", "전국", "서울특별시", "강북구", "6개광역시", "강남구"]


def week(k):
    return START + dt.timedelta(weeks=k)


def index_rows(n=130, gaps=()):
    rows = [["주간 매매가격지수"], HEAD]
    for k in range(n):
        d = week(k)
        when = [(d + dt.timedelta(days=k % 5)).strftime("%Y.%m.%d"), d.strftime("%Y-%m-%d"), (d - dt.date(1899, 12, 30)).days, d.strftime("%Y/%m/%d")][k % 4]
        rows.append([when, 100 + k, None if ("서울특별시", k) in gaps else f"{1000 + k:,}", None if ("강북구", k) in gaps else 50 + k / 8, 7.0, 9.0])
    return rows


@pytest.fixture(scope="module")
def cells(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("books")
    gaps = {("서울특별시", 10), ("강북구", 20), ("강북구", 21), ("강북구", 22)}
    rows = index_rows(gaps=gaps)
    rows[40][1] = "n/a"
    (path / "a.xlsx").write_bytes(book([("notes", [["nothing", "here"]]), ("매매지수", rows), ("전세지수", index_rows(120), "hidden")]))
    return workbook.cells(spark, str(path)).cache()


def test_cells(cells):
    got = {(r.sheet_name, r.row_idx, r.col_idx): (r.kind, r.raw) for r in cells.collect()}
    assert got[("매매지수", 1, 0)] == ("text", "구분") and got[("매매지수", 2, 2)] == ("text", "1,000")
    assert got[("매매지수", 4, 0)][0] == "number" and "lost" not in {k[0] for k in got}
    assert cells.select("sheet_state").where("sheet_name = '전세지수'").first()[0] == "hidden"


def test_column_index(spark):
    rows = spark.createDataFrame([("A1",), ("Z9",), ("AA10",), ("ab2",), ("12",)], "r string").select(workbook.column_index(F.col("r"))).collect()
    assert [r[0] for r in rows] == [0, 25, 26, 27, 0]
    there = {"xl/a", "xl/worksheets/b.xml"}
    assert {workbook.find_part(t, there) for t in ("/xl/a", "xl/a", "a", "../xl/a", "worksheets/../a")} == {"xl/a"}
    assert workbook.find_part("b.xml", there) is None and workbook.find_part("worksheets/b.xml", there) == "xl/worksheets/b.xml"


def test_dates(spark):
    rows = [("45000", "number"), ("500", "number"), ("-3", "number"), ("2024.1.8", "text"), (" 2024 - 01 - 08", "text"), ("2024/01/08", "text"), ("20240108", "text"), ("45000", "text"), ("soon", "text"), ("2024-01", "text"), ("Jan 8, 2024", "text"), ("2024-01-08 10:30", "text"), ("2024-01-08T00:00:00", "date")]
    got = spark.createDataFrame(rows, "raw string, kind string").select(ingest.library_date(F.col("raw"), F.col("kind")), ingest.dashboard_date(F.col("raw"))).collect()
    d, s = dt.date(2024, 1, 8), dt.date(2023, 3, 15)
    more = [dt.date(2024, 1, 1), d, d, d]
    assert [r[0] for r in got] == [s, dt.date(1901, 5, 14), None, d, d, d, d, None, None, *more]
    assert [r[1] for r in got] == [s, None, None, d, d, d, None, s, None, *more]


def test_detection(cells):
    scores = {r.sheet_name: r for r in ingest.sheet_scores(cells).collect()}
    assert ingest.best_sheet(ingest.sheet_scores(cells)).first().sheet_name == "매매지수"
    assert scores["매매지수"].score > scores["전세지수"].score > scores["notes"].score
    # the hidden sheet differs by its state alone
    assert abs(scores["매매지수"].score - scores["전세지수"].score - 0.55) < 0.02
    inventory = [(r.sheet_name, r.metric, r.score, r.rows) for r in ingest.sheet_inventory(cells).collect()]
    assert inventory == [("매매지수", "매매지수", 7, 132), ("전세지수", "매매지수", 7, 122), ("notes", "-", 0, 1)] or inventory[-1] == ("notes", "-", 0, 1)


def test_headers(spark):
    names = spark.createDataFrame([("s", "f", "t", k, n) for k, n in enumerate(["a", "b", "a", None, " ", "a"])], "source_name string, fingerprint string, sheet_name string, col_idx int, raw string")
    assert [r.header for r in ingest.unique_headers(names).orderBy("col_idx").collect()] == ["a", "b", "a_2", "column_3", "column_4", "a_3"]


def test_library_path(cells):
    rows = ingest.library_rows(cells).cache()
    panel = {(r.region, r.date): r for r in ingest.library_panel(rows).collect()}
    assert {k[0] for k in panel} == set(HEAD[1:])
    assert panel[("서울특별시", week(10))].value == 1010 and panel[("서울특별시", week(10))].is_imputed
    assert panel[("강북구", week(21))].value is None and not panel[("강북구", week(21))].is_imputed
    assert all(k[1].weekday() == 0 for k in panel)
    report = ingest.quality_report(rows).first()
    assert report.blocking_errors == ["Region '강북구' contains a missing weekly run of 3 weeks or longer after reindexing."]
    assert "Some worksheet cells could not be converted into numeric values." in report.warnings and any("서울특별시" in w for w in report.warnings)
    assert report.stats.unique_weeks == 130 and report.stats.regions == 5 and report.stats.max_missing_run == 3
    assert "강북구" in ingest.report_json(ingest.quality_report(rows)).first().json


def test_dashboard_path(cells):
    rows = ingest.dashboard_rows(cells).cache()
    assert {r.region for r in rows.select("region").distinct().collect()} == {"서울특별시", "강북구"}
    panel = {(r.region, r.date): r for r in ingest.dashboard_panel(rows).collect()}
    assert panel[("강북구", week(21))].value == 50 + 21 / 8 and panel[("강북구", week(21))].is_imputed
    assert panel[("서울특별시", week(3))].region_group == "서울 전체" and panel[("강북구", week(3))].metric == "매매지수"
    assert ingest.series_of(ingest.dashboard_panel(rows), "매매지수").count() == 260


def test_workbooks_do_not_meet(spark, tmp_path):
    for k, name in enumerate("ab"):
        rows = index_rows(110)
        for row in rows[2:]:
            row[1] = row[1] + k
        rows[50][0] = "no date"
        (tmp_path / f"{name}.xlsx").write_bytes(book([("매매지수", rows)]))
    (tmp_path / "c.xlsx").write_bytes(book([("매매지수", [HEAD])]))
    (tmp_path / "d.xlsx").write_bytes(book([("매매지수", [])]))
    cells = workbook.cells(spark, str(tmp_path)).cache()
    rows = ingest.library_rows(cells).cache()
    books = spark.createDataFrame([(f"{n}.xlsx", f) for n, f in {r.source_name[0]: r.fingerprint for r in cells.collect()}.items()] + [("d.xlsx", "-")], "source_name string, fingerprint string")
    report = {r.source_name: r for r in ingest.quality_report(rows, layout=ingest.layouts(cells), books=books).collect()}
    assert set(report) == {"a.xlsx", "b.xlsx", "c.xlsx", "d.xlsx"}
    for name in ("a.xlsx", "b.xlsx"):
        r = report[name]
        # a week that no region has is a week of the grid all the same
        assert r.blocking_errors == [] and r.stats.unique_weeks == 110 and r.stats.duplicate_conflicts == 0 and r.stats.regions == 5
        assert r.detected_layout.date_column == "구분" and r.detected_layout.columns == HEAD and r.detected_layout.sheet_scores[0].sheet_name == "매매지수"
    assert report["c.xlsx"].blocking_errors == [ingest.NO_ROWS, ingest.NO_SERIES] and report["d.xlsx"].blocking_errors[0] == ingest.EMPTY
    panel = ingest.library_panel(rows).collect()
    assert len(panel) == 2 * 5 * 110 and {r.source_file for r in panel} == {"a.xlsx", "b.xlsx"}
    assert ingest.dashboard_panel(ingest.dashboard_rows(cells)).groupBy("source_name", "metric").count().count() == 2
    assert "sheet_scores" in ingest.report_json(ingest.quality_report(rows, layout=ingest.layouts(cells))).first().json


def test_conflicting_weeks(spark):
    base = [("s", "f", "t", "a", week(k), k, "1", 1.0) for k in range(110)]
    rows = spark.createDataFrame([*base, ("s", "f", "t", "a", week(3), 200, "2", 2.0), *[("s", "f", "t", "b", week(k), k, "1", 1.0) for k in range(50)]], "source_name string, fingerprint string, sheet_name string, region string, date date, row_idx int, raw string, value double")
    report = ingest.quality_report(rows).first()
    assert "Region 'a' contains conflicting duplicate weekly values." in report.blocking_errors
    assert any("has only 50" in e for e in report.blocking_errors) and any("only 50 unique" in e for e in report.blocking_errors)
    assert {r.region for r in ingest.library_panel(rows).collect()} == {"b"}
