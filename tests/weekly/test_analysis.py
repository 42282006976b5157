"""End-to-end reports: shapes, bounds and the store."""

import datetime as dt

import numpy as np

from tests.weekly.books import book
from tests.weekly.test_ingest import index_rows
from weftline.operators import estimators as es
from weftline.plans import analysis, views

START = dt.date(2018, 1, 1)


def make(spark):
    t = np.arange(260)
    r = np.random.default_rng(5)
    values = {"a": 100 + 0.2 * t + 6 * np.sin(t / 9) + r.normal(size=260) * 0.4, "b": 100 + np.cumsum(r.normal(size=260)), "c": np.linspace(100, 101, 50)}
    return spark.createDataFrame([(k, START + dt.timedelta(weeks=i), float(v)) for k, vs in values.items() for i, v in enumerate(vs)], "region string, date date, value double")


def test_dashboard(spark):
    got = analysis.analyse(make(spark), 13, models={"HoltLog": es.holt_log})
    rows = got.forecast.collect()
    # a series too short for a back-test still gets a forecast, by the first model by name
    assert {r.region for r in rows} == {"a", "b", "c"} and len(rows) == 39 and {r.selected_models for r in rows if r.region == "c"} == {"Drift"}
    assert all(r.p10 <= r.p50 <= r.p90 and r.selected_models for r in rows)
    assert {r.model for r in got.backtest.leaderboard.collect()} == {"Naive", "Drift", "SeasonalNaive52", "HoltLog"}
    assert "c" in {r.region for r in got.backtest.warnings.collect()}
    chart = views.forecast_chart(got.history, got.forecast, 50).collect()
    assert sum(r.kind == "history" for r in chart if r.region == "a") == 50
    shown, marks = views.technical_chart(got.indicators, got.events, 60)
    assert shown.where("region = 'a'").count() == 60 and marks.count() <= got.events.count()
    labels = {r.model: r.model_label for r in views.labelled(got.backtest.leaderboard).collect()}
    assert labels["HoltLog"] == "Holt 로그 추세"


def test_library(spark):
    got = analysis.library_report(make(spark).where("region <> 'c'"), 13, horizons=(13,), boosting=False)
    board = got.leaderboard.collect()
    assert {r.model for r in board} == {"Naive", "Drift", "SeasonalNaive52", "AutoETS", "AutoARIMA", "Top2Ensemble"}
    assert got.forecast.count() == 26 and got.event_summary.count() == 4
    for r in got.risk.collect():
        assert 0 <= r.high_risk_score <= 100 and 0 <= r.low_zone_score <= 100
    assert all(r.negative_vote + r.positive_vote <= 100 for r in got.model_table.collect())


def test_store_is_used_again(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.xlsx").write_bytes(book([("매매지수", index_rows(110))]))
    first = analysis.panel_of(spark, str(tmp_path / "in"), str(tmp_path / "store"))
    n = first.count()
    files = sorted(p.name for p in (tmp_path / "store").rglob("*.parquet"))
    assert analysis.panel_of(spark, str(tmp_path / "in"), str(tmp_path / "store")).count() == n == 220
    assert sorted(p.name for p in (tmp_path / "store").rglob("*.parquet")) == files
