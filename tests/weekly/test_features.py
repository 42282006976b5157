"""Windows and folds against pandas, and the semantic traps."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weftline.functions import stats
from weftline.operators import backtest as bt
from weftline.operators import features as ft
from weftline.operators import macro as mc
from weftline.operators import panel as pn
from weftline.operators import signals as sg
from weftline.plans import views

START = dt.date(2018, 1, 1)


def frame(spark, **regions):
    rows = [(r, START + dt.timedelta(weeks=k), None if v is None else float(v)) for r, vs in regions.items() for k, v in enumerate(vs)]
    return spark.createDataFrame(rows, "region string, date date, value double")


def column(df, name, region="a"):
    return [r[name] for r in df.where(F.col("region") == region).orderBy("date").collect()]


def same(got, want, tol=1e-9):
    want = [None if pd.isna(w) else float(w) for w in want]
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert (g is None) == (w is None), (g, w)
        assert g is None or abs(g - w) <= tol * max(1, abs(w)), (g, w)


@pytest.fixture(scope="module")
def wave():
    r = np.random.default_rng(3)
    return pd.Series(100 + np.cumsum(r.normal(size=200)))


@pytest.fixture(scope="module")
def matrix(spark, wave):
    return ft.feature_matrix(frame(spark, a=wave)).cache()


def test_feature_matrix(matrix, wave):
    ema = lambda s, n: s.ewm(span=n, adjust=False).mean()
    macd = ema(wave, 12) - ema(wave, 26)
    t3 = ema(ema(ema(wave, 12), 12), 12)
    trix = t3.pct_change() * 100
    for name, want in {
        "lag_7": wave.shift(7), "roll_mean_13": wave.rolling(13).mean(), "roll_std_26": wave.rolling(26).std(), "drawdown_26": wave / wave.rolling(26, min_periods=4).max() - 1,
        "recovery_26": wave / wave.rolling(26, min_periods=4).min() - 1, "yoy_52": wave.pct_change(52), "ma24": wave.rolling(24).mean(), "macd": macd, "macd_signal": ema(macd, 9),
        "trix": trix, "trix_signal": ema(trix, 9), "disparity24": wave / wave.rolling(24).mean() * 100,
    }.items():
        same(column(matrix, name), want)
    assert len(matrix.columns) == 50 and column(matrix, "ichimoku_state")[:51] == [0.0] * 51


def test_indicators(spark, wave):
    got = ft.indicator_frame(frame(spark, a=wave, b=[100.0] * 60)).cache()
    d = wave.diff()
    gain, loss = (x.ewm(alpha=1 / 14, adjust=False).mean() for x in (d.clip(lower=0), -d.clip(upper=0)))
    same(column(got, "rsi14"), 100 - 100 / (1 + gain / loss.replace(0, np.nan)))
    same(column(got, "bb_upper"), wave.rolling(20, min_periods=12).mean() + 2 * wave.rolling(20, min_periods=12).std())
    same(column(got, "zscore26"), (wave - wave.rolling(26, min_periods=13).mean()) / wave.rolling(26, min_periods=13).std())
    same(column(got, "ma52"), wave.rolling(52, min_periods=26).mean())
    # a constant series: no spread and no loss give null, not a division by zero
    assert set(column(got, "zscore26", "b")) == {None} and set(column(got, "rsi14", "b")) == {None}


def test_percentile_of_last_with_gaps(spark, wave):
    x = wave.copy()
    x[::7] = np.nan

    def last(v):
        v = v[~np.isnan(v)]
        return (v <= v[-1]).mean() * 100

    got = frame(spark, a=[None if pd.isna(v) else v for v in x]).select("region", "date", ft.percentile_of_last(F.col("value"), 156, 26).alias("p"))
    same(column(got, "p"), x.rolling(156, min_periods=26).apply(last, raw=True))


@pytest.mark.parametrize("gap", range(1, 13))
def test_gaps(spark, gap):
    values = [1.0, *[None] * gap, 1.0 + gap + 1]
    s = pd.Series(values, dtype=float)
    grid = frame(spark, a=values)
    want = s.interpolate(limit=2, limit_direction="both")
    same(column(pn.interpolated(grid, 2), "filled"), want)
    twice = want.dropna().reindex(range(len(s))).interpolate(limit=2, limit_direction="both")
    same(column(pn.series(grid), "value"), twice.dropna())
    assert (None in column(pn.fill_library(grid), "value")) == (gap >= 3)
    assert pn.with_runs(grid).agg(F.max("run")).first()[0] == gap


def slow_turns(v):
    """Turning points by loops: smoothed extremum of six rows around, four rows on the other side, two percent within thirteen."""
    smooth = [sum(v[max(0, k - 2) : k + 1]) / len(v[max(0, k - 2) : k + 1]) for k in range(len(v))]
    out = []
    for k, x in enumerate(v):
        around, ahead = smooth[max(0, k - 6) : k + 7], v[k + 1 : k + 14]
        if len(ahead) < 4 or len(around) < 7:
            continue
        if smooth[k] == max(around) and min(ahead) / x - 1 <= -0.02 and all(y < x for y in ahead[:4]):
            out.append((k, "peak"))
        if smooth[k] == min(around) and max(ahead) / x - 1 >= 0.02 and all(y > x for y in ahead[:4]):
            out.append((k, "trough"))
    return out


def test_turning_points(spark, wave):
    up, down = [100 + k / 2 for k in range(20)], [110 - k / 2 for k in range(20)]
    values = {"a": up + down + up + down, "b": [5.0] * 80, "c": [float(round(x)) for x in wave]}
    got = ft.turning_points(frame(spark, **values)).collect()
    for r, v in values.items():
        assert sorted(((x.date - START).days // 7, x.event) for x in got if x.region == r) == slow_turns(v)
    assert len(slow_turns(values["c"])) > 3


def test_t_and_binomial_tails(spark):
    rows = [(0.0, 5), (1.476, 5), (2.015, 5), (-2.015, 5), (1.372, 10), (6.314, 1), (1.886, 2), (1.658, 120), (2.358, 120)]
    got = spark.createDataFrame(rows, "t double, df int").select(stats.t_tail(F.col("t"), F.col("df"))).collect()
    for (g,), w in zip(got, (0.5, 0.1, 0.05, 0.95, 0.1, 0.05, 0.1, 0.05, 0.01), strict=True):
        assert abs(g - w) < 2e-4
    cases = [(k, n) for n in (1, 2, 9, 40) for k in range(n + 1)]
    found = spark.createDataFrame(cases, "k int, n int").select(stats.binomial_tail(F.col("k"), F.col("n"))).collect()
    for (g,), (k, n) in zip(found, cases, strict=True):
        assert abs(g - sum(math.comb(n, j) for j in range(k, n + 1)) / 2**n) < 1e-12
    edge = spark.sql("select * from values (1L, 1d, null), (5L, 1d, 0d), (5L, -1d, 0d), (5L, 0d, 0d) as x(n, m, s)").select(stats.mean_tail(F.col("n"), F.col("m"), F.col("s"))).collect()
    assert [r[0] for r in edge] == [None, 0.0, 1.0, None]


def test_signals_need_known_values(spark, wave):
    ind = ft.indicator_frame(frame(spark, a=wave))
    assert sg.signals_long(ind).count() == 200 * 12
    assert sg.signals_long(ind).where("fired and indicator = 'Ichimoku'").agg(F.min("date")).first()[0] >= START + dt.timedelta(weeks=25)
    summary = sg.signal_summary(ind)
    assert summary.count() == 12 and summary.where("samples = 0 and (passed or p_value is not null)").count() == 0


def test_asof_and_frequency(spark):
    day = lambda s: dt.date.fromisoformat(s)
    macro = spark.createDataFrame([("q", day("2020-01-01"), 1.0), ("q", day("2020-04-01"), 2.0), ("q", day("2020-07-01"), 3.0), ("m", day("2020-01-01"), 5.0), ("m", day("2020-02-01"), 6.0), ("w", day("2020-01-06"), 7.0), ("w", day("2020-01-13"), 8.0), ("one", day("2020-01-01"), 9.0)], "indicator string, date date, value double")
    assert {r.indicator: r.freq for r in mc.frequency(macro).collect()} == {"q": "Q", "m": "M", "w": "W", "one": "M"}
    base = spark.createDataFrame([(day("2020-01-06") + dt.timedelta(weeks=k),) for k in range(30)] * 2, "date date")
    got = {(r.indicator, r.date): r.value for r in mc.macro_asof(base, macro).collect()}
    assert got[("q", day("2020-02-10"))] is None and got[("q", day("2020-02-17"))] == 1.0 and got[("m", day("2020-01-27"))] is None and got[("m", day("2020-02-03"))] == 5.0
    assert got[("w", day("2020-01-13"))] == 7.0 and got[("w", day("2020-01-20"))] == 8.0
    lagged = {r.date: r for r in mc.lag_columns(base, macro, ["q", "m"]).collect()}
    assert lagged[day("2020-03-02")].m_lag_4w == 5.0 and lagged[day("2020-03-02")].q_lag_12w is None and "q_lag_24w" in lagged[day("2020-03-02")]


def test_cutoffs(spark):
    n = spark.createDataFrame([("a", 344), ("b", 182), ("c", 86), ("d", 87)], "region string, n bigint")
    got = {}
    for r in bt.cutoffs_rolling(n, 26).collect():
        got.setdefault(r.region, []).append(r.position)
    assert sorted(got["a"]) == [156, 210, 264, 318] and got["b"] == [156] and "c" not in got and got["d"] == [61]
    assert sorted(r.position for r in bt.cutoffs_end(n.where("region = 'a'"), 13).collect()) == [311, 315, 319, 323, 327, 331]
    assert sorted(r.position for r in bt.cutoffs_start(n.where("region = 'a'"), 13).collect()) == [104, 108, 112, 116, 120, 124]


def test_backtest_of_a_line(spark):
    s = frame(spark, a=[100 + 0.1 * k for k in range(240)], b=[100.0] * 240)
    cuts = bt.cutoffs_rolling(bt.lengths(s), 26)
    pred = bt.predictions(s, bt.baseline_forecasts(s, cuts, 26))
    board = {(r.region, r.model): r for r in bt.leaderboard_dashboard(pred, bt.mase_scale(s)).collect()}
    drift = board[("a", "Drift")]
    assert drift.mae < 1e-9 and drift.passed and drift.direction_accuracy_pct == 100 and board[("a", "Naive")].p_value_vs_naive is None
    chosen = {r.region: r.model for r in bt.select_models(bt.leaderboard_dashboard(pred, bt.mase_scale(s))).where("rank = 1").collect()}
    assert chosen["a"] == "Drift" and not board[("b", "Drift")].passed and "b" in chosen


def test_short_series_have_no_changes(spark):
    got = {r.region: (r.r13 is None, r.r52 is None) for r in views.kpis(frame(spark, a=range(1, 15), b=range(1, 16), c=range(1, 55))).collect()}
    assert got == {"a": (True, True), "b": (False, True), "c": (False, False)}
    assert views.menu(frame(spark, **{"강남구": [1], "서울특별시": [1], "x": [1]})).select("region").collect()[0][0] == "서울특별시"
