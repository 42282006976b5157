"""End-to-end plans: both reports for all regions at once, and results kept by workbook.

The records hold lazy tables; nothing is collected until asked for. Panels are written once under the workbook's
fingerprint, and analyses under fingerprint, metric and horizon, so a workbook that was seen before is not read again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import backtest as bt
from weftline.operators import estimators as es
from weftline.operators import features as ft
from weftline.operators import forecast as fc
from weftline.operators import ingest
from weftline.operators import signals as sg
from weftline.sources import workbook


@dataclass(frozen=True)
class Backtest:
    """leaderboard, predictions, selected (region, model, rank), and warnings (region, warning)."""

    leaderboard: DataFrame
    predictions: DataFrame
    selected: DataFrame
    warnings: DataFrame


@dataclass(frozen=True)
class Analysis:
    """The dashboard's results of every region."""

    horizon: int
    history: DataFrame
    backtest: Backtest
    forecast: DataFrame
    model_forecasts: DataFrame
    indicators: DataFrame
    signals: DataFrame
    events: DataFrame


@dataclass(frozen=True)
class LibraryReport:
    """The library's results of every region: leaderboards of all horizons, predictions, event study, forecast, votes, risk and turning points."""

    leaderboard: DataFrame
    predictions: DataFrame
    event_summary: DataFrame
    forecast: DataFrame
    model_table: DataFrame
    risk: DataFrame
    turning_points: DataFrame
    warnings: DataFrame


def analyse(series: DataFrame, horizon: int = 26, windows: int = 4, models: dict[str, es.Forecaster] | None = None) -> Analysis:
    """The dashboard's path: rolling back-test, selection, forecast with interval, indicators and signals. models: the iterative ones, all by default."""
    models = es.DASHBOARD if models is None else models
    series = series.persist()
    n = bt.lengths(series)
    cuts = bt.cutoffs_rolling(n, horizon, windows).persist()
    made = bt.baseline_forecasts(series, cuts, horizon)
    last = n.select("region", F.col("n").cast("int").alias("position"))
    more = None
    if models:
        # one pass of the estimators for cut-offs and the whole history
        every = es.forecasts(series, cuts.unionByName(last), horizon, models).persist()
        made = made.unionByName(every.join(cuts, ["region", "position"], "left_semi"))
        more = every.join(last, ["region", "position"], "left_semi").select("region", "step", "model", "forecast")
    pred = bt.predictions(series, made).persist()
    board = bt.leaderboard_dashboard(pred, bt.mase_scale(series)).persist()
    chosen = bt.select_models(board)
    whole = fc.full_forecasts(series, horizon, more).persist()
    ind = ft.indicator_frame(series).persist()
    none = n.join(cuts.select("region").distinct(), "region", "left_anti").select("region", F.lit("데이터가 짧아 rolling-origin 검증 창을 충분히 만들지 못했습니다.").alias("warning"))
    weak = board.groupBy("region").agg(F.count_if("passed").alias("n")).where("n = 0").select("region", F.lit("Naive 대비 통계적으로 우수한 모델이 없어 최저 오류 모델 1개만 예측에 사용했습니다.").alias("warning"))
    return Analysis(horizon, series, Backtest(board, pred, chosen, none.unionByName(weak)), fc.dashboard_forecast(series, horizon, pred, chosen, whole), whole, ind, sg.signal_summary(ind, horizon), sg.signal_events(ind, horizon))


def library_report(series: DataFrame, horizon: int, horizons: tuple[int, ...] = (13, 26), boosting: bool = True) -> LibraryReport:
    """The library's path: statistical windows at the end, boosting windows at the start, the ensemble of the two best, and the risk composite.

    The two families are scored on different windows, and the ensemble averages what shares one, as it always did.
    """
    series = series.persist()
    n, scale = bt.lengths(series), bt.mase_scale(series)
    boards, preds = [], []
    for h in horizons:
        end, start = bt.cutoffs_end(n, h).persist(), bt.cutoffs_start(n, h).persist()
        made = bt.baseline_forecasts(series, end, h).unionByName(es.forecasts(series, end, h, es.LIBRARY))
        pred = bt.predictions(series, made).where(F.col("step") == h)
        if boosting:
            direct = es.direct_forecasts(series, start, h).where("model = 'MLForecast-HGBR'")
            pred = pred.unionByName(bt.predictions(series, direct))
        pred = pred.persist()
        board, ensemble = bt.library_report(pred, scale, h)
        boards.append(board)
        own = pred.select("region", F.lit(h).alias("horizon"), "cutoff", "target_date", "actual", "origin", "model", "forecast", (F.col("forecast") - F.col("actual")).alias("residual"))
        preds.append(own.unionByName(ensemble))
    board, pred = boards[0], preds[0]
    for b, p in zip(boards[1:], preds[1:], strict=True):
        board, pred = board.unionByName(b), pred.unionByName(p)
    board, pred = board.persist(), pred.persist()
    last = n.select("region", F.col("n").cast("int").alias("position"))
    more = es.forecasts(series, last, horizon, es.LIBRARY)
    if boosting:
        more = more.unionByName(es.direct_forecasts(series, last, horizon, final_only=False))
    whole = fc.full_forecasts(series, horizon, more).persist()
    known = horizon in horizons
    frame = fc.library_forecast(series, horizon, board if known else None, pred.where("model = 'Top2Ensemble'") if known else None, whole)
    vote = fc.votes(series, whole, horizon)
    short = n.where("n < 104").select("region", F.lit(es.library_models(0)[1][0]).alias("warning"))
    return LibraryReport(board, pred, ft.event_study(series), frame, vote, fc.risk_composite(series, frame, vote), ft.turning_points(series), short)


def panel_of(spark: SparkSession, path: str, store: str) -> DataFrame:
    """The dashboard panel of the workbooks below path, kept in store by fingerprint and metric: a workbook that is there is not taken apart again."""
    try:
        have = spark.read.parquet(store).select("fingerprint").distinct()
    except AnalysisException:
        have = spark.createDataFrame([], "fingerprint string")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select(F.sha2("content", 256).alias("fingerprint")).distinct()
    if not files.join(have, "fingerprint", "left_anti").isEmpty():
        # one pass and one write for all workbooks that are not there yet
        cells = workbook.cells(spark, path).join(have, "fingerprint", "left_anti")
        panel = ingest.dashboard_panel(ingest.dashboard_rows(cells)).drop("source_name")
        panel.write.mode("append").partitionBy("fingerprint", "metric").parquet(store)
    return spark.read.parquet(store).join(files, "fingerprint", "left_semi")
