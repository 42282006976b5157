"""Cut-off planners, baselines, rolling-origin back-tests, leaderboards and model selection.

Forecasts are one long table (region, horizon, cutoff, step, target_date, model, actual, origin, forecast) from the start,
so metrics are group-bys. Baselines are equi-joins on row numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.stats import mean_tail
from weftline.schema import SEASON

from .panel import by_week, whole


def numbered(series: DataFrame) -> DataFrame:
    """series with rn from 1 and n, the length."""
    return series.select("region", "date", "value", F.row_number().over(by_week()).alias("rn"), F.count(F.lit(1)).over(whole()).alias("n"))


def lengths(series: DataFrame) -> DataFrame:
    return series.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first"), F.max("date").alias("last"))


def cutoffs_rolling(n: DataFrame, horizon: int, windows: int = 4) -> DataFrame:
    """region, position (training rows): at most so many, evenly from max(156, 52 + h) to n - h."""
    least = max(156, 52 + horizon)
    last = F.col("n") - horizon
    count = F.least(F.lit(windows), F.greatest(F.lit(1), F.floor((last - least) / max(4, horizon // 2)) + 1)).cast("int")
    even = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.when(count == 1, F.lit(float(least))).otherwise(F.floor(least + i * ((last - least) / F.greatest(count - 1, F.lit(1))))).cast("int"))
    spread = F.when(last <= least, F.when(last > 60, F.array(last.cast("int"))).otherwise(F.array().cast("array<int>"))).otherwise(even)
    return n.select("region", F.explode(F.array_distinct(spread)).alias("position")).where("position > 60")


def _windows(horizon: int) -> Column:
    least = max(104, 3 * horizon)
    return F.greatest(F.lit(1), F.least(F.lit(6), F.greatest(F.lit(1), F.floor((F.col("n") - least - horizon) / 4) + 1))).cast("int")


def cutoffs_end(n: DataFrame, horizon: int) -> DataFrame:
    """Statistical family: windows every four weeks, the last one ending with the series."""
    each = F.sequence(F.lit(0), _windows(horizon) - 1)
    return n.select("region", "n", F.explode(each).alias("i")).select("region", (F.col("n") - horizon - 4 * F.col("i")).cast("int").alias("position")).where("position >= 1")


def cutoffs_start(n: DataFrame, horizon: int) -> DataFrame:
    """Boosting family: windows every four weeks from the shortest training length on, as long as there is a target."""
    each = F.sequence(F.lit(0), _windows(horizon) - 1)
    return n.select("region", "n", F.explode(each).alias("i")).select("region", "n", (F.lit(max(104, 3 * horizon)) + 4 * F.col("i")).cast("int").alias("position")).where(F.col("position") - 1 + horizon < F.col("n")).select("region", "position")


def baseline_forecasts(series: DataFrame, cutoffs: DataFrame, horizon: int) -> DataFrame:
    """region, position, step, model, forecast of Naive, Drift and SeasonalNaive52; a vector with a value that is not positive is left out."""
    rows = numbered(series).select("region", "rn", "value")
    first = rows.where("rn = 1").select("region", F.col("value").alias("v0"))
    origin = rows.select("region", F.col("rn").alias("position"), F.col("value").alias("origin"))
    plan = cutoffs.join(origin, ["region", "position"]).join(first, "region").select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    season = rows.select("region", F.col("rn").alias("at"), F.col("value").alias("seasonal"))
    at = F.col("position") - SEASON + F.pmod(F.col("step") - 1, F.lit(SEASON)) + 1
    met = plan.withColumn("at", F.when(F.col("position") >= SEASON, at)).join(season, ["region", "at"], "left")
    drift = F.col("origin") + (F.col("origin") - F.col("v0")) / F.greatest(F.lit(1), F.col("position") - 1) * F.col("step")
    long = met.select("region", "position", "step", F.inline(F.array(F.struct(F.lit("Naive").alias("model"), F.col("origin").alias("forecast")), F.struct(F.lit("Drift").alias("model"), drift.alias("forecast")), F.struct(F.lit("SeasonalNaive52").alias("model"), F.col("seasonal").alias("forecast")))))
    return positive(long, horizon)


def positive(forecasts: DataFrame, horizon: int) -> DataFrame:
    """Whole vectors of forecasts that are there, finite and positive."""
    w = Window.partitionBy("region", "position", "model")
    good = F.col("forecast").isNotNull() & ~F.isnan("forecast") & (F.col("forecast") > 0) & (F.col("forecast") < float("inf"))
    return forecasts.withColumn("good", F.count_if(good).over(w)).where(F.col("good") == horizon).drop("good")


def predictions(series: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Forecasts with cutoff, target_date, actual and origin; targets beyond the series are left out."""
    rows = numbered(series).select("region", "rn", "date", "value")
    target = rows.select("region", F.col("rn").alias("t"), F.col("date").alias("target_date"), F.col("value").alias("actual"))
    origin = rows.select("region", F.col("rn").alias("position"), F.col("date").alias("cutoff"), F.col("value").alias("origin"))
    met = forecasts.withColumn("t", F.col("position") + F.col("step")).join(target, ["region", "t"]).join(origin, ["region", "position"])
    return met.select("region", "cutoff", "target_date", "step", "origin", "actual", "forecast", "model")


def mase_scale(series: DataFrame) -> DataFrame:
    """region, scale: mean absolute weekly change of the whole series, 1 where there is none."""
    d = series.select("region", F.abs(F.col("value") - F.lag("value").over(by_week())).alias("d"))
    return d.groupBy("region").agg(F.coalesce(F.nullif(F.avg("d"), F.lit(0.0)), F.lit(1.0)).alias("scale"))


def leaderboard_dashboard(pred: DataFrame, scale: DataFrame) -> DataFrame:
    """Per region and model over all steps, against Naive, with passed and place (best first)."""
    naive = pred.where("model = 'Naive'").select("region", "cutoff", "step", F.col("forecast").alias("naive"))
    e, b = F.abs(F.col("forecast") - F.col("actual")), F.abs(F.col("naive") - F.col("actual"))
    rows = pred.join(naive, ["region", "cutoff", "step"]).select("*", e.alias("e"), b.alias("b"), (b - e).alias("d"), (F.signum(F.col("forecast") - F.col("origin")) == F.signum(F.col("actual") - F.col("origin"))).cast("double").alias("right"))
    got = rows.groupBy("region", "model").agg(F.avg("e").alias("mae"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), (F.try_divide(F.sum("e"), F.sum(F.abs("actual"))) * 100).alias("wape_pct"), (F.avg("right") * 100).alias("direction_accuracy_pct"), F.avg("b").alias("naive_mae"), F.count(F.lit(1)).alias("n_predictions"), F.avg("d").alias("dm"), F.stddev_samp("d").alias("ds"))
    base = F.col("model") == "Naive"
    better = F.when(base | (F.col("naive_mae") <= 0), F.lit(0.0)).otherwise((1 - F.col("mae") / F.nullif(F.col("naive_mae"), F.lit(0.0))) * 100)
    p = F.when(~base, mean_tail(F.col("n_predictions"), F.col("dm"), F.col("ds")))
    out = got.join(scale, "region").select("region", "model", "mae", "rmse", (F.col("mae") / F.col("scale")).alias("mase"), "wape_pct", "direction_accuracy_pct", better.alias("naive_improvement_pct"), p.alias("p_value_vs_naive"), "n_predictions")
    passed = ~base & (F.col("naive_improvement_pct") > 0) & (F.coalesce("p_value_vs_naive", F.lit(1.0)) <= 0.25) & (F.col("direction_accuracy_pct") >= 45)
    return out.withColumn("passed", passed).withColumn("place", F.row_number().over(Window.partitionBy("region").orderBy("mase", "wape_pct", "model")))


def select_models(board: DataFrame, most: int = 3) -> DataFrame:
    """region, model, rank: the first of those that pass, or else the single best."""
    w = Window.partitionBy("region")
    ranked = board.select("region", "model", "passed", F.count_if("passed").over(w).alias("n"), F.row_number().over(w.orderBy(F.desc("passed"), "place")).alias("rank"))
    return ranked.where(((F.col("n") > 0) & F.col("passed") & (F.col("rank") <= most)) | ((F.col("n") == 0) & (F.col("rank") == 1))).select("region", "model", "rank")


def leaderboard_library(pred: DataFrame, scale: DataFrame, horizon: int) -> DataFrame:
    """Per region and model at the final step: horizon, mae, rmse, mase, directional_accuracy, n_windows."""
    e = F.col("forecast") - F.col("actual")
    right = (F.signum(F.col("forecast") - F.col("origin")) == F.signum(F.col("actual") - F.col("origin"))).cast("double")
    got = pred.where(F.col("step") == horizon).groupBy("region", "model").agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(right).alias("directional_accuracy"), F.count(F.lit(1)).alias("n_windows"))
    return got.join(scale, "region").select("region", F.lit(horizon).alias("horizon"), "model", "mae", "rmse", (F.col("mae") / F.col("scale")).alias("mase"), "directional_accuracy", "n_windows")


def top_models(board: DataFrame, n: int = 2) -> DataFrame:
    """region, horizon, model: those of least mase."""
    w = Window.partitionBy("region", "horizon").orderBy("mase", "mae", "model")
    return board.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("region", "horizon", "model", "rank")


def top2_ensemble(pred: DataFrame, board: DataFrame, horizon: int) -> DataFrame:
    """Predictions of the mean of the two best models at the final step, with their residuals (forecast less actual)."""
    top = top_models(board).where(F.col("horizon") == horizon).select("region", "model")
    got = pred.where(F.col("step") == horizon).join(top, ["region", "model"], "left_semi").groupBy("region", "cutoff", "target_date", "actual", "origin").agg(F.avg("forecast").alias("forecast"))
    return got.select("region", F.lit(horizon).alias("horizon"), "cutoff", "target_date", "actual", "origin", F.lit("Top2Ensemble").alias("model"), "forecast", (F.col("forecast") - F.col("actual")).alias("residual"))


def library_report(pred: DataFrame, scale: DataFrame, horizon: int) -> tuple[DataFrame, DataFrame]:
    """(leaderboard with the ensemble's row, ensemble predictions)."""
    board = leaderboard_library(pred, scale, horizon)
    ensemble = top2_ensemble(pred, board, horizon)
    own = leaderboard_library(ensemble.withColumn("step", F.lit(horizon)), scale, horizon)
    return board.unionByName(own), ensemble
