"""Forecast frames, intervals and the risk composite, for all regions at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.schema import MODEL_LABELS

from .backtest import baseline_forecasts, lengths
from .features import roll, turning_points
from .panel import by_week


def full_forecasts(series: DataFrame, horizon: int, more: DataFrame | None = None) -> DataFrame:
    """region, date, step, model, forecast of the weeks after the series; more: forecasts of other models (region, step, model, forecast), which take the place of a baseline of their name."""
    n = lengths(series)
    made = baseline_forecasts(series, n.select("region", F.col("n").cast("int").alias("position")), horizon).select("region", "step", "model", "forecast")
    if more is not None:
        own = more.select("region", "step", "model", "forecast")
        made = made.join(own.select("region", "model").distinct(), ["region", "model"], "left_anti").unionByName(own)
    return made.join(n.select("region", "last"), "region").select("region", F.expr("date_add(last, 7 * step)").alias("date"), "step", "model", "forecast")


def dashboard_forecast(series: DataFrame, horizon: int, pred: DataFrame, selected: DataFrame, forecasts: DataFrame) -> DataFrame:
    """region, date, step, p50, p10, p90, selected_models: mean of the selected models with an interval of relative errors and volatility, widened to all models."""
    errors = pred.join(selected, ["region", "model"], "left_semi").select("region", ((F.col("actual") - F.col("forecast")) / F.nullif(F.col("forecast"), F.lit(0.0))).alias("e"))
    q = errors.groupBy("region").agg(F.percentile("e", 0.1).alias("q10"), F.percentile("e", 0.9).alias("q90"))
    back = Window.partitionBy("region").orderBy(F.desc("date"))
    returns = series.select("region", "date", (F.try_divide(F.col("value"), F.lag("value").over(by_week())) - 1).alias("r")).where("r is not null").withColumn("k", F.row_number().over(back)).where("k <= 156")
    vol = returns.groupBy("region").agg(F.stddev_samp("r").alias("vol"))
    use = forecasts.select("region", "model").distinct().join(selected, ["region", "model"]).select("region", "model", "rank")
    # where none of the selected is there, the first model by name stands in
    first = forecasts.groupBy("region").agg(F.min("model").alias("model")).join(use.select("region").distinct(), "region", "left_anti").select("region", "model", F.lit(1).alias("rank"))
    use = use.unionByName(first)
    label = F.create_map(*[F.lit(x) for pair in MODEL_LABELS.items() for x in pair])
    names = use.groupBy("region").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "model"))), lambda x: F.coalesce(F.try_element_at(label, x["model"]), x["model"])), ", ").alias("selected_models"))
    point = forecasts.join(use, ["region", "model"], "left_semi").groupBy("region", "date", "step").agg(F.avg("forecast").alias("p50"))
    spread = forecasts.groupBy("region", "step").agg(F.min("forecast").alias("low"), F.max("forecast").alias("high"))
    rows = point.join(spread, ["region", "step"]).join(q, "region", "left").join(vol, "region", "left").join(names, "region")
    band = 1.64 * F.when(F.col("vol") > 0, F.col("vol")).otherwise(F.lit(0.002)) * F.sqrt("step")
    lower = F.when(F.col("q10") < 0, F.col("p50") * (1 + F.col("q10") - band * 0.25)).otherwise(F.col("p50") * (1 - band))
    upper = F.when(F.col("q90") > 0, F.col("p50") * (1 + F.col("q90") + band * 0.25)).otherwise(F.col("p50") * (1 + band))
    return rows.select("region", "date", "step", "p50", F.least(lower, "low", "p50").alias("p10"), F.greatest(upper, "high", "p50").alias("p90"), "selected_models")


def library_forecast(series: DataFrame, horizon: int, board: DataFrame | None, ensemble: DataFrame | None, forecasts: DataFrame) -> DataFrame:
    """region, date, step, p50, p10, p90: mean of the two best models that can forecast, with quantiles of the ensemble's residuals added.

    Without a back-test the models AutoETS, AutoARIMA, MLForecast-HGBR and Naive are preferred in this order and the band is one
    percent of the last value; quantile models, named ...p10 and ...p90, only widen the band.
    """
    last = series.groupBy("region").agg(F.max_by("value", "date").alias("last"))
    plain = ~(F.col("model").endswith("p10") | F.col("model").endswith("p90"))
    there = forecasts.where(plain).select("region", "model").distinct()
    if board is None:
        order = F.array(*[F.lit(m) for m in ("AutoETS", "AutoARIMA", "MLForecast-HGBR", "Naive")])
        wanted = there.withColumn("rank", F.array_position(order, F.col("model"))).where("rank > 0").withColumn("rank", F.row_number().over(Window.partitionBy("region").orderBy("rank"))).where("rank <= 2")
        rest = last.select("region", (-0.01 * F.col("last")).alias("q10"), (0.01 * F.col("last")).alias("q90"))
    else:
        w = Window.partitionBy("region").orderBy("mase", "mae", "model")
        wanted = board.where(F.col("horizon") == horizon).withColumn("rank", F.row_number().over(w)).where("rank <= 2").select("region", "model", "rank")
        q = ensemble.where(F.col("horizon") == horizon).groupBy("region").agg(F.percentile("residual", 0.1).alias("q10"), F.percentile("residual", 0.9).alias("q90"))
        rest = last.join(q, "region", "left").select("region", F.coalesce("q10", -0.01 * F.col("last")).alias("q10"), F.coalesce("q90", 0.01 * F.col("last")).alias("q90"))
    use = wanted.join(there, ["region", "model"], "left_semi").select("region", "model")
    spare = there.join(use.select("region").distinct(), "region", "left_anti").withColumn("k", F.row_number().over(Window.partitionBy("region").orderBy("model"))).where("k <= 2").select("region", "model")
    use = use.unionByName(spare)
    point = forecasts.join(use, ["region", "model"], "left_semi").groupBy("region", "date", "step").agg(F.avg("forecast").alias("p50"))
    wide = forecasts.groupBy("region", "step").agg(F.min(F.when(F.col("model").endswith("p10"), F.col("forecast"))).alias("low"), F.max(F.when(F.col("model").endswith("p90"), F.col("forecast"))).alias("high"))
    rows = point.join(rest, "region").join(wide, ["region", "step"], "left")
    return rows.select("region", "date", "step", "p50", F.least(F.col("p50") + F.col("q10"), "low").alias("p10"), F.greatest(F.col("p50") + F.col("q90"), "high").alias("p90"))


def votes(series: DataFrame, forecasts: DataFrame, horizon: int) -> DataFrame:
    """Per region and model: forecast_last and return_pct; and by region the shares that end below and above the last value."""
    last = series.groupBy("region").agg(F.max_by("value", "date").alias("last"))
    plain = ~(F.col("model").endswith("p10") | F.col("model").endswith("p90"))
    rows = forecasts.where(plain & (F.col("step") == horizon)).join(last, "region")
    w = Window.partitionBy("region")
    share = lambda c: F.avg(c.cast("double")).over(w) * 100
    return rows.select("region", "model", F.col("forecast").alias("forecast_last"), ((F.col("forecast") / F.col("last") - 1) * 100).alias("return_pct"), share(F.col("forecast") < F.col("last")).alias("negative_vote"), share(F.col("forecast") > F.col("last")).alias("positive_vote"))


def _last_percentile(x: DataFrame, name: str) -> DataFrame:
    """Share of the last 156 known values of column x that are at most the last; 50 where there is none."""
    back = Window.partitionBy("region").orderBy(F.desc("date"))
    rows = x.where(F.col("x").isNotNull()).withColumn("k", F.row_number().over(back)).where("k <= 156").withColumn("end", F.first("x").over(back))
    return rows.groupBy("region").agg((F.avg((F.col("x") <= F.col("end")).cast("double")) * 100).alias(name))


def risk_composite(series: DataFrame, forecast: DataFrame, vote: DataFrame) -> DataFrame:
    """region, high_risk_score, low_zone_score, to one digit: percentiles of overheating, highs and drawdown, the forecast's slope, votes and recent turning points."""
    v = F.col("value")
    parts = series.select("region", "date", (F.try_divide(v, roll(F.avg, v, 24)) * 100).alias("d"), F.try_divide(v, roll(F.max, v, 52, 13)).alias("n"), (-(F.try_divide(v, roll(F.max, v, 26, 4)) - 1)).alias("w"))
    out = series.groupBy("region").agg(F.max_by("value", "date").alias("last"), F.max("date").alias("end"))
    for c, name in (("d", "hot"), ("n", "near"), ("w", "deep")):
        out = out.join(_last_percentile(parts.select("region", "date", F.col(c).alias("x")), name), "region", "left")
    final = forecast.groupBy("region").agg(F.max_by("p50", "step").alias("p50"))
    events = turning_points(series).join(out.select("region", "end"), "region").where(F.col("date") >= F.date_sub("end", 84)).groupBy("region").agg(F.bool_or(F.col("event") == "peak").alias("peak"), F.bool_or(F.col("event") == "trough").alias("trough"))
    vote = vote.select("region", "negative_vote", "positive_vote").distinct()
    rows = out.join(final, "region").join(vote, "region").join(events, "region", "left")
    slope = (F.col("p50") / F.col("last") - 1) * 600
    clip = lambda x: F.greatest(F.least(x, F.lit(100.0)), F.lit(0.0))
    hot, near, deep = (F.coalesce(F.col(c), F.lit(50.0)) for c in ("hot", "near", "deep"))
    cold = 100 - hot
    turn = lambda c: F.when(F.coalesce(F.col(c), F.lit(False)), 100.0).otherwise(40.0)
    high = 0.25 * hot + 0.2 * clip(-slope) + 0.2 * near + 0.2 * F.col("negative_vote") + 0.15 * turn("peak")
    low = 0.25 * F.when(F.col("hot").isNull(), 50.0).otherwise(cold) + 0.2 * clip(slope) + 0.2 * deep + 0.2 * F.col("positive_vote") + 0.15 * turn("trough")
    return rows.select("region", F.bround(clip(high), 1).alias("high_risk_score"), F.bround(clip(low), 1).alias("low_zone_score"))


