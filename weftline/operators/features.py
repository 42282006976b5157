"""Feature matrix and indicator frame as window expressions over one partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .panel import by_week


def roll(fn, x: Column, size: int, least: int | None = None) -> Column:
    """fn of x over the last size rows; null with fewer than least known values."""
    w = by_week().rowsBetween(-(size - 1), 0)
    return F.when(F.count(x).over(w) >= (size if least is None else least), fn(x).over(w))


def change(x: Column, k: int) -> Column:
    """Relative change to k rows before."""
    before = F.lag(x, k).over(by_week())
    return F.try_divide(x, before) - 1


def percentile_of_last(x: Column, size: int = 156, least: int = 26) -> Column:
    """Share in percent of the known values of the last size rows that are at most the last known one."""
    a = F.collect_list(x).over(by_week().rowsBetween(-(size - 1), 0))
    last = F.element_at(a, -1)
    return F.when(F.size(a) >= least, F.size(F.filter(a, lambda v: v <= last)) / F.size(a) * 100)


def middle(x: Column, size: int) -> Column:
    return (roll(F.max, x, size) + roll(F.min, x, size)) / 2


def recursive(series: DataFrame) -> DataFrame:
    """region, date, value and the recursive filters: macd, macd_signal, trix, trix_signal, rsi14.

    One fold over each region's ordered values; a region's history is one array, which weekly series keep short.
    """
    rows = series.groupBy("region").agg(F.array_sort(F.collect_list(F.struct("date", "value"))).alias("xs"))

    def ema(before: Column, x: Column, alpha: float) -> Column:
        return F.when(before.isNull(), x).otherwise((1 - alpha) * before + alpha * x)

    a12, a26, a9, a14 = 2 / 13, 2 / 27, 2 / 10, 1 / 14
    none = F.lit(None).cast("double")
    names = ["e12", "e26", "sig", "t1", "t2", "t3", "trix", "tsig", "gain", "loss"]
    start = F.struct(none.alias("prev"), *[none.alias(n) for n in names], F.array().cast("array<struct<date:date,value:double,macd:double,macd_signal:double,trix:double,trix_signal:double,rsi14:double>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        v = x["value"]
        e12, e26 = ema(s["e12"], v, a12), ema(s["e26"], v, a26)
        sig = ema(s["sig"], e12 - e26, a9)
        t1 = ema(s["t1"], v, a12)
        t2 = ema(s["t2"], t1, a12)
        t3 = ema(s["t3"], t2, a12)
        trix = (F.try_divide(t3, s["t3"]) - 1) * 100
        tsig = F.when(trix.isNull(), s["tsig"]).otherwise(ema(s["tsig"], trix, a9))
        d = v - s["prev"]
        gain = F.when(d.isNotNull(), ema(s["gain"], F.greatest(d, F.lit(0.0)), a14))
        loss = F.when(d.isNotNull(), ema(s["loss"], F.greatest(-d, F.lit(0.0)), a14))
        rsi = 100 - 100 / (1 + F.try_divide(gain, loss))
        row = F.struct(x["date"].alias("date"), v.alias("value"), (e12 - e26).alias("macd"), sig.alias("macd_signal"), trix.alias("trix"), tsig.alias("trix_signal"), rsi.alias("rsi14"))
        return F.struct(v.alias("prev"), e12.alias("e12"), e26.alias("e26"), sig.alias("sig"), t1.alias("t1"), t2.alias("t2"), t3.alias("t3"), trix.alias("trix"), tsig.alias("tsig"), gain.alias("gain"), loss.alias("loss"), F.concat(s["out"], F.array(row)).alias("out"))

    folded = rows.select("region", F.aggregate("xs", start, step, lambda s: s["out"]).alias("out"))
    return folded.select("region", F.inline("out"))


def feature_matrix(series: DataFrame, macro: DataFrame | None = None) -> DataFrame:
    """The library's features of each region's series: lags, rolling statistics, rates, recursive filters, Ichimoku state, and macro columns by (region, date) or date."""
    v = F.col("value")
    rows = recursive(series)
    tenkan, kijun, span_b = middle(v, 9), middle(v, 26), middle(v, 52)
    span_a = (tenkan + kijun) / 2
    state = F.when((span_a > span_b) & (v >= span_a), 1.0).when((span_a < span_b) & (v <= span_b), -1.0).otherwise(0.0)
    ma24 = roll(F.avg, v, 24)
    out = rows.select(
        "region", "date", v.alias("y"),
        *[F.lag(v, k).over(by_week()).alias(f"lag_{k}") for k in range(1, 27)],
        *[c for w in (4, 13, 26) for c in (roll(F.avg, v, w).alias(f"roll_mean_{w}"), roll(F.stddev_samp, v, w).alias(f"roll_std_{w}"))],
        (F.try_divide(v, roll(F.max, v, 26, 4)) - 1).alias("drawdown_26"), (F.try_divide(v, roll(F.min, v, 26, 4)) - 1).alias("recovery_26"),
        change(v, 1).alias("roc_1"), change(v, 4).alias("roc_4"), change(v, 13).alias("roc_13"), change(v, 52).alias("yoy_52"),
        roll(F.avg, v, 6).alias("ma6"), ma24.alias("ma24"), "macd", "macd_signal", (F.col("macd") - F.col("macd_signal")).alias("macd_hist"),
        (F.try_divide(v, ma24) * 100).alias("disparity24"), "trix", "trix_signal", state.alias("ichimoku_state"),
    )
    if macro is None:
        return out
    return out.join(macro, [c for c in ("region", "date") if c in macro.columns], "left")


def indicator_frame(series: DataFrame) -> DataFrame:
    """The dashboard's 17 columns of each region's series."""
    v = F.col("value")
    mid, std = roll(F.avg, v, 20, 12), roll(F.stddev_samp, v, 20, 12)
    tenkan, kijun = middle(v, 9), middle(v, 26)
    z = F.try_divide(v - roll(F.avg, v, 26, 13), F.nullif(roll(F.stddev_samp, v, 26, 13), F.lit(0.0)))
    return recursive(series).select(
        "region", "date", "value",
        roll(F.avg, v, 13, 8).alias("ma13"), roll(F.avg, v, 26, 13).alias("ma26"), roll(F.avg, v, 52, 26).alias("ma52"),
        mid.alias("bb_mid"), (mid + 2 * std).alias("bb_upper"), (mid - 2 * std).alias("bb_lower"), "macd", "macd_signal", "rsi14",
        tenkan.alias("tenkan"), kijun.alias("kijun"), ((tenkan + kijun) / 2).alias("span_a"), middle(v, 52).alias("span_b"), z.alias("zscore26"), change(v, 13).alias("momentum13"),
    )


def smoothed_extrema(series: DataFrame, radius: int = 6, ahead: int = 13, least: int = 4) -> DataFrame:
    """series with what turning points are told by: whether the smoothed value is a local maximum or minimum, and the rows ahead."""
    s = series.withColumn("smoothed", F.avg("value").over(by_week().rowsBetween(-2, 0)))
    around, future, soon = by_week().rowsBetween(-radius, radius), by_week().rowsBetween(1, ahead), by_week().rowsBetween(1, least)
    known = F.count("smoothed").over(around) >= radius + 1
    return s.select(
        "region", "date", "value",
        (known & (F.col("smoothed") == F.max("smoothed").over(around))).alias("is_max"), (known & (F.col("smoothed") == F.min("smoothed").over(around))).alias("is_min"),
        F.min("value").over(future).alias("low"), F.max("value").over(future).alias("high"), F.count("value").over(future).alias("n_ahead"),
        F.max("value").over(soon).alias("soon_high"), F.min("value").over(soon).alias("soon_low"),
    )


def turning_points(series: DataFrame, threshold: float = 0.02, least: int = 4) -> DataFrame:
    """region, date, event (peak or trough), value."""
    x = smoothed_extrema(series, least=least).where(F.col("n_ahead") >= least)
    peak = F.col("is_max") & (F.try_divide(F.col("low"), F.col("value")) - 1 <= -threshold) & (F.col("soon_high") < F.col("value"))
    trough = F.col("is_min") & (F.try_divide(F.col("high"), F.col("value")) - 1 >= threshold) & (F.col("soon_low") > F.col("value"))
    events = F.array_compact(F.array(F.when(peak, F.lit("peak")), F.when(trough, F.lit("trough"))))
    return x.select("region", "date", F.explode(events).alias("event"), "value")


def risk_scores(series: DataFrame) -> DataFrame:
    """region, date, high_score, low_score, each 0 to 100 or null."""
    v = F.col("value")
    parts = series.select("region", "date", (F.try_divide(v, roll(F.avg, v, 24)) * 100).alias("d"), F.try_divide(v, roll(F.max, v, 52, 13)).alias("n"), (-(F.try_divide(v, roll(F.max, v, 26, 4)) - 1)).alias("w"))
    p = parts.select("region", "date", percentile_of_last(F.col("d")).alias("high"), F.coalesce(percentile_of_last(F.col("n")), F.lit(50.0)).alias("near"), F.coalesce(percentile_of_last(F.col("w")), F.lit(50.0)).alias("deep"))
    clip = lambda x: F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(100.0)), F.lit(0.0)))
    high = 0.45 * F.col("high") + 0.35 * F.col("near") + 0.2 * (100 - F.col("deep"))
    low = 0.45 * (100 - F.col("high")) + 0.35 * F.col("deep") + 0.2 * (100 - F.col("near"))
    return p.select("region", "date", clip(high).alias("high_score"), clip(low).alias("low_score"))


def event_study(series: DataFrame, threshold: float = 80.0, weeks: int = 8) -> DataFrame:
    """Per region and signal type: signals, hits (a turning point within the next weeks) and hit rate."""
    scores, events = risk_scores(series), turning_points(series)
    pairs = F.array(F.struct(F.lit("high").alias("signal_type"), F.col("high_score").alias("score"), F.lit("peak").alias("event")), F.struct(F.lit("low").alias("signal_type"), F.col("low_score").alias("score"), F.lit("trough").alias("event")))
    long = scores.select("region", "date", F.inline(pairs))
    # a week's events as one row each, so a signal looks up its next weeks by equality: no range join
    ahead = events.select("region", "event", F.explode(F.array(*[F.date_sub("date", 7 * k) for k in range(1, weeks + 1)])).alias("date")).distinct().withColumn("hit", F.lit(1))
    met = long.join(ahead, ["region", "event", "date"], "left").groupBy("region", "signal_type").agg(F.count_if(F.col("score") >= threshold).alias("signals"), F.count_if((F.col("score") >= threshold) & F.col("hit").isNotNull()).alias("hits"))
    return met.select("region", "signal_type", "signals", "hits", F.coalesce(F.try_divide("hits", "signals"), F.lit(0.0)).alias("hit_rate"))
