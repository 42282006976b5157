"""Twelve indicator signals and how they did."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.stats import binomial_tail, mean_tail

from .panel import by_week


def signals_long(indicators: DataFrame) -> DataFrame:
    """region, date, value, indicator, signal, direction, fired of every signal and week; a comparison with null does not fire."""
    v = F.col("value")
    prev = lambda c: F.lag(c).over(by_week())
    up, down = F.greatest("span_a", "span_b"), F.least("span_a", "span_b")
    macd, sig, m = F.col("macd"), F.col("macd_signal"), F.col("momentum13")
    found = [
        ("Bollinger", "하단 이탈", "bullish", v <= F.col("bb_lower")),
        ("Bollinger", "상단 돌파", "bearish", v >= F.col("bb_upper")),
        ("MACD", "상향 교차", "bullish", (macd > sig) & (prev("macd") <= prev("macd_signal"))),
        ("MACD", "하향 교차", "bearish", (macd < sig) & (prev("macd") >= prev("macd_signal"))),
        ("RSI", "과매도", "bullish", F.col("rsi14") <= 35),
        ("RSI", "과열", "bearish", F.col("rsi14") >= 65),
        ("Ichimoku", "구름 상단 우위", "bullish", (v > up) & (F.col("tenkan") > F.col("kijun"))),
        ("Ichimoku", "구름 하단 약세", "bearish", (v < down) & (F.col("tenkan") < F.col("kijun"))),
        ("Z-score", "저평가", "bullish", F.col("zscore26") <= -1.5),
        ("Z-score", "고평가", "bearish", F.col("zscore26") >= 1.5),
        ("Momentum", "13주 모멘텀 전환", "bullish", (m > 0) & (prev("momentum13") <= 0)),
        ("Momentum", "13주 모멘텀 둔화", "bearish", (m < 0) & (prev("momentum13") >= 0)),
    ]
    rows = F.array(*[F.struct(F.lit(i).alias("indicator"), F.lit(s).alias("signal"), F.lit(d).alias("direction"), F.coalesce(c, F.lit(False)).alias("fired")) for i, s, d, c in found])
    return indicators.withColumn("rows", rows).select("region", "date", "value", F.inline("rows"))


def signal_summary(indicators: DataFrame, horizon: int = 26) -> DataFrame:
    """Per region and signal: samples, hit_rate_pct, mean_forward_return_pct, p_value, passed."""
    h = min(13, horizon)
    ahead = indicators.withColumn("forward", F.try_divide(F.lead("value", h).over(by_week()), F.col("value")) - 1)
    forward = ahead.select("region", "date", "forward")
    rows = signals_long(indicators).join(forward, ["region", "date"])
    bear = F.col("direction") == "bearish"
    valid = F.col("fired") & F.col("forward").isNotNull()
    signed = F.when(valid, F.when(bear, -F.col("forward")).otherwise(F.col("forward")))
    got = rows.groupBy("region", "indicator", "signal", "direction").agg(F.count(signed).alias("samples"), F.count_if(signed > 0).alias("hits"), F.avg(F.when(valid, F.col("forward"))).alias("mean"), F.avg(signed).alias("signed"), F.stddev_samp(signed).alias("std"))
    p = F.least(binomial_tail(F.col("hits"), F.col("samples")), mean_tail(F.col("samples"), F.col("signed"), F.col("std")))
    rate = F.coalesce(F.try_divide("hits", "samples"), F.lit(0.0))
    out = got.select("region", "indicator", "signal", "direction", "samples", (rate * 100).alias("hit_rate_pct"), (F.col("mean") * 100).alias("mean_forward_return_pct"), p.alias("p_value"))
    return out.withColumn("passed", (F.col("samples") >= 10) & (F.col("hit_rate_pct") >= 55) & F.coalesce(F.col("p_value") <= 0.25, F.lit(False)))


def signal_events(indicators: DataFrame, horizon: int = 26) -> DataFrame:
    """Every date of a signal that passes, also those too late for a forward return."""
    passed = signal_summary(indicators, horizon).where("passed").select("region", "indicator", "signal", "direction")
    return signals_long(indicators).where("fired").join(passed, ["region", "indicator", "signal", "direction"], "left_semi").select("region", "date", "value", "indicator", "signal", "direction")
