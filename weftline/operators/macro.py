"""Macro features: publication lags, as-of join and lagged columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def frequency(macro: DataFrame) -> DataFrame:
    """indicator, freq (M, Q or W) of macro(indicator, date, value), by the median distance of its dates."""
    gaps = macro.where("value is not null").withColumn("gap", F.datediff("date", F.lag("date").over(Window.partitionBy("indicator").orderBy("date"))))
    got = gaps.groupBy("indicator").agg(F.count(F.lit(1)).alias("n"), F.percentile("gap", 0.5).alias("median"))
    freq = F.when(F.col("n") < 2, "M").when(F.col("median") >= 60, "Q").when(F.col("median") >= 20, "M").otherwise("W")
    return got.select("indicator", freq.alias("freq"))


def released(macro: DataFrame) -> DataFrame:
    """macro with the date on which each value is out: four weeks later when monthly, six when quarterly, one when weekly."""
    days = F.when(F.col("freq") == "M", 28).when(F.col("freq") == "Q", 42).otherwise(7)
    return macro.where("value is not null").join(frequency(macro), "indicator").select("indicator", "freq", F.date_add("date", days).alias("date"), "value")


def asof(base: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """base (by, date) with value of the latest row of right at or before its date: a union and a running last value, so one sort and no range join.

    Of several rows of one date the last counts: by the column seq where right has one, else the largest value.
    """
    one = right.groupBy(*by, "date").agg(F.max_by("value", F.struct("seq", "value")) if "seq" in right.columns else F.max("value")).toDF(*by, "date", "value")
    both = base.select(*by, "date", F.lit(None).cast("double").alias("value"), F.lit(1).alias("side")).unionByName(one.select(*by, "date", "value", F.lit(0).alias("side")))
    w = Window.partitionBy(*by).orderBy("date", "side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("value", F.last("value", True).over(w)).where("side = 1").drop("side")


def macro_asof(base: DataFrame, macro: DataFrame) -> DataFrame:
    """indicator, freq, date, value for each distinct date of base."""
    out = released(macro)
    dates = base.select("date").distinct()
    # one row for each indicator: its number is that of columns, not of rows
    kinds = out.select("indicator", "freq").distinct()
    grid = dates.crossJoin(kinds)
    return asof(grid, out, ["indicator", "freq"])


def lag_columns(base: DataFrame, macro: DataFrame, indicators: list[str]) -> DataFrame:
    """date and <indicator>_lag_<k>w columns: lags by rows of base's distinct dates, 4, 8 and 12, or 12 and 24 when quarterly."""
    rows = macro_asof(base, macro)
    w = Window.partitionBy("indicator").orderBy("date")
    lags = rows.select("indicator", "freq", "date", *[F.lag("value", k).over(w).alias(f"l{k}") for k in (4, 8, 12, 24)])
    long = lags.select("date", "indicator", F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"l{k}").alias("v"), F.when(F.col("freq") == "Q", F.lit(k in (12, 24))).otherwise(F.lit(k in (4, 8, 12))).alias("on")) for k in (4, 8, 12, 24)]))).where("on")
    names = [f"{i}_lag_{k}w" for i in indicators for k in (4, 8, 12, 24)]
    return long.withColumn("name", F.format_string("%s_lag_%dw", "indicator", "k")).groupBy("date").pivot("name", names).agg(F.first("v"))
