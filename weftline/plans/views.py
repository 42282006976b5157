"""Rows for charts and tables: tails, returns, key figures, menus and labelled results. Drawing them is left to others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.panel import by_week
from weftline.schema import MODEL_LABELS, region_dim



def tail(rows: DataFrame, n: int) -> DataFrame:
    """The last n rows of each region."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy("region").orderBy(F.desc("date")))).where(F.col("_k") <= n).drop("_k")


def kpis(series: DataFrame) -> DataFrame:
    """Per region: first_date, last_date, weeks, latest, and percent changes to 13 and 52 rows before, where a series is longer than 14 and 53 rows."""
    moved = series.select("region", "date", "value", F.lag("value", 13).over(by_week()).alias("a"), F.lag("value", 52).over(by_week()).alias("b"))
    got = moved.groupBy("region").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count(F.lit(1)).alias("weeks"), F.max_by("value", "date").alias("latest"), F.max_by("a", "date").alias("a"), F.max_by("b", "date").alias("b"))
    change = lambda c, n: F.when(F.col("weeks") > n, (F.try_divide("latest", c) - 1) * 100)
    return got.select("region", "first_date", "last_date", "weeks", "latest", change("a", 14).alias("r13"), change("b", 53).alias("r52"))


def returns_long(series: DataFrame) -> DataFrame:
    """region, period (r13 or r52), return_pct."""
    return kpis(series).unpivot("region", ["r13", "r52"], "period", "return_pct")


def forecast_chart(series: DataFrame, forecast: DataFrame, n: int = 420) -> DataFrame:
    """The last n weeks of history and the forecast with its band as one table."""
    none = F.lit(None).cast("double")
    history = tail(series, n).select("region", "date", F.lit("history").alias("kind"), "value", none.alias("p10"), none.alias("p90"))
    return history.unionByName(forecast.select("region", "date", F.lit("forecast").alias("kind"), F.col("p50").alias("value"), "p10", "p90"))


def labelled(rows: DataFrame, model: str = "model") -> DataFrame:
    """rows with model_label, the model itself where it has none."""
    label = F.create_map(*[F.lit(x) for pair in MODEL_LABELS.items() for x in pair])
    return rows.withColumn("model_label", F.coalesce(F.try_element_at(label, F.col(model)), F.col(model)))


def technical_chart(indicators: DataFrame, events: DataFrame, n: int = 420) -> tuple[DataFrame, DataFrame]:
    """The last n indicator rows of each region, and the passing events in their range with a marker text."""
    shown = tail(indicators, n)
    start = shown.groupBy("region").agg(F.min("date").alias("start"))
    marks = events.join(start, "region").where("date >= start").drop("start").withColumn("marker", F.concat_ws(" ", "indicator", "signal"))
    return shown, marks


def menu(panel: DataFrame) -> DataFrame:
    """Known regions that a panel has, in menu order, with their groups."""
    there = panel.select("region").distinct()
    return there.join(F.broadcast(region_dim(panel.sparkSession)), "region").orderBy("ord")


def percent(x: Column, digits: int = 2) -> Column:
    """Text with a percent sign; a dash where null."""
    return F.coalesce(F.concat(F.format_number(x, digits), F.lit("%")), F.lit("-"))


def number(x: Column, digits: int = 2) -> Column:
    return F.coalesce(F.format_number(x, digits), F.lit("-"))
