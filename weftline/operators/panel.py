"""Weekly panels: adapter from relational tables, dense Monday grid, duplicates and gaps.

A panel is one long table (region, date, value); every region is worked on at once by windows that share one
partitioning, so a plan has one shuffle and one sort however many columns it adds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from weftline.schema import monday


def by_week() -> WindowSpec:
    """A region's rows in order; made when asked for, as it needs a session."""
    return Window.partitionBy("region").orderBy("date")


def whole() -> WindowSpec:
    return Window.partitionBy("region")


def order_panel(spark: SparkSession, sf_dir: str, grain: str) -> DataFrame:
    """Weekly exact sums of order prices by n_name, r_name or c_mktsegment. Dimension tables are small; Catalyst broadcasts them by their size."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    rows = read("orders").select("o_custkey", "o_orderdate", "o_totalprice").join(read("customer").select("c_custkey", "c_nationkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    if grain != "c_mktsegment":
        rows = rows.join(read("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        if grain == "r_name":
            rows = rows.join(read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    total = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double")
    return rows.groupBy(F.col(grain).alias("region"), monday(F.col("o_orderdate")).alias("date")).agg(total.alias("value"))


def weekly_grid(panel: DataFrame) -> DataFrame:
    """Every Monday between a region's first and last, value null where there is none."""
    days = panel.groupBy("region").agg(F.min("date").alias("a"), F.max("date").alias("b")).select("region", F.explode(F.expr("sequence(a, b, interval 7 days)")).alias("date"))
    return days.join(panel, ["region", "date"], "left")


def dedup_last(rows: DataFrame, order: str) -> DataFrame:
    """One value per region and week: the last that is not null, by order."""
    return rows.where(F.col("value").isNotNull()).groupBy("region", "date").agg(F.max_by("value", order).alias("value"))


def dedup_checked(rows: DataFrame) -> DataFrame:
    """One value per region and week, rounded to 12 digits, and conflicts: how many different values there are."""
    return rows.where(F.col("value").isNotNull()).groupBy("region", "date").agg(F.array_sort(F.collect_set(F.round("value", 12))).alias("values")).select("region", "date", F.element_at("values", 1).alias("value"), F.size("values").alias("n_values"))


def with_runs(grid: DataFrame) -> DataFrame:
    """grid with run: length of the stretch of missing weeks that a row is in, 0 where its value is there."""
    missing = F.col("value").isNull().cast("int")
    changed = grid.withColumn("missing", missing).withColumn("change", F.coalesce((F.col("missing") != F.lag("missing").over(by_week())).cast("int"), F.lit(0)))
    runs = changed.withColumn("run_id", F.sum("change").over(by_week().rowsBetween(Window.unboundedPreceding, 0)))
    return runs.withColumn("run", F.sum("missing").over(Window.partitionBy("region", "run_id"))).drop("missing", "change", "run_id")


def interpolated(grid: DataFrame, limit: int) -> DataFrame:
    """grid with filled: the value, or the straight line between its neighbours as far as limit weeks from either."""
    back, ahead = by_week().rowsBetween(Window.unboundedPreceding, 0), by_week().rowsBetween(0, Window.unboundedFollowing)
    at = grid.withColumn("rn", F.row_number().over(by_week()))
    known = F.when(F.col("value").isNotNull(), F.col("rn"))
    near = at.select("*", F.last("value", True).over(back).alias("pv"), F.last(known, True).over(back).alias("pr"), F.first("value", True).over(ahead).alias("nv"), F.first(known, True).over(ahead).alias("nr"))
    line = F.col("pv") + (F.col("nv") - F.col("pv")) * (F.col("rn") - F.col("pr")) / (F.col("nr") - F.col("pr"))
    reach = (F.col("rn") - F.col("pr") <= limit) | (F.col("nr") - F.col("rn") <= limit)
    return near.withColumn("filled", F.when(F.col("value").isNotNull(), F.col("value")).when(reach, line)).drop("pv", "pr", "nv", "nr", "rn")


def fill_dashboard(grid: DataFrame) -> DataFrame:
    """region, date, value, is_imputed: gaps filled two weeks from either side, other missing weeks dropped."""
    return interpolated(grid, 2).where("filled is not null").select("region", "date", F.col("filled").alias("value"), F.col("value").isNull().alias("is_imputed"))


def fill_library(grid: DataFrame) -> DataFrame:
    """region, date, value, is_imputed: a region with a gap of three weeks or more is not filled at all; missing weeks stay."""
    runs = with_runs(grid).withColumn("longest", F.max("run").over(whole()))
    filled = F.when(F.col("longest") < 3, F.col("filled")).otherwise(F.col("value"))
    return interpolated(runs, 2).select("region", "date", filled.alias("new"), "value").select("region", "date", F.col("new").alias("value"), (F.col("value").isNull() & F.col("new").isNotNull()).alias("is_imputed"))


def series(grid: DataFrame) -> DataFrame:
    """region, date, value for analysis: filled as when a panel is filled twice, four weeks from either side; other weeks are dropped, so rows stand for weeks from here on."""
    return interpolated(grid, 4).where("filled is not null").select("region", "date", F.col("filled").alias("value"))


def quality(rows: DataFrame, grid: DataFrame, least_weeks: int = 104, name: Column | None = None) -> DataFrame:
    """Per region: weeks, missing, longest_gap, conflicts, imputed, observed, and messages of what blocks or warns, which call it by name."""
    name = F.col("region") if name is None else name
    runs = with_runs(grid)
    filled = interpolated(grid, 2)
    a = runs.groupBy("region").agg(F.count(F.lit(1)).alias("weeks"), F.count_if(F.col("value").isNull()).alias("missing"), F.max("run").cast("bigint").alias("longest_gap"))
    b = filled.groupBy("region").agg(F.count_if(F.col("value").isNull() & F.col("filled").isNotNull()).alias("fillable"))
    conflicts = dedup_checked(rows).groupBy("region").agg(F.count_if(F.col("n_values") > 1).alias("conflicts"))
    out = a.join(b, "region").join(conflicts, "region", "left").withColumn("conflicts", F.coalesce("conflicts", F.lit(0)))
    imputed = F.when(F.col("longest_gap") < 3, F.col("fillable")).otherwise(F.lit(0))
    observed = F.col("weeks") - F.col("missing") + imputed
    out = out.withColumn("imputed", imputed).withColumn("observed", observed)
    say = lambda c, text, *x: F.when(c, F.format_string(text, name, *x))
    blocking = F.array_compact(F.array(say(F.col("conflicts") > 0, "Region '%s' contains conflicting duplicate weekly values."), say(F.col("longest_gap") >= 3, "Region '%s' contains a missing weekly run of 3 weeks or longer after reindexing."), say(F.col("observed") < least_weeks, "Region '%s' has only %d weekly observations; %d are required.", F.col("observed"), F.lit(least_weeks))))
    warning = F.array_compact(F.array(say(F.col("longest_gap").between(1, 2), "Region '%s' contains short gaps that were linearly interpolated.")))
    return out.select("region", "weeks", "missing", "longest_gap", "conflicts", "imputed", "observed", blocking.alias("blocking"), warning.alias("warnings"))
