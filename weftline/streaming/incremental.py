"""Weekly sums kept up to date from a stream of rows.

Batches recompute everything from whole tables; a stream of new rows can keep the panel's sums as a state instead. Late
rows are taken as far as the watermark reaches. The gap policies and features then run on the panel that was written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def weekly_sums(rows: DataFrame, lateness: str = "14 days") -> DataFrame:
    """region, date, value of a stream (region, at timestamp, amount decimal or double): tumbling weeks that start on Monday, exact sums."""
    # weeks of the window function count from 1970-01-01, a Thursday: four days on is a Monday
    week = F.window("at", "7 days", "7 days", "4 days")
    total = F.sum(F.col("amount").cast("decimal(18,2)")).cast("double")
    return rows.withWatermark("at", lateness).groupBy("region", week.alias("week")).agg(total.alias("value")).select("region", F.to_date("week.start").alias("date"), "value")


def keep_panel(sums: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append the weeks that are past the watermark to a Parquet panel. once: take what is there and stop."""
    out = sums.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (out.trigger(availableNow=True) if once else out).start()
