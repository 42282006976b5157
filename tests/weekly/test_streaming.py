"""A stream's weekly sums equal those of a batch."""

import datetime as dt
import random

from pyspark.sql import functions as F

from weftline.schema import monday
from weftline.streaming import incremental


def test_weekly_sums(spark, tmp_path):
    r = random.Random(1)
    rows = [("ab"[k % 2], dt.datetime(2024, 1, 1) + dt.timedelta(hours=r.randrange(24 * 90)), r.randrange(1000) / 100) for k in range(400)]
    rows.append(("z", dt.datetime(2024, 9, 2), 1.0))  # moves the watermark past the rest
    schema = "region string, at timestamp, amount double"
    for k in range(4):
        spark.createDataFrame(sorted(rows, key=lambda x: x[1])[k::4] if k < 3 else rows[-1:], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    used = spark.read.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    for _ in range(2):
        incremental.keep_panel(incremental.weekly_sums(stream, "400 days"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(60)
    batch = used.groupBy("region", monday(F.col("at")).alias("date")).agg(F.sum(F.col("amount").cast("decimal(18,2)")).cast("double").alias("value"))
    live = stream.isStreaming
    got = incremental.weekly_sums(used, "1 day")
    assert live and sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))
