"""Session factory and the few settings that the library relies on."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: UTC keeps week flooring stable, adaptive execution splits skewed joins and merges small partitions.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def session(master: str = "local[8]", partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the library's defaults; conf overrides them."""
    settings = DEFAULTS | {"spark.sql.shuffle.partitions": str(partitions)} | conf
    return SparkSession.builder.master(master).config(map=settings).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package's code to the executors, once per application, so that nothing need be installed there."""
    context = spark.sparkContext
    if getattr(context, "_weftline_sent", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="weftline-code-")) / "weftline_code.zip"
    with zipfile.ZipFile(target, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, f"{root.name}/{path.relative_to(root)}")
    context.addPyFile(str(target))
    context._weftline_sent = True


def written(df: DataFrame, tag: str = "weekly") -> DataFrame:
    """df as a table in the folder that spark.checkpoint.dir names: plans that use it often start there, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="weftline-")
    path = f"{folder.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
