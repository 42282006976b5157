"""Shared folder, files and tables that survive a lost executor."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.session import ship

_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only where it is unset (tests on one machine) is one made."""
    found = spark.conf.get(_KEY, None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {_KEY} to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="weftline-")
        spark.conf.set(_KEY, found)
    return found.rstrip("/")


def work_dir(spark: SparkSession, tag: str) -> str:
    """A new folder's URI below the shared one; two calls never meet."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def saved(spark: SparkSession, df: DataFrame, tag: str, path: str | None = None) -> DataFrame:
    """df written as Parquet to the shared folder and read again: later plans start at the files, so a lost executor costs no recomputation."""
    path = path or work_dir(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of an Arrow batch that goes to a Python worker: whole documents can be long, so few. It is the same for every plan, as plans are lazy.
BATCH = 500


def prepare(spark: SparkSession) -> None:
    """Send the code to the executors and bound the rows of Arrow batches."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI (file:, hdfs:, s3:, gs: or a plain path) and the path in it."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), os.path.abspath(uri)
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def make_dir(uri: str) -> None:
    fs, path = file_system(uri)
    fs.create_dir(path, recursive=True)


def put(uri: str, chunks: Iterable[bytes]) -> int:
    """Write a file under another name, then rename it: a task that runs twice leaves one whole file. Returns its size."""
    fs, path = file_system(uri)
    part, size = f"{path}.{uuid.uuid4().hex}.part", 0
    with fs.open_output_stream(part) as out:
        for chunk in chunks:
            out.write(chunk)
            size += len(chunk)
    fs.move(part, path)
    return size


def open_read(uri: str) -> BinaryIO:
    fs, path = file_system(uri)
    return fs.open_input_file(path)


def local_path(uri: str) -> str | None:
    """The path of a URI that this machine can memory-map, else None."""
    fs, path = file_system(uri)
    return path if isinstance(fs, pafs.LocalFileSystem) else None


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of Arrow batches as tuples."""
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def columns_of(df: DataFrame, names: Iterable[str]) -> None:
    """Complain early about a column that is missing."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns missing: {missing}; there are {df.columns}")


def quoted(name: str) -> Column:
    """The column of that very name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def slot(k: int) -> str:
    return f"c{k}"


def packed(df: DataFrame, names: list[str]) -> Column:
    """A struct of the named columns under plain names slot(0), slot(1) and so on, so that no name of theirs can clash."""
    return F.struct(*[quoted(c).alias(slot(k)) for k, c in enumerate(names)])


def unpacked(names: list[str], row: str = "row") -> list[Column]:
    """The columns that packed() has put into row, under their own names."""
    return [F.col(row).getField(slot(k)).alias(c) for k, c in enumerate(names)]


def plain_names(df: DataFrame) -> DataFrame:
    """df with its columns named slot(0), slot(1) and so on: functions over Arrow batches take no dots in names."""
    return df.toDF(*[slot(k) for k in range(len(df.columns))])


#: Rows of the bit table that tells which rows need not be shuffled. It is broadcast, and never larger.
WORDS = 1 << 16


def bit_table(ids: DataFrame, column: str) -> DataFrame:
    """word, bits: which values of ids may be there. At most WORDS rows."""
    h = F.xxhash64(column)
    return ids.select(F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(WORDS - 1)).alias("word"), F.expr(f"shiftleft(1L, cast(xxhash64({column}) & 63 as int)) as bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))


def maybe_in(df: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """df with a boolean column maybe: false only where the value is not among those of the table."""
    word = F.shiftrightunsigned(F.xxhash64(column), 6).bitwiseAND(F.lit(WORDS - 1))
    met = df.withColumn("_word", word).join(F.broadcast(table.withColumnRenamed("word", "_word")), "_word", "left")
    bit = F.expr(f"shiftrightunsigned(bits, cast(xxhash64({column}) & 63 as int)) & 1")
    return met.withColumn("maybe", F.coalesce(bit, F.lit(0)) == 1).drop("_word", "bits")
