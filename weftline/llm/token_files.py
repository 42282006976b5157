"""Token ids as flat binary files with 64-bit document offsets.

A folder holds, for each partition p of the documents in ascending doc_id order, p.bin (little-endian unsigned
integers, 16 bits where the vocabulary allows) and p.idx (int64: number of documents n, then n + 1 offsets in
ids, then n doc_ids, then n flags that are 0 where the doc_id is null). The base of a partition, that is the ids
of all documents before it, is the prefix sum of the partitions' counts and stands in the manifest.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .pieces import encoder as encoder_of

TOKENIZER, END = "byte_bpe_50k.json", 2
#: Texts that are encoded together.
GROUP = 256


@dataclass(frozen=True)
class Manifest:
    """What a folder of token files holds. One entry per partition, so it stays small: parts in order, their bases and sizes in ids."""

    path: str
    width: int
    parts: list[int]
    bases: list[int]
    sizes: list[int]
    documents: int

    @property
    def tokens(self) -> int:
        return self.bases[-1] + self.sizes[-1] if self.parts else 0


def _writer(path: str, tokenizer: str, end: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = encoder_of(tokenizer, end), TaskContext.get().partitionId()
        ids, valid, sizes = [], [], []

        def chunks():
            for batch in batches:
                docs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for at in range(0, len(docs), GROUP):
                    for one in encoder.encode([t or "" for t in texts[at : at + GROUP]]):
                        sizes.append(len(one) // encoder.width)
                        yield one
                ids.extend(d or 0 for d in docs)
                valid.extend(d is not None for d in docs)

        total = shared.put(f"{path}/{part:06d}.bin", chunks()) // encoder.width
        if not ids:
            return
        offsets = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        index = np.concatenate([[len(ids)], offsets, np.array(ids, np.int64), np.array(valid, np.int64)]).astype("<i8")
        shared.put(f"{path}/{part:06d}.idx", [index.tobytes()])
        yield pa.RecordBatch.from_pydict({"part": [part], "n_docs": [len(ids)], "n_ids": [total], "width": [encoder.width]})

    return write


def write_token_files(docs: DataFrame, path: str, *, tokenizer: str = TOKENIZER, end: int = END) -> Manifest:
    """Write doc_id, text of docs to path in ascending doc_id order (null ids first, equal ids by text) and return the manifest.

    A null or empty text is the end id alone. An empty table gives a manifest without parts. Other columns are not read.
    One range shuffle of the texts; each task streams its partition, so memory does not grow with it. doc_id must fit 64 bits.
    """
    shared.columns_of(docs, ["doc_id", "text"])
    spark = docs.sparkSession
    shared.prepare(spark)
    shared.make_dir(path)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # the text's hash is a second key so that even one repeated doc_id is dealt over several partitions
    ordered = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(shared.partitions(spark), "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")
    made = ordered.select("doc_id", "text").mapInArrow(_writer(path, tokenizer, end), "part bigint, n_docs bigint, n_ids bigint, width bigint")
    found = sorted(made.collect())  # a row for each partition
    sizes = [r.n_ids for r in found]
    bases = [int(x) for x in np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])[:-1]] if found else []
    manifest = Manifest(path, found[0].width if found else 2, [r.part for r in found], bases, sizes, sum(r.n_docs for r in found))
    shared.put(f"{path}/manifest.json", [json.dumps(manifest.__dict__).encode()])
    return manifest


def open_manifest(path: str) -> Manifest:
    with shared.open_read(f"{path}/manifest.json") as f:
        return Manifest(**json.loads(f.read()))


def part_documents(path: str, part: int, width: int) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc_id, offset in the part, ids) of each document; the ids are a view of the mapped file."""
    with shared.open_read(f"{path}/{part:06d}.idx") as f:
        index = np.frombuffer(f.read(), "<i8")
    n = int(index[0])
    offsets, ids, valid = index[1 : n + 2], index[n + 2 : 2 * n + 2], index[2 * n + 2 :]
    local, dtype = shared.local_path(f"{path}/{part:06d}.bin"), np.dtype(f"<u{width}")
    if int(offsets[-1]) == 0:
        flat = np.empty(0, dtype)
    elif local:
        flat = np.memmap(local, dtype, "r")
    else:
        with shared.open_read(f"{path}/{part:06d}.bin") as f:
            flat = np.frombuffer(f.read(), dtype)
    for k in range(n):
        yield (int(ids[k]) if valid[k] else None), int(offsets[k]), flat[offsets[k] : offsets[k + 1]]


SCHEMA = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def read_token_files(spark: SparkSession, manifest: Manifest) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of its ids as 32-bit integers)."""
    shared.prepare(spark)
    parts, bases, path, width = manifest.parts, manifest.bases, manifest.path, manifest.width

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (k,) in shared.rows_of(batches):
            rows = [(d, bases[k] + at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for d, at, ids in part_documents(path, parts[k], width)]
            for at in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[at : at + 10_000], strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    if not parts:
        return spark.createDataFrame([], SCHEMA)
    return spark.range(0, len(parts), 1, len(parts)).mapInArrow(read, SCHEMA)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document, read back from the files: doc_id, start, n_tokens, ids_crc32."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_token_files(spark, write_token_files(docs, shared.work_dir(spark, "tokens")))
