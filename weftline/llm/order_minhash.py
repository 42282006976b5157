"""Order MinHash fingerprints.

The k-mers of a text are numbered by occurrence. For each of several hash functions the few smallest (k-mer, number)
pairs are taken, put back into text order, and the tuple of their k-mers is hashed: a component agrees when the same
k-mers are smallest and stand in the same order, so likeness falls with edit distance and also with moved passages.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

#: Code points of a k-mer, hash functions, k-mers in a tuple (two: the code below orders a pair).
K, FUNCTIONS = 12, 48
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
#: Positions that are hashed by all functions at once.
_BLOCK = 1 << 14


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_FACTORS = _mix(np.arange(1, FUNCTIONS + 1, dtype=np.uint64)) | np.uint64(1)
_ROWS = np.arange(FUNCTIONS)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_BASE, n, 1 << 64))


def kmers(text: str) -> np.ndarray:
    """Hashes of the k-mers in text order; a shorter text is one k-mer, an empty one has none."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    n = len(c)
    if not n:
        return c
    size, h = 1, c
    want = min(K, n)
    parts = {1: c}
    while size * 2 <= want:
        h = h[: len(h) - size] * _power(size) + h[size:]
        size *= 2
        parts[size] = h
    done, total = 0, np.zeros(n - want + 1, np.uint64)
    for size in sorted(parts, reverse=True):
        while done + size <= want:
            total = total * _power(size) + parts[size][done : done + len(total)]
            done += size
    return _mix(total + np.uint64(want))


def numbered(h: np.ndarray) -> np.ndarray:
    """Hashes of (k-mer, occurrence number): the first occurrence keeps the k-mer's own."""
    s = np.sort(h)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return h
    twice = np.unique(twice)
    at = np.searchsorted(twice, h)
    at[at == len(twice)] = 0
    where = np.flatnonzero(twice[at] == h)
    order = where[np.argsort(h[where], kind="stable")]
    values = h[order]
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    number = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    out = h.copy()
    again = number > 0
    out[order[again]] = _mix(values[again] + number[again].astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    return out


def _smallest_two(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the two smallest values of x under each function (the first of ties; one value alone is both)."""
    best = np.full((2, FUNCTIONS), _MASK, np.uint64)
    place = np.zeros((2, FUNCTIONS), np.int64)
    for at in range(0, len(x), _BLOCK):
        y = x[None, at : at + _BLOCK] * _FACTORS[:, None]
        for _ in range(min(2, y.shape[1])):
            i = y.argmin(axis=1)
            v = y[_ROWS, i]
            first, second = v < best[0], (v >= best[0]) & (v < best[1])
            best[1], place[1] = np.where(first, best[0], np.where(second, v, best[1])), np.where(first, place[0], np.where(second, i + at, place[1]))
            best[0], place[0] = np.where(first, v, best[0]), np.where(first, i + at, place[0])
            y[_ROWS, i] = np.uint64(_MASK)
    if len(x) == 1:
        place[1] = place[0]
    return place[0], place[1]


def signature(text: str | None) -> np.ndarray:
    """FUNCTIONS components of 32 bits. Null and empty texts have the same, which no other text shares by design."""
    h = kmers(text or "")
    if not len(h):
        return np.zeros(FUNCTIONS, np.uint32)
    a, b = _smallest_two(numbered(h))
    low, high = np.minimum(a, b), np.maximum(a, b)
    pair = _mix(_mix(h[low] + _FACTORS) ^ h[high])
    return (pair >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def as_text(components: np.ndarray) -> str:
    """Hexadecimal digits, eight for each component."""
    return components.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of components that agree, 0 to 1."""
    return float((a == b).mean())


_OUT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order, each bucket followed by the first row of the next: results of each row with its follower."""
    rows, before = [], None

    def flush():
        columns = list(zip(*rows, strict=True))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    for bucket, head, doc, text in shared.rows_of(batches):
        if head and (before is None or before[0] != bucket):
            continue  # a further row with the id of the bucket's follower
        text = text or ""
        now = (bucket, doc, text, signature(text))
        if before is not None and before[0] == bucket:
            _, d, t, f = before
            n = len(t)
            edited = t[: n - n // 2] + text[: n // 2]
            e = signature(edited)
            rows.append((d, n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), as_text(f), as_text(e), likeness(f, e), likeness(f, now[3])))
            if len(rows) == 500:
                yield flush()
        before = None if head else now
    if rows:
        yield flush()


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last floor(n_chars / 2) code points replaced by the first as many (or all) of
    the next document in descending doc_id; the last is followed by the first, a lone document by itself. A null text is
    empty, a null doc_id smaller than any; rows with equal ids follow each other by text, descending. Other columns are
    not read; an empty table gives an empty table. Texts are shuffled once, by ranges of doc_id; each range also gets
    the first row of the one that follows.
    """
    shared.columns_of(docs, ["doc_id", "text"])
    spark = docs.sparkSession
    shared.prepare(spark)
    lowest = -(1 << 63)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.coalesce("doc_id", F.lit(lowest)))
    n = 2 * shared.partitions(spark)
    # cut points are driver-side numbers, so every job deals the rows alike
    cuts = np.array(sorted(set(map(int, rows.approxQuantile("key", [k / n for k in range(1, n)], 0.25 / n)))), np.int64)

    @F.pandas_udf("bigint")
    def bucket(key: pd.Series) -> pd.Series:
        return pd.Series(len(cuts) - np.searchsorted(cuts, key.to_numpy(), "right"))

    dealt = rows.withColumn("bucket", bucket("key"))
    firsts = sorted(map(tuple, dealt.groupBy("bucket").agg(F.max("key")).collect()))  # a row for each bucket
    if not firsts:
        return spark.createDataFrame([], _OUT)
    follows = {key: firsts[k - 1][0] for k, (_, key) in enumerate(firsts)}
    target = F.create_map(*[F.lit(x) for pair in follows.items() for x in pair])[F.col("key")]
    heads = rows.where(F.col("key").isin(list(follows))).select(target.alias("bucket"), F.lit(True).alias("head"), "doc_id", "text", "key")
    both = dealt.select("bucket", F.lit(False).alias("head"), "doc_id", "text", "key").unionByName(heads)
    met = both.repartition(shared.partitions(spark), "bucket").sortWithinPartitions("bucket", "head", F.desc("key"), F.desc("text"))
    return met.select("bucket", "head", "doc_id", "text").mapInArrow(_compare, _OUT)


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fingerprints() of all documents."""
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
