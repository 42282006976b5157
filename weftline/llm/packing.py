"""Best-fit packing after Martello-Toth reduction.

Only the counts of the lengths matter for packing, and there are at most as many lengths as tokens in a sequence, so
the instance that the driver solves never grows with the documents. For a length, a small set of other lengths that
fills the sequence with it dominates when every set that fits beside it can be swapped for that one; such sequences are
fixed for good and leave the instance. Best-fit decreasing packs the rest. The plan says which ranks of a length go to
which sequences, and the rows take their ranks by counts of their partitions.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared
from .pieces import encoder as encoder_of

TOKENIZER, END, CAPACITY = "word_bpe_49k.json", 0, 2048
GROUP = 256
#: Pieces that a worker remembers.
PIECES = 500_000
#: A pattern: lengths in a sequence, and how many sequences have it.
Pattern = tuple[tuple[int, ...], int]


def _largest(counts: np.ndarray, most: int, but: tuple[int, ...] = ()) -> int:
    """The largest length up to most of which there is one besides but; 0 if none."""
    for x in range(min(most, len(counts) - 1), 0, -1):
        if counts[x] > but.count(x):
            return x
    return 0


def _smallest(counts: np.ndarray, n: int, but: int) -> list[int]:
    """The n smallest items besides one of length but."""
    out: list[int] = []
    for x in np.flatnonzero(counts):
        out += [int(x)] * min(n - len(out), int(counts[x]) - (x == but))
        if len(out) == n:
            break
    return out


def _dominating(counts: np.ndarray, length: int, capacity: int) -> tuple[int, ...] | None:
    """Lengths that dominate every set that fits beside one item of this length, or None if that can't be shown."""
    room = capacity - length
    best = _largest(counts, room, (length,))
    if not best:
        return ()
    if best == room:
        return (best,)
    low = _smallest(counts, 3, length)
    if len(low) < 2 or low[0] + low[1] > room:
        return (best,)  # no two fit, so the largest that fits takes the place of any
    if len(low) == 3 and sum(low) <= room:
        return None
    # pairs at most: the largest sum, and the largest smaller half
    top, pair, half = 0, (), 0
    for a in range(min(best, room), 0, -1):
        if counts[a] <= (a == length):
            continue
        b = _largest(counts, min(a, room - a), (length, a))
        if b:
            half = max(half, b)
            if a + b > top:
                top, pair = a + b, (a, b)
    if top <= best:
        return (best,)
    if pair[0] == best and half <= pair[1]:
        return pair
    return None


def reduce_instance(counts: np.ndarray, capacity: int) -> tuple[list[Pattern], np.ndarray]:
    """Sequences that can be fixed without losing the optimum, and the counts of the lengths that remain."""
    left, fixed = counts.copy(), []
    for length in range(len(left) - 1, 0, -1):
        while left[length]:
            beside = _dominating(left, length, capacity)
            if beside is None:
                break
            pattern = (length, *beside)
            times = min(int(left[x]) // pattern.count(x) for x in set(pattern))
            if len(beside) == 2 or (len(beside) == 1 and beside[0] != capacity - length):
                # the proof looks at the small items that are left; hold on to it while they are many, else go one by one
                times = max(1, min(times, min(int(left[x]) - 3 for x in set(pattern))))
            for x in pattern:
                left[x] -= times
            fixed.append((pattern, times))
    return fixed, left


def best_fit_decreasing(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Best-fit decreasing over counts: equal sequences are kept as one with a number."""
    open_: dict[int, list[list]] = defaultdict(list)  # room -> [lengths, number]
    rooms = np.zeros(capacity + 1, np.int64)
    for length in range(len(counts) - 1, 0, -1):
        n = int(counts[length])
        while n:
            fits = np.flatnonzero(rooms[length:])
            if not len(fits):
                each = capacity // length
                whole, rest = divmod(n, each)
                for lengths, number in (((length,) * each, whole), ((length,) * rest, 1)):
                    if lengths and number:
                        room = capacity - sum(lengths)
                        open_[room].append([lengths, number])
                        rooms[room] += number
                break
            room = int(fits[0]) + length
            lengths, number = open_[room][-1]
            each = room // length
            # a sequence takes items until the next does not fit, as its room stays the smallest
            some = min(number, n // each)
            put = each if some else n
            some = some or 1
            open_[room][-1][1] -= some
            if not open_[room][-1][1]:
                open_[room].pop()
            rooms[room] -= some
            left = room - put * length
            open_[left].append([lengths + (length,) * put, some])
            rooms[left] += some
            n -= put * some
    return [(lengths, number) for groups in open_.values() for lengths, number in groups if number]


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[Pattern]:
    """Patterns that hold every item of counts (counts[x]: items of length x) in few sequences."""
    fixed, left = reduce_instance(counts, capacity)
    return fixed + best_fit_decreasing(left, capacity)


def slots(patterns: list[Pattern]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per length: first rank, sequence of that rank and offset of each run of places."""
    runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    taken: dict[int, int] = defaultdict(int)
    sequence = 0
    for lengths, number in patterns:
        offset = 0
        for x in lengths:
            runs[x].append((taken[x], sequence, offset))
            taken[x] += number
            offset += x
        sequence += number
    return {x: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for x, r in runs.items()}


def _cutter(tokenizer: str, end: int, capacity: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer, end, PIECES)
        for batch in batches:
            docs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out = []
            for at in range(0, len(docs), GROUP):
                for d, one in zip(docs[at : at + GROUP], encoder.encode([t or "" for t in texts[at : at + GROUP]]), strict=True):
                    ids = np.frombuffer(one, encoder.dtype).astype("<u4")
                    for k, start in enumerate(range(0, len(ids), capacity)):
                        some = ids[start : start + capacity]
                        out.append((d, k, start, len(some), zlib.crc32(some.tobytes())))
            columns = zip(*out, strict=True) if out else ([],) * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return cut


_PIECE = "doc_id bigint, piece bigint, start bigint, length bigint, ids_crc32 bigint"


def pack(docs: DataFrame, *, tokenizer: str = TOKENIZER, end: int = END, capacity: int = CAPACITY) -> DataFrame:
    """Per piece of a document: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Documents longer than capacity are cut into pieces of capacity tokens, the last maybe shorter. A null or empty text
    is the end id alone. Repeated rows are packed each by itself, null doc_ids too. Other columns are not read; an empty
    table gives an empty table. Texts are not shuffled; the pieces are written once, as narrow rows.
    """
    shared.columns_of(docs, ["doc_id", "text"])
    spark = docs.sparkSession
    shared.prepare(spark)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    path = shared.work_dir(spark, "pieces")
    rows.mapInArrow(_cutter(tokenizer, end, capacity), _PIECE).write.parquet(path)
    # file name and place in it number the rows for good, whichever task reads them
    pieces = spark.read.schema(_PIECE.replace(" bigint", " long")).parquet(path).select("*", F.col("_metadata.file_name").alias("file"))
    per_file = pieces.groupBy("file", "length").count()
    before = Window.partitionBy("length").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    bases = shared.saved(spark, per_file.withColumn("base", F.coalesce(F.sum("count").over(before), F.lit(0))), "bases")
    counts = np.zeros(capacity + 1, np.int64)
    for r in bases.groupBy("length").agg(F.sum("count").alias("n")).collect():  # at most as many rows as capacity
        counts[r.length] = r.n
    places = slots(plan(counts, capacity))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            length, rank = (batch.column(names.index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            for some in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else ():
                first, number, at = places[int(length[some[0]])]
                k = np.searchsorted(first, rank[some], "right") - 1
                sequence[some], offset[some] = number[k] + rank[some] - first[k], at[k]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*names[:5], "sequence_id", "offset"])

    shared.prepare(spark)
    within = F.row_number().over(Window.partitionBy("file", "length").orderBy("doc_id", "piece", "start", "ids_crc32"))
    # as many bases as files and lengths: they are dealt as the pieces are, never broadcast
    ranked = pieces.withColumn("k", within).join(bases.hint("merge"), ["file", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("k") - 1 + F.col("base")).alias("rank"))
    return ranked.mapInArrow(put, _PIECE + ", sequence_id bigint, offset bigint").withColumn("piece", F.col("piece").cast("int"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pack() of all documents at 2048 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
