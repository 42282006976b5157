"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

A byte goes when a string of DEPTH bytes that covers it also starts elsewhere. Suffixes are ordered by most significant
digits and only through DEPTH bytes; those that stay together to the end are exactly the repeated windows.

Ordering every suffix of a large corpus would move many times its size, so the first digit is taken where it matters:
each window has an anchor, its GRAM-byte string of least hash (the leftmost of ties), and equal windows have equal
anchors at equal places. Windows that follow each other with one anchor make a run.

1. Digit one is the anchor's string. Counts of it, combined before the shuffle, drop runs whose anchor stands alone.
2. Runs whose whole span occurs twice are repeated as they are. One of each span goes on.
3. Digit two is the SIDE bytes before the anchor, for windows that have so many, or those after it, for the others.
4. The spans that still share their digits meet, and their windows are sorted by four more digits of DEPTH / 4 bytes,
   without those that stand alone after a digit. A digit shared by very many spans (a short passage in many documents)
   is not brought into one task: its windows are grouped by their own hashes over the cluster.

Digits are compared by 64-bit hashes of their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

DEPTH, GRAM, SIDE = 200, 32, 84
WIDTH = DEPTH - GRAM + 1
#: Spans under one digit that a task takes; those of larger groups are grouped window by window.
CROWD = 20_000
#: Bits of the map of anchors' strings that occur twice: it is broadcast, is no larger, and lets through a few others when full.
MAP_BITS = 1 << 27
#: Bytes that are worked on together; a longer text is cut into parts that overlap.
BUFFER = 1 << 20
_BASE = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hashes:
    """Hashes of any substrings of a buffer, by sums of powers modulo 2^64."""

    _powers = np.ones(1, np.uint64)
    _inverse = np.ones(1, np.uint64)
    _values = _mix(np.arange(1, 257, dtype=np.uint64))

    def __init__(self, data: np.ndarray):
        cls = Hashes
        if len(cls._powers) <= len(data):
            n = max(2 * BUFFER, len(data) + 1)
            inverse = pow(_BASE, -1, 1 << 64)  # of an odd number there is one
            cls._powers = np.cumprod(np.append(np.ones(1, np.uint64), np.full(n, _BASE, np.uint64)))
            cls._inverse = np.cumprod(np.append(np.ones(1, np.uint64), np.full(n, inverse, np.uint64)))
        self._sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(cls._values[data] * cls._powers[: len(data)])])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Signed 64-bit hashes of data[start:stop], never 0."""
        h = _mix((self._sums[stop] - self._sums[start]) * Hashes._inverse[start] + (stop - start).astype(np.uint64))
        h[h == 0] = 1
        return h.view(np.int64)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size, m = 1, x
    while size * 2 <= width:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    rest = width - size
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def runs(data: np.ndarray, ends: np.ndarray) -> tuple[Hashes, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, first window, windows, anchor) of the runs of a buffer that holds texts ending at ends; windows cross no end."""
    hashes = Hashes(data)
    if len(data) < DEPTH:
        none = np.empty(0, np.int64)
        return hashes, none, none, none
    at = np.arange(len(data) - GRAM + 1)
    key = (hashes.of(at, at + GRAM).view(np.uint64) & ~np.uint64(0xFFFFFF)) | at.astype(np.uint64)
    anchor = (_sliding_min(key, WIDTH) & np.uint64(0xFFFFFF)).astype(np.int64)
    valid = np.ones(len(anchor), bool)
    starts = np.concatenate([[0], ends[:-1]])
    for s, e in zip(np.maximum(ends - DEPTH + 1, starts), ends, strict=True):
        valid[s:e] = False
    change = np.flatnonzero((anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1])) + 1
    first = np.concatenate([[0], change])
    number = np.diff(np.append(first, len(anchor)))
    good = valid[first]
    return hashes, first[good], number[good], anchor[first[good]]


def _buffers(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, data, ends, offsets) of texts or parts of them: rows has doc_id and tie of each part, offsets where it starts in its text."""
    rows, parts, offsets, size = [], [], [], 0

    def out():
        data = np.frombuffer(b"".join(parts), np.uint8)
        return rows, data, np.cumsum([len(p) for p in parts]), np.array(offsets)

    for doc, tie, text in shared.rows_of(batches):
        raw = (text or "").encode("utf-8", "surrogatepass")
        step = BUFFER - DEPTH + 1
        for at in range(0, max(1, len(raw) - DEPTH + 1), step):
            part = raw[at : at + BUFFER]
            if len(part) < DEPTH:
                continue
            if size + len(part) > BUFFER and parts:
                yield out()
                rows, parts, offsets, size = [], [], [], 0
            rows.append((doc, tie))
            parts.append(part)
            offsets.append(at)
            size += len(part)
    if parts:
        yield out()


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, data, ends, _ in _buffers(batches):
        hashes, _, _, anchor = runs(data, ends)
        yield pa.RecordBatch.from_arrays([pa.array(hashes.of(anchor, anchor + GRAM))], names=["gram"])


_RUN = "gram bigint, span bigint, left bigint, right bigint, doc_id bigint, tie bigint, start bigint, windows bigint, lead bigint"


def _kept_runs(held):
    """Runs whose anchor's string may occur twice, with their digits. lead: bytes of the span before the anchor."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value
        for rows, data, ends, offsets in _buffers(batches):
            hashes, first, number, anchor = runs(data, ends)
            gram = hashes.of(anchor, anchor + GRAM)
            slot = gram.view(np.uint64) % np.uint64(len(bits) * 8)
            keep = (bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1
            gram, first, number, anchor = gram[keep], first[keep], number[keep], anchor[keep]
            span, lead = hashes.of(first, first + number - 1 + DEPTH), anchor - first
            left, right = np.zeros(len(gram), np.int64), np.zeros(len(gram), np.int64)
            has = lead >= SIDE
            left[has] = hashes.of(anchor[has] - SIDE, anchor[has])
            has = lead - number + 1 < SIDE
            right[has] = hashes.of(anchor[has] + GRAM, anchor[has] + GRAM + SIDE)
            part = np.searchsorted(ends, first, "right")
            start = first - np.concatenate([[0], ends[:-1]])[part] + offsets[part]
            docs = [rows[k] for k in part.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (gram, span, left, right)] + [pa.array([d for d, _ in docs], pa.int64()), pa.array([t for _, t in docs], pa.int64())] + [pa.array(x) for x in (start, number, lead)], names=["gram", "span", "left", "right", "doc_id", "tie", "start", "windows", "lead"])

    return work


def _bit_map(spark: SparkSession, grams: DataFrame, size: int) -> np.ndarray:
    """A map with a bit for each gram, gathered as slices of bytes: its size is bounded by MAP_BITS, whatever grams holds."""
    bits = 1 << 16
    while bits < min(MAP_BITS, 16 * size):
        bits *= 2
    words = grams.select(F.expr(f"cast(cast(gram as decimal(20)) + if(gram < 0, 18446744073709551616, 0) as decimal(20)) % {bits}").cast("bigint").alias("slot"))
    slices = words.select(F.shiftright("slot", 6).alias("word"), F.expr("shiftleft(1L, cast(slot & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    out = np.zeros(bits // 64, "<u8")
    for r in slices.toLocalIterator():
        out[r.word] = r.bits & (1 << 64) - 1
    return out.view(np.uint8)


def repeated_windows(spans: list[np.ndarray], lead: np.ndarray, windows: np.ndarray, group: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(span number, window number) of the windows that another span of the group has too.

    Windows of one group and one place of the anchor are sorted by digits of DEPTH / 4 bytes; after each digit those that
    stand alone leave. side 0 takes windows with at least SIDE bytes before the anchor, side 1 the others.
    """
    data = np.concatenate(spans)
    hashes, base = Hashes(data), np.concatenate([[0], np.cumsum([len(s) for s in spans])[:-1]])
    which = np.repeat(np.arange(len(spans)), windows)
    number = np.arange(len(which)) - np.repeat(np.cumsum(windows) - windows, windows)
    place = lead[which] - number
    own = (place >= SIDE) == (side[which] == 0)
    which, number, place = which[own], number[own], place[own]
    at = base[which] + number
    groups = group[which].astype(np.int64) * DEPTH + place
    digit = DEPTH // 4
    for depth in range(0, DEPTH, digit):
        key = hashes.of(at + depth, at + depth + digit)
        order = np.lexsort((key, groups))
        g, k = groups[order], key[order]
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (k[1:] != k[:-1])]) if len(g) else np.empty(0, bool)
        label = np.cumsum(new) - 1
        stay = np.bincount(label)[label] > 1 if len(label) else np.empty(0, bool)
        order, groups = order[stay], label[stay]
        which, number, at = which[order], number[order], at[order]
    return which, number


_SPAN = "gram bigint, side int, ctx bigint, doc_id bigint, tie bigint, start bigint, windows bigint, lead bigint, crowd boolean, bytes binary"
_PLACE = "doc_id bigint, tie bigint, first bigint, stop bigint"


def _cut_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the wanted spans of each text."""
    names = ["gram", "side", "ctx", "doc_id", "tie", "start", "windows", "lead", "crowd", "bytes"]
    kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 6, pa.bool_(), pa.binary()]
    for doc, tie, text, wanted in shared.rows_of(batches):
        raw = text.encode("utf-8", "surrogatepass")
        rows = [(w["gram"], w["side"], w["ctx"], doc, tie, w["start"], w["windows"], w["lead"], w["crowd"], raw[w["start"] : w["start"] + w["windows"] - 1 + DEPTH]) for w in wanted]
        for at in range(0, len(rows), 5000):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[at : at + 5000], strict=True), kinds, strict=True)], names=names)


def _intervals(doc: list, tie: list, start: np.ndarray, which: np.ndarray, number: np.ndarray) -> pa.RecordBatch:
    """Windows put together to stretches of bytes."""
    order = np.lexsort((number, which))
    w, n = which[order], number[order]
    new = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (n[1:] != n[:-1] + 1)])) if len(w) else np.empty(0, np.int64)
    last = np.append(new[1:], len(w)) - 1 if len(w) else new
    rows = w[new].tolist() if len(w) else []
    first, stop = start[w[new]] + n[new] if len(w) else new, start[w[new]] + n[last] + DEPTH if len(w) else new
    return pa.RecordBatch.from_arrays([pa.array([doc[k] for k in rows], pa.int64()), pa.array([tie[k] for k in rows], pa.int64()), pa.array(first, pa.int64()), pa.array(stop, pa.int64())], names=["doc_id", "tie", "first", "stop"])


def _sort_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by digit: whole groups are gathered to some thousand spans and their windows sorted."""
    held, groups, key, group_start = [], [], None, 0

    def work(n):
        rows, ids = held[:n], np.array(groups[:n])
        _, side, _, doc, tie, start, windows, lead, data = zip(*rows, strict=True)
        which, number = repeated_windows([np.frombuffer(d, np.uint8) for d in data], np.array(lead), np.array(windows), ids, np.array(side))
        return _intervals(doc, tie, np.array(start), which, number)

    for row in shared.rows_of(batches):
        if row[:3] != key:
            if len(held) > 4000:
                yield work(len(held))
                held, groups = [], []
            key, group_start = row[:3], group_start + 1
        held.append(row)
        groups.append(group_start)
    if held:
        yield work(len(held))


def _explode_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each window of a span of a crowded group: hash, and where it is."""
    for gram, side, _ctx, doc, tie, start, windows, lead, data in shared.rows_of(batches):
        hashes, number = Hashes(np.frombuffer(data, np.uint8)), np.arange(windows)
        number = number[(lead - number >= SIDE) == (side == 0)]
        h = hashes.of(number, number + DEPTH)
        n = len(number)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, gram)), pa.array(h), pa.array([doc] * n, pa.int64()), pa.array(np.full(n, tie)), pa.array(start + number)], names=["gram", "h", "doc_id", "tie", "at"])


def _text_rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("tie"), F.col("text").cast("string").alias("text"))


def _maybe(df: DataFrame, table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """df split by whether its tie may be among those of table; the table of bits that is broadcast has at most 2^16 rows."""
    word = F.expr("shiftrightunsigned(tie, 6) & 65535")
    bits = table.select(word.alias("word"), F.expr("shiftleft(1L, cast(tie & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    met = df.withColumn("word", word).join(F.broadcast(bits), "word", "left").withColumn("maybe", F.expr("coalesce(shiftrightunsigned(bits, cast(tie & 63 as int)) & 1, 0) = 1"))
    return met.where("maybe").drop("word", "bits", "maybe"), met.where("not maybe").drop("word", "bits", "maybe")


def repeated(docs: DataFrame) -> DataFrame:
    """doc_id, tie (hash of the text), places (first and stop of stretches of bytes to remove, which may overlap) of the rows of docs that have any."""
    spark = docs.sparkSession
    shared.prepare(spark)
    rows = _text_rows(docs)
    grams = rows.mapInArrow(_grams, "gram bigint").groupBy("gram").count().where("count > 1").select("gram")
    grams = shared.saved(spark, grams, "grams")
    held = spark.sparkContext.broadcast(_bit_map(spark, grams, grams.count()))
    found = shared.saved(spark, rows.mapInArrow(_kept_runs(held), _RUN), "runs")
    # equal spans: all their windows are repeated; one of each goes on
    one = F.min(F.struct("doc_id", "tie", "start", "windows", "lead", "left", "right")).alias("one")
    spans = shared.saved(spark, found.groupBy("gram", "span").agg(F.count(F.lit(1)).alias("n"), one), "spans")
    whole = found.join(spans.where("n > 1").select("gram", "span"), ["gram", "span"]).select("doc_id", "tie", F.col("start").alias("first"), (F.col("start") + F.col("windows") - 1 + DEPTH).alias("stop"))
    sides = spans.select("gram", "span", "one", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("one.left").alias("ctx")), F.struct(F.lit(1).alias("side"), F.col("one.right").alias("ctx")))).alias("d")).where("d.ctx <> 0").select("gram", "d.side", "d.ctx", "one")
    sizes = sides.groupBy("gram", "side", "ctx").count().where("count > 1").withColumn("crowd", F.col("count") > CROWD).drop("count")
    wanted = sides.join(sizes, ["gram", "side", "ctx"]).select("one.doc_id", "one.tie", F.struct("gram", "side", "ctx", "one.start", "one.windows", "one.lead", "crowd").alias("w"))
    # bounded by the text, as a set of places in each document however often its row is repeated
    wanted = shared.saved(spark, wanted.groupBy("doc_id", "tie").agg(F.collect_set("w").alias("wanted")), "wanted")
    some, _ = _maybe(rows.where("text is not null"), wanted)
    left = some.select("doc_id", "tie", "text").alias("t")
    met = left.join(wanted.alias("w"), (F.col("t.tie") == F.col("w.tie")) & F.col("t.doc_id").eqNullSafe(F.col("w.doc_id"))).select("t.doc_id", "t.tie", "t.text", "w.wanted")
    cut = shared.saved(spark, met.mapInArrow(_cut_spans, _SPAN).dropDuplicates(["gram", "side", "ctx", "doc_id", "tie", "start"]), "cut")
    names = ["gram", "side", "ctx", "doc_id", "tie", "start", "windows", "lead", "bytes"]
    shared.prepare(spark)
    few = cut.where("not crowd").select(*names).repartition(shared.partitions(spark), "gram", "side", "ctx").sortWithinPartitions("gram", "side", "ctx")
    sorted_ = few.mapInArrow(_sort_groups, _PLACE)
    crowd = cut.where("crowd").select(*names)
    places = whole.unionByName(sorted_)
    if not crowd.isEmpty():
        rows_ = shared.saved(spark, crowd.mapInArrow(_explode_windows, "gram bigint, h bigint, doc_id bigint, tie bigint, at bigint"), "windows")
        twice = rows_.groupBy("gram", "h").count().where("count > 1").select("gram", "h")
        places = places.unionByName(rows_.join(twice, ["gram", "h"]).select("doc_id", "tie", F.col("at").alias("first"), (F.col("at") + DEPTH).alias("stop")))
    return shared.saved(spark, places.groupBy("doc_id", "tie").agg(F.collect_set(F.struct("first", "stop")).alias("places")), "places")


def keep(raw: bytes, places: list) -> tuple[bytes, int, int]:
    """What is left of a text without the places, bytes removed and stretches removed."""
    kept, at, removed, n, end = [], 0, 0, 0, -1
    for first, stop in sorted((p["first"], p["stop"]) for p in places):
        if first > end:
            n += 1
            kept.append(raw[at:first])
            removed += stop - first
            at = end = stop
        elif stop > end:
            removed += stop - end
            at = end = stop
    kept.append(raw[at:])
    return b"".join(kept), removed, n


_OUT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def _results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc, text, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            raw = (text or "").encode("utf-8", "surrogatepass")
            kept, removed, n = keep(raw, places or [])
            out.append((doc, len(raw), removed, n, hashlib.sha256(kept).hexdigest()))
        columns = list(zip(*out, strict=True)) if out else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k == 4 else pa.int64()) for k, c in enumerate(columns)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _with_places(docs: DataFrame) -> DataFrame:
    """doc_id, text, places of every row; only texts that may lose something are shuffled."""
    rows, places = _text_rows(docs), repeated(docs)
    some, rest = _maybe(rows, places)
    met = some.alias("t").join(places.alias("p"), (F.col("t.tie") == F.col("p.tie")) & F.col("t.doc_id").eqNullSafe(F.col("p.doc_id")), "left").select("t.doc_id", "t.text", "p.places")
    kind = places.schema["places"].dataType
    return met.unionByName(rest.select("doc_id", "text", F.lit(None).cast(kind).alias("places")))


def report(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_removed, n_spans (maximal removed stretches), kept_sha256 (of the bytes that are left).

    A null text is empty; texts shorter than DEPTH bytes lose nothing. Rows with the same doc_id and text are copies of
    each other like any. Other columns are not read. An empty table gives an empty table.
    """
    shared.columns_of(docs, ["doc_id", "text"])
    out = _with_places(docs)
    shared.prepare(docs.sparkSession)
    return out.mapInArrow(_results, _OUT)


def kept_bytes(docs: DataFrame) -> DataFrame:
    """doc_id and kept, the bytes of each text that no repeated window covers (they need not be whole characters)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [keep((t or "").encode("utf-8", "surrogatepass"), p or [])[0] for t, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary())], names=["doc_id", "kept"])

    return _with_places(docs).mapInArrow(work, "doc_id bigint, kept binary")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """report() of all documents."""
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
