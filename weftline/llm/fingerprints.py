"""SimHash near-duplicates by covering-code anchors.

A 64-bit fingerprint is seen as three segments of 23, 23 and 18 bits. Two fingerprints that differ in at most four
bits differ in at most one bit of some segment. In each segment the anchors are the 4096 words of the binary Golay
code of length 23 (the last segment is padded with zeros), a perfect code: every segment value lies within three
bits of exactly one anchor, its home. A fingerprint goes to its home and to every anchor within four bits, covering
radius plus one, so any such pair meets at the home of either. Each anchor's fingerprints are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared
from .components import connected
from .shared import bit_table, maybe_in

SHINGLE, SEED, DISTANCE = 4, 42, 4
#: Generator polynomial of the Golay code of length 23 and the length, a fixed value.
GENERATOR, LENGTH = 0xC75, 23
#: (shift, bits) of the segments.
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: An anchor with more rows than this is split into tiles.
TILE = 200_000


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of word shingles: a bit is set where over half the shingles' XXH64 have it; without words 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only ASCII white space parts
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        joined, ends, at = b" ".join(words), [], 0
        for w in words:
            at += len(w) + 1
            ends.append(at)
        starts = [0, *ends]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[shingle - 1 :], strict=False)]
    rows = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    counts = np.zeros(64, np.int64)
    for part in range(0, len(rows), 65_536):
        counts += np.unpackbits(rows[part : part + 65_536], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(rows), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(made)], names=["doc_id", "tie", "fp"])


def _bit_syndromes() -> np.ndarray:
    """Remainder of x^i by the generator, for each bit i."""
    out, r = [], 1
    for _ in range(LENGTH):
        out.append(r)
        r <<= 1
        if r & 0x800:
            r ^= GENERATOR
    return np.array(out, np.int64)


def _xor_table(values: np.ndarray) -> np.ndarray:
    """XOR of the chosen values for each subset of them, by subset number."""
    out = np.zeros(1, np.int64)
    for v in values:
        out = np.concatenate([out, out ^ v])
    return out


class Golay:
    """Nearest anchors: home() is the one within three bits, near() all within four when one of the lowest bits flips."""

    def __init__(self):
        bits = _bit_syndromes()
        self._low, self._high = _xor_table(bits[:12]), _xor_table(bits[12:])
        self._leader = np.full(2048, -1, np.int64)
        for weight in range(4):
            for some in combinations(range(LENGTH), weight):
                self._leader[np.bitwise_xor.reduce(bits[list(some)]) if some else 0] = sum(1 << i for i in some)
        assert (self._leader >= 0).all()

    def home(self, v: np.ndarray) -> np.ndarray:
        return v ^ self._leader[self._low[v & 0xFFF] ^ self._high[v >> 12]]

    def near(self, v: np.ndarray, bits: int) -> np.ndarray:
        """Row i: anchors of v[i] and of v[i] with one of the lowest bits flipped, the home first; repeated ones are -1."""
        home = self.home(v)
        all_ = np.sort(np.stack([self.home(v ^ (1 << i)) for i in range(bits)], axis=1), axis=1)
        all_[:, 1:][all_[:, 1:] == all_[:, :-1]] = -1
        all_[all_ == home[:, None]] = -1
        return np.concatenate([home[:, None], all_], axis=1)


def _anchors(tiles: dict[int, int]):
    """Rows (anchor, tile, fp, home): a home goes to one tile of its anchor, the others to all."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        golay = Golay()
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            u = fps.view(np.uint64)
            for k, (shift, bits) in enumerate(SEGMENTS):
                v = ((u >> np.uint64(shift)) & np.uint64((1 << bits) - 1)).astype(np.int64)
                near = golay.near(v, bits)
                row, col = np.nonzero(near >= 0)
                anchor, home, fp = (k << LENGTH) | near[row, col], col == 0, fps[row]
                tile = np.zeros(len(anchor), np.int64)
                if tiles:
                    n = np.array([tiles.get(int(a), 1) for a in anchor], np.int64)
                    own = (fp.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % n
                    # every fingerprint is dealt to all tiles to be found; where it searches, its own tile is marked home
                    again = np.repeat(np.arange(len(anchor)), n)
                    tile = np.concatenate([np.arange(x) for x in n]) if len(n) else tile
                    anchor, fp, home = anchor[again], fp[again], home[again] & (tile == own[again])
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(tile), pa.array(fp), pa.array(home)], names=["anchor", "tile", "fp", "home"])

    return deal


def _pairs(x: np.ndarray, y: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) with at most distance differing bits between x[i] and y[j], in blocks."""
    if len(x) * len(y) <= 1 << 24:
        step = max(1, (1 << 21) // max(1, len(y)))
        for at in range(0, len(x), step):
            i, j = np.nonzero(np.bitwise_count(x[at : at + step, None] ^ y[None, :]) <= distance)
            yield i + at, j
        return
    # blocks of bits: distance spoils at most that many of distance + 2 blocks, so two agree
    n = distance + 2
    cuts = [round(64 * k / n) for k in range(n + 1)]
    masks = [np.uint64(((1 << (b - a)) - 1) << a) for a, b in zip(cuts, cuts[1:], strict=False)]
    for p, q in combinations(masks, 2):
        key = p | q
        order = np.argsort(y & key, kind="stable")
        keys = (y & key)[order]
        lo, hi = np.searchsorted(keys, x & key, "left"), np.searchsorted(keys, x & key, "right")
        count, at = hi - lo, 0
        ends = np.cumsum(count)
        while at < len(x):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 21), "right")))
            c = count[at:stop]
            i = np.repeat(np.arange(at, stop), c)
            j = order[np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c) + np.repeat(lo[at:stop], c)]
            good = np.bitwise_count(x[i] ^ y[j]) <= distance
            yield i[good], j[good]
            at = stop


def _join_labels(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels (smallest index of the group) after i[k] and j[k] are put together."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        parent = np.arange(len(label))
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while (parent[parent] != parent).any():
            parent = parent[parent]
        label = parent[label]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per anchor and tile: a forest of links, at most an edge for each fingerprint."""

    def groups():
        held, key = [], None
        for batch in batches:
            anchor, tile, fp, home = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if not len(anchor):
                continue
            cuts = np.flatnonzero((anchor[1:] != anchor[:-1]) | (tile[1:] != tile[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, len(anchor)], strict=True):
                now = (anchor[a], tile[a])
                if now != key and held:
                    yield [np.concatenate(x) for x in zip(*held, strict=True)]
                    held = []
                key = now
                held.append((fp[a:b], home[a:b]))
        if held:
            yield [np.concatenate(x) for x in zip(*held, strict=True)]

    out_a, out_b, size = [], [], 0
    for fp, home in groups():
        if len(fp) > 1 and home.any():
            order = np.argsort(fp, kind="stable")
            fp, home = fp[order], home[order]
            u, own = fp.view(np.uint64), np.flatnonzero(home)
            label = np.arange(len(fp))
            for i, j in _pairs(u[own], u, DISTANCE):
                label = _join_labels(label, own[i], j)
            linked = np.flatnonzero(label != np.arange(len(fp)))
            out_a.append(fp[linked])
            out_b.append(fp[label[linked]])
            size += len(linked)
        if size > 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], names=["a", "b"])
            out_a, out_b, size = [], [], 0
    if out_a:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], names=["a", "b"])


def links(classes: DataFrame) -> DataFrame:
    """Edges (a, b) between the distinct fingerprints fp of classes that connect all at most DISTANCE bits apart."""
    spark = classes.sparkSession
    shared.prepare(spark)
    kind = "anchor bigint, tile bigint, fp bigint, home boolean"
    load = classes.select("fp").mapInArrow(_anchors({}), kind).groupBy("anchor").count().where(F.col("count") > TILE)
    tiles = {r["anchor"]: -(-r["count"] // TILE) for r in load.collect()}  # at most as many rows as there are anchors, 12,288
    dealt = classes.select("fp").mapInArrow(_anchors(tiles), kind)
    met = dealt.repartition(shared.partitions(spark), "anchor", "tile").sortWithinPartitions("anchor", "tile")
    return met.mapInArrow(_compare, "a bigint, b bigint")


def _grouped(docs: DataFrame) -> DataFrame:
    """doc_id, tie (hash of the text), fp, root (fingerprint that names the group), component_id of every row of docs."""
    shared.columns_of(docs, ["doc_id", "text"])
    spark = docs.sparkSession
    shared.prepare(spark)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.select("doc_id", "text", F.xxhash64("text").alias("tie"))
    fps = shared.saved(spark, rows.mapInArrow(_fingerprints, "doc_id bigint, tie bigint, fp bigint"), "fps")
    classes = shared.saved(spark, fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    edges = shared.saved(spark, links(classes), "links")
    roots = shared.saved(spark, connected(edges), "roots")
    linked = roots.join(classes, F.col("node") == F.col("fp")).select("node", "root", "first")
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    of = classes.join(roots, F.col("fp") == F.col("node"), "left").join(least, "root", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("least", "first").alias("component_id"))
    return fps.join(shared.saved(spark, of, "of"), "fp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id linked directly or through others).

    Null and empty texts have fingerprint zero and are linked like any other. Equal fingerprints are one class, so copies
    are never expanded into pairs. Rows that share a doc_id each get a row. A null doc_id never is a component_id unless
    its whole group has none. Other columns are not read. An empty table gives an empty table.
    """
    return _grouped(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each group: that with the smallest doc_id (null last), then text hash; all columns stay.

    Only rows that may leave are shuffled.
    """
    spark = docs.sparkSession
    groups = shared.saved(spark, _grouped(docs).select("doc_id", "tie", "root"), "groups")
    first = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")
    met = groups.join(first, "root").groupBy("doc_id", "tie").agg(F.max(own.eqNullSafe(F.col("first")).cast("int")).alias("stays"))
    shaky = shared.saved(spark, met, "shaky")
    row = docs.select(shared.packed(docs, docs.columns).alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("tie"))
    split = maybe_in(row, bit_table(shaky, "tie"), "tie")
    held = split.where("maybe").join(shaky, (split["tie"] == shaky["tie"]) & split["doc_id"].eqNullSafe(shaky["doc_id"]), "left").select("row", split["doc_id"], split["tie"], "stays")
    nth = F.row_number().over(Window.partitionBy("doc_id", "tie").orderBy(F.lit(0)))
    held = held.where("stays is null or stays = 1").withColumn("nth", nth).where("nth = 1 or stays is null")
    return held.select("row").unionByName(split.where("not maybe").select("row")).select(*shared.unpacked(docs.columns))


def op10_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_duplicates() of all documents."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
