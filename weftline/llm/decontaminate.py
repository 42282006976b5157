"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton has a state for each class of word sequences that end at the same places of the items. Training
words are streamed through it; at each word it gives the length of the longest sequence that ends there and
stands in some item. A length of at least the window marks the last words of it as hit, and the state with the
window itself lists the items. Items shorter than the window are one window each and are found on the suffix links.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import shared

WINDOW = 10
#: Words of test items in one automaton, which a worker holds (some 100 MB at most). A larger benchmark takes several passes over the
#: documents, one automaton after the other.
PASS_WORDS = 250_000
#: Share of a document's words that may be hit before the pipeline drops it as a whole.
COVERAGE = 0.5

_WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    """Words of a text: A-Z lower-cased, then runs of letters, digits and anything beyond ASCII. Null has none."""
    return _WORDS.findall((text or "").encode("utf-8", "surrogatepass").lower())


class Automaton:
    """Generalised suffix automaton of (item_id, words) with the windows' items."""

    def __init__(self, items: Iterable[tuple[object, list[bytes]]], window: int = WINDOW):
        self.window, self.vocabulary = window, {}
        self._next: list[dict[int, int]] = [{}]
        self._link, self._length = [-1], [0]
        sequences = []
        for item, words in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
            if ids:
                sequences.append((item, ids))
                last = 0
                for w in ids:
                    last = self._extend(last, w)
        self.shortest = min((min(len(ids), window) for _, ids in sequences), default=0)
        # items by the state that holds a window, and length by the state that holds a short item
        self._items: dict[int, set] = {}
        self._short: dict[int, dict[int, set]] = {}
        for item, ids in sequences:
            if len(ids) < window:
                state = self._walk(ids)
                self._short.setdefault(state, {}).setdefault(len(ids), set()).add(item)
            else:
                for at in range(len(ids) - window + 1):
                    self._items.setdefault(self._walk(ids[at : at + window]), set()).add(item)
        # the state on the way of suffix links, itself included, that holds the last window of a sequence
        self._at_window = [-1] * len(self._link)
        for s in sorted((s for s in range(1, len(self._link)) if self._length[s] >= window), key=self._length.__getitem__):
            up = self._link[s]
            self._at_window[s] = s if self._length[up] < window else self._at_window[up]
        # the nearest state on the way of suffix links, itself included, that holds a short item
        self._near_short = [-1] * len(self._link)
        for s in sorted(range(1, len(self._link)), key=self._length.__getitem__):
            self._near_short[s] = s if s in self._short else self._near_short[self._link[s]]

    def _new(self, length: int, link: int, step: dict[int, int]) -> int:
        self._next.append(step)
        self._length.append(length)
        self._link.append(link)
        return len(self._link) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        """The state of the sequences of q that are as long as those of p and w, taken out of q where need be."""
        if self._length[p] + 1 == self._length[q]:
            return q
        twin = self._new(self._length[p] + 1, self._link[q], dict(self._next[q]))
        self._link[q] = twin
        while p >= 0 and self._next[p].get(w) == q:
            self._next[p][w] = twin
            p = self._link[p]
        return twin

    def _extend(self, last: int, w: int) -> int:
        if w in self._next[last]:
            return self._split(last, w, self._next[last][w])
        made, p = self._new(self._length[last] + 1, 0, {}), last
        while p >= 0 and w not in self._next[p]:
            self._next[p][w] = made
            p = self._link[p]
        if p >= 0:
            self._link[made] = self._split(p, w, self._next[p][w])
        return made

    def _walk(self, ids: list[int]) -> int:
        state = 0
        for w in ids:
            state = self._next[state][w]
        return state

    def match(self, words: list[bytes], hit: np.ndarray) -> set:
        """Mark hit words and return the items of the windows that occur."""
        found: set = set()
        n, k = len(words), self.shortest
        if not k or n < k:
            return found
        get = self.vocabulary.get
        ids = np.fromiter((get(w, -1) for w in words), np.int64, n)
        known = np.concatenate([[False], ids >= 0, [False]])
        edges = np.flatnonzero(known[1:] != known[:-1])
        starts, stops = edges[::2], edges[1::2]
        for a, b in zip(starts.tolist(), stops.tolist(), strict=True):
            if b - a >= k:
                self._stream(ids[a:b].tolist(), a, hit, found)
        return found

    def _stream(self, ids: list[int], base: int, hit: np.ndarray, found: set) -> None:
        step, link, length, window = self._next, self._link, self._length, self.window
        state, size, seen = 0, 0, set()
        for at, w in enumerate(ids, base + 1):
            while state and w not in step[state]:
                state = link[state]
                size = length[state]
            if w in step[state]:
                state = step[state][w]
                size += 1
            if size >= window:
                hit[at - window : at] = True
                s = self._at_window[state]
                if s not in seen:
                    seen.add(s)
                    found |= self._items[s]
            s = self._near_short[state] if self._short else -1
            while s >= 0:
                for short, items in self._short[s].items():
                    if short <= size:
                        hit[at - short : at] = True
                        found |= items
                s = self._near_short[link[s]]


def passes(benchmark: DataFrame, window: int = WINDOW, most: int = PASS_WORDS) -> Iterator[Automaton]:
    """Automata of benchmark's item_id, text, one after the other, each of at most about most words.

    Items with a null or wordless text have no window. Rows that share an item_id are one item. The rows come to the driver one
    by one. A longer item goes into several automata in parts that share window - 1 words, so that no window is lost.
    """
    shared.columns_of(benchmark, ["item_id", "text"])
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    held, size, any_ = [], 0, False
    for r in rows.toLocalIterator():
        words = words_of(r.text)
        for at in range(0, max(1, len(words) - window + 1), most):
            part = words[at : at + most + window - 1]
            if held and size + len(part) > most + window:
                yield Automaton(held, window)
                held, size, any_ = [], 0, True
            if part:
                held.append((r.item_id, part))
                size += len(part)
    if held or not any_:
        yield Automaton(held, window)


def _spans(hit: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of hit words."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


_FOUND = "digest string, spans array<struct<a: int, b: int>>, items array<string>"


def _found(texts: DataFrame, benchmark: DataFrame, window: int, most: int) -> DataFrame:
    """digest (SHA-256 of the text), spans (stretches of hit words), items of each text of texts (digest, text) that has any; a scan of texts for each automaton."""
    spark, out = texts.sparkSession, []
    kinds = [pa.string(), pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])), pa.list_(pa.string())]
    for machine in passes(benchmark, window, most):
        held = spark.sparkContext.broadcast(machine)

        def scan(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for digest, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    words = words_of(text)
                    hit = np.zeros(len(words), bool)
                    items = held.value.match(words, hit)
                    if items:
                        rows.append((digest, [{"a": a, "b": b} for a, b in _spans(hit)], sorted(x or "" for x in items)))
                columns = list(zip(*rows, strict=True)) if rows else [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["digest", "spans", "items"])

        out.append(shared.saved(spark, texts.mapInArrow(scan, _FOUND), "found"))
        held.unpersist()
    met = out[0]
    for more in out[1:]:
        met = met.unionByName(more)
    # a text's own stretches and items, once for each automaton
    return met.dropDuplicates(["digest", "spans", "items"]).groupBy("digest").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))


def _scanned(docs: DataFrame, at: int, benchmark: DataFrame, window: int, most: int, schema: str | StructType, finish) -> DataFrame:
    """finish(batch, texts' (words, hit, items)) of the batches of docs, whose column number at is the text.

    A benchmark of one automaton is matched where the batch is; with more, what they found in a text is joined to it by digest.
    """
    spark = docs.sparkSession
    shared.prepare(spark)
    machines = passes(benchmark, window, most)
    first, more = next(machines), next(machines, None)
    if more is None:
        held = spark.sparkContext.broadcast(first)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield finish(batch, [_hits(held.value, t) for t in batch.column(at).to_pylist()])

        return docs.mapInArrow(scan, schema)
    machines.close()
    names = docs.columns
    row = docs.select(shared.packed(docs, names).alias("row"), F.sha2(F.col(names[at]).cast("string").cast("binary"), 256).alias("digest"))
    known = _found(row.select("digest", F.col("row").getField(shared.slot(at)).cast("string").alias("text")).where("text is not null"), benchmark, window, most)
    met = row.join(shared.saved(spark, known, "known"), "digest", "left").select(*shared.unpacked(names), "spans", "items")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = []
            for text, spans, items in zip(*(batch.column(k).to_pylist() for k in (at, len(names), len(names) + 1)), strict=True):
                words = words_of(text)
                hit = np.zeros(len(words), bool)
                for x in spans or []:
                    hit[x["a"] : x["b"]] = True
                hits.append((words, hit, set(items or [])))
            yield finish(pa.RecordBatch.from_arrays(batch.columns[: len(names)], names=names), hits)

    return met.mapInArrow(merge, schema)


def _hits(machine: Automaton, text: str | None) -> tuple[list[bytes], np.ndarray, set]:
    words = words_of(text)
    hit = np.zeros(len(words), bool)
    return words, hit, {x or "" for x in machine.match(words, hit)}


def report(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, pass_words: int = PASS_WORDS) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    n_items counts the items with a window in the text; items_sha256 is the digest of their ids, sorted as strings and
    joined by commas (of nothing where there are none; a null item_id counts as an empty string). Null and empty texts
    have no words. Other columns are not read, whatever their names; repeated rows each get a row; an empty table gives an
    empty table and an empty benchmark hits nothing. Time grows with a text's words, repeated ones included.
    """
    shared.columns_of(docs, ["doc_id", "text"])
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def finish(batch: pa.RecordBatch, hits: list) -> pa.RecordBatch:
        out = []
        for words, hit, found in hits:
            names = sorted(found)
            out.append((len(words), int(hit.sum()), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(names)))
        n_words, n_hit, n_items, digest, contaminated = zip(*out, strict=True) if out else ([],) * 5
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(digest, pa.string()), pa.array(contaminated, pa.bool_())], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return _scanned(rows, 1, benchmark, window, pass_words, "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean", finish)


def cut_spans(text: str, words: list[bytes], hit: np.ndarray, coverage: float = COVERAGE) -> str | None:
    """The text without its hit spans, each from its first word to its last; None where more than coverage of the words are hit."""
    if not hit.any():
        return text
    if hit.sum() > coverage * len(words):
        return None
    raw = text.encode("utf-8", "surrogatepass")
    kept, at, last = [], 0, 0
    for k, m in enumerate(_WORDS.finditer(raw.lower())):
        if hit[k]:
            if not k or not hit[k - 1]:
                kept.append(raw[at : m.start()])
            last = m.end()
        elif k and hit[k - 1]:
            at = last
    kept.append(raw[last if hit[-1] else at :])
    return b"".join(kept).decode("utf-8", "surrogatepass")


def remove_contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, coverage: float = COVERAGE, pass_words: int = PASS_WORDS) -> DataFrame:
    """docs with every hit span cut out of text (n_chars, where there, follows), without documents of which more than coverage of the words are hit.

    A document without a hit is kept as it is, null and empty texts included. All columns stay, whatever their names. Repeated
    rows are cut alike and all stay. An empty table gives an empty table; an empty benchmark cuts nothing.
    """
    shared.columns_of(docs, ["text"])
    plain, at = shared.plain_names(docs), docs.columns.index("text")
    count = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def finish(batch: pa.RecordBatch, hits: list) -> pa.RecordBatch:
        texts = batch.column(at).to_pylist()
        made = [None if t is None else cut_spans(t, words, hit, coverage) for t, (words, hit, _) in zip(texts, hits, strict=True)]
        keep = pa.array([t is None or m is not None for t, m in zip(texts, made, strict=True)], pa.bool_())
        columns = list(batch.columns)
        columns[at] = pa.array(made, columns[at].type)
        if count is not None:
            old = columns[count].to_pylist()
            columns[count] = pa.array([o if m == t else len(m) if m is not None else None for o, t, m in zip(old, texts, made, strict=True)], columns[count].type)
        return pa.RecordBatch.from_arrays(columns, names=batch.schema.names).filter(keep)

    return _scanned(plain, at, benchmark, window, pass_words, plain.schema, finish).toDF(*docs.columns)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """report() of all documents against the whole benchmark."""
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: The same by a join on the windows themselves, for small tables.
OP4_SQL = r"""
WITH dw AS (
  SELECT doc_id, row_number() OVER () AS rid,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
bw AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, k, array_to_string(w[s : s + k - 1], ' ') AS g
  FROM (SELECT item_id, w, least(len(w), 10) AS k, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS s FROM bw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM win),
dg AS (
  SELECT rid, k, s, array_to_string(w[s : s + k - 1], ' ') AS g
  FROM (SELECT rid, w, k, unnest(generate_series(1, len(w) - k + 1)) AS s FROM dw CROSS JOIN sizes WHERE len(w) >= k)),
m AS (SELECT rid, k, s, item_id FROM dg JOIN win USING (k, g)),
h AS (
  SELECT rid, count(DISTINCT p) AS n_hit
  FROM (SELECT rid, unnest(generate_series(s, s + k - 1)) AS p FROM (SELECT DISTINCT rid, k, s FROM m)) GROUP BY rid),
i AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT rid, item_id FROM m) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) > 0 AS contaminated
FROM dw LEFT JOIN h USING (rid) LEFT JOIN i USING (rid)
"""
