"""Toxicity by a support vector machine with a gap-weighted subsequence kernel and Nystroem landmarks.

A text is seen as sentences, and these as units: words (lower case, look-alike digits turned to letters, other signs
dropped, runs of single letters put together), long ones cut into overlapping windows. The kernel of two units counts
their common subsequences, each weighted down by the stretch that it spans, so letters put into an insult cost little;
that of two sentences sums over their units and is scaled by their number. Landmarks are units that stand in many toxic
texts and few clean ones, and the clean units most like them.

The machine is trained on sentences of labelled texts. A toxic text need not be toxic in every sentence, so each gives
the sentence that the machine of the round before holds worst, clean texts their worst and one by hash. A text's score is
a logistic curve, fitted to labelled texts, of its two worst words and sentences and of its number of words.

A machine on kernel values to landmarks is linear in the subsequences themselves. So each word gets its exact value from
a table of a weight for each triple of letters, however unlike all landmarks it is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

#: Length of subsequences, decay for each letter that they span, letters in a unit and step of windows.
ORDER, DECAY, UNIT, STEP = 3, 0.6, 10, 3
#: Labelled rows that the model is fitted on, at most: a documented bound, chosen by hash. All rows are scored.
TRAIN_ROWS = 20_000
#: Clean landmarks (of insults there are as many as are unlike each other), and words of either kind that the machine is trained on.
LANDMARKS, WORDS = 32, 1500
#: Rounds of choosing sentences and training on them, and sentences of either kind that the machine is trained on, at most, chosen by hash.
ROUNDS, SENTENCES = 3, 4000
#: predicted is 1 from this score on.
THRESHOLD = 0.3
#: Rows with this remainder are held out.
HELD_OUT, FOLDS = 2, 4

_LOOK = dict(zip("013457@$", "oieastas", strict=True))
_BLANK = b" \t\r\x0b\x0c"
_SINGLE = re.compile(rb"(?<![^ \n])(?:[a-z] ){2,}[a-z](?![^ \n])")
_END = re.compile(rb"[.!?]+(?=[ \t\n\r])|\n")
_SEEN = 400_000


def _tables() -> tuple[bytes, bytes]:
    """Translation of bytes and bytes to drop: letters stay, blanks become one kind, bytes beyond ASCII stay, signs go."""
    table, drop = bytearray(range(256)), bytearray()
    for b in range(128):
        c = chr(b)
        if c in _LOOK:
            table[b] = ord(_LOOK[c])
        elif b in _BLANK:
            table[b] = 32
        elif not c.isalpha() and c != "\n":
            drop.append(b)
    return bytes(table), bytes(drop)


_TABLE, _DROP = _tables()
#: Letters by code: 0 between words, 1-26 for a-z, 27-30 for bytes beyond ASCII, 31 for the start of a word.
_START, _STEM = b"^", b"*"
_CODE = np.array([31 if b == _START[0] else 0 if b < 97 else b - 96 if b <= 122 else 27 + (b & 3) if b >= 128 else 0 for b in range(256)], np.uint8)


def plain(text: str | None) -> bytes:
    """The letters of a text, words parted by blanks and sentences by line ends."""
    raw = _END.sub(b"\n", (text or "").lower().encode("utf-8", "surrogatepass")).translate(_TABLE, _DROP)
    return _SINGLE.sub(lambda m: m[0].replace(b" ", b""), raw)


def units(word: bytes) -> list[bytes]:
    """A word (or stem) with a mark at its start, or its windows where it is long."""
    word = _START + word.removesuffix(_STEM)
    if len(word) <= UNIT:
        return [word]
    return [word[k : k + UNIT] for k in range(0, len(word) - UNIT + STEP, STEP)]


def _codes(words: list[bytes]) -> np.ndarray:
    """Rows of letter codes, filled up with 0."""
    width = max(map(len, words), default=1) or 1
    return _CODE[np.frombuffer(b"".join([w.ljust(width, b"\0") for w in words]), np.uint8)].reshape(len(words), width)


def kernel(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Subsequence kernel of code rows that are matched by broadcasting: s is (a, 1, p) or (a, p), t (1, b, q) or (a, q)."""
    lam = DECAY
    shape = np.broadcast_shapes(s.shape[:-1], t.shape[:-1])
    p, q = s.shape[-1], t.shape[-1]
    same = [[(s[..., i] == t[..., j]) & (s[..., i] > 0) for j in range(q)] for i in range(p)]
    # below[j]: weight of common subsequences of the prefixes, carried to their ends
    before = [[np.ones(shape) for _ in range(q + 1)] for _ in range(p + 1)]
    for _ in range(ORDER - 1):
        now = [[np.zeros(shape) for _ in range(q + 1)]]
        for i in range(p):
            row, run = [np.zeros(shape)], np.zeros(shape)
            for j in range(q):
                run = lam * run + np.where(same[i][j], lam * lam * before[i][j], 0)
                row.append(lam * now[i][j + 1] + run)
            now.append(row)
        before = now
    total = np.zeros(shape)
    for i in range(p):
        for j in range(q):
            total += np.where(same[i][j], lam * lam * before[i][j], 0)
    return total


def similarities(words: list[bytes], marks: list[bytes]) -> np.ndarray:
    """Kernel of words and marks, each word scaled to length one; a word too short for any subsequence has zeros."""
    out = np.zeros((len(words), len(marks)))
    t = _codes(marks)
    own_t = np.sqrt(kernel(t, t))
    for at in range(0, len(words), 500):
        s = _codes(words[at : at + 500])
        own = np.sqrt(kernel(s, s))[:, None] * own_t[None, :]
        out[at : at + 500] = np.divide(kernel(s[:, None, :], t[None, :, :]), own, out=np.zeros(own.shape), where=own > 0)
    return out


#: Weight of a triple of letters at places i < j < k of a unit.
_PLACES = [(i, j, k, DECAY ** (k - i + 1)) for i in range(UNIT) for j in range(i + 1, UNIT) for k in range(j + 1, UNIT)]


def _triples(codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(rows that have it, its number, weight) of the letters at each three places of rows of codes."""
    c, lengths = codes.astype(np.int64), (codes > 0).sum(axis=1)
    rows = {k: np.flatnonzero(lengths > k) for k in range(c.shape[1])}
    for i, j, k, weight in _PLACES:
        if k < c.shape[1] and len(rows[k]):
            some = rows[k]
            yield some, c[some, i] << 10 | c[some, j] << 5 | c[some, k], weight


def triple_table(marks: list[bytes]) -> np.ndarray:
    """A row for each triple of letter codes: its weighted counts in each landmark, scaled to length one."""
    out = np.zeros((1 << 15, len(marks)))
    if marks:
        codes = _codes(marks)
        for some, number, weight in _triples(codes):
            np.add.at(out, (number, some), weight)
        out /= np.sqrt(np.maximum(kernel(codes, codes), 1e-300))
    return out


def triple_sums(words: list[bytes], table: np.ndarray) -> np.ndarray:
    """A row for each unit: the table's rows of its triples, weighted, over its own length. With triple_table the kernel to each landmark."""
    out = np.zeros((len(words), table.shape[1]))
    for at in range(0, len(words), 4000):
        codes = _codes(words[at : at + 4000])
        own = np.sqrt(kernel(codes, codes))[:, None]
        some_out = np.zeros((len(codes), table.shape[1]))
        for some, number, weight in _triples(codes):
            some_out[some] += weight * table[number]
        out[at : at + 4000] = np.divide(some_out, own, out=np.zeros_like(some_out), where=own > 0)
    return out


@dataclass(frozen=True)
class Model:
    """Landmarks, weights of the kernel values, and the curve of the score: weights of a text's features, then the offset."""

    marks: list[bytes]
    weights: np.ndarray
    curve: np.ndarray

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.curve[:-1] + self.curve[-1], -30, 30)))


#: Features of a text: two worst words, two worst sentences, logarithm of one more than the number of words.
FEATURES = 5


class Reader:
    """Values of words by a model, remembered for as many words as _SEEN, and what follows from them for whole texts."""

    def __init__(self, model: Model):
        self._table = (triple_table(model.marks) @ model.weights)[:, None]
        self._seen: dict[bytes, int] = {}
        self._known = np.zeros((3, 1024))

    def values(self, words: list[bytes]) -> np.ndarray:
        """Rows for each word: sum over its units, worst unit, number of units."""
        parts = [units(w) for w in words]
        flat = [u for p in parts for u in p]
        total = triple_sums(flat, self._table)[:, 0]
        starts = np.cumsum([0, *[len(p) for p in parts]])[:-1]
        return np.stack([np.add.reduceat(total, starts), np.maximum.reduceat(total, starts), np.array([len(p) for p in parts], float)]) if flat else np.zeros((3, 0))

    def _places(self, words: list[bytes]) -> np.ndarray:
        """Where the values of the words stand in _known."""
        fresh = [w for w in dict.fromkeys(words) if w not in self._seen]
        if len(self._seen) + len(fresh) > _SEEN:
            self._seen.clear()
            fresh = list(dict.fromkeys(words))
        if fresh:
            first, stop = len(self._seen), len(self._seen) + len(fresh)
            if stop > self._known.shape[1]:
                self._known = np.concatenate([self._known[:, :first], np.zeros((3, 2 * stop - first))], axis=1)
            self._known[:, first:stop] = self.values(fresh)
            self._seen.update(zip(fresh, range(first, stop), strict=True))
        return np.fromiter(map(self._seen.__getitem__, words), np.int64, len(words))

    def _block(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        """(values of the words, sentence of each word, text of each sentence, sentences) of some texts."""
        sentences = [r.split(b"\n") for r in raws]
        words = [[x.split() for x in own] for own in sentences]
        flat = [w for own in words for x in own for w in x]
        places = self._places(flat)  # which may make _known anew
        value = self._known[:, places]
        sizes = np.array([len(x) for own in words for x in own], np.int64)
        return value, np.repeat(np.arange(len(sizes)), sizes), np.repeat(np.arange(len(raws)), [len(x) for x in sentences]), [x for own in sentences for x in own]

    @staticmethod
    def _worst(value: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """For each of n groups the places of the largest and the second value, -1 where there is none."""
        order = np.lexsort((-value, of))
        group = of[order]
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(order) else order
        out = np.full((2, n), -1)
        out[0, group[first]] = order[first]
        more = first[np.append(first[1:], len(order)) - first > 1] + 1
        out[1, group[more]] = order[more]
        return out[0], out[1]

    def features(self, texts: list[str | None]) -> np.ndarray:
        """A row for each text; where there is no word or sentence a feature is 0, the value of a unit that is like no other."""
        return self._all(texts)[0]

    def sentences(self, texts: list[str | None]) -> list[list[bytes]]:
        """For each text its two worst sentences, without those that have no word."""
        return self._all(texts)[1]

    def _all(self, texts: list[str | None]) -> tuple[np.ndarray, list[list[bytes]]]:
        out, chosen, at = np.zeros((len(texts), FEATURES)), [], 0
        raws = [plain(t) for t in texts]
        while at < len(raws):
            stop, size = at, 0
            while stop < len(raws) and (stop == at or size + len(raws[stop]) <= 1 << 20):
                size += len(raws[stop])
                stop += 1
            value, of, text, sentences = self._block(raws[at:stop])
            n = stop - at
            count = np.bincount(of, value[2], len(sentences))
            sums = np.bincount(of, value[0], len(sentences)) / np.sqrt(np.maximum(count, 1))
            some = np.flatnonzero(count > 0)
            for k, (worst, x) in enumerate(((self._worst(value[1], text[of], n), value[1]), (self._worst(sums[some], text[some], n), sums[some]))):
                for m in (0, 1):
                    has = worst[m] >= 0
                    out[at:stop][has, 2 * k + m] = x[worst[m][has]]
            pair = np.stack(worst, axis=1)
            chosen += [[sentences[some[p]] for p in row if p >= 0] for row in pair.tolist()]
            out[at:stop, 4] = np.log1p(np.bincount(text[of], minlength=n))
            at = stop
        return out, chosen


def fold(doc_id) -> F.Column:
    """crc32 of doc_id as text, modulo FOLDS."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def _document_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, toxic, clean of each word of each text and of the stems of its words, once a text."""
    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = {w for w in plain(text).split() if 3 <= len(w) <= 40}
            words = [*found, *{w[:k] + _STEM for w in found for k in (4, 5, 6) if len(w) > k}]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([int(toxic)] * len(words), pa.int64()), pa.array([1 - int(toxic)] * len(words), pa.int64())], names=["word", "toxic", "clean"])


def _copy_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text, toxic and three keys: near copies share most of them, other texts none."""
    for batch in batches:
        keys = []
        for text in batch.column(0).to_pylist():
            words = text.lower().encode("utf-8", "surrogatepass").split()
            triples = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
            keys.append([min(xxhash.xxh64_intdigest(t, seed) for t in triples) >> 1 for seed in (1, 2, 3)])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array([k[n] for k in keys], pa.int64()) for n in range(3)]], names=["text", "toxic", "k1", "k2", "k3"])


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text, toxic of at most TRAIN_ROWS labelled rows that are not held out, near copies taken once.

    The rows are chosen by a hash, so the table of labels that is broadcast has at most TRAIN_ROWS rows. Null labels are ignored.
    """
    spark = docs.sparkSession
    shared.prepare(spark)
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1) and doc_id is not null")
    known = known.where(fold(F.col("doc_id")) != HELD_OUT).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = known.orderBy(F.xxhash64("doc_id", F.lit(17))).limit(TRAIN_ROWS)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    met = texts.join(F.broadcast(some), "doc_id").select("text", "toxic")
    # near copies mostly share the least hashes of their word triples: of texts that share two of three one is taken, by a total order
    met = met.mapInArrow(_copy_keys, "text string, toxic int, k1 bigint, k2 bigint, k3 bigint")
    for a, b in (("k1", "k2"), ("k1", "k3"), ("k2", "k3")):
        met = met.groupBy(a, b).agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "toxic", "k1", "k2", "k3")).alias("one")).select("one.*").drop("h")
    met = met.select("text", "toxic")
    return shared.saved(spark, met, "labelled")


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Linear machine with hinge loss by dual coordinate descent; cost bounds each word's multiplier."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w, alpha, square = np.zeros(x.shape[1]), np.zeros(len(x)), (x * x).sum(axis=1)
    order = np.random.default_rng(0)
    for _ in range(rounds):
        moved = 0.0
        for k in order.permutation(len(x)).tolist():
            gradient = y[k] * (x[k] @ w) - 1
            new = min(max(alpha[k] - gradient / square[k], 0.0), cost[k])
            if new != alpha[k]:
                w += (new - alpha[k]) * y[k] * x[k]
                moved = max(moved, abs(new - alpha[k]))
                alpha[k] = new
        if moved < 1e-4:
            break
    return w[:-1], float(w[-1])


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and offset by Newton steps, with a little shrinkage of the weights."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    shrink = np.diag([0.1] * (x.shape[1] - 1) + [1e-6])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + shrink, x.T @ (p - y) + shrink @ w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def landmarks(bad: list[tuple[bytes, int, int]], good: list[tuple[bytes, int]], rate: float, tried: int) -> tuple[list[bytes], list[bytes]]:
    """(insults, clean units): landmarks from words with their numbers of toxic and clean texts, and from clean words.

    rate is the share of toxic texts and tried the number of words that were looked at: a word is taken for an insult when
    not even one of so many would be in as many toxic texts by chance. The clean ones are those most like insults. Both are
    empty where there is no such word.
    """
    least = 3
    while tried * rate**least > 0.5 and least < 1000:
        least += 1
    strong = sorted(((t - 4 * c, w, t) for w, t, c in bad if t >= least and t > 4 * c), reverse=True)
    if not strong:
        return [], []
    heads = list(dict.fromkeys(u for _, w, _ in strong for u in units(w)[:1]))
    near = similarities(heads, heads)
    # the strongest first; a word much like one that is there already adds nothing
    chosen: list[int] = []
    for k in range(len(heads)):
        if not chosen or near[k, chosen].max() < 0.6:
            chosen.append(k)
    insults = [heads[k] for k in chosen]
    known = set(heads)
    clean = dict.fromkeys(u for w, _ in good for u in units(w) if u not in known)
    rows = list(clean)
    close = similarities(rows, insults).max(axis=1) if rows else np.empty(0)
    return insults, [rows[k] for k in np.argsort(-close, kind="stable")[:LANDMARKS]]


def sentence_rows(sentences: list[bytes], marks: list[bytes]) -> np.ndarray:
    """Kernel of sentences and landmarks: summed over a sentence's units, over the root of their number."""
    out, table = np.zeros((len(sentences), len(marks))), triple_table(marks)
    for first in range(0, len(sentences), 500):
        parts = [[u for w in s.split() for u in units(w)] for s in sentences[first : first + 500]]
        at = {u: k for k, u in enumerate(dict.fromkeys(u for p in parts for u in p))}
        values = triple_sums(list(at), table)
        for k, p in enumerate(parts, first):
            out[k] = values[[at[u] for u in p]].sum(axis=0) / np.sqrt(max(1, len(p)))
    return out


def fit_sentences(bad: np.ndarray, good: np.ndarray, marks: list[bytes]) -> np.ndarray:
    """Weights of the landmarks by a machine on the kernel rows of toxic and of clean sentences; the landmarks' own kernel whitens them."""
    gram = similarities(marks, marks)
    value, vector = np.linalg.eigh((gram + gram.T) / 2)
    whiten = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-2))) @ vector.T
    y = np.concatenate([np.ones(len(bad)), -np.ones(len(good))])
    cost = np.concatenate([np.full(len(bad), 500 / max(1, len(bad))), np.full(len(good), 500 / max(1, len(good)))])
    w, _ = _svm(np.concatenate([bad, good]) @ whiten, y, cost)
    return whiten @ w


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from labels.toxic of rows that are not held out. What reaches the driver is bounded: counts of WORDS words and SENTENCES sentences of either kind, and the features of TRAIN_ROWS texts."""
    shared.columns_of(labels, ["doc_id", "toxic"])
    rows = training_rows(docs, labels)
    spark = rows.sparkSession
    n = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n_toxic, n_clean = n.get(1, 0), n.get(0, 0)
    base = np.log((n_toxic + 0.01) / (n_clean + 1))
    counts = rows.mapInArrow(_document_words, "word binary, toxic bigint, clean bigint").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counts = shared.saved(spark, counts, "words")
    tried = counts.where("toxic + clean >= 3").count()
    bad = counts.where("toxic >= 3 and toxic > 4 * clean").orderBy(F.desc(F.col("toxic") - 4 * F.col("clean")), "word").limit(WORDS).collect()
    harmless = counts.where("clean >= 1 and toxic <= clean").select("word", "clean")
    good = harmless.orderBy(F.desc("clean"), "word").limit(WORDS).union(harmless.orderBy(F.xxhash64("word")).limit(WORDS)).distinct().collect()
    rate = n_toxic / max(1, n_toxic + n_clean)
    insults, clean = landmarks([(bytes(r.word), r.toxic, r.clean) for r in bad], [(bytes(r.word), r.clean) for r in sorted(good)], rate, tried)
    marks = insults + clean
    if not marks:
        return Model([], np.empty(0), np.array([0.0] * FEATURES + [base]))
    # at first a sentence is as toxic as it is like insults
    model = Model(marks, np.array([1.0] * len(insults) + [0.0] * len(clean)), np.zeros(FEATURES + 1))
    for _ in range(ROUNDS):
        sides = []
        picked = rows.mapInArrow(_sentences(model), "toxic int, sentence binary").withColumn("h", F.xxhash64("sentence"))
        for toxic in (1, 0):
            found = picked.where(F.col("toxic") == toxic).orderBy("h", "sentence").limit(SENTENCES).collect()
            sides.append(sentence_rows([bytes(r.sentence) for r in found], marks))
        model = replace(model, weights=fit_sentences(*sides, marks))
    names = [f"f{k}" for k in range(FEATURES)]
    found = rows.mapInArrow(_features(model), ", ".join(f"{c} double" for c in names) + ", toxic int").collect()  # TRAIN_ROWS at most
    known = np.array(sorted(tuple(r) for r in found), float)
    return replace(model, curve=_logistic(known[:, :FEATURES], known[:, FEATURES]))


def _sentences(model: Model):
    """toxic, sentence: of a toxic text the worst sentence, of a clean one the worst and one by hash."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        for batch in batches:
            out = []
            texts, labels = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for text, toxic, worst in zip(texts, labels, reader.sentences(texts), strict=True):
                some = worst[:1]
                if not toxic:
                    own = [x for x in plain(text).split(b"\n") if x.split()]
                    some = some + [min(own, key=xxhash.xxh64_intdigest)] if own else some
                out += [(toxic, x) for x in some]
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], names=["toxic", "sentence"])

    return work


def _features(model: Model):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        for batch in batches:
            made = reader.features(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*[pa.array(made[:, k]) for k in range(FEATURES)], batch.column(1)], names=[*[f"f{k}" for k in range(FEATURES)], "toxic"])

    return work


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs; a null text is scored as an empty one. Other columns are not read."""
    shared.columns_of(docs, ["doc_id", "text"])
    shared.prepare(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(reader.features(batch.column(1).to_pylist())), pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = rows.mapInArrow(work, "doc_id bigint, score double")
    return made.select("doc_id", F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """docs without the rows whose text scores THRESHOLD or more; all columns stay, whatever their names.

    Null texts are scored as empty ones; whole texts are read, however long; repeated rows are scored alike and stay or go
    together. An empty table gives an empty table.
    """
    shared.columns_of(docs, ["text"])
    shared.prepare(docs.sparkSession)
    plain, at = shared.plain_names(docs), docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        for batch in batches:
            yield batch.filter(pa.array(model.score(reader.features(batch.column(at).to_pylist())) < THRESHOLD))

    return plain.mapInArrow(work, plain.schema).toDF(*docs.columns)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score() of all documents by a model fitted to the rows that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
