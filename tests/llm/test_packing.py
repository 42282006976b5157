"""Packing against exhaustive search on small instances, and the rows against the tokenizers library."""

import random
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest
from tokenizers import Tokenizer

from weftline.llm import packing
from weftline.llm.pieces import tokenizer_path


def optimum(items, capacity):
    items = tuple(sorted(items, reverse=True))

    @lru_cache(None)
    def least(rest, rooms):
        if not rest:
            return len(rooms)
        best = least(rest[1:], tuple(sorted([*rooms, capacity - rest[0]])))
        for k in range(len(rooms)):
            if rooms[k] >= rest[0] and (not k or rooms[k] != rooms[k - 1]):
                best = min(best, least(rest[1:], tuple(sorted([*rooms[:k], rooms[k] - rest[0], *rooms[k + 1 :]]))))
        return best

    return least(items, ())


def count(items, capacity):
    out = np.zeros(capacity + 1, np.int64)
    for i in items:
        out[i] += 1
    return out


@pytest.mark.parametrize("seed", range(60))
def test_reduction_keeps_the_optimum_and_nothing_is_lost(seed):
    r = random.Random(seed)
    capacity = r.choice([10, 13, 20])
    items = [r.randint(1, capacity) for _ in range(r.randint(1, 9))]
    counts = count(items, capacity)
    fixed, left = packing.reduce_instance(counts, capacity)
    used = Counter()
    for p, n in fixed + packing.best_fit_decreasing(left, capacity):
        assert sum(p) <= capacity
        for x in p:
            used[x] += n
    assert used == Counter(items)
    rest = [x for x in range(len(left)) for _ in range(left[x])]
    assert sum(n for _, n in fixed) + (optimum(rest, capacity) if rest else 0) == optimum(items, capacity)


def test_best_fit_decreasing_equals_the_plain_one():
    r = random.Random(3)
    for _ in range(40):
        items = sorted((r.randint(1, 50) for _ in range(300)), reverse=True)
        rooms = []
        for x in items:
            fits = [q for q in rooms if q >= x]
            if fits:
                rooms.remove(min(fits))
                rooms.append(min(fits) - x)
            else:
                rooms.append(50 - x)
        made = packing.best_fit_decreasing(count(items, 50), 50)
        assert sum(n for _, n in made) == len(rooms)
        assert sorted(50 - sum(p) for p, n in made for _ in range(n)) == sorted(rooms)


def test_rows(spark):
    r = random.Random(9)
    texts = [None, "", *[" ".join(r.choice(["Alpha", "beta", "gammas", "x"]) for _ in range(r.choice([1, 5, 40, 64, 130]))) for _ in range(120)]]
    ids = [None, 7, 7, *range(20, 20 + len(texts) - 3)]
    docs = spark.createDataFrame(list(zip(ids, texts, ["f"] * len(ids), strict=True)), "doc_id bigint, text string, file string").repartition(3)
    rows = packing.pack(docs, capacity=64).collect()
    t = Tokenizer.from_file(tokenizer_path(packing.TOKENIZER))
    want = []
    for i, x in zip(ids, texts, strict=True):
        e = [*t.encode(x or "", add_special_tokens=False).ids, 0]
        want += [(i, k, s, len(e[s : s + 64]), zlib.crc32(np.array(e[s : s + 64], "<u4").tobytes())) for k, s in enumerate(range(0, len(e), 64))]
    assert sorted(([(q.doc_id, q.piece, q.start, q.length, q.ids_crc32) for q in rows]), key=str) == sorted(want, key=str)
    by = defaultdict(list)
    for q in rows:
        by[q.sequence_id].append((q.offset, q.length))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 64
    assert len(by) <= -(-sum(q.length for q in rows) // 64) + 2
    assert packing.pack(docs.limit(0), capacity=64).count() == 0
