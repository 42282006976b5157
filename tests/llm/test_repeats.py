"""Repeated byte strings against a dictionary of all windows."""

import hashlib
import random
from collections import Counter

import pytest

from weftline.llm import repeats


def slow(rows):
    raws = [(t or "").encode() for _, t in rows]
    seen = Counter(r[p : p + 200] for r in raws for p in range(len(r) - 199))
    out = []
    for (d, _), r in zip(rows, raws, strict=True):
        gone = bytearray(len(r))
        for p in range(len(r) - 199):
            if seen[r[p : p + 200]] > 1:
                gone[p : p + 200] = b"\1" * 200
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        spans = sum(g and (not k or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((d, len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def made(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeéü") for _ in range(r.randint(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(n) for n in (20, 33, 36, 40, 45, 80, 300)] + ["x" * 230, "ab" * 110, "é" * 100]
    rows = []
    for d in range(60):
        parts = []
        for _ in range(r.randint(0, 5)):
            p = r.choice(passages)
            if r.random() < 0.3:
                k = r.randrange(len(p))
                p = p[:k] + r.choice(["", "Z", "QQ"]) + p[k + 1 :]
            parts += [prose(r.randint(0, 30)), p]
        rows.append((d, "".join(parts)))
    rows += [(90, None), (91, ""), (92, "k" * 199), (93, "k" * 200), (94, "m" * 201), (95, "n" * 1000), (None, rows[3][1]), rows[4], rows[4], (7, rows[5][1])]
    return rows


@pytest.mark.parametrize(("seed", "crowd", "buffer"), [(1, 20_000, 1 << 20), (2, 1, 1 << 20), (3, 20_000, 700), (4, 3, 2000)])
def test_equals_all_windows(spark, monkeypatch, seed, crowd, buffer):
    monkeypatch.setattr(repeats, "CROWD", crowd)
    monkeypatch.setattr(repeats, "BUFFER", buffer)
    rows = made(seed)
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id bigint, text string, gram int, places string").repartition(3)
    assert sorted(map(tuple, repeats.report(docs).collect()), key=str) == slow(rows)


def test_empty_table_and_kept_bytes(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert repeats.report(docs).count() == 0
    rows = made(6)[:30]
    kept = {r.doc_id: hashlib.sha256(bytes(r.kept)).hexdigest() for r in repeats.kept_bytes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert kept == {x[0]: x[4] for x in slow(rows)}
