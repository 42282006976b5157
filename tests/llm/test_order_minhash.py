"""Order MinHash against a plain version, and the rows against brute force."""

import hashlib
import random

import numpy as np
import pytest

from weftline.llm import order_minhash as om


def slow(text):
    """Pairs of smallest numbered k-mers by plain loops over the same hashes."""
    h = om.kmers(text).tolist()
    if not h:
        return [0] * om.FUNCTIONS
    seen, numbered = {}, []
    for x in h:
        k = seen[x] = seen.get(x, -1) + 1
        numbered.append(x if not k else int(om._mix(np.array([x], np.uint64) + np.uint64(k) * np.uint64(0xD1B54A32D192ED03))[0]))
    out = []
    for f in om._FACTORS.tolist():
        ranked = sorted(range(len(h)), key=lambda i: (numbered[i] * f & om._MASK, i))
        a, b = sorted((ranked * 2)[:2] if len(h) == 1 else ranked[:2])
        one = om._mix(np.array([h[a] + f & om._MASK], np.uint64)) ^ np.uint64(h[b])
        out.append(int(om._mix(one)[0]) >> 32 | 1)
    return out


def test_kmers_depend_on_their_own_letters():
    x, y = om.kmers("abcdefghijklmnopqrstuvwxyz" * 2), om.kmers("xxx" + "defghijklmnopq" + "yyy")
    assert len(x) == 52 - om.K + 1
    assert x[0] == x[26] and x[3] == y[3] and x[5] == y[5] and x[2] != y[2]
    assert len(om.kmers("")) == 0 and len(om.kmers("abc")) == 1
    assert om.kmers("abc")[0] != om.kmers("abd")[0]


@pytest.mark.parametrize("seed", range(12))
def test_signature_equals_the_plain_one(seed, monkeypatch):
    r = random.Random(seed)
    monkeypatch.setattr(om, "_BLOCK", r.choice([1, 5, 64, 1 << 14]))
    text = "".join(r.choice("ab ") for _ in range(r.choice([0, 1, 5, 12, 13, 80, 400])))
    assert om.signature(text).tolist() == slow(text)


def test_likeness_follows_edits_and_order():
    r = random.Random(2)
    words = [f"{r.randrange(10**6)}" for _ in range(400)]
    text = " ".join(words)
    near = " ".join(words[:200] + ["changed"] + words[201:])
    swapped = " ".join(words[200:] + words[:200])
    other = " ".join(f"{r.randrange(10**6)}" for _ in range(400))
    f = om.signature(text)
    assert om.likeness(f, om.signature(near)) > 0.75
    assert om.likeness(f, om.signature(near)) > om.likeness(f, om.signature(swapped)) > om.likeness(f, om.signature(other))
    assert om.likeness(f, om.signature(other)) == 0


def test_rows(spark):
    r = random.Random(8)
    texts = [None, "", "a", "same text over here", "same text over here", *["".join(r.choice("abcdé😀 ") for _ in range(r.randint(0, 90))) for _ in range(60)]]
    ids = [5, 6, None, 7, 7, *r.sample(range(100, 1000), 60)]
    docs = spark.createDataFrame([(i, t, 0) for i, t in zip(ids, texts, strict=True)], "doc_id bigint, text string, bucket int").repartition(5)
    got = om.fingerprints(docs).collect()
    rows = sorted(((i is not None, i or 0, (t or "").encode(), t or "") for i, t in zip(ids, texts, strict=True)), reverse=True)
    want = []
    for k, (known, i, _, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][3]
        n = len(t)
        edited = t[: n - n // 2] + after[: n // 2]
        f, e, a = (om.signature(x) for x in (t, edited, after))
        want.append((i if known else None, n, hashlib.sha256(edited.encode()).hexdigest(), om.as_text(f), om.as_text(e), om.likeness(f, e), om.likeness(f, a)))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    one = om.fingerprints(docs.where("doc_id = 6")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert om.fingerprints(docs.limit(0)).count() == 0
