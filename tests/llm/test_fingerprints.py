"""SimHash fingerprints and links against brute force."""

import re

import numpy as np
import xxhash

from weftline.llm import fingerprints as fpx


def slow_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprint_by_definition():
    for t in (None, "", " \t\n", "One", "one Two three", "a b c d", "a b c d e f g a b c d", "É à Ünï x y z\x0bk w w w w w w", "lorem ipsum " * 300):
        assert fpx.fingerprint(t) == slow_fingerprint(t)


def test_every_close_pair_meets_at_a_home():
    rng, golay = np.random.default_rng(1), fpx.Golay()
    for _ in range(300):
        x = int(rng.integers(0, 1 << 63)) * 2 + int(rng.integers(0, 2))
        y = x
        for b in rng.choice(64, int(rng.integers(0, 5)), replace=False):
            y ^= 1 << int(b)
        met = False
        for shift, bits in fpx.SEGMENTS:
            vx, vy = (np.array([(v >> shift) & ((1 << bits) - 1)]) for v in (x, y))
            met |= int(golay.home(vx)[0]) in golay.near(vy, bits)[0].tolist()
        assert met


def brute(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def cluster(rng, n):
    """Fingerprints in chains and clusters, with copies."""
    out = []
    while len(out) < n:
        x = int(rng.integers(0, 1 << 62)) * 4 + int(rng.integers(0, 4))
        for _ in range(int(rng.integers(1, 12))):
            out.append(x)
            for b in rng.choice(64, int(rng.integers(0, 6)), replace=False):
                x ^= 1 << int(b)
    return out[:n]


def test_links_equal_brute_force_also_in_tiles(spark, monkeypatch):
    fps = cluster(np.random.default_rng(5), 700)
    signed = sorted({int(np.uint64(f).astype(np.int64)) for f in fps})
    want = brute([s & (1 << 64) - 1 for s in signed])
    for tile in (200_000, 3):
        monkeypatch.setattr(fpx, "TILE", tile)
        edges = [(r.a, r.b) for r in fpx.links(spark.createDataFrame([(s,) for s in signed], "fp bigint")).collect()]
        at = {s: i for i, s in enumerate(signed)}
        label = fpx._join_labels(np.arange(len(signed)), np.array([at[a] for a, _ in edges]), np.array([at[b] for _, b in edges]))
        assert label.tolist() == want


def test_pairs_by_blocks_equal_all_pairs():
    fps = np.array(cluster(np.random.default_rng(2), 5000), np.uint64)
    fps = np.concatenate([fps, fps[:200] ^ np.uint64(5)])
    got = set()
    for i, j in fpx._pairs(fps, fps, 4):
        got |= set(zip(i.tolist(), j.tolist(), strict=True))
    want = {(i, int(j)) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 4)}
    assert got == want


def test_rows_with_nulls_copies_and_extra_columns(spark):
    base = " ".join(f"w{i}" for i in range(400))
    texts = [base, base + " tail", "", None, "other words here that are not close at all", base, "x"]
    ids = [9, 3, 8, 4, 5, 9, None]
    docs = spark.createDataFrame([(i, t, "z", 1) for i, t in zip(ids, texts, strict=True)], "doc_id bigint, text string, fp string, root int")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.fingerprint, r.component_id) for r in fpx.near_duplicates(docs).collect())
    fps = [slow_fingerprint(t) for t in texts]
    label = brute(fps)
    want = []
    for k, i in enumerate(ids):
        group = [ids[m] for m in range(len(ids)) if label[m] == label[k] and ids[m] is not None]
        want.append((i if i is not None else -1, f"{fps[k]:016x}", min(group, default=None)))
    assert got == sorted(want)
    assert fpx.near_duplicates(docs.limit(0)).count() == 0
