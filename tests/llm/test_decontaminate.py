"""The suffix automaton against windows by brute force."""

import hashlib
import random
import time

import numpy as np
import pytest

from weftline.llm import decontaminate as dc


def slow(text, items, window=10):
    words = dc.words_of(text)
    hit, found = [False] * len(words), set()
    for item, t in items:
        own = dc.words_of(t)
        k = min(window, len(own))
        for s in range(len(own) - k + 1) if k else ():
            for at in range(len(words) - k + 1):
                if words[at : at + k] == own[s : s + k]:
                    found.add(item)
                    hit[at : at + k] = [True] * k
    return len(words), sum(hit), found


def test_words():
    assert dc.words_of("It's ÉTÉ 42-a\x00B_c") == [w.encode() for w in ("it", "s", "ÉtÉ", "42", "a", "b", "c")]
    assert dc.words_of(None) == []


@pytest.mark.parametrize("seed", range(30))
def test_match_equals_brute_force(seed):
    r = random.Random(seed)
    alphabet = "abcd" if seed % 2 else "abcdefghijkl"
    text = lambda n: " ".join(r.choice(alphabet) for _ in range(n))
    items = [(f"i{k}", text(r.choice([0, 1, 2, 3, 5, 6, 9, 20]))) for k in range(8)]
    window = r.choice([3, 4, 6])
    machine = dc.Automaton([(i, dc.words_of(t)) for i, t in items], window)
    for _ in range(10):
        doc = text(r.randint(0, 80)) + (" zz " + items[-1][1] if r.random() < 0.5 else "")
        words = dc.words_of(doc)
        hit = np.zeros(len(words), bool)
        found = machine.match(words, hit)
        assert (len(words), int(hit.sum()), found) == slow(doc, items, window)


def test_report_with_nulls_passes_and_short_items(spark):
    long = " ".join(f"w{i}" for i in range(30))
    items = [(1, long), (2, None), (3, "Two Words"), (4, ""), (10, long + " more"), (None, "lonely")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    texts = [None, "", long, "x " + " ".join(f"w{i}" for i in range(5, 16)) + " y", "say two words, two", "w1 w2 w3", "lonely", " ".join(f"W{i}" for i in range(10))]
    docs = spark.createDataFrame([(i, t, "e") for i, t in enumerate(texts)], "doc_id bigint, text string, item_id string")
    for words in (1_000_000, 5):
        assert len(list(dc.passes(bench, most=words)))  >= (1 if words > 5 else 2)
        for r in dc.report(docs, bench, pass_words=words).collect():
            n, h, found = slow(texts[r.doc_id], [(str(i) if i is not None else "", t) for i, t in items])
            want = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
            assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n, h, len(found), want, h > 0)
    assert dc.report(docs, bench.limit(0)).where("contaminated").count() == 0
    assert dc.report(docs.limit(0), bench).count() == 0


def test_spans_are_cut_and_covered_documents_dropped(spark):
    passage = " ".join(f"w{i}" for i in range(12))
    pad = " ".join(f"p{i}" for i in range(30))
    bench = spark.createDataFrame([(1, passage)], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, f"{pad}. {passage}! {pad}", 5), (2, passage + " z", 6), (3, pad, 7), (4, None, 8), (5, f"{passage}, {pad}", 9)], "doc_id bigint, text string, n_chars bigint")
    got = {r.doc_id: (r.text, r.n_chars) for r in dc.remove_contamination(docs, bench).collect()}
    cut = f"{pad}. ! {pad}"
    want = {1: (cut, len(cut)), 3: (pad, 7), 4: (None, 8), 5: (f", {pad}", len(pad) + 2)}
    assert got == want
    # the same in several passes, with extra columns whose names clash or hold a dot
    odd = docs.selectExpr("*", "'x' as `a.b`", "doc_id as digest", "'y' as spans")
    out = dc.remove_contamination(odd, bench, pass_words=3)
    assert out.columns == odd.columns
    assert {r.doc_id: (r.text, r.n_chars) for r in out.collect()} == want


def test_time_grows_with_the_words_of_items_of_one_word():
    took = []
    for n in (4_000, 16_000):
        words = [b"a"] * n
        machine = dc.Automaton([("i", words)])
        began = time.perf_counter()
        hit = np.zeros(n, bool)
        assert machine.match(words, hit) == {"i"} and hit.all()
        took.append(time.perf_counter() - began)
    assert took[1] < 10 * took[0]
