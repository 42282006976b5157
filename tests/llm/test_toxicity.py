"""The kernel against all subsequences, the machine on held-out texts, and odd tables."""

import random
import zlib
from itertools import combinations

import numpy as np
import pytest

from weftline.llm import toxicity as tx


def slow_kernel(a, b):
    """Common subsequences of ORDER letters, each weighted by the stretches that it spans in either word."""
    total = 0.0
    for i in combinations(range(len(a)), tx.ORDER):
        for j in combinations(range(len(b)), tx.ORDER):
            if all(a[x] == b[y] for x, y in zip(i, j, strict=True)):
                total += tx.DECAY ** (i[-1] - i[0] + 1 + j[-1] - j[0] + 1)
    return total


def test_kernel_by_definition():
    r = random.Random(3)
    words = ["".join(r.choice("abcd") for _ in range(r.randint(1, 8))).encode() for _ in range(14)]
    got = tx.kernel(tx._codes(words)[:, None, :], tx._codes(words)[None, :, :])
    want = [[slow_kernel(a, b) for b in words] for a in words]
    assert np.allclose(got, want)


def test_triples_give_the_kernel():
    r = random.Random(4)
    words = [tx.units("".join(r.choice("abcd") for _ in range(r.randint(1, 9))).encode())[0] for _ in range(40)]
    assert np.allclose(tx.triple_sums(words, tx.triple_table(words[:9])), tx.similarities(words, words[:9]))


def test_plain_text():
    assert tx.plain("You are an 1d10t, i d i o t i-d.i,o.t!") == b"you are an idiot idiot idiot"
    assert tx.plain(None) == b"" and tx.plain("a b") == b"a b"


INSULTS = ["blorpface", "grumwit", "snackle"]


def made(n, seed):
    r = random.Random(seed)
    syllables = ["an", "er", "th", "in", "ou", "ti", "re", "es", "la", "mo", "du", "ke"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    docs, labels = [], []
    for d in range(n):
        words = [word() for _ in range(r.randint(1, 60))]
        toxic = r.random() < 0.25
        if toxic:
            for _ in range(2):
                words.insert(r.randrange(len(words) + 1), r.choice(INSULTS))
        docs.append((d, " ".join(words)))
        if r.random() < 0.95:
            labels.append((d, int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def model(spark):
    docs, labels = made(700, 1)
    return tx.fit(spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id bigint, text string, toxic string"), spark.createDataFrame(labels, "doc_id bigint, toxic int"))


def test_held_out_accuracy_and_changed_insults(spark, model):
    docs, labels = made(700, 2)
    known = dict(labels)
    rows = tx.score(spark.createDataFrame(docs, "doc_id bigint, text string"), model).collect()
    right = [r.predicted == known[r.doc_id] for r in rows if r.doc_id in known]
    assert len(rows) == 700 and sum(right) / len(right) > 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    changed = ["ouan blorp-face inla snack.le", "esla g r u m w i t ti 5nackle", "blorxpface anti grumxwit", "lamo gruwmwit snackkle du"]
    odd = tx.score(spark.createDataFrame(list(enumerate(changed)), "doc_id bigint, text string"), model).collect()
    assert all(r.predicted == 1 for r in odd), odd


def slow_value(model, unit):
    """The machine on one unit by all subsequences."""
    codes = lambda u: tx._codes([u])[0].tolist()
    own = slow_kernel(codes(unit), codes(unit))
    if not own:
        return 0.0
    return sum(w * slow_kernel(codes(unit), codes(m)) / np.sqrt(own * slow_kernel(codes(m), codes(m))) for m, w in zip(model.marks, model.weights, strict=True))


def test_features_equal_a_plain_loop(model):
    """Every word meets the kernel: no filter stands before it."""
    few = tx.Model(model.marks[:6], model.weights[:6], model.curve)
    reader = tx.Reader(few)
    texts = [". ".join([t[: len(t) // 2], t[len(t) // 2 :]]) for _, t in made(12, 5)[0]] + [None, "", " ", "blorpface", "x", "a\n\nsnackleblorpfacesnackle! one two"]
    for t, row, chosen in zip(texts, reader.features(texts), reader.sentences(texts), strict=True):
        sentences = [s for s in tx.plain(t).split(b"\n") if s.split()]
        words = [[[slow_value(few, u) for u in tx.units(w)] for w in s.split()] for s in sentences]
        best = sorted((max(us) for s in words for us in s), reverse=True)[:2]
        sums = [sum(sum(us) for us in s) / np.sqrt(sum(len(us) for us in s)) for s in words]
        worst = sorted(sums, reverse=True)[:2]
        want = [*best, *[0.0] * (2 - len(best)), *worst, *[0.0] * (2 - len(worst)), np.log1p(sum(len(s) for s in words))]
        assert np.allclose(row, want)
        assert [sums[sentences.index(s)] for s in chosen] == pytest.approx(worst)


def test_sentences_are_rows_of_the_same_machine(model):
    reader = tx.Reader(model)
    texts = [t for _, t in made(40, 8)[0]]
    rows = tx.sentence_rows([tx.plain(t) for t in texts], model.marks) @ model.weights
    assert np.allclose(rows, reader.features(texts)[:, 2])


def test_odd_tables(spark, model):
    docs = spark.createDataFrame([(None, None), (1, ""), (1, "blorpface grumwit"), (2, "z" * 100_000)], "doc_id bigint, text string")
    rows = tx.score(docs, model).collect()
    assert len(rows) == 4 and sum(r.predicted for r in rows) == 1 and not any(r.held_out for r in rows if r.doc_id is None)
    assert {r.text for r in tx.drop_toxic(docs, model).collect()} == {None, "", "z" * 100_000}
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert all(r.predicted == 0 for r in tx.score(docs, tx.fit(docs, none)).collect())
    assert tx.score(docs.limit(0), model).count() == 0


def test_every_insult_of_a_large_lexicon_is_a_landmark():
    r = random.Random(6)
    word = lambda letters: "".join(r.choice(letters) for _ in range(7)).encode()
    bad, good = [word("bcdfghjklmnpqrstvwxz") for _ in range(90)], [word("aeiouyrstln") for _ in range(300)]
    insults, clean = tx.landmarks([(w, 20, 0) for w in bad], [(w, 5) for w in good], 0.1, 400)
    assert len(insults) > 80 > tx.LANDMARKS == len(clean)


def test_training_rows_are_the_same_every_time_and_copies_count_once(spark):
    docs, labels = made(300, 4)
    docs += [(1000 + k, docs[k % 3][1] + " tail" * (k % 2)) for k in range(60)]
    labels += [(1000 + k, dict(labels).get(k % 3, 0)) for k in range(60)]
    table, known = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    got = [sorted(r.text for r in tx.training_rows(table.repartition(n), known).collect()) for n in (2, 5)]
    assert got[0] == got[1] and len(got[0]) < 290
    # texts that share but one key are unlike, and all stay
    assert len(got[0]) > 200


def test_code_rows_are_those_of_each_word():
    words = [b"", b"^abc", b"^a\x00b", "^é".encode(), b"^abcdefghij"]
    got = tx._codes(words)
    assert got.shape == (5, 11) and tx._codes([]).shape == (0, 1)
    for row, w in zip(got.tolist(), words, strict=True):
        assert row == [int(tx._CODE[b]) for b in w] + [0] * (11 - len(w))
