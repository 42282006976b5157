"""Token files against the library on whole texts."""

import zlib

import numpy as np
from tokenizers import Tokenizer

from weftline.llm import shared, token_files
from weftline.llm.pieces import PieceEncoder, tokenizer_path

TEXTS = ["", None, "a", "Two  blanks and a tail ", "line\nbreak \n mixed\t tab", "naïve café — ünïcode 漢字 😀", " lead", "it's we'll I'd", "x" * 5000, "word " * 3000, "a b  c", "A\r\nB  \r\n C", "1234 5678,90", "\n\n\n", "   "]


def whole(name, texts):
    t = Tokenizer.from_file(tokenizer_path(name))
    return [x.ids for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_pieces_equal_the_library_on_whole_texts():
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        encoder = PieceEncoder(name, 7)
        got = [np.frombuffer(x, encoder.dtype).tolist() for x in encoder.encode([t or "" for t in TEXTS])]
        assert got == [x + [7] for x in whole(name, TEXTS)]


def test_round_trip_in_order_with_nulls_ties_and_extra_columns(spark):
    ids = [None, 5, 5, *range(10, 10 + len(TEXTS) - 3)]
    docs = spark.createDataFrame([(i, t, "start", 3) for i, t in zip(ids, TEXTS, strict=True)], "doc_id bigint, text string, start string, n_tokens int")
    manifest = token_files.write_token_files(docs, shared.work_dir(spark, "t"))
    rows = token_files.read_token_files(spark, manifest).orderBy("start").collect()
    assert len(rows) == len(TEXTS) == manifest.documents
    at, seen = 0, []
    expected = sorted(zip(ids, whole("byte_bpe_50k.json", TEXTS), strict=True), key=lambda x: (x[0] is not None, x[0] or 0))
    for r in rows:
        assert r.start == at
        at += r.n_tokens
        seen.append((r.doc_id, r.n_tokens, r.ids_crc32))
    assert at == manifest.tokens
    want = [(i, len(x) + 1, zlib.crc32(np.array(x + [2], "<u4").tobytes())) for i, x in expected]
    assert sorted(seen, key=str) == sorted(want, key=str)
    assert [s[0] for s in seen] == [w[0] for w in want]
    assert token_files.open_manifest(manifest.path) == manifest


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    manifest = token_files.write_token_files(docs, shared.work_dir(spark, "t"))
    assert manifest.tokens == 0 and token_files.read_token_files(spark, manifest).count() == 0


def test_pieces_equal_the_library_on_random_texts():
    import random

    r = random.Random(4)
    alphabet = ["a", "B", "é", "Ü", "ß", "ñ", " ", " ", "\n", "'", "'s", "'LL", "9", "42", ".", ",##", "\t", "\xa0", "\x1f", "İ", "Σ", "ς", "x́", "漢", "<|endoftext|>", "<|startoftext|>", "-", "_", "²", "¡", "\xad", "µ", "×"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(3000)]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        encoder = PieceEncoder(name)
        assert [np.frombuffer(x, encoder.dtype).tolist() for x in encoder.encode(texts)] == whole(name, texts)


def test_a_small_memory_changes_nothing():
    texts = [f"word{k % 37}, other{k} and Ünter{k % 11}." for k in range(400)]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        encoder = PieceEncoder(name, None, 20)
        got = [np.frombuffer(x, encoder.dtype).tolist() for at in range(0, 400, 7) for x in encoder.encode(texts[at : at + 7])]
        assert got == whole(name, texts)
