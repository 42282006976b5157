"""One row of each near-duplicate group stays, also among repeated rows."""

from weftline.llm import fingerprints as fpx


def test_keep_one(spark):
    a, b = " ".join(f"w{i}" for i in range(300)), " ".join(f"v{i}" for i in range(300))
    rows = [(5, a), (5, a), (3, a + " x"), (None, a), (7, b), (7, b), (7, a), (9, None), (8, ""), (None, "alone"), (None, "alone")]
    docs = spark.createDataFrame([(d, t, "y", "z") for d, t in rows], "doc_id bigint, text string, tie string, row string").repartition(3)
    got = sorted(((r.doc_id, r.text) for r in fpx.keep_one(docs).collect()), key=str)
    linked = (fpx.fingerprint(a) ^ fpx.fingerprint(a + " x")).bit_count() <= 4
    want = [(3, a + " x"), (7, b), (8, ""), (None, "alone")] + ([] if linked else [(5, a)])
    assert got == sorted(want, key=str)
    assert fpx.keep_one(docs).columns == docs.columns
