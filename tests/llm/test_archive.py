"""WARC round trips and lookups."""

import hashlib

from weftline.llm import archive, shared


def test_url_keys():
    assert archive.url_key("http://www.Example.org:8080/a?b=1") == "org,example,www):8080/a?b=1"
    assert archive.url_key(None) == "" and archive.url_key("no host") == "no host"
    assert archive.url_key("http://[bad/") == "http://[bad/"


def test_round_trip_and_lookup(spark, monkeypatch):
    monkeypatch.setattr(archive, "BLOCK_LINES", 3)
    big = "é\r\n\r\n" * 300
    rows = [(1, "http://a.org/x", big), (2, "http://a.org/x", big), (3, "http://b.org/\nq", "small"), (4, None, "small"), (5, "u", None), (6, "http://a.org/y", ""), (9, "http://z.net/", big), (9, "http://z.net/", big), (None, "http://n.net/", big), (None, None, None), (12, "http://c.com/", big + "!")]
    rows += [(100 + k, f"http://h{k % 7}.net/p", "t" * k) for k in range(40)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, digest string").repartition(3)
    path = shared.work_dir(spark, "warc")
    captures = archive.write_archives(pages, path)
    archive.write_index(captures, path)
    got = sorted(map(tuple, archive.read_by_index(spark, path).collect()), key=str)
    want = []
    for i, _, h in rows:
        p = (h or "").encode()
        same = [r[0] for r in rows if (r[2] or "").encode() == p and r[0] is not None]
        revisit = len(p) >= 1000 and same and i != max(same)
        want.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if revisit else "response", max(same) if revisit else None))
    assert got == sorted(want, key=str)
    index = archive.Index(spark, path)
    for url in {r[1] for r in rows}:
        found = index.lookup(url)
        assert sorted(c["page_id"] or 0 for c in found) == sorted(r[0] or 0 for r in rows if r[1] == url)
        for c in found:
            headers, payload = index.read(c)
            assert archive.capture_of(headers, payload)[0] == c["page_id"]
            if c["type"] == "response":
                assert hashlib.sha1(payload).hexdigest() == c["digest"]
    assert index.lookup("http://nowhere.org/") == []


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    path = shared.work_dir(spark, "warc")
    captures = archive.write_archives(pages, path)
    archive.write_index(captures, path)
    assert captures.count() == 0 and archive.Index(spark, path).lookup("a") == []
    assert archive.read_by_index(spark, path).count() == 0


def test_a_second_attempt_in_another_order_harms_nothing(spark):
    pages = spark.createDataFrame([(k, f"http://h{k % 5}.net/{k}", "p" * 50 * k) for k in range(60)], "page_id bigint, url string, html string")
    path = shared.work_dir(spark, "warc")
    captures = archive.write_archives(pages.repartition(3), path)
    # the same tasks once more, with other rows in each: what a retry after a lost shuffle does
    archive.write_archives(pages.orderBy("html").repartition(3), f"{path}/again").count()
    rows = [(r.page_id, r.url, "p" * 50 * r.page_id, None) for r in pages.orderBy("url").collect()]
    spark.createDataFrame(rows, "page_id bigint, url string, html string, refers_to bigint").repartition(3).mapInArrow(archive._writer(path), archive._LINE).count()
    archive.write_index(captures, path)
    got = archive.read_by_index(spark, path).collect()
    assert sorted((r.page_id, r.payload_bytes) for r in got) == [(k, 50 * k) for k in range(60)]


def test_captures_are_found_by_lookups_of_their_urls(spark, monkeypatch):
    monkeypatch.setattr(archive, "BLOCK_LINES", 4)
    urls = ["http://a.org/x", "https://a.org/x", "http://b.org/", None, "u"]
    rows = [(k, urls[k % 5] if k < 50 else f"http://c.org/{k}", "t" * k) for k in range(90)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    path = shared.work_dir(spark, "warc")
    archive.write_index(archive.write_archives(pages, path), path)
    asked = [urls[1], urls[3], "http://c.org/77", "http://c.org/none", urls[1]]
    got = archive.read_by_index(spark, path, spark.createDataFrame([(u,) for u in asked], "url string")).collect()
    assert sorted((r.page_id, r.payload_bytes) for r in got) == [(k, k) for k, u, _ in rows if u in asked]
