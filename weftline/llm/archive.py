"""WARC archives with revisits and a two-level capture index.

Records are gzip members, so each can be read by a range. The index has a line for each capture, sorted by the reversed
host of its URL: lines are put into compressed blocks, and a sparse directory keeps the first key and the range of each
block. A lookup searches the directory and then the block by bisection, and reads only the records' ranges.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import itertools
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

#: Payloads from this size on are stored once; equal ones revisit the response with the largest page_id.
REVISIT_FROM = 1000
#: Index lines in a compressed block.
BLOCK_LINES = 2000
#: Bytes of several records that one read takes at most, and between two of them.
READ_BYTES, GAP = 1 << 20, 1 << 14
#: A fixed time: the tables have none.
DATE = "2000-01-01T00:00:00Z"


def url_key(url: str | None) -> str:
    """Sort key of a URL: host labels reversed and joined by commas, a closing bracket, then port, path and query. Null and hostless URLs sort by their own text."""
    text = url or ""
    try:
        parts = urlsplit(text)
        host, port = parts.hostname, parts.port
    except ValueError:
        return text
    if not host:
        return text
    rest = (f":{port}" if port else "") + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return ",".join(reversed(host.split("."))) + ")" + rest


def _clean(value: str) -> str:
    """A header value cannot hold a line end."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A gzip member: a response with its payload, or a revisit without it."""
    digest = hashlib.sha1(payload).hexdigest()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Date: {DATE}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (by lower-case name) and payload of a record."""
    head, _, rest = member.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(headers["content-length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


def _number(urn: str | None) -> int | None:
    digits = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def capture_of(headers: dict[str, str], payload: bytes) -> tuple[int | None, int, str, str, int | None]:
    """(page_id, payload bytes, digest, type, refers_to) of a record; a response's are taken from its payload and must agree with its headers."""
    size, digest = int(headers["x-payload-length"]), headers["warc-payload-digest"].removeprefix("sha1:")
    if headers["warc-type"] == "response" and (size, digest) != (len(payload), hashlib.sha1(payload).hexdigest()):
        raise ValueError(f"a damaged record: {headers}")
    return _number(headers["warc-record-id"]), size, digest, headers["warc-type"], _number(headers.get("warc-refers-to"))


_LINE = "url_key string, url string, page_id bigint, type string, digest string, file string, start bigint, size bigint"
_NAMES = ["url_key", "url", "page_id", "type", "digest", "file", "start", "size"]


def _arrow(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=_NAMES)


def _attempt() -> str:
    """A name of this attempt of a task alone: a task that runs twice writes two files, and only the one whose rows are kept is ever read."""
    task = TaskContext.get()
    return f"{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}"


def _writer(path: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, lines, at = f"part-{_attempt()}.warc.gz", [], 0

        def chunks():
            nonlocal at
            for page, url, html, refers in shared.rows_of(batches):
                payload = (html or "").encode("utf-8", "surrogatepass")
                one = record(page, url, payload, refers)
                lines.append((url_key(url), url, page, "response" if refers is None else "revisit", hashlib.sha1(payload).hexdigest(), name, at, len(one)))
                at += len(one)
                yield one

        shared.put(f"{path}/{name}", chunks())
        for k in range(0, len(lines), 5000):
            yield _arrow(lines[k : k + 5000])

    return write


def _indexer(path: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"index-{_attempt()}.gz"
        blocks, at, held, count = [], 0, [], 0

        def block():
            nonlocal at
            data = gzip.compress("\n".join(json.dumps(x) for x in held).encode("utf-8", "surrogatepass"), 6, mtime=0)
            blocks.append((held[0][0], name, at, len(data), len(held)))
            at += len(data)
            held.clear()
            return data

        def chunks():
            nonlocal count
            for row in shared.rows_of(batches):
                held.append(row)
                count += 1
                if len(held) == BLOCK_LINES:
                    yield block()
            if held:
                yield block()

        shared.put(f"{path}/{name}", chunks())
        if blocks:
            columns = list(zip(*blocks, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k < 2 else pa.int64()) for k, c in enumerate(columns)], names=["first", "file", "start", "size", "lines"])

    return write


def revisits(pages: DataFrame) -> DataFrame:
    """(page_id, digest, refers_to) of the pages whose payload another page with a larger id has, as far as it is large enough.

    Only ids, sizes and digests are shuffled; the counts are combined before the shuffle, so a payload that a third of all pages have is no hot group.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    ids = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).alias("bytes"))
    ids = ids.where(F.col("bytes") >= REVISIT_FROM)
    best = ids.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1 and refers_to is not null")
    return ids.join(best, "digest").where("page_id is null or page_id < refers_to").select("page_id", "digest", "refers_to").distinct()


def write_archives(pages: DataFrame, path: str) -> DataFrame:
    """Write page_id, url, html of pages as WARC files to path and return the captures: url_key, url, page_id, type, digest, file, start, size.

    A null html is an empty payload; a null url is left out of the headers. Rows that share page_id and payload with the
    response are responses too; a null page_id never is referred to. Other columns are not read. An empty table gives no captures.
    """
    shared.columns_of(pages, ["page_id", "url", "html"])
    spark = pages.sparkSession
    shared.prepare(spark)
    shared.make_dir(path)
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    digest = F.sha1(F.coalesce("html", F.lit("")).cast("binary"))
    dup = revisits(rows)
    keyed = rows.withColumn("digest", digest)
    # pages meet their decisions on (page_id, digest), which is as evenly spread as the ids are
    met = keyed.join(dup.withColumnRenamed("page_id", "p"), (F.col("p").eqNullSafe(F.col("page_id"))) & (dup["digest"] == keyed["digest"]), "left").select("page_id", "url", "html", "refers_to")
    captures = met.mapInArrow(_writer(path), _LINE)
    return shared.saved(spark, captures, "captures", f"{path}/captures")


def write_index(captures: DataFrame, path: str) -> DataFrame:
    """Write the two-level index of captures below path; returns the directory: first, file, start, size, lines of each block."""
    spark = captures.sparkSession
    shared.prepare(spark)
    shared.make_dir(f"{path}/index")
    order = ["url_key", "page_id", "file", "start"]
    dealt = captures.select(*_NAMES).repartitionByRange(shared.partitions(spark), *order).sortWithinPartitions(*order)
    return shared.saved(spark, dealt.mapInArrow(_indexer(f"{path}/index"), "first string, file string, start bigint, size bigint, lines bigint"), "directory", f"{path}/directory")


class Index:
    """Point lookups. The directory, a row for each BLOCK_LINES captures, is held in memory; blocks and records are read by range."""

    def __init__(self, spark: SparkSession, path: str):
        self._path = path
        rows = spark.read.parquet(f"{path}/directory").orderBy("first", "file", "start").collect()
        self._blocks = [tuple(r) for r in rows]
        self._firsts = [b[0] for b in self._blocks]

    def _range(self, name: str, start: int, size: int) -> bytes:
        with shared.open_read(f"{self._path}/{name}") as f:
            f.seek(start)
            return gzip.decompress(f.read(size))

    def lookup(self, url: str | None) -> list[dict]:
        """The captures of a URL in order of page_id."""
        key, found = url_key(url), []
        for at in _blocks_of(self._firsts, key):
            _, name, start, size, _ = self._blocks[at]
            found += [dict(zip(_NAMES, x, strict=True)) for x in _found(_block(self._path, name, start, size), {key: {url}})]
        return found

    def read(self, capture: dict) -> tuple[dict[str, str], bytes]:
        """Headers and payload of a capture's record, which for a revisit is empty."""
        return parse(self._range(capture["file"], capture["start"], capture["size"]))


_CAPTURE = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def _block(path: str, name: str, start: int, size: int) -> list[tuple]:
    """The captures of an index block."""
    with shared.open_read(f"{path}/index/{name}") as f:
        f.seek(start)
        text = gzip.decompress(f.read(size)).decode("utf-8", "surrogatepass")
    return [tuple(json.loads(x)) for x in text.split("\n")]


def _records(path: str, captures: list[tuple]) -> Iterator[bytes]:
    """The records of captures (file, start, size) in their order by place; ranges that lie close together are one read."""
    captures, at = sorted(captures), 0
    while at < len(captures):
        name, first, _ = captures[at]
        with shared.open_read(f"{path}/{name}") as f:
            while at < len(captures) and captures[at][0] == name:
                first, stop, k = captures[at][1], captures[at][1] + captures[at][2], at + 1
                while k < len(captures) and captures[k][0] == name and captures[k][1] <= stop + GAP and captures[k][1] + captures[k][2] <= first + READ_BYTES:
                    stop, k = captures[k][1] + captures[k][2], k + 1
                f.seek(first)
                held = f.read(stop - first)
                for _, start, size in captures[at:k]:
                    yield gzip.decompress(held[start - first : start - first + size])
                at = k


def _blocks_of(firsts: list[str], key: str) -> Iterator[int]:
    """Numbers of the blocks that may hold a key, found by bisection of the directory's first keys."""
    at = max(0, bisect.bisect_left(firsts, key) - 1)
    while at < len(firsts) and firsts[at] <= key:
        yield at
        at += 1


def _found(lines: list[tuple], wanted: dict[str, set[str | None]]) -> Iterator[tuple]:
    """The lines of a block that have one of the wanted URLs (by key), found by bisection of its keys."""
    keys = [x[0] for x in lines]
    for key, urls in wanted.items():
        for x in lines[bisect.bisect_left(keys, key) : bisect.bisect_right(keys, key)]:
            if x[1] in urls:
                yield x


def read_by_index(spark: SparkSession, path: str, urls: DataFrame | None = None) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of the captures of urls (column url; without it, of all captures at path).

    Each distinct URL is looked up: its key in the directory by bisection, then, dealt by block, in the block by bisection, and
    the records that it leads to are read by their ranges. A block is read once for all its URLs, and a URL of many captures is
    spread over its blocks, so memory is bounded by the directory, a block's lines and a record. URLs that the index does not
    have give no rows; a damaged record raises.
    """
    shared.prepare(spark)
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    directory = Index(spark, path)
    blocks, firsts = directory._blocks, directory._firsts

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(at, key, url) for url in batch.column(0).to_pylist() for key in [url_key(url)] for at in _blocks_of(firsts, key)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string()))], names=["block", "url_key", "url"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, rows in itertools.groupby(shared.rows_of(batches), lambda x: x[0]):
            wanted: dict[str, set[str | None]] = {}
            for _, key, url in rows:
                wanted.setdefault(key, set()).add(url)
            places = [x[5:8] for x in _found(_block(path, *blocks[at][1:4]), wanted)]
            made = [capture_of(*parse(r)) for r in _records(path, places)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in made], t) for k, t in enumerate(kinds)], names=names)

    if urls is None:
        urls = spark.read.parquet(f"{path}/captures")
    asked = urls.select(F.col("url").cast("string").alias("url")).distinct().mapInArrow(search, "block bigint, url_key string, url string")
    return asked.repartition(shared.partitions(spark), "block").sortWithinPartitions("block").mapInArrow(read, _CAPTURE)


def op7_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page: page_id, payload_bytes, payload_digest, record_type, refers_to, read back by a lookup of each page's URL in the index."""
    path, pages = shared.work_dir(spark, "warc"), spark.read.parquet(f"{sf_dir}/pages.parquet")
    write_index(write_archives(pages, path), path)
    return read_by_index(spark, path, pages)


OP7_SQL = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT payload_digest, max(page_id) AS top FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, p.payload_digest,
       CASE WHEN top IS NOT NULL AND (page_id IS NULL OR page_id < top) THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN top IS NOT NULL AND (page_id IS NULL OR page_id < top) THEN top END AS refers_to
FROM p LEFT JOIN m ON p.payload_digest = m.payload_digest AND payload_bytes >= 1000
"""
