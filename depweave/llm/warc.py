"""WARC archives of web captures, and their index merged into global capture histories.

Writing: every capture becomes a WARC/1.1 record.  Of captures with equal payloads
of at least ``REVISIT_BYTES`` the one with the largest id is stored as a response,
the others as revisits that refer to it (identical-payload-digest profile); a
revisit holds the HTTP head alone, which tells the payload's size.  Records are
written by Spark's text writer with the record separator as line separator: files
appear in the output folder by its commit protocol, so a lost or repeated task
leaves no half archive, and any file system that Spark can write will do.

Reading: archives are read whole, one by one (``ARCHIVE_BYTES`` each on average, a
gigabyte at most by ``SIZE_CLASSES``), and parsed by Content-Length, so payloads may
hold anything.  Each archive yields
one run of index entries, sorted by URL key and time.

Merging: the runs are dealt into ranges of (URL key, time, id), about
``RANGE_ENTRIES`` entries each however long the index is, and merged in each range
with a loser tree, k runs at a time.  The output, range after range, is
ordered globally: each URL's captures stand together in order of time.

Defined results: a null payload is empty; a null URL has no target header and
sorts first; of rows with the same largest id and payload each is a response; if
all ids of equal payloads are null, all are responses; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depweave.session import materialise, shared_dir

REVISIT_BYTES = 1000
ARCHIVE_BYTES = 16_000_000
#: (bytes, records): payloads up to that size go to archives of so many records at most, so that none exceeds a gigabyte; larger ones stand alone.
SIZE_CLASSES = ((256_000, 4_000), (16_000_000, 60))
#: Index entries that a range has on average; a range is merged in one task's memory.
RANGE_ENTRIES = 100_000
#: Rows up to which the table of repeated payloads is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 400_000

_CRLF = "\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:x-capture:"


def with_revisits(captures: DataFrame) -> DataFrame:
    """(id, url, captured, payload) -> also size, digest, refers_to (null for responses) and response."""
    c = captures.select("id", "url", "captured", F.coalesce("payload", F.lit("")).alias("payload"))
    c = c.withColumns({"size": F.octet_length("payload").cast("long"), "digest": F.sha1(F.col("payload").cast("binary"))})
    repeated = c.where(F.col("size") >= REVISIT_BYTES).groupBy("digest").agg(F.max("id").alias("keep"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("d"), "keep")
    repeated = materialise(repeated, "warc-repeated")
    side = F.broadcast(repeated) if repeated.count() <= BROADCAST_ROWS else repeated
    joined = c.join(side, (F.col("digest") == F.col("d")) & (F.col("size") >= REVISIT_BYTES), "left").drop("d")
    response = F.col("keep").isNull() | F.col("id").eqNullSafe(F.col("keep"))
    return joined.withColumns({"response": response, "refers_to": F.when(~response, F.col("keep"))}).drop("keep")


def record(id_: Column, url: Column, captured: Column, payload: Column, size: Column, digest: Column, response: Column, refers_to: Column) -> Column:
    """One WARC record as a string, without the separator after it."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}Content-Length: "), size.cast("string"), F.lit(_CRLF * 2))
    block = F.octet_length(http) + F.when(response, size).otherwise(F.lit(0))
    clean = url
    for c in "%\r\n\t ":  # what would end the header or be trimmed from it
        clean = F.replace(clean, F.lit(c), F.lit(f"%{ord(c):02X}"))
    head = F.concat(
        F.lit(f"WARC/1.1{_CRLF}WARC-Type: "), F.when(response, "response").otherwise("revisit"),
        F.lit(f"{_CRLF}WARC-Record-ID: <{_ID}"), text(id_), F.lit(f">{_CRLF}WARC-Date: "), F.date_format(F.to_utc_timestamp(captured, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        F.when(url.isNull(), "").otherwise(F.concat(F.lit(f"{_CRLF}WARC-Target-URI: "), clean)),
        F.lit(f"{_CRLF}WARC-Payload-Digest: sha1:"), digest,
        F.when(response, "").otherwise(F.concat(F.lit(f"{_CRLF}WARC-Profile: {_PROFILE}{_CRLF}WARC-Refers-To: <{_ID}"), text(refers_to), F.lit(">"))),
        F.lit(f"{_CRLF}Content-Type: application/http; msgtype=response{_CRLF}Content-Length: "), block.cast("string"), F.lit(_CRLF * 2),
    )
    return F.concat(head, http, F.when(response, payload).otherwise(F.lit("")))


def write_archives(captures: DataFrame, path: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> str:
    """Writes captures (id, url, captured, payload) as WARC files into a new folder and returns it."""
    path = path or f"{shared_dir(captures.sparkSession)}/tables/warc-{uuid.uuid4().hex}"
    c = with_revisits(captures)
    bytes_ = F.octet_length("payload")
    mean, largest = captures.agg(F.coalesce(F.avg(bytes_), F.lit(0.0)), F.coalesce(F.max(bytes_), F.lit(0))).first()
    wanted = max(1, int(archive_bytes / (mean + 500)))
    above = -1
    for upto, most in (*SIZE_CLASSES, (None, 1)):
        if above >= largest:
            break  # most tables have no large pages and are written in one pass
        sized = c.where(F.col("size") > above) if upto is None else c.where(F.col("size").between(above + 1, upto))
        records = sized.select(record(*(F.col(x) for x in ("id", "url", "captured", "payload", "size", "digest", "response", "refers_to"))).alias("value"))
        records.write.mode("append").option("lineSep", _CRLF * 2).option("maxRecordsPerFile", min(wanted, most)).text(path)
        above = upto
    return path


def parse(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers in lower case, block) of each record."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split(_CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(headers["content-length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) != size or data[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} is cut short")
        yield at, end + 8 + size - at, headers, block
        at = end + 8 + size


def url_key(url: str | None) -> str:
    """The sort-friendly form: host labels reversed, then path and query; '' for none."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip().lower())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url.lower()
    host = host.removeprefix("www.")
    known = {"http": 80, "https": 443}.get(parts.scheme)
    where = ",".join(reversed(host.split("."))) + (f":{port}" if port and port != known else "")
    return f"{where}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def _unquote(url: str | None) -> str | None:
    if url is None:
        return None
    for c in " \t\n\r%":
        url = url.replace(f"%{ord(c):02X}", c)
    return url


_ENTRY = pa.schema([
    ("url_key", pa.string()), ("captured", pa.string()), ("id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("seq", pa.int64()),
])
ENTRY = T.StructType([T.StructField(f.name, T.LongType() if pa.types.is_int64(f.type) else T.StringType()) for f in _ENTRY])


def _entry(archive: str, offset: int, length: int, headers: dict[str, str], block: bytes) -> dict:
    number = lambda x: int(x) if (x := x.strip("<>").removeprefix(_ID)) else None
    head, _, payload = block.partition(b"\r\n\r\n")
    digest = headers["warc-payload-digest"].removeprefix("sha1:")
    url = _unquote(headers.get("warc-target-uri"))
    if headers["warc-type"] == "response":
        if hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"{archive}: the payload at byte {offset} has another digest")
        size, refers = len(payload), None
    else:
        http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split(_CRLF)[1:])}
        size, refers = int(http["content-length"]), number(headers["warc-refers-to"])
    return {
        "url_key": url_key(url), "captured": headers["warc-date"], "id": number(headers["warc-record-id"]), "url": url, "record_type": headers["warc-type"], "refers_to": refers,
        "payload_bytes": size, "payload_digest": digest, "archive": archive, "offset": offset, "length": length,
    }


def sort_key(e: dict) -> tuple:
    return e["url_key"], e["captured"], e["id"] is not None, e["id"] or 0, e["archive"], e["offset"]


def capture_runs(spark: SparkSession, path: str) -> DataFrame:
    """Index entries of all archives in a folder, written as runs: each archive's sorted by :func:`sort_key`, ``seq`` its order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0), b.column(1), strict=True):
                archive = name.as_py().rsplit("/", 1)[-1]
                entries = sorted((_entry(archive, *r) for r in parse(content.as_py())), key=sort_key)
                for i, e in enumerate(entries):
                    e["seq"] = i
                yield from pa.Table.from_pylist(entries, _ENTRY).to_batches()

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return materialise(files.mapInArrow(run, ENTRY), "warc-runs")


class LoserTree:
    """Merges k sorted sequences: inner nodes hold the losers of their matches, so each step replays one path."""

    def __init__(self, runs: list[list], key: Callable):
        self.runs, self.key, self.k = runs, key, len(runs)
        self.at = [0] * self.k
        self.head = [key(r[0]) if r else None for r in runs]
        self.loser = [-1] * max(1, self.k)
        self.winner = self._play(1) if self.k > 1 else 0

    def _less(self, a: int, b: int) -> bool:
        if self.head[a] is None:
            return False
        return self.head[b] is None or self.head[a] <= self.head[b]

    def _play(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        left, right = self._play(2 * node), self._play(2 * node + 1)
        won, lost = (left, right) if self._less(left, right) else (right, left)
        self.loser[node] = lost
        return won

    def __iter__(self) -> Iterator:
        while self.k and self.head[self.winner] is not None:
            r = self.winner
            yield self.runs[r][self.at[r]]
            self.at[r] += 1
            self.head[r] = self.key(self.runs[r][self.at[r]]) if self.at[r] < len(self.runs[r]) else None
            node = (r + self.k) >> 1
            while node:
                if not self._less(r, self.loser[node]):
                    r, self.loser[node] = self.loser[node], r
                node >>= 1
            self.winner = r


def merge_runs(runs: DataFrame) -> DataFrame:
    """All entries in global order; adds ``range`` and ``position``, by which they can be read in order."""
    ranges = max(runs.sparkSession.sparkContext.defaultParallelism, runs.count() // RANGE_ENTRIES + 1)
    dealt = runs.repartitionByRange(ranges, "url_key", "captured", "id").withColumn("range", F.spark_partition_id())
    dealt = dealt.sortWithinPartitions("archive", "seq")  # each run whole and in its own order again
    schema = T.StructType([*ENTRY, T.StructField("range", T.IntegerType()), T.StructField("position", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_archive: dict[str, list[dict]] = {}
        for b in batches:
            for e in b.to_pylist():
                by_archive.setdefault(e["archive"], []).append(e)
        out, position = [], 0
        for e in LoserTree(list(by_archive.values()), sort_key):
            e["position"] = position
            position += 1
            out.append(e)
            if len(out) == 10_000:
                yield pa.RecordBatch.from_pylist(out, wanted)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, wanted)

    wanted = pa.schema([*_ENTRY, ("range", pa.int32()), ("position", pa.int64())])
    return dealt.mapInArrow(run, schema)
