"""WARC archives with a two-level capture index.

Archives hold one gzip member per record. Captures are sorted by reversed-host URL key; their lines form compressed
blocks of an index file, and the file ends with a sparse directory, one entry per block. A lookup bisects the
files' first keys, the file's directory and one block, and then knows the byte range of its record. Files are
written to the shared folder under names of their own, so a task that runs again leaves no half-written file in use.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
from bisect import bisect_right
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import shared_path, slices
from corpusloom.session import materialize

MIN_REVISIT_BYTES = 0  # smaller payloads are always responses
FILE_BYTES = 1 << 30  # an archive this large is closed
BLOCK_LINES = 3000
TASK_BYTES = 64 << 20
READ_BYTES = 8 << 20  # neighbouring records are read together up to this size
DATE = "1970-01-01T00:00:00Z"  # pages carry no capture time
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURE = "page_id long, key string, file string, offset long, length long"
TAIL = "<Q"  # length of the compressed directory
TAIL_BYTES = struct.calcsize(TAIL)


def url_key(url: str | None) -> str:
    """Host labels in reverse, then the path and query: ``http://a.example.com/x?y`` gives ``com,example,a)/x?y``.

    Host and scheme are lower-cased, user and fragment dropped; a null url has the empty key, and a string
    that is no URL is its own key.
    """
    if url is None:
        return ""
    scheme, mark, rest = url.partition("://")
    if not mark:
        return url
    rest = rest.partition("#")[0]
    cut = min((i for i in map(rest.find, "/?") if i >= 0), default=len(rest))
    host, _, port = rest[:cut].rpartition("@")[2].lower().partition(":")
    path = rest[cut:] or "/"
    return f"{','.join(reversed(host.split('.')))}{':' + port if port else ''}){path}"


def record_id(page_id: int | None) -> str:
    """A page's id as a UUID; the upper half says whether there is an id."""
    value = (1 << 64) if page_id is None else page_id & ((1 << 64) - 1)
    return f"<urn:uuid:{uuid.UUID(int=value)}>"


def page_of(record: str) -> int | None:
    value = uuid.UUID(record.strip("<>").removeprefix("urn:uuid:")).int
    return None if value >> 64 else value - (1 << 64) if value >> 63 else value


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha1:{digest_of(payload)}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(record: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Header fields, HTTP head and payload."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    return fields, http, payload


def _open(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    files, place = pyarrow.fs.FileSystem.from_uri(folder)
    files.create_dir(place, recursive=True)
    return files, place


def write_archives(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Write a record per row of ``pages`` (``page_id``, ``url``, ``html``); the captures: where each record lies.

    Among equal payloads of at least ``min_bytes`` the one with the smallest id is the response, the others
    revisit it; null ids are never the smallest, and equal payloads without any id are all responses. Null html is empty.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha1(F.col("html").cast("binary")))
    narrow = materialize(rows.select("page_id", "sha", F.octet_length("html").alias("size")), "payloads")
    equal = narrow.where(F.col("size") >= min_bytes)
    firsts = equal.groupBy("sha").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1 and first_id is not null")
    firsts = materialize(firsts.drop("n"), "repeated-payloads")
    # A payload that very many pages share is one row here; its many pages may be split among tasks by the join.
    revisits = equal.join(firsts, "sha").where(~F.col("page_id").eqNullSafe(F.col("first_id")))
    revisits = materialize(revisits.select(F.col("page_id").alias("_id"), F.col("sha").alias("_sha"), "first_id").distinct(), "revisits")
    typed = rows.join(revisits, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("sha") == F.col("_sha")), "left")
    folder = shared_path(pages.sparkSession, "warc")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, place = _open(folder)
        out, name, at = None, "", 0
        for batch in slices(batches, "html"):
            captures = []
            for page_id, url, html, first in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "first_id")), strict=True):
                if out is None or at > FILE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = files.open_output_stream(f"{place}/{name}", compression=None)
                member = gzip.compress(make_record(page_id, url, html.encode(), first, first is not None), 3, mtime=0)
                out.write(member)
                captures.append((page_id, url_key(url), f"{folder}/{name}", at, len(member)))
                at += len(member)
            yield _batch(captures, CAPTURE_TYPES)
        if out is not None:
            out.close()

    return materialize(typed.select("page_id", "url", "html", "first_id").mapInArrow(work, CAPTURE), "captures")


CAPTURE_TYPES = {"page_id": pa.int64(), "key": pa.string(), "file": pa.string(), "offset": pa.int64(), "length": pa.int64()}
BLOCK_TYPES = {"first_key": pa.string(), "first_id": pa.int64(), "file": pa.string(), "offset": pa.int64(), "length": pa.int64()}
RECORD_TYPES = {
    "page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "url": pa.string(),
}


def _batch(rows: list[tuple], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types.values(), strict=True)], list(types))


def _rank(key: str, page_id: int | None) -> tuple:
    """Compares as Spark sorts: null ids first."""
    return (key, page_id is not None, page_id or 0)


def build_index(captures: DataFrame, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Write the capture index; the sparse directory: a row per block with its first key and byte range.

    Ranges of (key, id) balance the files even if one host or URL holds most captures.
    """
    folder = shared_path(captures.sparkSession, "capture-index")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, place = _open(folder)
        out, name, at, waiting, directory = None, f"{uuid.uuid4().hex}.idx", 0, [], []

        def flush(lines):
            nonlocal at, out
            if out is None:
                out = files.open_output_stream(f"{place}/{name}", compression=None)
            block = gzip.compress("\n".join(map(json.dumps, lines)).encode(), 3, mtime=0)
            out.write(block)
            directory.append((lines[0][0], lines[0][1], f"{folder}/{name}", at, len(block)))
            at += len(block)

        for batch in batches:
            waiting += zip(*(batch.column(c).to_pylist() for c in ("key", "page_id", "file", "offset", "length")), strict=True)
            while len(waiting) >= block_lines:
                flush(waiting[:block_lines])
                del waiting[:block_lines]
        if waiting:
            flush(waiting)
        if out is not None:
            tail = gzip.compress(json.dumps([(k, i, o, n) for k, i, _, o, n in directory]).encode(), 3, mtime=0)
            out.write(tail + struct.pack(TAIL, len(tail)))
            out.close()
            yield _batch(directory, BLOCK_TYPES)

    ordered = captures.select("key", "page_id", "file", "offset", "length").repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id")
    return materialize(ordered.mapInArrow(work, "first_key string, first_id long, file string, offset long, length long"), "index-directory")


class _IndexFile:
    """An open index file: its directory, and the block that was read last."""

    def __init__(self, path: str) -> None:
        files, place = pyarrow.fs.FileSystem.from_uri(path)
        self.file = files.open_input_file(place)
        size = self.file.size()
        length = struct.unpack(TAIL, self._read(size - TAIL_BYTES, TAIL_BYTES))[0]
        self.blocks = json.loads(gzip.decompress(self._read(size - TAIL_BYTES - length, length)))
        self.firsts = [_rank(k, i) for k, i, _, _ in self.blocks]
        self.block, self.lines, self.ranks = -1, [], []

    def _read(self, at: int, length: int) -> bytes:
        self.file.seek(at)
        return self.file.read(length)

    def find(self, key: str, page_id: int | None) -> Iterator[list]:
        """All captures of the key and id; repeats of one may go on in the next blocks."""
        wanted = _rank(key, page_id)
        block = max(0, bisect_right(self.firsts, wanted) - 1)
        while block > 0 and self.firsts[block] == wanted:
            block -= 1
        while block < len(self.blocks) and self.firsts[block] <= wanted:
            if block != self.block:
                _, _, at, length = self.blocks[block]
                self.block, self.lines = block, [json.loads(x) for x in gzip.decompress(self._read(at, length)).decode().split("\n")]
                self.ranks = [_rank(k, i) for k, i, *_ in self.lines]
            end = bisect_right(self.ranks, wanted)
            start = end
            while start and self.ranks[start - 1] == wanted:
                start -= 1
            yield from self.lines[start:end]
            block += 1


def lookup(directory: DataFrame, queries: DataFrame) -> DataFrame:
    """Captures of ``queries`` (``url``, ``page_id``): asked once for each distinct key and id.

    The first keys of the index files, one per task that wrote the index, are what the driver holds.
    """
    starts = directory.groupBy("file").agg(F.min(F.struct("first_key", "first_id")).alias("first"), F.max(F.struct("first_key", "first_id")).alias("last"))
    starts = sorted((_rank(*r["first"]), _rank(*r["last"]), r["file"]) for r in starts.collect())
    firsts, paths = [first for first, _, _ in starts], [path for _, _, path in starts]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for url, page_id in zip(batch.column("url").to_pylist(), batch.column("page_id").to_pylist(), strict=True):
                key = url_key(url)
                last = bisect_right(firsts, _rank(key, page_id)) - 1
                rows += [(key, page_id, last)] if last >= 0 else []
                while last > 0 and firsts[last] == _rank(key, page_id):  # repeats that began in the file before
                    last -= 1
                    rows.append((key, page_id, last))
            yield _batch(rows, {"key": pa.string(), "page_id": pa.int64(), "part": pa.int32()})

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, opened = None, None
        for batch in batches:
            found = []
            for key, page_id, part in zip(*(batch.column(c).to_pylist() for c in ("key", "page_id", "part")), strict=True):
                if part != opened:
                    index, opened = _IndexFile(paths[part]), part
                found += [(i, k, f, o, n) for k, i, f, o, n in index.find(key, page_id)]
            yield _batch(found, CAPTURE_TYPES)

    placed = queries.select("url", F.col("page_id").cast("long").alias("page_id")).mapInArrow(place, "key string, page_id long, part int").distinct()
    return placed.repartition("part").sortWithinPartitions("part", "key", "page_id").mapInArrow(find, CAPTURE)


def read_records(captures: DataFrame) -> DataFrame:
    """Read the records at the captures' byte ranges: ``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``, ``url``.

    A response's size and digest are those of the payload that was read, and its digest must be the one in its header.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            wanted = zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True)
            for path, ranges in groupby(wanted, key=itemgetter(0)):
                files, place = pyarrow.fs.FileSystem.from_uri(path)
                with files.open_input_file(place) as file:
                    for member in _members(file, [(o, n) for _, o, n in ranges]):
                        rows.append(_described(gzip.decompress(member)))
            yield _batch(rows, RECORD_TYPES)

    stretch = F.floor(F.col("offset") / TASK_BYTES)  # a large archive is read by several tasks
    ordered = captures.select("file", "offset", "length").repartition("file", stretch).sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(work, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def _members(file, ranges: list[tuple[int, int]]) -> Iterator[bytes]:
    """The bytes of each range; ranges that follow each other are read at once."""
    at = 0
    while at < len(ranges):
        end, size = at + 1, ranges[at][1]
        while end < len(ranges) and ranges[end][0] == sum(ranges[end - 1]) and size + ranges[end][1] <= READ_BYTES:
            size += ranges[end][1]
            end += 1
        begin = ranges[at][0]
        file.seek(begin)
        data = file.read(size)
        yield from (data[o - begin : o - begin + n] for o, n in ranges[at:end])
        at = end


def _described(record: bytes) -> tuple:
    fields, http, payload = parse_record(record)
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    if fields["WARC-Type"] == "response" and (digest_of(payload) != digest or len(payload) != size):
        raise ValueError(f"record {fields['WARC-Record-ID']} does not hold the payload that its header describes")
    refers_to = page_of(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None
    return page_of(fields["WARC-Record-ID"]), size, digest, fields["WARC-Type"], refers_to, fields.get("WARC-Target-URI")


def round_trip(pages: DataFrame) -> DataFrame:
    """Archive all ``pages``, index the captures, look every page up and read its record.

    One row per row of ``pages``, repeated ids and urls included; no rows give no rows and no files.
    """
    captures = write_archives(pages)
    directory = build_index(captures)
    found = materialize(lookup(directory, pages), "found-captures")
    return read_records(found).drop("url")


# SHA-1 in hex to base32: each run of five hex digits (20 bits) gives four letters.
SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY sha) AS first_id FROM p
)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      ((('0x' || substr(sha, 5 * (i // 4)::INT + 1, 5))::BIGINT >> (5 * (3 - i % 4))::INT) & 31)::INT + 1, 1) FOR i IN range(32)], '') AS payload_digest,
  CASE WHEN first_id IS NULL OR page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM f
"""
