"""Web archives: writing pages as WARC records, and a salvage reader.

Writing: each page becomes one record, a gzip member of its own. Of pages with equal payloads of `least`
bytes or more the one with the largest page_id is a response record, the others are revisit records
that name it and hold no payload. Which pages these are comes from one aggregation of digests; payloads
stay where they are as long as the repeated digests are few enough to be sent around. A task writes its
pages to one file under a name of its own, and only files of tasks that ended well are in the index.

Reading: a file is read record by record. A record counts if its gzip member ends soundly, its version line, headers,
lengths and end marks are right, and the digests of block and payload agree. After a failed check the
reader goes on behind the record if another begins there, else it searches for the next gzip magic or version
line from which a whole record can be read. The bytes between are a gap: file, begin, end and reason are logged. Members may
hold several records, and plain files are read the same way.

Defined results: a null html is an empty payload; a null page_id is a page like others, but the largest id of its
payload is that of a known one, and without any all are responses; rows that share the largest page_id of a payload are
all responses; addresses are kept with blanks and control characters percent-coded, a null one is left out; a
very long page is one record; an empty table gives no files and empty results; other columns are ignored.
Equal payloads are told by SHA-1 and length.
"""

from __future__ import annotations

import base64
import hashlib
import re
import urllib.parse
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from supportlake.llm.common import batches, drop, scratch, store

#: Bytes below which a payload is always written.
LEAST = 1000
#: Repeated digests up to which they are sent to all tasks, some 100 bytes each; beyond it both sides are shuffled.
SENT = 100_000
#: Fixed values of the format.
VERSION, PROFILE, MAGIC = b"WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", b"\x1f\x8b\x08"
#: Bytes read at once, and the longest header block.
PIECE, HEADER = 1 << 18, 1 << 20
DATE = "2024-01-01T00:00:00Z"
INDEX = "path string, page_id long, offset long, bytes long, record_type string"
READ = "path string, begin long, end long, reason string, page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"


def base32(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}:{digest}')}>"


def member(headers: list[tuple[str, str | None]], block: bytes, level: int) -> bytes:
    """One record as a gzip member; headers without a value are left out."""
    lines = [VERSION.decode(), *(f"{k}: {v}" for k, v in headers if v is not None), f"Content-Length: {len(block)}", "", ""]
    coder = zlib.compressobj(level, zlib.DEFLATED, 31)
    return coder.compress("\r\n".join(lines).encode()) + coder.compress(block) + coder.compress(b"\r\n\r\n") + coder.flush()


def one_line(url: str | None) -> str | None:
    return None if url is None else urllib.parse.quote(url, safe="".join(map(chr, range(33, 127))))


def page_record(page_id: int | None, url: str | None, payload: bytes, leader: tuple[int, str | None] | None, level: int) -> bytes:
    """A response, or a revisit of the page `leader` (id, address)."""
    raw = hashlib.sha1(payload).digest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if leader else http + payload
    refers = leader or (None, None)
    return member(
        [
            ("WARC-Type", "revisit" if leader else "response"), ("WARC-Record-ID", record_id(page_id, raw.hex())), ("WARC-Date", DATE), ("WARC-Target-URI", one_line(url)),
            ("WARC-Profile", PROFILE if leader else None), ("WARC-Refers-To", record_id(refers[0], raw.hex()) if leader else None), ("WARC-Refers-To-Target-URI", one_line(refers[1])),
            ("WARC-Payload-Digest", base32(raw)), ("WARC-Block-Digest", base32(hashlib.sha1(block).digest())), ("Page-ID", None if page_id is None else str(page_id)),
            ("Refers-To-Page-ID", str(refers[0]) if leader else None), ("Content-Type", "application/http; msgtype=response"),
        ],
        block, level,
    )


def leaders(pages: DataFrame, least: int) -> DataFrame:
    """(digest, size, leader (page_id, url)) of payloads that several rows share. Partial maxima are made before the shuffle, so a payload of a third of all pages is one row a task."""
    seen = pages.filter(F.col("size") >= least).groupBy("digest", "size").agg(F.count("*").alias("n"), F.max(F.struct("page_id", "url")).alias("leader"))
    return seen.filter("n > 1 and leader.page_id is not null").select("digest", "size", "leader")


def write_archives(pages: DataFrame, folder: str, least: int = LEAST, level: int = 4) -> DataFrame:
    """Write (page_id, url, html) as files below `folder`; returns their index, read back from its own table."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    shared = store(leaders(rows.drop("payload"), least), "warc-leaders")
    few = shared.limit(SENT + 1).count() <= SENT
    marked = rows.join(F.broadcast(shared) if few else shared, ["digest", "size"], "left")
    marked = marked.select("page_id", "url", "payload", F.when(F.coalesce(F.col("page_id") < F.col("leader.page_id"), F.col("leader").isNotNull()), F.col("leader")).alias("leader"))

    def write(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        path, out, at = f"{folder}/archives/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", None, 0
        for b in batches(frames, 512):
            if out is None:
                files, target = fs.FileSystem.from_uri(path)
                files.create_dir(target.rpartition("/")[0], recursive=True)
                out = files.open_output_stream(target, compression=None)
                info = b"software: supportlake\r\nformat: WARC File Format 1.1\r\n"
                headers = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, path)}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields"), ("WARC-Block-Digest", base32(hashlib.sha1(info).digest()))]
                at += out.write(member(headers, info, level))
            ids, urls, lead = (b[c].to_pylist() for c in ("page_id", "url", "leader"))
            begins, sizes = [], []
            for i, url, body, to in zip(ids, urls, b["payload"], lead, strict=True):
                begins.append(at)
                sizes.append(out.write(page_record(i, url, body.as_py(), (to["page_id"], to["url"]) if to else None, level)))
                at += sizes[-1]
            kinds = ["revisit" if to else "response" for to in lead]
            yield pa.RecordBatch.from_arrays([pa.array([path] * len(ids)), pa.array(ids, pa.int64()), pa.array(begins, pa.int64()), pa.array(sizes, pa.int64()), pa.array(kinds, pa.string())], names=["path", "page_id", "offset", "bytes", "record_type"])
        if out:
            out.close()

    marked.mapInArrow(write, INDEX).write.parquet(f"{folder}/index")
    drop(pages.sparkSession, shared.inputFiles()[0].rsplit("/", 1)[0]) if shared.inputFiles() else None
    return pages.sparkSession.read.schema(INDEX).parquet(f"{folder}/index")


class Damage(Exception):
    """A failed check, and where the record ends if its own lengths can be trusted."""

    def __init__(self, reason: str, end: int | None = None):
        super().__init__(reason)
        self.reason, self.end = reason, end


class Record(NamedTuple):
    headers: dict[str, str]
    block: bytes


Reader = Callable[[int, int], bytes]  # (bytes, offset)


def _check(record: Record) -> None:
    for name, of in (("warc-block-digest", lambda: record.block), ("warc-payload-digest", lambda: record.block.partition(b"\r\n\r\n")[2])):
        want = record.headers.get(name, "")
        if name == "warc-payload-digest" and record.headers.get("warc-type") != "response":
            continue
        if want.lower().startswith("sha1:") and want[5:].upper() != base32(hashlib.sha1(of()).digest())[5:]:
            raise Damage(f"{name} differs")


def parse_record(read: Reader, at: int, size: int) -> tuple[Record, int]:
    """The record that begins at `at` of plain bytes, checked, and its end."""
    head = read(min(HEADER, 4096), at)
    if b"\r\n\r\n" not in head:
        head = read(HEADER, at)
    stop = head.find(b"\r\n\r\n")
    if not re.match(rb"WARC/\d\.\d+\r\n", head) or stop < 0:
        raise Damage("no version line and headers")
    lines = head[:stop].decode("utf-8", "replace").split("\r\n")[1:]
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    length = headers.get("content-length", "")
    if not re.fullmatch(r"\d{1,18}", length):
        raise Damage("no content length")
    begin, end = at + stop + 4, at + stop + 8 + int(length)
    if end > size:
        raise Damage("cut off")
    block = read(int(length) + 4, begin)
    if block[-4:] != b"\r\n\r\n":
        raise Damage("no end mark")
    record = Record(headers, block[:-4])
    try:
        _check(record)
    except Damage as e:
        raise Damage(e.reason, end) from None
    return record, end


def read_member(read: Reader, at: int, size: int) -> tuple[list[Record], int]:
    """All records of the gzip member that begins at `at`, and its end."""
    coder, parts, place = zlib.decompressobj(31), [], at
    try:
        while not coder.eof:
            piece = read(PIECE, place)
            if not piece:
                raise Damage("cut off")
            parts.append(coder.decompress(piece))
            place += len(piece)
            if sum(map(len, parts[:1])) >= 5 and not parts[0].startswith(b"WARC/"):
                raise Damage("a member without a record")
    except zlib.error as e:
        raise Damage(f"gzip: {str(e).partition(': ')[2] or e}") from None
    end, data = place - len(coder.unused_data), b"".join(parts)
    records, inside = [], 0
    try:
        while inside < len(data):
            record, inside = parse_record(lambda n, o: data[o : o + n], inside, len(data))
            records.append(record)
    except Damage as e:
        raise Damage(e.reason, end) from None
    if not records:
        raise Damage("an empty member", end)
    return records, end


def take(read: Reader, at: int, size: int) -> tuple[list[Record], int]:
    start = read(5, at)
    if start.startswith(MAGIC):
        return read_member(read, at, size)
    if start == b"WARC/":
        record, end = parse_record(read, at, size)
        return [record], end
    raise Damage("neither a member nor a version line")


def candidates(read: Reader, at: int, size: int) -> Iterator[int]:
    """Places from `at` on that hold the gzip magic or a version line, in order; one piece of the file at a time."""
    pattern, reach = re.compile(re.escape(MAGIC) + rb"|WARC/\d\.\d+\r\n"), 16
    while at < size:
        piece = read(PIECE + reach, at)
        yield from (at + m.start() for m in pattern.finditer(piece) if m.start() < PIECE)
        at += PIECE


def salvage(read: Reader, size: int) -> Iterator[tuple[int, int, str | None, Record | None]]:
    """(begin, end, None, record) for each sound record and (begin, end, reason, None) for each gap, in the file's order."""
    at = 0
    while at < size:
        try:
            records, end = take(read, at, size)
        except Damage as e:
            after = None
            for place in ([e.end] if e.end else []) + [None]:
                after = place if place == size or (place and _sound(read, place, size)) else None
                if after:
                    break
            if not after:
                after = next((c for c in candidates(read, at + 1, size) if _sound(read, c, size)), size)
            yield at, after, e.reason, None
            at = after
            continue
        for record in records:
            yield at, end, None, record
        at = end


def _sound(read: Reader, at: int, size: int) -> bool:
    try:
        return bool(take(read, at, size))
    except Damage:
        return False


def read_archives(paths: DataFrame, payloads: bool = True) -> DataFrame:
    """Page records and gaps (reason not null) of the files in column `path`; a task holds one record at a time. `payloads`: whether to return them."""

    def row(path: str, begin: int, end: int, reason: str | None, record: Record | None) -> tuple:
        if record is None:
            return path, begin, end, reason, *[None] * 7
        h = record.headers
        http, _, body = record.block.partition(b"\r\n\r\n")
        revisit, length = h["warc-type"] == "revisit", re.search(rb"(?im)^content-length:\s*(\d+)", http)
        number = lambda name: int(h[name]) if re.fullmatch(r"-?\d{1,19}", h.get(name, "")) else None
        digest = h.get("warc-payload-digest", "")
        code = base64.b32decode(digest[5:].upper()).hex() if re.fullmatch(r"(?i)sha1:[a-z2-7]{32}", digest) else None if revisit else hashlib.sha1(body).hexdigest()
        count = (int(length[1]) if length else None) if revisit else len(body)
        return path, begin, end, None, number("page-id"), h.get("warc-target-uri"), h["warc-type"], body if payloads and not revisit else None, count, code, number("refers-to-page-id")

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        shape = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[t]) for n, t in (c.split() for c in READ.split(", "))])
        for b in frames:
            for path in b["path"].to_pylist():
                files, target = fs.FileSystem.from_uri(path)
                with files.open_input_file(target) as f:
                    rows, held = [], 0
                    for begin, end, reason, record in salvage(lambda n, o: f.read_at(n, o), f.size()):  # noqa: B023
                        if record is not None and record.headers.get("warc-type") not in ("response", "revisit"):
                            continue
                        rows.append(row(path, begin, end, reason, record))
                        held += len(rows[-1][7] or b"") + 200
                        if held > 1 << 22:
                            yield pa.RecordBatch.from_pylist([dict(zip(shape.names, r, strict=True)) for r in rows], shape)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist([dict(zip(shape.names, r, strict=True)) for r in rows], shape)

    names = paths.select("path").distinct()
    return names.repartition(max(1, names.count())).mapInArrow(run, READ)


def records(read: DataFrame) -> DataFrame:
    """Sound page records."""
    return read.filter("reason is null").drop("reason")


def gaps(read: DataFrame) -> DataFrame:
    """The log of what was quarantined: (path, begin, end, reason)."""
    return read.filter("reason is not null").select("path", "begin", "end", "reason")


def restored(found: DataFrame) -> DataFrame:
    """Records with the payload of each revisit put back from a response with the same digest; null where that one was lost."""
    held = found.filter("record_type = 'response'").select("payload_digest", F.col("payload").alias("own")).dropDuplicates(["payload_digest"])
    revisits = found.filter("record_type = 'revisit'").join(held, "payload_digest", "left").withColumn("payload", F.col("own")).drop("own")
    return found.filter("record_type = 'response'").unionByName(revisits)


def archive_digest(spark: SparkSession, pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Write all pages, read the archives back, and give each page's record as they hold it. The archives go once they are read."""
    folder = scratch(spark, "warc")
    index = write_archives(pages, folder, least)
    found = records(read_archives(index, payloads=False)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    kept = store(found, "warc-digest")
    drop(spark, folder)
    return kept


def archive_sql(least: int = LEAST) -> str:
    return f"""
    WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages), m AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS top FROM p)
    SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest, CASE WHEN n >= {least} AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
     CASE WHEN n >= {least} AND page_id < top THEN top END AS refers_to FROM m
    """
