"""Token ids as length-delimited binary records, with a separate offset index.

A record is: length of the payload (u64), its masked checksum (u32), payload, the payload's masked
checksum (u32), all little-endian. The checksum is CRC-32C, masked by a rotation of 15 bits and a
constant so that checksums of data that holds checksums stay sound. The payload is: a flag byte
(1: the id is null, 2: ids are u32), the document's id (i64), then its token ids as u16, or as u32 for
vocabularies beyond 65,536 ids.

Documents are dealt by ranges of doc_id, sorted within, and each partition writes one shard file
under a name of its own in a folder of attempts, then moves it into place; a repeated or speculative
task only replaces the file by an equal one, and what stopped attempts leave goes with their folder.
The number of shards grows with the text (`SHARD_CHARS`). The index is a Parquet table.

Defined results: a null text is an empty one (its record holds the end id alone); the string of a
special token inside a text is that token's id, as the library has it; a null doc_id sorts first; rows with equal ids follow
each other, by text; an empty table has no shards and an empty index; other columns are ignored.
Records are the result of `write_records` and stay in the folder the caller names.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from supportlake.llm.common import batches, drop, scratch
from supportlake.llm.tokens import by_bytes, library_encoder, with_end

#: Fixed values of the format: CRC-32C's reversed polynomial and the mask's constant.
POLYNOMIAL, MASK_DELTA = 0x82F63B78, 0xA282EAD8
BLOCK = 256
FRAME, HEAD = "<QI", "<Bq"
NULL_ID, WIDE = 1, 2
#: Characters of text a shard holds, about.
SHARD_CHARS = 16_000_000


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The byte table, and for each byte of a state what it becomes after BLOCK zero bytes."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(POLYNOMIAL), table >> 1).astype(np.uint32)
    shift = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    for _ in range(BLOCK):
        shift = table[shift & 0xFF] ^ (shift >> 8)
    return table, shift


def crc32c(buffers: list[bytes]) -> np.ndarray:
    """CRC-32C of many buffers at once, each of four bytes or more.

    The checksum is linear, so blocks of all buffers are worked side by side and then folded.
    With the first four bytes inverted the state starts at zero, and zeros in front change nothing.
    """
    table, shift = _tables()
    sizes = np.array([len(b) for b in buffers])
    blocks = -(-sizes // BLOCK)
    last = np.cumsum(blocks)
    data = np.zeros(int(last[-1]) * BLOCK, dtype=np.uint8)
    for b, end in zip(buffers, last * BLOCK, strict=True):
        data[end - len(b) : end] = np.frombuffer(b, dtype=np.uint8)
    at = (last * BLOCK - sizes)[:, None] + np.arange(4)
    data[at] ^= 0xFF
    columns = np.ascontiguousarray(data.reshape(-1, BLOCK).T)
    state = np.zeros(columns.shape[1], dtype=np.uint32)
    for c in columns:
        state = table[(state ^ c) & 0xFF] ^ (state >> 8)
    out = np.zeros(len(buffers), dtype=np.uint32)
    for k in range(int(blocks.max()), 0, -1):  # the k-th block from the end
        on = np.flatnonzero(blocks >= k)
        o = out[on]
        out[on] = shift[0][o & 0xFF] ^ shift[1][(o >> 8) & 0xFF] ^ shift[2][(o >> 16) & 0xFF] ^ shift[3][o >> 24] ^ state[last[on] - k]
    return out ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> 15) | (crc << 17)) + np.uint32(MASK_DELTA)


def frame(payloads: list[bytes]) -> list[bytes]:
    heads = masked(crc32c([struct.pack("<Q", len(p)) for p in payloads]))
    bodies = masked(crc32c(payloads))
    return [struct.pack(FRAME, len(p), int(h)) + p + struct.pack("<I", int(b)) for p, h, b in zip(payloads, heads, bodies, strict=True)]


def unframe(data: list[tuple[bytes, bytes, bytes]]) -> None:
    """Check (length, payload, checksum) parts as read; raise on damage."""
    want = np.frombuffer(b"".join(h[8:12] for h, _, _ in data), dtype="<u4"), np.frombuffer(b"".join(c for _, _, c in data), dtype="<u4")
    have = masked(crc32c([h[:8] for h, _, _ in data])), masked(crc32c([p for _, p, _ in data]))
    if not all(np.array_equal(a, b) for a, b in zip(want, have, strict=True)):
        raise ValueError("damaged record: a checksum differs")


INDEX = "shard int, path string, doc_id long, offset long, bytes long, n_tokens long"


def write_records(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 2, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """Write shard files below `folder` and return their offset index, read back from its own table."""

    def write(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        path, aside = f"{folder}/shards/{shard:06d}.rec", f"{folder}/attempts/{uuid.uuid4().hex}"
        store, target = fs.FileSystem.from_uri(path)
        own = fs.FileSystem.from_uri(aside)[1]
        for name in (target, own):
            store.create_dir(name.rpartition("/")[0], recursive=True)
        encoder, out, at = library_encoder(vocabulary, end_id), None, 0
        wide = WIDE if encoder.dtype.itemsize == 4 else 0
        for b in by_bytes(frames):
            names = b["doc_id"].to_pylist()
            ids, edges = with_end(*encoder.encode_column(b["text"]), end_id)
            raw, places = ids.tobytes(), (edges * ids.itemsize).tolist()
            heads = (struct.pack(HEAD, wide | (NULL_ID if i is None else 0), i or 0) for i in names)
            records = frame([h + raw[x:y] for h, x, y in zip(heads, places[:-1], places[1:], strict=True)])
            out = out or store.open_output_stream(own)
            sizes = np.array([len(r) for r in records])
            offsets = at + np.cumsum(sizes) - sizes
            out.write(b"".join(records))
            at += int(sizes.sum())
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard] * len(names), pa.int32()), pa.array([path] * len(names)), pa.array(names, pa.int64()), pa.array(offsets), pa.array(sizes), pa.array(np.diff(edges))],
                names=["shard", "path", "doc_id", "offset", "bytes", "n_tokens"],
            )
        if out:
            out.close()
            store.move(own, target)

    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    dealt = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(max(1, -(-chars // shard_chars)), "doc_id").sortWithinPartitions("doc_id", "text")
    dealt.mapInArrow(write, INDEX).write.parquet(f"{folder}/index")
    drop(docs.sparkSession, f"{folder}/attempts")
    return docs.sparkSession.read.schema(INDEX).parquet(f"{folder}/index")


def read_part(source, start: int | None = None) -> tuple[bytes, bytes, bytes] | None:
    """The next record's parts from an open file, None at its end."""
    if start is not None:
        source.seek(start)
    head = source.read(struct.calcsize(FRAME))
    if not head:
        return None
    payload = source.read(struct.unpack(FRAME, head)[0])
    return head, payload, source.read(4)


def parse(payload: bytes) -> tuple[int | None, np.ndarray]:
    flags, doc_id = struct.unpack_from(HEAD, payload)
    return None if flags & NULL_ID else doc_id, np.frombuffer(payload, dtype="<u4" if flags & WIDE else "<u2", offset=struct.calcsize(HEAD))


READ = "shard int, doc_id long, local_start long, n_tokens long, ids_crc32 long"


def scan_records(index: DataFrame) -> DataFrame:
    """Read every shard from its first byte to its last; checksums are verified. One task holds one slice of a shard."""

    def read(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in frames:
            for shard, path in zip(b["shard"].to_pylist(), b["path"].to_pylist(), strict=True):
                store, target = fs.FileSystem.from_uri(path)
                with store.open_input_stream(target, buffer_size=1 << 20) as source:
                    start = 0
                    while parts := [p for p in (read_part(source) for _ in range(256)) if p]:
                        unframe(parts)
                        rows = []
                        for doc_id, ids in (parse(p) for _, p, _ in parts):
                            rows.append((shard, doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                            start += len(ids)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), *[pa.int64()] * 4), strict=True)],
                            names=["shard", "doc_id", "local_start", "n_tokens", "ids_crc32"],
                        )

    n = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return index.select("shard", "path").distinct().repartition(n, "shard").mapInArrow(read, READ)


def fetch(index: DataFrame) -> DataFrame:
    """Random access: the records that the rows of `index` name, in any order and number."""

    def read(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in batches(frames, 256):
            docs, tokens, files = [], [], {}
            for path, offset in zip(b["path"].to_pylist(), b["offset"].to_pylist(), strict=True):
                if path not in files:
                    store, target = fs.FileSystem.from_uri(path)
                    files[path] = store.open_input_file(target)
                part = read_part(files[path], offset)
                unframe([part])
                doc_id, ids = parse(part[1])
                docs.append(doc_id)
                tokens.append(ids.astype(np.int32))
            for f in files.values():
                f.close()
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(tokens, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return index.mapInArrow(read, "doc_id long, ids array<int>")


def shard_starts(index: DataFrame) -> DataFrame:
    """Ids before each shard. The window sees one row a shard, not one a document."""
    totals = index.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))


def record_digest(spark: SparkSession, docs: DataFrame, vocabulary: str, end_id: int = 2) -> DataFrame:
    """Write, read back, and give each document's place and checksum as the files hold them."""
    index = write_records(docs, scratch(spark, "records"), vocabulary, end_id)
    found = scan_records(index).join(shard_starts(index), "shard")
    return found.select("doc_id", (F.col("shard_start") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
