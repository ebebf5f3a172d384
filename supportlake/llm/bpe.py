"""Byte-level BPE by a hierarchical-bitmap rank queue.

Adjacent pairs that can merge wait in buckets, one bucket a merge rank, as positions in a linked
list of tokens. A bitmap of two levels, 256 bits a word, tells which buckets hold something; finding the
first set bit of each level gives the next rank. Entries whose pair has changed since are skipped when taken out.
A pre-token of n bytes costs O(n) merges of near-constant cost, however long it is.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from supportlake.llm.common import batches
from supportlake.llm.tokens import PieceEncoder, binary_column, by_bytes


class Bpe:
    """Ranks are ids: merging a pair of rank r gives token r."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: b for b, i in ranks.items()}
        self.single = [ranks.get(bytes([b]), -1) for b in range(256)]
        # The rank queue, empty between calls: bit k of word w stands for rank 256 w + k, bit w of the top for word w.
        self.words = [0] * ((max(ranks.values(), default=0) >> 8) + 1)
        self.buckets: dict[int, list[int]] = {}
        self.table: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token. A piece that is itself a token stays whole."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        rank_of, words, buckets, n = self.ranks.get, self.words, self.buckets, len(piece)
        top = 0
        token = [self.single[b] for b in piece]
        # Token i spans piece[i:end[i]], and end[i] is where the next one starts. pair[i]: the rank of merging both.
        end, back, pair = list(range(1, n + 1)), list(range(-1, n)), [-1] * n
        for i in range(n - 1):
            r = rank_of(piece[i : i + 2])
            if r is not None:
                pair[i] = r
                if r in buckets:
                    buckets[r].append(i)
                else:
                    buckets[r] = [i]
                    words[r >> 8] |= 1 << (r & 255)
                    top |= 1 << (r >> 8)
        while top:
            w = (top & -top).bit_length() - 1
            bits = words[w]
            rank = (w << 8) + (bits & -bits).bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                i = heappop(bucket)
            else:
                i = bucket[0]
                del buckets[rank]
                words[w] = bits = bits & (bits - 1)
                if not bits:
                    top &= top - 1
            if pair[i] != rank:  # stale: one side was merged since
                continue
            token[i] = rank
            j = end[i]
            k = end[i] = end[j]
            pair[i] = pair[j] = -1
            for at, stop in ((i, end[k] if k < n else 0), (back[i], k)):
                if at < 0 or not stop:
                    continue
                r = rank_of(piece[at:stop])
                if r is None:
                    pair[at] = -1
                    continue
                pair[at] = r
                if r in buckets:
                    heappush(buckets[r], at)
                else:
                    buckets[r] = [at]
                    words[r >> 8] |= 1 << (r & 255)
                    top |= 1 << (r >> 8)
            if k < n:
                back[k] = i
        out, i = [], 0
        while i < n:
            out.append(token[i])
            i = end[i]
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def decode_runs(self, ids: np.ndarray, edges: np.ndarray) -> list[bytes]:
        """The bytes of each run of ids (of which `edges` gives the bounds), gathered from one table of all tokens' bytes."""
        if self.table is None:
            parts = [self.tokens.get(i, b"") for i in range(max(self.tokens, default=-1) + 1)]
            sizes = np.array([len(p) for p in parts], dtype=np.int64)
            self.table = np.frombuffer(b"".join(parts), dtype=np.uint8), np.cumsum(sizes) - sizes, sizes
        data, starts, sizes = self.table
        n = sizes[ids]
        reached = np.concatenate([[0], np.cumsum(n)])
        raw = data[np.repeat(starts[ids] - reached[:-1], n) + np.arange(reached[-1])].tobytes()
        at = reached[edges].tolist()
        return [raw[x:y] for x, y in zip(at[:-1], at[1:], strict=True)]


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


_loaded: dict[tuple[str, str], tuple[Bpe, PieceEncoder]] = {}


def worker_bpe(path: str, pattern: str) -> tuple[Bpe, PieceEncoder]:
    """One coder a worker and vocabulary. Pre-tokens and the pieces between spaces are both cached."""
    if (path, pattern) not in _loaded:
        import regex

        bpe, split, known = Bpe(load_ranks(path)), regex.compile(pattern).findall, {}

        def encode_piece(piece: str) -> list[int]:
            if len(known) > 200_000:
                known.clear()
            ids: list[int] = []
            for t in split(piece):
                if (found := known.get(t)) is None:
                    found = bpe.encode_piece(t.encode())
                    if len(t) < 64:
                        known[t] = found
                ids += found
            return ids

        _loaded[path, pattern] = bpe, PieceEncoder(encode_piece, lambda word, spaced: bpe.encode_piece((" " + word if spaced else word).encode()), len(bpe.ranks))
    return _loaded[path, pattern]


CODED = "doc_id long, ids binary, decoded_sha256 string"


def encode_texts(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id and the ids of its whole text as little-endian u32, one row an input row, without any shuffle.

    Defined results: a null text is an empty one and has no ids; an empty table gives none; a text
    of one giant pre-token costs time in proportion to its length; other columns are ignored.
    """

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, encoder = worker_bpe(ranks_path, pattern)
        for b in by_bytes(frames):
            ids, edges = encoder.encode_column(b["text"])
            yield pa.RecordBatch.from_arrays([b["doc_id"].cast(pa.int64()), binary_column(ids.astype("<u4"), edges)], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary")


def decode_ids(coded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id and the decoded bytes of `ids`."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, _ = worker_bpe(ranks_path, pattern)
        for b in batches(frames, 128):
            raw = [bpe.decode(np.frombuffer(x, dtype="<u4").tolist()) for x in b["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(raw, pa.binary())], names=["doc_id", "decoded"])

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")


DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def round_trip_digest(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Encode, decode from the ids, and give both digests, in one pass over the texts."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, encoder = worker_bpe(ranks_path, pattern)
        for b in by_bytes(frames):
            ids, edges = encoder.encode_column(b["text"])
            raw, at = ids.astype("<u4").tobytes(), (4 * edges).tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    b["doc_id"].cast(pa.int64()),
                    pa.array(np.diff(edges)),
                    pa.array([hashlib.sha256(raw[x:y]).hexdigest() for x, y in zip(at[:-1], at[1:], strict=True)]),
                    pa.array([hashlib.sha256(text).hexdigest() for text in bpe.decode_runs(ids, edges)]),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, DIGEST)
