"""Lexical retrieval packing: windows filled with a document's BM25 neighbours.

Documents become token ids once, in a table. Document frequencies and the mean length come from all
documents; there is one frequency for each id of the vocabulary, so they go to every task. Documents are dealt over shards of about a million ids by a lexical key, so that documents that
share rare ids meet in a shard; each shard builds an inverted index with BM25 weights, and windows are
filled greedily: a seed, then its best unused neighbours; the neighbour that crosses the end is cut, its
rest opens the next window and is the next seed. So a shard leaves one window short at most, whatever
the lengths are. Neighbours in other shards stay out of reach (the README has their share).

The key is a chain of minima: ids are ranked once by -ln(u) / idf with a fixed random u, and a document's
key is its three smallest ranks, then bits of a hash of id and text. Two documents have the same first rank with
a probability that is their Jaccard similarity weighted by idf. Shards are ranges of the key that hold about
the same number of ids, so a common first rank is divided by the second, copies by the hash, and equal rows in
turn. The edges come from a sample, so they may differ between runs over other file splits, and so may windows.

The string of a special token inside a text is that token's id, as the library has it.

Defined results: a null text is an empty one and has the end id alone; every row is packed, repeated
rows too, and rows with a null doc_id; a text longer than a window is cut into several; an empty table
gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supportlake.llm.common import batches, store
from supportlake.llm.tokens import id_type, vocabulary_size

WINDOW = 2048
SHARD_TOKENS = 1_000_000
#: Sampled points a shard from which the ranges are cut.
POINTS = 64
K1, B = 1.2, 0.75
#: A token's list is kept as a whole row once more than one document in this many holds it.
DENSE = 8


def token_table(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """(doc_id, ids: little-endian u16, or u32 for vocabularies beyond 65,536 ids, n, deal), a row a document, and a row a task whose `df` counts its documents by id.

    `deal` is a hash of id and text. Document frequencies are counted here, where the ids are at hand.
    """

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from supportlake.llm.tokens import binary_column, by_bytes, library_encoder, with_end

        encoder = library_encoder(vocabulary, end_id)
        df = np.zeros(encoder.size, dtype=np.int64)
        for b in by_bytes(frames):
            ids, edges = with_end(*encoder.encode_column(b["text"]), end_id)
            df += held_once(ids, edges, encoder.size)
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], binary_column(ids, edges), pa.array(np.diff(edges)), b["deal"], pa.nulls(b.num_rows, pa.binary())], names=["doc_id", "ids", "n", "deal", "df"]
            )
        pa.default_memory_pool().release_unused()  # the worker goes on to other tasks
        if df.any():
            packed = zlib.compress(df.astype("<u8").tobytes(), 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array([None], pa.int64()), pa.array([None], pa.binary()), pa.array([0], pa.int64()), pa.array([0], pa.int64()), pa.array([packed], pa.binary())], names=["doc_id", "ids", "n", "deal", "df"]
            )

    read = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("doc_id", "text").alias("deal"))
    return store(read.mapInArrow(run, "doc_id long, ids binary, n long, deal long, df binary"), "packing-tokens")


def held_once(ids: np.ndarray, edges: np.ndarray, size: int) -> np.ndarray:
    """For each token id, the number of texts that hold it."""
    bits = size.bit_length()
    wide = np.uint32 if (len(edges) << bits) < 1 << 32 else np.uint64
    key = (np.repeat(np.arange(len(edges) - 1, dtype=wide), np.diff(edges)) << wide(bits)) | ids
    key.sort()
    first = np.ones(len(key), dtype=bool)
    first[1:] = key[1:] != key[:-1]
    return np.bincount((key[first] & wide((1 << bits) - 1)).astype(np.int64), minlength=size)


def document_frequencies(tokens: DataFrame, size: int) -> np.ndarray:
    """For each token id, the number of documents that hold it, summed over the tasks' counts."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, dtype=np.int64)
        for b in frames:
            for x in b["df"].to_pylist():
                df += np.frombuffer(zlib.decompress(x), dtype="<u8").astype(np.int64)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(df[at])], names=["token", "df"])

    out = np.zeros(size, dtype=np.int64)
    for r in tokens.filter("df is not null").select("df").mapInArrow(run, "token int, df long").groupBy("token").agg(F.sum("df").alias("df")).collect():
        out[r.token] = r.df
    return out


def id_ranks(df: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """The rank of each id by -ln(u) / idf; ids of fewer than two documents, which link nothing, come last. Ranks from 65,534 on, hardly ever a minimum, are one."""
    u = np.random.RandomState(1).random_sample(len(df))
    cost = np.where(df >= 2, -np.log1p(-u) / idf, np.inf)
    ranks = np.empty(len(df), dtype=np.uint16)
    ranks[np.argsort(cost, kind="stable")] = np.minimum(np.arange(len(df)), 0xFFFE)
    return ranks


def lexical_keys(ids: pa.Array, deal: np.ndarray, ranks: np.ndarray, dtype: str) -> np.ndarray:
    """For each document its three smallest ranks and 14 bits of its hash; no document is empty, as the end id is in each."""
    flat, edges = id_runs(ids, dtype)
    last, starts, sizes = np.uint16(0xFFFF), edges[:-1], np.diff(edges)
    found, key = ranks[flat], np.zeros(len(sizes), dtype=np.int64)
    for _ in range(3):
        least = np.minimum.reduceat(found, starts)
        key = (key << 16) | least
        found[found == np.repeat(least, sizes)] = last
    return (key << 14) | (deal & 0x3FFF)


def id_runs(ids: pa.Array, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a binary column, and where each row's begin, with the end of the last. No row is null."""
    _, offsets, data = ids.buffers()
    at = np.frombuffer(offsets, dtype=np.int32)[ids.offset : ids.offset + len(ids) + 1].astype(np.int64)
    width = np.dtype(dtype).itemsize
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]].view(dtype), (at - at[0]) // width


def shard_edges(tokens: DataFrame, ranks, shards: int, shard_tokens: int, dtype: str) -> np.ndarray:
    """Keys at which the next shard begins, from a sample that takes each document in proportion to its length."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(frames, 256):
            yield pa.RecordBatch.from_arrays([pa.array(lexical_keys(b["ids"], b["deal"].to_numpy(), ranks.value, dtype)), b["points"]], names=["key", "points"])

    # Equal rows share a hash, so their place in the scan is mixed in: else all of them or none would be taken.
    random = F.xxhash64("deal", F.monotonically_increasing_id()).bitwiseAND(F.lit(0xFFFFFF)) / (1 << 24)
    points = F.floor(F.col("n") / F.lit(max(1.0, shard_tokens / POINTS)) + random).alias("points")
    sample = tokens.select("ids", "deal", points).filter("points > 0").mapInArrow(run, "key long, points long").toArrow()
    key, points = sample["key"].to_numpy(), sample["points"].to_numpy()
    order = np.argsort(key, kind="stable")
    reached = np.cumsum(points[order])
    return key[order][np.searchsorted(reached, reached[-1] * np.arange(1, shards) / shards)] if len(key) else np.zeros(shards - 1, dtype=np.int64)


def shard_of(key: np.ndarray, edges: np.ndarray, seen: int) -> np.ndarray:
    """The range of each key. A key that fills several ranges (equal rows) is dealt over them in turn."""
    low, high = np.searchsorted(edges, key, side="left"), np.searchsorted(edges, key, side="right")
    return np.where(high - low <= 1, high, low + 1 + (seen + np.arange(len(key))) % np.maximum(high - low, 1))


def deal_out(tokens: DataFrame, df: np.ndarray, idf: np.ndarray, shards: int, shard_tokens: int, dtype: str) -> DataFrame:
    """(doc_id, ids, deal, shard): ranges of the lexical key."""
    if shards == 1:
        return tokens.select("doc_id", "ids", "deal", F.lit(0).cast("long").alias("shard"))
    context = tokens.sparkSession.sparkContext
    ranks = context.broadcast(id_ranks(df, idf))  # one number for each id of the vocabulary
    edges = context.broadcast(shard_edges(tokens, ranks, shards, shard_tokens, dtype))  # one number for each shard

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for b in batches(frames, 256):
            key = lexical_keys(b["ids"], b["deal"].to_numpy(), ranks.value, dtype)
            shard = shard_of(key, edges.value, seen)
            seen += b.num_rows
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["ids"], b["deal"], pa.array(shard, pa.int64())], names=["doc_id", "ids", "deal", "shard"])

    return tokens.select("doc_id", "ids", "deal").mapInArrow(run, "doc_id long, ids binary, deal long, shard long")


class Index:
    """An inverted index of one shard: for each token, its documents and their BM25 weights."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        lengths = np.array([len(d) for d in docs])
        owner = np.repeat(np.arange(len(docs), dtype=np.int64), lengths)
        keys, tf = np.unique((np.concatenate(docs).astype(np.int64) << 32) | owner, return_counts=True)
        token, self.doc = keys >> 32, keys & 0xFFFFFFFF
        norm = K1 * (1 - B + B * lengths / mean)
        self.weight = idf[token] * tf * (K1 + 1) / (tf + norm[self.doc])
        self.starts = np.searchsorted(token, np.arange(len(idf) + 1))
        self.free = np.ones(len(docs), dtype=bool)
        # Lists that hold more than a part in DENSE of all documents stand as whole rows, so that a query adds them in sequence; DENSE times the postings at most.
        heavy = np.flatnonzero(np.diff(self.starts) * DENSE > len(docs))
        self.row = np.full(len(idf), -1)
        self.row[heavy] = np.arange(len(heavy))
        self.rows, own = np.zeros((len(heavy), len(docs))), self.row[token]
        self.rows[own[own >= 0], self.doc[own >= 0]] = self.weight[own >= 0]

    def neighbours(self, text: np.ndarray) -> Iterator[int]:
        """Unused documents by falling score for the tokens of `text`; ties by place."""
        t = np.sort(text)  # by radix for two-byte ids, faster than np.unique
        t = t[np.concatenate([[True], t[1:] != t[:-1]])]
        dense = self.row[t]
        t, dense = t[dense < 0], dense[dense >= 0]
        size = self.starts[t + 1] - self.starts[t]
        at = np.repeat(self.starts[t] - np.cumsum(size) + size, size) + np.arange(size.sum())
        score = np.bincount(self.doc[at], weights=self.weight[at], minlength=len(self.free)) + self.rows[dense].sum(axis=0)
        score[~self.free] = -1
        left = int(self.free.sum())
        for most in (32, left):
            if most >= left:
                top = np.flatnonzero(self.free)
            else:
                edge = np.partition(score, len(score) - most)[len(score) - most]
                top = np.flatnonzero(self.free & (score >= edge))
            for d in top[np.argsort(-score[top], kind="stable")]:
                if self.free[d]:
                    yield int(d)


def fill_windows(docs: list[np.ndarray], idf: np.ndarray, mean: float, window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, window, offset) of one shard."""
    index, pieces = Index(docs, idf, mean), []
    number = fill = 0

    def put(d: int, start: int) -> int:
        nonlocal number, fill
        n = min(len(docs[d]) - start, window - fill)
        pieces.append((d, start, n, number, fill))
        fill += n
        if fill == window:
            number, fill = number + 1, 0
        return start + n

    for first in range(len(docs)):
        if not index.free[first]:
            continue
        seed, start = first, 0
        index.free[seed] = False
        while seed is not None:
            while start < len(docs[seed]):
                last, start = start, put(seed, start)
            if not fill:
                break
            found, seed = index.neighbours(docs[seed][last:]), None
            for d in found:
                index.free[d] = False
                start = put(d, 0)
                if not fill:  # the window closed: what is left of d opens the next one
                    seed = d if start < len(docs[d]) else None
                    break
    return pieces


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, vocabulary: str, end_id: int = 1, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS, with_ids: bool = True) -> DataFrame:
    """One row for each piece; with `with_ids` the column `ids` holds its ids as stored in the token table."""
    size = max(vocabulary_size(vocabulary), end_id + 1)
    dtype, every = id_type(size), token_table(docs, vocabulary, end_id)
    df, tokens = document_frequencies(every, size), every.filter("df is null").drop("df")
    rows, total = tokens.agg(F.count("*"), F.sum("n")).first()
    idf = np.log1p((rows - df + 0.5) / (df + 0.5))
    mean, shards = (total or 0) / max(1, rows), max(1, math.ceil((total or 0) / shard_tokens))
    shared = docs.sparkSession.sparkContext.broadcast(idf.astype(np.float64))  # one number for each id of the vocabulary

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["doc_id", "deal"], kind="stable")
        ids = [np.frombuffer(x, dtype=dtype) for x in g.ids]
        names, shard = g.doc_id.tolist(), int(g.shard.iloc[0])
        out = []
        for d, start, n, number, offset in fill_windows(ids, shared.value, mean, window):
            part = ids[d][start : start + n]
            out.append((names[d], start, n, zlib.crc32(part.astype("<u4").tobytes()), len(ids[d]), (shard << 32) | number, offset, *([part.tobytes()] if with_ids else [])))
        result = pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])])
        result["doc_id"] = result["doc_id"].astype("Int64")
        return result

    return deal_out(tokens, df, idf, shards, shard_tokens, dtype).groupBy("shard").applyInPandas(run, PIECES + (", ids binary" if with_ids else ""))
