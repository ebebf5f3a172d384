"""Hard negatives by a secondary-sort shuffle.

Scores of an anchor's pairs are packed into one binary key (anchor, descending score, positives before
negatives, id) whose bytes sort as its parts do. Rows are repartitioned by anchor and sorted within
partitions by that key, and one pass over each partition opens a window for a positive and emits the
negatives that fall into it. The pass keeps one anchor's open windows, never its rows.

Before that shuffle, pairs are combined where they are made, so that it carries a few rows for each
anchor and block of rows and not all pairs. Anchors and rows are dealt into blocks that meet by a
matrix product. The first round sends on each block's best rows of the anchor's label, of which the best of
all are the positives. The second knows their scores and sends on each block's best rows of every window.
The best of all blocks are among the best of each, so nothing is lost.

Defined results: rows with a null vec_id, label or vector, or with a null or non-finite component, take no
part; of rows that share a vec_id one counts, the smallest by label and components; vectors of another
length than the anchor's match nothing, empty ones score 0; equal scores go by vec_id; scores and components
beyond 64 bits stand at the nearest 64-bit number; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from supportlake.llm.common import drop_table, store

#: Anchors and rows of a block, and anchors whose products are held at once.
ANCHOR_BLOCK, ROW_BLOCK, AT_ONCE = 1024, 16_384, 64
#: A packed key: anchor, complement of the score, 0 for positives and 1 for negatives, id. Signed numbers are shifted by half their range.
KEY = np.dtype([("anchor", ">u8"), ("score", ">u8"), ("kind", "u1"), ("id", ">u8")])
HALF = 1 << 63
OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def clean_rows(table: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, label, q): usable rows with integer components, one for each vec_id."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = table.filter("vec_id is not null and label is not null and embedding is not null").filter(~F.coalesce(bad, F.lit(False)))
    top = float(1 << 62)  # components beyond stand there
    whole = F.transform(v, lambda x: F.floor(F.greatest(F.least(x * scale, F.lit(top)), F.lit(-top))))
    rows = usable.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), whole.cast("array<bigint>").alias("q"))
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("r")).select("vec_id", "r.label", "r.q")


def matrix(lists: pa.ChunkedArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, vectors) for each length of vectors."""
    column = lists.combine_chunks()
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    out = []
    for dim in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == dim)
        out.append((at, column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), dim)))
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all rows of a with all rows of b, in doubles where these are exact."""
    most = (int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0))) * a.shape[1]
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < HALF:
        return a @ b.T
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, -HALF, HALF - 1).astype(np.int64)


def first_best(scores: np.ndarray, n: int) -> np.ndarray:
    """Places of the n highest scores, equal ones by place."""
    if len(scores) > n:
        least = np.partition(scores, -n)[-n]
        above = np.flatnonzero(scores > least)
        at = np.concatenate([above, np.flatnonzero(scores == least)[: n - len(above)]])
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((at, ~scores[at]))]


def window(positive: int, low: int, high: int) -> tuple[int, int]:
    """The least and largest integer score s with low*positive <= 100*s <= high*positive."""
    return -(-low * positive // 100), high * positive // 100


def pack(anchor: int | np.ndarray, scores: np.ndarray, kind: int, ids: np.ndarray) -> np.ndarray:
    out = np.empty(len(ids), KEY)
    shifted = lambda x: np.asarray(x, np.int64).view(np.uint64) ^ np.uint64(HALF)
    out["anchor"], out["score"], out["kind"], out["id"] = shifted(anchor), ~shifted(scores), kind, shifted(ids)
    return out


def key_table(parts: list[np.ndarray]) -> pa.Table:
    raw = b"".join(p.tobytes() for p in parts)  # a concatenated array would have the machine's byte order
    n = len(raw) // KEY.itemsize
    edges = (np.arange(n + 1) * KEY.itemsize).astype(np.int32)
    return pa.table([pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(edges), pa.py_buffer(raw)])], names=["key"])


def unpacked(keys: list[bytes]) -> Iterator[tuple[int, int, int, int]]:
    """(anchor, score, kind, id) of each key."""
    for anchor, score, kind, i in struct.iter_unpack(">QQBQ", b"".join(keys)):
        yield anchor - HALF, HALF - 1 - score, kind, i - HALF


def by_blocks(anchors: DataFrame, rows: DataFrame, sizes: tuple[int, int], pick: Callable, schema: str = "key binary") -> DataFrame:
    """Every block of anchors with every block of rows: pick(anchor, scores of the other rows' label or not, ...) gives packed keys."""
    na, nr = (max(1, -(-n // block)) for n, block in zip(sizes, (ANCHOR_BLOCK, ROW_BLOCK), strict=True))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    deal = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    rows = rows.select(*(F.col(c).alias(c) for c in rows.columns))  # columns of its own, as anchors may come from the same table
    left = anchors.select("*", deal(na).alias("ab"), every(nr).alias("rb")).repartition(na * nr, "ab", "rb")
    right = rows.select("*", deal(nr).alias("rb"), every(na).alias("ab")).repartition(na * nr, "ab", "rb")

    def meet(one: pa.Table, other: pa.Table) -> pa.Table:
        parts: list[np.ndarray] = []
        if one.num_rows and other.num_rows:
            other = other.sort_by("vec_id")
            ids, labels = other["vec_id"].to_numpy(), other["label"].to_numpy()
            names, own = one["vec_id"].to_numpy(), one["label"].to_numpy()
            windows = one["scores"].to_pylist() if "scores" in one.column_names else None
            sides = {x.shape[1]: (at, x) for at, x in matrix(other["q"])}
            for at, x in matrix(one["q"]):
                if x.shape[1] not in sides:
                    continue
                where, y = sides[x.shape[1]]
                of = {int(label): labels[where] == label for label in np.unique(own[at])}
                for s in range(0, len(at), AT_ONCE):
                    for i, row in zip(at[s : s + AT_ONCE].tolist(), products(x[s : s + AT_ONCE], y), strict=True):
                        parts.append(pick(int(names[i]), row, of[int(own[i])], ids[where], windows[i] if windows else None))
        return key_table(parts)

    return left.groupBy("ab", "rb").cogroup(right.groupBy("ab", "rb")).applyInArrow(meet, schema)


def hard_negatives(table: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, relabel: int = 7) -> DataFrame:
    """Anchors (vec_id divisible by `every`), their first positives, and for each its first negatives with low*p <= 100*n <= high*p.

    Where vec_id is divisible by `relabel`, a label becomes (label+1)%10.
    """
    label = F.when(F.col("vec_id") % relabel == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = store(clean_rows(table).withColumn("label", label), "negative-rows")
    anchors = rows.filter(F.col("vec_id") % every == 0)
    n = rows.agg(F.count_if(F.col("vec_id") % every == 0).alias("a"), F.count("*").alias("r")).first()

    def alike(anchor: int, scores: np.ndarray, same: np.ndarray, ids: np.ndarray, _) -> np.ndarray:
        at = np.flatnonzero(same & (ids != anchor))
        at = at[first_best(scores[at], positives)]
        return pack(anchor, scores[at], 0, ids[at])

    def others(anchor: int, scores: np.ndarray, same: np.ndarray, ids: np.ndarray, held: list[int]) -> np.ndarray:
        spans = [window(p, low, high) for p in held]
        at = np.flatnonzero(~same & (scores >= min(a for a, _ in spans)) & (scores <= max(b for _, b in spans)))
        at = at[np.lexsort((at, ~scores[at]))]
        found = [at[np.flatnonzero((scores[at] >= a) & (scores[at] <= b))[:negatives]] for a, b in spans]
        at = np.unique(np.concatenate(found))
        return pack(anchor, scores[at], 1, ids[at])

    chosen = store(first_of_anchor(by_blocks(anchors, rows, (n.a, n.r), alike), positives), "negative-positives")
    held = chosen.groupBy("anchor").agg(F.collect_list("score").alias("scores"))
    asking = anchors.join(held, F.col("vec_id") == F.col("anchor")).select("vec_id", "label", "q", "scores")
    pairs = chosen.select("key").union(by_blocks(asking, rows, (n.a, n.r), others))
    found = store(secondary_sort(pairs).mapInArrow(lambda frames: emit(frames, negatives, low, high), OUT), "hard-negatives")
    drop_table(rows, chosen)
    return found


def secondary_sort(pairs: DataFrame) -> DataFrame:
    """Rows of an anchor in one partition, sorted by the packed key. The sort is Spark's own and spills."""
    return pairs.withColumn("anchor", F.substring("key", 1, 8)).repartition("anchor").sortWithinPartitions("key").select("key")


def first_of_anchor(pairs: DataFrame, n: int) -> DataFrame:
    """(key, anchor, score): the first n keys of each anchor; Spark cuts this window before its shuffle."""
    top = pairs.withColumn("a", F.substring("key", 1, 8)).withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy("key"))).filter(F.col("r") <= n)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            parts = list(unpacked(b["key"].to_pylist()))
            yield pa.RecordBatch.from_arrays([b["key"], pa.array([p[0] for p in parts], pa.int64()), pa.array([p[1] for p in parts], pa.int64())], names=["key", "anchor", "score"])

    return top.select("key").mapInArrow(run, "key binary, anchor long, score long")


def emit(frames: Iterator[pa.RecordBatch], negatives: int, low: int, high: int) -> Iterator[pa.RecordBatch]:
    """One pass over sorted keys. A positive opens its window; a negative goes to each open window that holds it and is not full."""
    anchor, open_ = None, []
    for b in frames:
        out = []
        for a, score, kind, i in unpacked(b["key"].to_pylist()):
            if a != anchor:
                anchor, open_ = a, []
            if kind == 0:
                open_.append([i, score, *window(score, low, high), 0])
                continue
            for w in open_:
                if w[2] <= score <= w[3] and w[4] < negatives:
                    w[4] += 1
                    out.append((a, w[0], w[4], i, w[1], score))
            open_ = [w for w in open_ if w[4] < negatives and score >= w[2]]
        columns = zip(*out, strict=True) if out else [()] * 6
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in OUT.split(", ")])


def negatives_sql() -> str:
    """The same negatives in DuckDB SQL."""
    dot = "list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i]))"
    return f"""
    WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
      FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST({dot} AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0),
    p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
    SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank, other AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
    QUALIFY rank <= 3
    """
