"""Exact inner-product search over cells of vectors (R2).

Every vector goes to the cell of its nearest pivot. For a cell with centre c and radius r no vector in it has an inner
product with q above q.c + |q| r. So a question first visits the cell whose centre is best for it; the k-th
score found there is a floor, and in the second round it visits only the cells whose bound reaches that floor. Vectors
without clusters have wide cells that all bounds reach: then every cell is visited, as in a plain search.

Defined results: null vectors and null ids take no part; vectors match only questions of their length; equal scores (rounded) go by
chunk_id; questions that share a query_id are one, with the best of their scores; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from supportlake.functions.tables import OwnTable

#: Pivots at most, and vectors for each where there are fewer. Pivots and the cells' sizes are all that the driver holds.
PIVOTS, PER_PIVOT = 256, 50
#: Vectors and questions that meet in one task.
VECTORS, QUESTIONS = 20_000, 2_000
#: Scores of a task at once, and questions whose visits to all cells are listed at once.
SCORES, VISITS = 2_000_000, 64
#: Vectors up to which one task a length takes all of them and cells do not pay.
PLAIN = 5_000
ROUND = 6


def _by_length(x: pd.Series) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, matrix) for each length of vectors."""
    sizes = x.map(len).to_numpy()
    for dim in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == dim)
        yield dim, at, np.stack([np.asarray(v, np.float64) for v in x.iloc[at]]).reshape(len(at), dim)


def _slices(frames: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    """Frames of at most `rows` rows, so that what is made of one stays small."""
    for f in frames:
        for at in range(0, len(f), rows):
            yield f.iloc[at : at + rows]


def _centres(pivots: dict[int, np.ndarray], dim: int) -> np.ndarray:
    return pivots.get(dim, np.zeros((1, dim)))


def dense_topk(queries: DataFrame, vectors: DataFrame, k: int = 20, threshold: float = 0.7, products=None) -> DataFrame:
    """R2: the k highest inner products of each question (query_id, qvec) with all vectors (chunk_id, vector), then score >= threshold, rounded to 4.

    `products` is an accumulator that gets the number of inner products computed.
    """
    rows = vectors.filter("vector is not null and chunk_id is not null").select("chunk_id", F.col("vector").cast("array<double>").alias("x"))
    n = rows.count()
    kinds = {"chunk_id": dict(vectors.dtypes)["chunk_id"], "query_id": dict(queries.dtypes)["query_id"]}
    asked = queries.filter("qvec is not null and query_id is not null").select("query_id", F.col("qvec").cast("array<double>").alias("x"))

    def best_of(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": left.query_id[:0], "chunk_id": right.chunk_id[:0], "raw": np.zeros(0)})
        if not len(left) or not len(right):
            return none
        right = right.sort_values("chunk_id")
        ids, m = right.chunk_id.to_numpy(), np.stack(right.x.tolist())
        kept, scores, sizes = [], [], []
        for some in _slices([left], min(QUESTIONS, max(1, SCORES // len(m)))):
            raw = np.stack(some.x.tolist()) @ m.T
            if products is not None:
                products.add(raw.size)
            for exact, row in zip(raw, np.round(raw, ROUND), strict=True):
                if len(row) > k:
                    least = np.partition(row, -k)[-k]
                    keep = np.concatenate([np.flatnonzero(row > least), np.flatnonzero(row == least)[: k - int((row > least).sum())]])
                else:
                    keep = np.arange(len(row))
                kept.append(keep)
                scores.append(exact[keep])
                sizes.append(len(keep))
        return pd.DataFrame({"query_id": np.repeat(left.query_id.to_numpy(), sizes), "chunk_id": ids[np.concatenate(kept)], "raw": np.concatenate(scores)})

    def ranked(some: DataFrame) -> DataFrame:
        once = some.groupBy("query_id", "chunk_id").agg(F.max("raw").alias("raw"))
        order = Window.partitionBy("query_id").orderBy(F.desc(F.round("raw", ROUND)), "chunk_id")
        return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    shape = f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, raw double"
    turns = max(1, -(-asked.count() // QUESTIONS))  # groups of questions, each of which meets a cell by itself
    of_group = F.pmod(F.xxhash64("query_id"), F.lit(turns)).cast("int").alias("qs")
    every_group = F.explode(F.sequence(F.lit(0), F.lit(turns - 1))).alias("qs")
    if n <= PLAIN:
        keyed = lambda df, group: df.select("*", F.size("x").alias("dim"), group).groupBy("dim", "qs")
        found = ranked(keyed(asked, of_group).cogroup(keyed(rows, every_group)).applyInPandas(best_of, shape)).filter(F.col("raw") >= threshold)
        return found.select("query_id", "chunk_id", F.round("raw", 4).alias("score"), "rank")
    picked = rows.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(min(PIVOTS, max(1, n // PER_PIVOT))).select("x").toPandas()
    pivots = {dim: m for dim, _, m in _by_length(picked.x)}

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            cell, apart = np.zeros(len(f), np.int32), np.zeros(len(f))
            for dim, at, m in _by_length(f.x):
                c = _centres(pivots, dim)
                near = ((c * c).sum(axis=1)[None, :] - 2 * (m @ c.T)).argmin(axis=1)
                cell[at], apart[at] = near, np.sqrt(((m - c[near]) ** 2).sum(axis=1))
            yield f.assign(dim=f.x.map(len).astype("int32"), cell=cell, apart=apart)

    placed = OwnTable(rows.mapInPandas(place, f"chunk_id {kinds['chunk_id']}, x array<double>, dim int, cell int, apart double"), "vector-cells").df
    known = placed.groupBy("dim", "cell").agg(F.max("apart").alias("radius"), F.count("*").alias("n")).collect()  # a row a pivot, and one for each other length
    cells: dict[int, list] = {}
    for r in sorted(known, key=lambda r: (r.dim, r.cell)):
        cells.setdefault(r.dim, []).append((r.cell, r.radius, -(-r.n // VECTORS)))
    parts = {(dim, cell): p for dim, held in cells.items() for cell, _, p in held}

    def visit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A row for each question and cell of its length: (…, cell, part, bound, turn)."""
        shape = ["query_id", "x", "dim", "cell", "part", "bound", "turn"]
        for f in _slices(frames, VISITS):
            out = [pd.DataFrame([], columns=shape)]
            for dim, at, m in _by_length(f.x):
                if dim not in cells:
                    continue
                own = cells[dim]
                c, radius = _centres(pivots, dim)[[x[0] for x in own]], np.array([x[1] for x in own])
                dots = m @ c.T
                bound = dots + np.sqrt((m * m).sum(axis=1))[:, None] * radius[None, :] * (1 + 1e-9) + 1e-9
                best = dots.argmax(axis=1)
                splits = [np.arange(x[2]) for x in own]
                one = np.repeat(np.arange(len(own)), [len(x) for x in splits])  # a cell's number for each of its parts
                part, cell = np.concatenate(splits), np.array([x[0] for x in own])[one]
                i, j = np.repeat(np.arange(len(at)), len(one)), np.tile(one, len(at))
                out.append(pd.DataFrame({"query_id": f.query_id.to_numpy()[at[i]], "x": f.x.to_numpy()[at[i]], "dim": dim, "cell": np.tile(cell, len(at)), "part": np.tile(part, len(at)), "bound": bound[i, j], "turn": (best[i] != j).astype(int)}))
            yield pd.concat(out, ignore_index=True)[shape]

    visits = OwnTable(asked.mapInPandas(visit, f"query_id {kinds['query_id']}, x array<double>, dim int, cell int, part int, bound double, turn int"), "vector-visits").df
    split = F.coalesce(F.create_map(*[x for (d, c), p in parts.items() for x in (F.lit(f"{d}:{c}"), F.lit(p))])[F.concat_ws(":", "dim", "cell")], F.lit(1)) if parts else F.lit(1)
    held = placed.withColumn("part", F.pmod(F.xxhash64("chunk_id"), split).cast("int"))

    def scored(some: DataFrame) -> DataFrame:
        keys = ["dim", "cell", "part"]
        left = some.select("query_id", "x", *keys, of_group).groupBy(*keys, "qs")
        right = held.select(*(F.col(c).alias(c) for c in ("chunk_id", "x", *keys)), every_group).groupBy(*keys, "qs")
        return left.cogroup(right).applyInPandas(best_of, shape)

    first = OwnTable(scored(visits.filter("turn = 0").select("query_id", "x", "dim", "cell", "part")), "vector-first").df
    floors = ranked(first).filter(F.col("rank") == k).select("query_id", F.col("raw").alias("floor"))
    rest = visits.filter("turn = 1").join(floors, "query_id", "left").filter("floor is null or bound >= floor - 2e-6")
    found = ranked(first.union(scored(rest.select("query_id", "x", "dim", "cell", "part")))).filter(F.col("raw") >= threshold)
    return OwnTable(found.select("query_id", "chunk_id", F.round("raw", 4).alias("score"), "rank"), "vector-found").df
