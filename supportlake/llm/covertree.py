"""Embedding near-duplicates: a dual traversal of cover trees, exact for a cosine threshold.

Vectors become points on the unit sphere, where a cosine is a distance. Rows compare only within
their label. Equal vectors are one point with a weight, so copies cost nothing. A label's points are
cut into cells around spread-out centres, the tree's top level; a cell too large for one task is cut
by hash into blocks. Pairs of cells whose covering balls lie further apart than the threshold are
never formed. The rest meet as block pairs, one group each: both sides grow a cover tree (nested
levels, radii halving) and the pair of roots is traversed. A node pair is pruned when
d - r1 - r2 exceeds the threshold; pairs of small nodes are compared exactly, in double precision.

Defined results: rows with a null label, a null vector, a zero vector, null or non-finite components
or a length unlike others of the label link with nothing (lengths that differ never match); rows that
share a vec_id are one vector: each of their embeddings may link it, its links add up, and its rows share
one component; a cosine equal to the threshold is a link; a null vec_id has no component and is kept; an
empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supportlake.llm.common import drop_table, store
from supportlake.llm.components import connected_components
from supportlake.llm.minhash import Forest

#: Points a block may hold, and points a tree node may hold before it is split further.
BLOCK, LEAF = 2048, 64
#: Cells a label is cut into at most; larger cells are cut further by hash. It bounds the sample that one task sees.
MAX_CELLS = 4096
#: Widening of bounds against rounding; exact comparison decides within it.
SLACK = 1e-9


def unit(x: np.ndarray) -> np.ndarray:
    """Unit vectors. Rows are first scaled by a power of two, which is exact, so that no square overflows or vanishes."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


class Node:
    __slots__ = ("at", "center", "children", "radius")

    def __init__(self, at: np.ndarray, center: np.ndarray, radius: float):
        self.at, self.center, self.radius, self.children = at, center, radius, []


def cover_tree(points: np.ndarray) -> Node:
    """Nested levels: the children of a node lie within its radius and cover their points with half of it.

    A child's centre is a point at least that far from the earlier ones; its true covering radius is
    kept for pruning. Nodes of LEAF points or fewer, or of one repeated point, stay whole.
    """
    start = points[0]
    far = np.sqrt(((points - start) ** 2).sum(axis=1))
    root = Node(np.arange(len(points)), start, float(far.max()))
    open_ = [(root, far, float(far.max()))]
    while open_:
        node, dist, level = open_.pop()
        if len(node.at) <= LEAF or node.radius <= 1e-7:
            continue
        level = min(level, node.radius) / 2
        own, near = np.zeros(len(node.at), dtype=np.int64), dist.copy()
        centers = [node.center]
        while near.max() > level:
            centers.append(points[node.at[near.argmax()]])
            d = np.sqrt(((points[node.at] - centers[-1]) ** 2).sum(axis=1))
            closer = d < near
            own[closer], near[closer] = len(centers) - 1, d[closer]
            if len(centers) * LEAF > 4 * len(node.at):  # points too spread out for small children: keep fewer, wider ones
                break
        for k, center in enumerate(centers):
            mine = np.flatnonzero(own == k)
            if len(mine):
                child = Node(node.at[mine], center, float(near[mine].max()))
                node.children.append(child)
                if len(mine) < len(node.at):
                    open_.append((child, near[mine], level))
    return root


def leaf_pairs(a: Node, b: Node, limit: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Dual traversal: pairs of point sets that may hold pairs within `limit`."""
    todo = [(a, b)]
    while todo:
        x, y = todo.pop()
        if math.dist(x.center, y.center) - x.radius - y.radius > limit + SLACK:
            continue
        if not x.children and not y.children:
            yield x.at, y.at
        elif x is y:
            todo += [(p, q) for i, p in enumerate(x.children) for q in x.children[i:]]
        elif x.children and (not y.children or x.radius >= y.radius):
            todo += [(p, y) for p in x.children]
        else:
            todo += [(x, q) for q in y.children]


def clean_vectors(table: DataFrame) -> DataFrame:
    """(vec_id, label, vector, key): the distinct usable vectors of each id. Equal vectors of a label share the 128-bit key."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(v, lambda x: x != 0)
    usable = table.filter("vec_id is not null and label is not null and embedding is not null").filter(some & ~F.coalesce(bad, F.lit(True)))
    plain = F.transform(v, lambda x: x + 0.0)  # -0.0 and 0.0 are one value
    rows = usable.select(F.col("vec_id").cast("long"), "label", plain.alias("vector"))
    key = F.struct(F.xxhash64("label", "vector").alias("h"), F.xxhash64(F.lit(7), "vector", "label").alias("g"))
    return rows.withColumn("key", key).dropDuplicates(["vec_id", "key"])


def distinct_points(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row for each distinct vector of a label (key, id, least, label, vector, w), w rows hold it; and links (u, v) of points that share a vec_id.

    A point is named by its smallest vec_id, or by a hash where that vec_id has several vectors.
    """
    sums = rows.groupBy("key").agg(F.min("vec_id").alias("least"), F.count("*").alias("w"), F.any_value("label").alias("label"), F.any_value("vector").alias("vector"))
    many = store(rows.groupBy("vec_id").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).filter("lo <> hi").select("vec_id", "lo"), "cover-many")
    name = F.when(F.col("lo").isNull(), F.col("least")).otherwise(F.col("key.h"))
    points = store(sums.join(many, F.col("least") == F.col("vec_id"), "left").select("key", name.alias("id"), "least", "label", "vector", "w"), "cover-points")
    named = points.select("key", "id")
    each = rows.select("vec_id", "key").join(many, "vec_id").join(named.withColumnRenamed("id", "u"), "key")
    return points, store(each.join(named.select(F.col("key").alias("lo"), F.col("id").alias("v")), "lo").select("u", "v"), "cover-same")


#: Points that one task compares with its label's centres.
PLACED = 20_000


def cells(points: DataFrame, limit: float, block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Points with their cell and its number of parts, the pairs of cells of a label whose covering balls come within `limit`, and the two scratch tables behind them.

    Centres: as many as the label has blocks, MAX_CELLS at most, from a sample of about 8 points a centre
    by hash, each the furthest from those before. Only speed depends on them. Points meet the centres in
    tasks of PLACED points of a label, as one matrix product; pairs of cells are found in one task a label,
    which holds MAX_CELLS cells at most.
    """
    kind = dict(points.dtypes)["label"]
    sized = points.groupBy("label", F.size("vector").alias("dim")).agg(F.count("*").alias("n")).filter(F.col("n") > 1)
    wanted = F.least(F.ceil(F.col("n") / block), F.lit(MAX_CELLS))
    known = points.withColumn("dim", F.size("vector")).join(sized, ["label", "dim"])
    share = F.least(wanted * 8_000_000 / F.col("n"), F.lit(1_000_000))
    sample = known.filter((F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < share) | (F.col("n") <= 8 * block))

    def spread(g: pd.DataFrame) -> pd.DataFrame:
        x, k = unit(np.stack(g.sort_values("id").vector.tolist())), min(math.ceil(g.n.iloc[0] / block), MAX_CELLS)
        near, picked = np.full(len(x), np.inf), []
        while len(picked) < min(k, len(x)):
            picked.append(int(near.argmax()) if picked else 0)
            near = np.minimum(near, ((x - x[picked[-1]]) ** 2).sum(axis=1))
        return pd.DataFrame({"label": g.label.iloc[0], "dim": g.dim.iloc[0], "n": g.n.iloc[0], "centers": [x[picked].ravel()]})

    centers = store(sample.select("id", "label", "dim", "n", "vector").groupBy("label", "dim").applyInPandas(spread, f"label {kind}, dim int, n long, centers array<double>"), "cover-centers")
    deals = F.ceil(F.col("n") / PLACED).cast("int")
    dealt = known.select("id", "label", "dim", "w", "vector", F.pmod(F.xxhash64(F.lit(3), "id"), deals).cast("int").alias("deal"))
    copies = centers.select("label", "dim", F.explode(F.sequence(F.lit(0), deals - 1)).alias("deal"), "centers")

    def place(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        cell, dist = np.zeros(len(left), dtype=np.int32), np.full(len(left), 2.0)
        if len(left) and len(right):
            x, c = unit(np.stack(left.vector.tolist())), np.asarray(right.centers.iloc[0]).reshape(-1, int(left.dim.iloc[0]))
            for at in range(0, len(x), 2048):
                dots = x[at : at + 2048] @ c.T
                best = dots.argmax(axis=1)
                cell[at : at + 2048] = best
                dist[at : at + 2048] = np.sqrt(((x[at : at + 2048] - c[best]) ** 2).sum(axis=1))
        return left.drop(columns="deal").assign(cell=cell, dist=dist)

    schema = f"id long, label {kind}, dim int, w long, vector array<double>, cell int, dist double"
    placed = dealt.groupBy("label", "dim", "deal").cogroup(copies.groupBy("label", "dim", "deal")).applyInPandas(place, schema)
    in_cells = store(placed, "cover-cells")
    summary = in_cells.groupBy("label", "dim", "cell").agg(F.count("*").alias("n"), F.max("dist").alias("radius"))
    parts = F.ceil(F.col("n") / block).cast("int").alias("parts")

    def near_cells(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ["label", "dim", "c1", "c2", "k1", "k2"]
        if not len(left) or not len(right):
            return pd.DataFrame([], columns=names)
        at, radius, k = left.cell.to_numpy(), left.radius.to_numpy(), left.parts.to_numpy()
        c = np.asarray(right.centers.iloc[0]).reshape(-1, int(left.dim.iloc[0]))[at]
        one, two = [], []
        for i in range(len(c)):
            apart = np.sqrt(((c[i:] - c[i]) ** 2).sum(axis=1))
            j = i + np.flatnonzero((apart - radius[i:] - radius[i] <= limit + 1e-6) | (np.arange(len(c) - i) == 0))
            one.append(np.full(len(j), i)), two.append(j)
        i, j = np.concatenate(one), np.concatenate(two)
        return pd.DataFrame({"label": left.label.iloc[0], "dim": left.dim.iloc[0], "c1": at[i], "c2": at[j], "k1": k[i], "k2": k[j]})[names]

    rows = summary.select("label", "dim", "cell", "radius", parts)
    pairs = rows.groupBy("label", "dim").cogroup(centers.groupBy("label", "dim")).applyInPandas(near_cells, f"label {kind}, dim int, c1 int, c2 int, k1 int, k2 int")
    return in_cells.join(rows.drop("radius"), ["label", "dim", "cell"]), pairs, in_cells, centers


def near_vectors(table: DataFrame, cosine: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept, one row an input row."""
    limit = math.sqrt(2 - 2 * cosine)
    rows = store(clean_vectors(table), "cover-rows")
    points, same = distinct_points(rows)
    placed, pairs, *scratch = cells(points, limit)

    parts = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    tasks = pairs.select("label", "dim", "c1", "c2", "k2", parts("k1").alias("p1")).select("label", "dim", "c1", "c2", "p1", parts("k2").alias("p2"))
    tasks = store(tasks.filter("c1 <> c2 or p1 <= p2").withColumn("task", F.xxhash64("label", "dim", "c1", "c2", "p1", "p2")), "cover-tasks")

    held = placed.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    side = lambda c, p, s: tasks.select("label", "dim", F.col(c).alias("cell"), F.col(p).alias("part"), "task", F.lit(s).alias("side"), ((F.col("c1") == F.col("c2")) & (F.col("p1") == F.col("p2"))).alias("self"))
    sides = side("c1", "p1", 0).union(side("c2", "p2", 1).filter("not self"))
    dealt = held.join(sides, ["label", "dim", "cell", "part"]).select("task", "side", "self", "id", "w", "vector")

    def compare(g: pd.DataFrame) -> pd.DataFrame:
        one_self = bool(g.self.iloc[0])
        x = unit(np.stack(g.vector.tolist()))
        ids, w, side_of = g.id.to_numpy(), g.w.to_numpy(), g.side.to_numpy()
        count, forest, group = np.zeros(len(g), dtype=np.int64), Forest(), ids.copy()
        left = np.flatnonzero(side_of == 0)
        right = left if one_self else np.flatnonzero(side_of == 1)
        if len(left) and len(right):
            a = cover_tree(x[left])
            b = a if one_self else cover_tree(x[right])
            for p, q in leaf_pairs(a, b, limit):
                i, j = left[p], right[q]
                hit = x[i] @ x[j].T
                close = np.argwhere(hit >= cosine - 1e-12)
                if not len(close):
                    continue
                u, v = i[close[:, 0]], j[close[:, 1]]
                near_edge = hit[close[:, 0], close[:, 1]] < cosine + 1e-12
                if near_edge.any():  # decided by a plain sum of products
                    ok = ~near_edge
                    ok[near_edge] = [float(np.dot(x[s], x[t])) >= cosine for s, t in zip(u[near_edge], v[near_edge], strict=True)]
                    u, v = u[ok], v[ok]
                keep = u < v if one_self and p is q else u != v
                u, v = u[keep], v[keep]
                np.add.at(count, u, w[v])
                np.add.at(count, v, w[u])
                new = np.unique(np.stack([group[u], group[v]], axis=1)[group[u] != group[v]], axis=0)
                for s, t in new.tolist():
                    s, t = forest.root(s), forest.root(t)
                    if s != t:
                        forest.join(s, t)
                if len(new):
                    group = np.array([forest.root(s) for s in group.tolist()])
        found = np.flatnonzero(count)
        return pd.DataFrame({"id": ids[found], "links": count[found], "root": group[found]})

    hits = store(dealt.groupBy("task").applyInPandas(compare, "id long, links long, root long"), "cover-hits")
    drop_table(tasks, *scratch)
    links = hits.groupBy("id").agg(F.sum("links").alias("links"))
    groups = store(connected_components(hits.select(F.col("id").alias("u"), F.col("root").alias("v")).union(same)), "cover-groups")
    known = points.select("key", "id", "least", "w").join(links, "id", "left").join(groups.withColumnRenamed("node", "id"), "id", "left").withColumn("group", F.coalesce("component", "id"))
    # A group's id is the smallest vec_id of its points.
    named = known.join(known.groupBy("group").agg(F.min("least").alias("smallest")), "group").select("key", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"), "smallest")
    each = rows.select("vec_id", "key").join(named, "key").groupBy("vec_id").agg(F.sum("n_links").alias("n_links"), F.min("smallest").alias("smallest"))
    out = table.select(F.col("vec_id").cast("long")).join(each, "vec_id", "left")
    component = F.coalesce("smallest", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
