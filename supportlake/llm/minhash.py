"""MinHash near-duplicate groups with b-bit signatures and exact confirmation.

1. Each text becomes its set of w-word shingles (64-bit hashes). Equal sets share one node, so a group
   of exact copies costs one node however large it is.
2. Each node gets bands * rows minima. A band's minima hash to a bucket; nodes that share a bucket are
   candidates. The number of bands is set so that a pair at the threshold misses all buckets with a
   probability of at most `miss`. The low b bits of all minima are packed as b bit planes.
3. In each bucket every node is first paired with the bucket's smallest node. Bit counts of the packed
   planes give a collision-corrected similarity; pairs above the threshold less five standard errors are
   confirmed, and confirmed pairs are contracted to components.
4. Buckets that still hold several components go through all their remaining pairs, in blocks of
   bounded size, by the same estimate and confirmation. So a bucket of many near copies costs one pass
   over it, and no pair of different components is left out.
5. Confirmation compares full shingle sets. Nodes lie in blocks by cluster, a task holds two blocks,
   and it returns only the links that join something.

Defined results: a null text or one without words has an empty set and links with nothing; a text of
fewer words than w is one shingle; rows that share a doc_id are one document: each of their texts may link
it, and all its rows get the smallest component of any; rows with a null doc_id stay alone (component_id
null, kept); an empty table gives an empty one; other columns are ignored.
Each near copy is linked if any chain of confirmed links reaches it. The method itself is
probabilistic: see `miss`.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supportlake.llm.common import batches, drop_table, store
from supportlake.llm.components import connected_components

ROWS = 5
BITS = 4
#: A block holds about so many shingles; a node counts as NODE_SHINGLES at least, so that many short texts fill one too.
BLOCK_SHINGLES, NODE_SHINGLES = 100_000, 50
BUCKET_BLOCK = 1024


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; A-Z lower-cased, words split at ASCII white space."""
    words = [(t or "").encode().lower().split() for t in texts]
    flat = [w for ws in words for w in ws]
    if not flat:
        return [np.zeros(0, dtype=np.uint64) for _ in texts]
    h = pd.util.hash_array(np.array(flat, dtype=object), categorize=False)
    n = len(h)
    mix = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(min(width, n)):
            mix[: n - k] = (mix[: n - k] ^ h[k:]) * np.uint64(0x9E3779B97F4A7C15)
            mix ^= mix >> np.uint64(29)
    out, at = [], 0
    for ws in words:
        m = len(ws)
        if m == 0 or m >= width:
            out.append(np.unique(mix[at : at + m - width + 1]) if m else np.zeros(0, dtype=np.uint64))
        else:
            digest = hashlib.blake2b(b"\0".join(ws), digest_size=8).digest()
            out.append(np.frombuffer(digest, dtype="<u8").copy())
        at += m
    return out


def bands_for(percent: int, miss: float) -> int:
    return math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** ROWS))


def multipliers(n: int) -> np.ndarray:
    return np.random.RandomState(20).randint(1, 2**63 - 1, n, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def minima(shingles: np.ndarray, by: np.ndarray) -> np.ndarray:
    """The smallest 32-bit hash under each multiplier, worked in slices so that memory stays bounded."""
    out = np.full(len(by), 0xFFFFFFFF, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), 2048):
            part = shingles[at : at + 2048]
            np.minimum(out, ((by[:, None] * part[None, :]) >> np.uint64(32)).min(axis=1), out=out)
    return out.astype(np.uint32)


def pack(low: np.ndarray, bits: int) -> bytes:
    """Bit planes of the low bits: plane after plane, padded to whole bytes."""
    return b"".join(np.packbits((low >> np.uint32(b)) & np.uint32(1)).tobytes() for b in range(bits))


FEATURES = "doc_id long, set_key binary, n_shingles long, buckets array<long>, packed binary"


def features(docs: DataFrame, width: int, bands: int, bits: int = BITS) -> DataFrame:
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = multipliers(bands * ROWS)
        salt = multipliers(bands + ROWS)
        for b in batches(frames, 256):
            sets = shingle_sets(b["text"].to_pylist(), width)
            keys, buckets, packed = [], [], []
            for s in sets:
                if not len(s):
                    keys.append(None), buckets.append(None), packed.append(None)
                    continue
                low = minima(s, by)
                with np.errstate(over="ignore"):
                    h = (low.reshape(bands, ROWS).astype(np.uint64) * salt[None, :ROWS]).sum(axis=1, dtype=np.uint64)
                    h = (h ^ (h >> np.uint64(31))) * salt[ROWS:]
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                buckets.append((h ^ (h >> np.uint64(29))).astype(np.int64))
                packed.append(pack(low, bits))
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"].cast(pa.int64()), pa.array(keys, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(buckets, pa.list_(pa.int64())), pa.array(packed, pa.binary())],
                names=["doc_id", "set_key", "n_shingles", "buckets", "packed"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, FEATURES)


class Forest:
    """Union-find over the ids one task sees."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (p := up.get(x, x)) != x:
            up[x] = up.get(p, p)
            x = p
        return x

    def join(self, a: int, b: int) -> None:
        self.up[max(a, b)] = min(a, b)


def confirm(pairs: DataFrame, placed: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (u, v) between components, by full shingle sets.

    pairs: a_block, b_block, a: array<long>, b: array<long>; placed: node, block, component.
    """
    need = pairs.select(F.col("a_block").alias("x"), F.col("b_block").alias("y"), F.explode(F.array_distinct(F.concat("a", "b"))).alias("node")).distinct()
    held = need.join(placed.select("node", "component"), "node").join(texts, "node")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        links: list[tuple[int, int]] = []
        if len(left) and len(right):
            right = right.drop_duplicates("node")
            sets = dict(zip(right.node, (set(s.tolist()) for s in shingle_sets(right.text.tolist(), width)), strict=True))
            of, forest = dict(zip(right.node, right.component, strict=True)), Forest()
            a, b = np.concatenate(left.a.tolist()), np.concatenate(left.b.tolist())
            for x, y in np.unique(np.stack([a, b], axis=1), axis=0).tolist():
                i, j = forest.root(of[x]), forest.root(of[y])
                if i == j:
                    continue
                s, t = sets[x], sets[y]
                if 100 * min(len(s), len(t)) < percent * max(len(s), len(t)):
                    continue
                both = len(s & t)
                if 100 * both >= percent * (len(s) + len(t) - both):
                    forest.join(i, j)
                    links.append((x, y))
        return pd.DataFrame(links, columns=["u", "v"], dtype="int64")

    return pairs.groupBy("a_block", "b_block").cogroup(held.groupBy("x", "y")).applyInPandas(run, "u long, v long")


def most_differing(percent: int, bands: int, bits: int) -> float:
    """Differing minima that a pair at the threshold shows at most, collisions of low bits counted, with five standard errors."""
    size, share = bands * ROWS, 2.0**-bits
    error = math.sqrt((share + (1 - share) * percent / 100) * (1 - share) * (1 - percent / 100) / size) / (1 - share)
    return size * (1 - ((percent / 100 - 5 * error) * (1 - share) + share))


def estimated(pairs: DataFrame, nodes: DataFrame, percent: int, bands: int, bits: int) -> DataFrame:
    """Pairs (node, center) that sizes and packed signatures leave possible."""
    most = most_differing(percent, bands, bits)
    left = nodes.select("node", F.col("n").alias("_n"), F.col("packed").alias("_p"))
    right = nodes.select(F.col("node").alias("center"), F.col("n").alias("_m"), F.col("packed").alias("_q"))
    sized = pairs.join(left, "node").join(right, "center").filter(100 * F.least("_n", "_m") >= percent * F.greatest("_n", "_m"))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(frames, 4096):
            planes = (np.frombuffer(b"".join(b[c].to_pylist()), dtype=np.uint8).reshape(b.num_rows, bits, -1) for c in ("_p", "_q"))
            differ = np.bitwise_count(np.bitwise_or.reduce(np.bitwise_xor(*planes), axis=1)).sum(axis=1)
            yield b.select(["node", "center"]).filter(pa.array(differ <= most))

    return sized.select("node", "center", "_p", "_q").mapInArrow(run, "node long, center long")


def remaining(members: DataFrame, percent: int, bands: int, bits: int) -> DataFrame:
    """Candidate pairs of different components in each bucket, block by block, packed into arrays.

    members: bucket, size, node, component, block, n, buckets, packed.
    """
    salted = members.withColumn("parts", F.ceil(F.col("size") / BUCKET_BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    other = F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(F.least("own", k).alias("i"), F.greatest("own", k).alias("j"))))
    dealt = salted.select("bucket", other.alias("p"), "own", "node", "component", "block", "n", "buckets", "packed").select("*", "p.i", "p.j").drop("p")
    groups = max(1, members.count() // 5_000)
    dealt = dealt.withColumn("deal", F.pmod(F.xxhash64("bucket", "i", "j"), F.lit(groups)))
    most = most_differing(percent, bands, bits)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        found: dict[tuple[int, int], list[np.ndarray]] = {}
        for (bucket, i, j), m in g.groupby(["bucket", "i", "j"], sort=False):
            left, right = m[m.own == i], m[m.own == j]
            bl, br = (np.stack([np.asarray(x) for x in d.buckets]) if len(d) else np.zeros((0, bands), np.int64) for d in (left, right))
            pl, pr = (np.frombuffer(b"".join(d.packed), dtype=np.uint8).reshape(len(d), bits, -1) for d in (left, right))
            rn, rc, rs, rb = right.node.to_numpy(), right.component.to_numpy(), right.n.to_numpy(), right.block.to_numpy()
            for k, (node, comp, n, block) in enumerate(zip(left.node, left.component, left.n, left.block, strict=True)):
                ok = (rc != comp) & (100 * np.minimum(rs, n) >= percent * np.maximum(rs, n))
                if i == j:
                    ok &= rn > node
                at = np.flatnonzero(ok)
                if not len(at):
                    continue
                same = bl[k] == br[at]  # only in the first bucket that a pair shares
                at = at[bl[k][same.argmax(axis=1)] == bucket]
                differ = np.bitwise_count(np.bitwise_or.reduce(pl[k] ^ pr[at], axis=1)).sum(axis=1)
                at = at[differ <= most]
                for other in np.unique(rb[at]):
                    t = rn[at[rb[at] == other]]
                    s = np.full(len(t), node)
                    key, pair = ((block, other), (s, t)) if block <= other else ((other, block), (t, s))
                    if block == other:
                        pair = np.minimum(s, t), np.maximum(s, t)
                    found.setdefault(key, []).append(np.stack(pair))
        rows = [(*key, *np.concatenate(parts, axis=1)) for key, parts in found.items()]
        return pd.DataFrame(rows, columns=["a_block", "b_block", "a", "b"])

    return dealt.groupBy("deal").applyInPandas(run, "a_block long, b_block long, a array<long>, b array<long>")


def set_texts(docs: DataFrame, nodes: DataFrame, placed: DataFrame, many: DataFrame, width: int) -> DataFrame:
    """(node, text) for the placed nodes. Rows whose id has several sets find their set's node by the shingles again."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(frames, 256):
            keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in shingle_sets(b["text"].to_pylist(), width)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), b["text"]], names=["set_key", "text"])

    own = docs.select(F.col("doc_id").cast("long").alias("node"), "text")
    odd = own.join(many.select(F.col("doc_id").alias("node")), "node", "left_semi").select("text").mapInArrow(run, "set_key binary, text string")
    keyed = odd.join(nodes.filter("node <> least").select("set_key", "node"), "set_key").groupBy("node").agg(F.min("text").alias("text"))
    return own.union(keyed).join(placed.select("node"), "node", "left_semi")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, miss: float = 1e-6, bits: int = BITS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, one row an input row."""
    bands = bands_for(percent, miss)
    found = store(features(docs, width, bands, bits), "minhash-features")
    sets = found.filter("set_key is not null and doc_id is not null").groupBy("set_key")
    one = sets.agg(F.min(F.struct("doc_id", "n_shingles", "buckets", "packed")).alias("s"))
    # A node is named by its smallest doc_id, or by a hash where that id has several sets; `same` links these.
    per_id = found.filter("set_key is not null and doc_id is not null").groupBy("doc_id").agg(F.min("set_key").alias("lo"), F.max("set_key").alias("hi"))
    many = store(per_id.filter("lo <> hi").select("doc_id", "lo"), "minhash-many")
    name = F.when(F.col("lo").isNull(), F.col("s.doc_id")).otherwise(F.xxhash64("set_key"))
    named = one.join(many, F.col("s.doc_id") == F.col("doc_id"), "left").select("set_key", name.alias("node"), F.col("s.doc_id").alias("least"), F.col("s.n_shingles").alias("n"), "s.buckets", "s.packed")
    nodes = store(named, "minhash-nodes")
    key = nodes.select("set_key", "node")
    held = found.select("doc_id", "set_key").join(many, "doc_id").filter("set_key is not null").distinct().join(key.withColumnRenamed("node", "u"), "set_key")
    same = store(held.join(key.select(F.col("set_key").alias("lo"), F.col("node").alias("v")), "lo").select("u", "v"), "minhash-same")

    entries = nodes.select("node", F.explode("buckets").alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.count("*").alias("size"), F.min("node").alias("center")).filter("size > 1")
    members = store(entries.join(shared, "bucket"), "minhash-members")

    # Blocks: nodes of one cluster lie together, and a large cluster is split by the shingles it holds.
    near = members.groupBy("node").agg(F.min("center").alias("cluster")).join(nodes.select("node", F.greatest("n", F.lit(NODE_SHINGLES)).alias("n")), "node")
    volume = near.groupBy("cluster").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).alias("parts"))
    total = near.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, math.ceil(total / BLOCK_SHINGLES))
    block = F.pmod(F.xxhash64("cluster", F.pmod(F.xxhash64("node"), "parts")), F.lit(blocks))
    placed = store(near.join(volume, "cluster").select("node", block.alias("block"), F.col("node").alias("component")), "minhash-blocks")
    texts = store(set_texts(docs, nodes, placed, many, width), "minhash-texts")

    star = estimated(members.filter("node <> center").select("node", "center").distinct(), nodes, percent, bands, bits)
    star = star.join(placed.select("node", F.col("block").alias("x")), "node").join(placed.select(F.col("node").alias("center"), F.col("block").alias("y")), "center")
    first = F.col("x") <= F.col("y")
    star = star.select(
        F.least("x", "y").alias("a_block"), F.greatest("x", "y").alias("b_block"),
        F.array(F.when(first, F.col("node")).otherwise(F.col("center"))).alias("a"), F.array(F.when(first, F.col("center")).otherwise(F.col("node"))).alias("b"),
    )
    star = store(star, "minhash-star")
    links = store(confirm(star, placed, texts, width, percent), "minhash-links")
    once = store(connected_components(links.union(same)), "minhash-once")

    now = placed.select("node", "block").join(once, "node", "left").select("node", "block", F.coalesce("component", "node").alias("component"))
    now = store(now, "minhash-now")
    several = members.filter("size > 2").join(now, "node")
    mixed = several.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("bucket")
    open_ = several.join(mixed, "bucket").select("bucket", "size", "node", "component", "block").join(nodes.select("node", "n", "buckets", "packed"), "node")
    open_ = store(open_, "minhash-open")
    rest = store(remaining(open_, percent, bands, bits), "minhash-rest")
    more = store(confirm(rest, now, texts, width, percent), "minhash-more")
    final = store(connected_components(links.union(same).union(more)), "minhash-final")

    drop_table(many, members, placed, texts, star, links, once, now, open_, rest, more, same)

    # A group's id is the smallest doc_id of its sets.
    grouped = nodes.select("set_key", "node", "least").join(final, "node", "left").select("set_key", "least", F.coalesce("component", "node").alias("group"))
    mapped = grouped.join(grouped.groupBy("group").agg(F.min("least").alias("component")), "group").select("set_key", "component")
    out = found.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("set_key")).alias("set_key")).join(mapped, "set_key", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The input rows of one document of each group, the smallest id, with the input's own columns."""
    gone = near_duplicates(docs, width, percent).filter("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(store(gone, "minhash-gone"), F.col("doc_id") == F.col("_gone"), "left_anti")
