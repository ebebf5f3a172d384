"""Language-model scores by deleted interpolation of unigrams and bigrams.

P(w | v) = l2(b) c(v, w) / c(v) + l1(b) c(w) / N + l0(b) / (V + 1), b the frequency bucket of the
context v (powers of two). The weights of each bucket are learned by expectation-maximisation on
counts held out from training: one fold is deleted, the other training folds give the estimates.
Scores then use the counts of all training folds.

Documents are dealt into chunks by hash. A chunk sends its distinct unigrams and bigrams (64-bit
hashes, of which bigrams keep 48 bits inside a bucket, counted) to count buckets, one packed row for each chunk and bucket; so a frequent word costs
one entry a chunk. A bucket sums the counts of all chunks and returns to each chunk, entry by entry in the
order it sent them, what the rest of the corpus adds. A second pass over the texts meets these sums.
Chunks and buckets keep a fixed size, their number grows with the input.

Defined results: a null text is an empty one (its end token alone); a null doc_id counts as the empty
text for its fold; repeated rows count and are scored each; with no training text N and V are 0 and
the uniform part gives log10(1) for each token; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supportlake.llm.common import drop_table, store

CHUNK_CHARS = 8_000_000
FOLDS, HELD_OUT, DELETED = 7, 2, 5
TOP_BUCKET = 40
EM_STEPS = 40
END = b" "  # no word holds a space


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text's end included, and the number of tokens of each text."""
    out, sizes = [], []
    for at in range(0, len(texts), 256):
        words = [[*(t or "").encode().lower().split(), END] for t in texts[at : at + 256]]
        sizes += map(len, words)
        out.append(pd.util.hash_array(np.array([w for ws in words for w in ws], dtype=object), categorize=False))
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.array(sizes, dtype=np.int64)


def contexts(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The token before each token; the end token stands before a text's first."""
    before = np.empty_like(words)
    before[1:] = words[:-1]
    starts = np.cumsum(sizes) - sizes
    before[starts] = words[np.cumsum(sizes) - 1]
    return before


def pair_hashes(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (before * np.uint64(0x9E3779B97F4A7C15)) ^ (words + np.uint64(0x632BE59BD9B4E019))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))


def counted(keys: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with their counts in the retained and in the deleted folds."""
    distinct, place = np.unique(keys, return_inverse=True)
    kept = np.bincount(place[(fold != HELD_OUT) & (fold != DELETED)], minlength=len(distinct))
    gone = np.bincount(place[fold == DELETED], minlength=len(distinct))
    return distinct, kept.astype(np.int64), gone.astype(np.int64)


#: Bytes kept of a key. Its count bucket is told by its upper half, so 48 bits are compared within one bucket only.
KINDS = {"uni": 8, "bi": 6}
COUNTS = ", ".join(f"{k}_{f} binary" for k in KINDS for f in ("kept", "gone"))
FIELDS = ", ".join(f"{k}_keys binary" for k in KINDS) + ", " + COUNTS


def pack_keys(keys: np.ndarray, width: int) -> bytes:
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def load_keys(raw: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


def pack_counts(counts: np.ndarray) -> bytes:
    """Small numbers mostly: compressed before they are sent."""
    return zlib.compress(counts.astype("<u4").tobytes(), 1)


def load_counts(raw: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw), dtype="<u4").astype(np.int64)


@dataclass(frozen=True)
class Totals:
    """Tokens and distinct tokens, of the retained folds and of all training folds."""

    n_kept: int
    v_kept: int
    n: int
    v: int


class Chunk:
    """The texts of one chunk as hashes, with their own counts, later raised to the corpus's totals."""

    def __init__(self, texts: list[str | None], fold: np.ndarray):
        self.words, self.sizes = word_hashes(texts)
        self.before = contexts(self.words, self.sizes) if len(self.words) else self.words
        self.pairs = pair_hashes(self.before, self.words)
        self.fold = np.repeat(fold, self.sizes)
        self.counts = {"uni": counted(self.words, self.fold), "bi": counted(self.pairs, self.fold)}

    def dealt(self, kind: str, parts: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the keys by count bucket, sorted within, and where each bucket begins."""
        part = ((self.counts[kind][0] >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        return order, np.searchsorted(part[order], np.arange(parts + 1))

    def raise_to(self, returned: pd.DataFrame, parts: int) -> None:
        for kind in KINDS:
            _, kept, gone = self.counts[kind]
            order, edges = self.dealt(kind, parts)
            for row in returned.itertuples():
                at = order[edges[row.part] : edges[row.part + 1]]
                kept[at] += load_counts(getattr(row, f"{kind}_kept"))
                gone[at] += load_counts(getattr(row, f"{kind}_gone"))

    def look_up(self, kind: str, wanted: np.ndarray, deleted: bool) -> np.ndarray:
        keys, kept, gone = self.counts[kind]
        at = np.searchsorted(keys, wanted)
        return kept[at] if deleted else kept[at] + gone[at]

    def estimates(self, totals: Totals, rows: np.ndarray, deleted: bool):
        """c(w), p2, p1, p0 and the context's bucket for the tokens `rows`; `deleted`: from the retained folds only."""
        n, v = (totals.n_kept, totals.v_kept) if deleted else (totals.n, totals.v)
        c_word, c_before = (self.look_up("uni", x[rows], deleted) for x in (self.words, self.before))
        c_pair = self.look_up("bi", self.pairs[rows], deleted)
        bucket = np.minimum(np.ceil(np.log2(c_before + 1.0)), TOP_BUCKET).astype(np.int64)
        return c_word, c_pair / np.maximum(c_before, 1), c_word / max(n, 1), 1 / (v + 1), bucket


def count_chunk(g: pd.DataFrame, parts: int) -> pd.DataFrame:
    chunk, columns = Chunk(g.text.tolist(), g.fold.to_numpy()), {"part": range(parts), "chunk": int(g.chunk.iloc[0])}
    for kind, width in KINDS.items():
        keys, kept, gone = chunk.counts[kind]
        order, edges = chunk.dealt(kind, parts)
        slices = [order[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
        columns |= {f"{kind}_keys": [pack_keys(keys[x], width) for x in slices], f"{kind}_kept": [pack_counts(kept[x]) for x in slices], f"{kind}_gone": [pack_counts(gone[x]) for x in slices]}
    return pd.DataFrame(columns)[["part", "chunk", *(f.split()[0] for f in FIELDS.split(", "))]]


def sum_part(g: pd.DataFrame) -> pd.DataFrame:
    """For each chunk, what the other chunks add to its counts; the bucket's own totals stand in the first row."""
    out = {"part": g.part.to_numpy(), "chunk": g.chunk.to_numpy()}
    sums = [0, 0, 0, 0]
    for kind, width in KINDS.items():
        keys = [load_keys(x, width) for x in g[f"{kind}_keys"]]
        distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
        edges = np.cumsum([len(k) for k in keys])[:-1]
        totals = []
        for f in ("kept", "gone"):
            own = [load_counts(x) for x in g[f"{kind}_{f}"]]
            total = np.bincount(place, weights=np.concatenate(own), minlength=len(distinct)).astype(np.int64)
            out[f"{kind}_{f}"] = [pack_counts(t - o) for t, o in zip(np.split(total[place], edges), own, strict=True)]
            totals.append(total)
        if kind == "uni":
            kept, every = totals[0], totals[0] + totals[1]
            sums = [int(kept.sum()), int((kept > 0).sum()), int(every.sum()), int((every > 0).sum())]
    for name, value in zip(("n_kept", "v_kept", "n", "v"), sums, strict=True):
        out[name] = [value] + [0] * (len(g) - 1)
    return pd.DataFrame(out)


def learn_weights(cells: list, steps: int = EM_STEPS) -> np.ndarray:
    """Weights (bucket, [l2, l1, l0]) from held-out counts (bucket, n, p2, p1, p0). Buckets without counts take those of all."""
    out = np.full((TOP_BUCKET + 1, 3), 1 / 3)
    if not cells:
        return out
    bucket, n = np.array([c[0] for c in cells]), np.array([c[1] for c in cells], dtype=float)
    p = np.array([c[2:5] for c in cells], dtype=float)

    def fit(on: np.ndarray) -> np.ndarray:
        w = np.full(3, 1 / 3)
        for _ in range(steps):
            part = p[on] * w
            share = (part / part.sum(axis=1, keepdims=True) * n[on, None]).sum(axis=0)
            w = share / share.sum()
        return np.maximum(w, 1e-9) / np.maximum(w, 1e-9).sum()

    out[:] = fit(np.ones(len(n), dtype=bool))
    for b in np.unique(bucket):
        out[b] = fit(bucket == b)
    return out


def held_out_cells(left: pd.DataFrame, right: pd.DataFrame, totals: Totals, parts: int) -> pd.DataFrame:
    """Deleted tokens summed over cells: the context's bucket and half octaves of p2 and p1 (at most 41 * 82 * 82 cells)."""
    names = ["bucket", "q2", "q1", "n", "p2", "p1"]
    if not (left.fold == DELETED).any():
        return pd.DataFrame([], columns=names).astype({n: "float64" for n in names})
    chunk = Chunk(left.text.tolist(), left.fold.to_numpy())
    chunk.raise_to(right, parts)
    _, p2, p1, _, bucket = chunk.estimates(totals, np.flatnonzero(chunk.fold == DELETED), True)
    octave = lambda p: np.where(p > 0, np.maximum(np.round(2 * np.log2(np.maximum(p, 1e-30))), -80), 1).astype(np.int64)
    cells = pd.DataFrame({"bucket": bucket, "q2": octave(p2), "q1": octave(p1), "n": 1, "p2": p2, "p1": p1})
    return cells.groupby(["bucket", "q2", "q1"], as_index=False).sum()[names]


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_chunk(left: pd.DataFrame, right: pd.DataFrame, totals: Totals, parts: int, weights: np.ndarray) -> pd.DataFrame:
    if not len(left):
        return pd.DataFrame([], columns=[c.split()[0] for c in SCORES.split(", ")])
    chunk = Chunk(left.text.tolist(), left.fold.to_numpy())
    chunk.raise_to(right, parts)
    c_word, p2, p1, p0, bucket = chunk.estimates(totals, np.arange(len(chunk.words)), False)
    w = weights[bucket]
    starts = np.cumsum(chunk.sizes) - chunk.sizes
    per_text = lambda x: np.add.reduceat(x, starts)
    return pd.DataFrame(
        {
            "doc_id": left.doc_id.astype("Int64"),
            "held_out": left.fold == HELD_OUT,
            "n_tokens": chunk.sizes,
            "n_known": per_text((c_word > 0).astype(np.int64)),
            "train_tokens": totals.n,
            "base_score": per_text(np.log10((c_word + 1) / (totals.n + totals.v + 1))),
            "score": per_text(np.log10(w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] * p0)),
        }
    )


def lm_scores(docs: DataFrame, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, math.ceil(chars / chunk_chars))
    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(FOLDS)).cast("int")
    chunk = F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).cast("int")
    dealt = docs.select(F.col("doc_id").cast("long"), "text", fold.alias("fold"), chunk.alias("chunk"))

    counts = dealt.groupBy("chunk").applyInPandas(lambda g: count_chunk(g, parts), f"part int, chunk int, {FIELDS}")
    summed = counts.groupBy("part").applyInPandas(sum_part, f"part int, chunk int, {COUNTS}, n_kept long, v_kept long, n long, v long")
    back = store(summed, "lm-counts")
    totals = Totals(*(x or 0 for x in back.agg(*(F.sum(c) for c in ("n_kept", "v_kept", "n", "v"))).first()))
    both = dealt.groupBy("chunk").cogroup(back.drop("n_kept", "v_kept", "n", "v").withColumnRenamed("chunk", "c").groupBy("c"))

    cells = both.applyInPandas(lambda a, b: held_out_cells(a, b, totals, parts), "bucket int, q2 int, q1 int, n double, p2 double, p1 double")
    summed_cells = store(cells.groupBy("bucket", "q2", "q1").agg(*(F.sum(c).alias(c) for c in ("n", "p2", "p1"))), "lm-cells")
    found = summed_cells.collect()
    drop_table(summed_cells)
    weights = learn_weights([(r.bucket, r.n, r.p2 / r.n, r.p1 / r.n, 1 / (totals.v_kept + 1)) for r in sorted(found, key=lambda r: (r.bucket, r.q2, r.q1))])
    return both.applyInPandas(lambda a, b: score_chunk(a, b, totals, parts, weights), SCORES)
