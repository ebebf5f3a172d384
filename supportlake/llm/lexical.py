"""Ranked lexical search over segments of an inverted index, by a hybrid of terms and documents at a time.

Index: each task inverts its documents in slices of bounded text (segments), so building it shuffles
nothing. A segment has one row a term (local document numbers and occurrences) and one head row with
the documents' ids and lengths. Document numbers ascend with doc_id.

Search: the items' terms get their document frequencies by one aggregation of list lengths. Lists of
these terms meet by segment and block of items; each group is scored by itself and sends on its k best
an item, which one ranking window (cut early by Spark) merges.

In a group, for each item: the short lists are summed term by term into accumulators. These sums, with
their largest as a bound, are then one iterator beside the long lists. Documents are taken in order, in
windows; iterators whose bounds together cannot beat the k-th score so far are only probed for documents
that the others brought up and that may still reach it. Everything is exact 64-bit integer arithmetic.

Defined results: a null or term-free text (document or item) has no terms; rows that share a doc_id are
documents of their own, a null doc_id too (its hits carry null and come last among equals); rows that
share an item_id (null too) are one item with the terms of all of them; a very long text stands in a
segment of its own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import string
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from supportlake.llm.common import drop_table, store
from supportlake.llm.tokens import by_bytes

#: Bytes of text of a segment, about, and documents of one at most (their numbers fit 16 bits).
SEGMENT_BYTES, SEGMENT_DOCS = 4_000_000, 1 << 16
#: Items of a block, about; a group holds one segment's lists for one block.
ITEM_BLOCK = 256
#: Short lists: the shortest ones that together hold this share of a segment's documents.
SHORT_SHARE = 0.25
#: First and largest window of documents.
WINDOW, WIDEST = 512, 8192
#: Pairs of (term, item) up to which the asked terms are sent to all tasks, some 60 bytes each; beyond it both sides are shuffled.
SENT = 200_000

#: Every separator becomes a space, A-Z become small. All separators are ASCII, so UTF-8 stays whole.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b) in string.digits + string.ascii_lowercase else 32 for b in range(256))
INDEX = "segment long, term string, n int, docs binary, tfs binary, ids array<long>"


def words(column: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The terms of a column of texts as one dictionary array (with empty strings between separators), and where each text's begin."""
    column = pc.fill_null(column, "")
    _, edges, data = column.buffers()
    offsets = np.frombuffer(edges, np.int32)[column.offset : column.offset + len(column) + 1]
    raw = bytes(memoryview(data)[offsets[0] : offsets[-1]]).translate(FOLD) if data else b""
    folded = pa.StringArray.from_buffers(len(column), pa.py_buffer((offsets - offsets[0]).astype(np.int32)), pa.py_buffer(raw))
    lists = pc.split_pattern(folded, " ")
    return lists.flatten().dictionary_encode(), lists.offsets.to_numpy().astype(np.int64)


def packed(values: np.ndarray, edges: np.ndarray, kind: str) -> pa.Array:
    """One binary entry for each stretch of values between two edges."""
    raw = values.astype(kind)
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer((edges * raw.itemsize).astype(np.int32)), pa.py_buffer(raw)])


def invert(b: pa.RecordBatch, segment: int) -> pa.RecordBatch:
    """One segment: its head row and a row a term."""
    b = b.take(pc.sort_indices(b["doc_id"], null_placement="at_end"))
    coded, starts = words(b["text"])
    code, terms, docs = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary, b.num_rows
    doc = np.repeat(np.arange(docs), np.diff(starts))
    blank = pc.index(terms, "").as_py()
    code, doc = code[code != blank], doc[code != blank]
    lengths = np.bincount(doc, minlength=docs).astype("<i8")
    pairs, tf = np.unique(code * docs + doc, return_counts=True)
    first = np.flatnonzero(np.diff(pairs // docs, prepend=-1))
    edges = np.append(first, len(pairs))
    head = lambda entry, kind: pa.array([entry], kind)
    names = pa.concat_arrays([pa.nulls(1, pa.string()), terms.take(pa.array(pairs[first] // docs))])
    numbers = pa.concat_arrays([head(b"", pa.binary()), packed(pairs % docs, edges, "<u2")])
    tfs = pa.concat_arrays([head(lengths.tobytes(), pa.binary()), packed(tf, edges, "<u4")])
    ids = pa.ListArray.from_arrays(pa.array([0, docs, *[docs] * len(first)], pa.int32()), b["doc_id"].cast(pa.int64()))
    count = np.append(docs, np.diff(edges)).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(names), segment)), names, pa.array(count), numbers, tfs, ids], names=["segment", "term", "n", "docs", "tfs", "ids"])


def build_index(docs: DataFrame) -> DataFrame:
    """The stored index of (doc_id, text): the head row of a segment has a null term, its documents' ids, and their lengths as 64-bit numbers in `tfs`."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 32
        for part in by_bytes(frames, "text", SEGMENT_BYTES):
            for start in range(0, part.num_rows, SEGMENT_DOCS):
                yield invert(part.slice(start, SEGMENT_DOCS), at)
                at += 1

    return store(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, INDEX), "lexical-index")


def asked_terms(items: DataFrame, blocks: int) -> DataFrame:
    """Distinct (item_id, block, term) of (item_id, text)."""
    folded = F.translate(F.coalesce("text", F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    parts = F.split(folded, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    rows = items.select(F.col("item_id").cast("long"), F.explode_outer(parts).alias("term")).filter("term <> ''").distinct()
    return rows.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int"))


class Postings(NamedTuple):
    docs: np.ndarray
    gains: np.ndarray
    bound: int


class Work:
    """Postings touched, for tests and tuning: summed into accumulators, scanned as drivers, probed."""

    def __init__(self):
        self.summed = self.scanned = self.probed = 0


def accumulate(lists: list[Postings]) -> Postings:
    """The sums of several lists, term at a time, as one bounded list."""
    if len(lists) == 1:
        return lists[0]
    docs, gains = np.concatenate([p.docs for p in lists]), np.concatenate([p.gains for p in lists])
    order = docs.argsort(kind="stable")
    docs, gains = docs[order], gains[order]
    first = np.flatnonzero(np.diff(docs, prepend=-1))
    sums = np.add.reduceat(gains, first)
    return Postings(docs[first], sums, int(sums.max()))


def hybrid_topk(lists: list[Postings], n_docs: int, k: int, work: Work) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of the k highest positive sums, best first, equal ones by document number."""
    lists = sorted((p for p in lists if p.bound > 0), key=lambda p: len(p.docs))
    none = np.zeros(0, np.int64)
    if not lists:
        return none, none
    held = np.cumsum([len(p.docs) for p in lists])
    short = int(np.searchsorted(held, SHORT_SHARE * n_docs, side="right"))
    if short:
        work.summed += int(held[short - 1])
        lists = [accumulate(lists[:short]), *lists[short:]]
    lists.sort(key=lambda p: p.bound)
    reach = np.cumsum([p.bound for p in lists])
    docs, scores, least, at, width = none, none, 0, 0, WINDOW
    while at < n_docs:
        lead = int(np.searchsorted(reach, least, side="right"))  # lists before it cannot beat `least` by themselves
        if lead == len(lists):
            break
        end, sums, ahead = min(at + width, n_docs), np.zeros(width, np.int64), n_docs
        for p in lists[lead:]:
            a, b = np.searchsorted(p.docs, (at, end))
            sums[p.docs[a:b] - at] += p.gains[a:b]
            work.scanned += int(b - a)
            ahead = min(ahead, int(p.docs[b])) if b < len(p.docs) else ahead
        rest = int(reach[lead - 1]) if lead else 0
        found = np.flatnonzero((sums > 0) & (sums + rest > least))
        for p in reversed(lists[:lead]):
            if not len(found):
                break
            place = np.searchsorted(p.docs, found + at)
            place[place == len(p.docs)] = 0
            hit = p.docs[place] == found + at
            sums[found[hit]] += p.gains[place[hit]]
            work.probed += len(found)
            rest -= p.bound
            found = found[sums[found] + rest > least]
        if len(found):
            docs, scores = np.concatenate([docs, found + at]), np.concatenate([scores, sums[found]])
            best = np.lexsort((docs, -scores))[:k]
            docs, scores = docs[best], scores[best]
            least = int(scores[-1]) if len(scores) == k else 0
        at, width = max(end, ahead), min(2 * width, WIDEST)
    return docs, scores


def search(index: DataFrame, items: DataFrame, k: int = 10, scale: int = 1_000_000_000, work: Work | None = None) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item of (item_id, text) by the integer BM25 of the module's query."""
    spark = index.sparkSession
    heads, lists = index.filter("term is null"), index.filter("term is not null")
    totals = heads.mapInArrow(_lengths, "segments long, docs long, terms long").agg(*(F.sum(c).alias(c) for c in ("segments", "docs", "terms"))).first()
    blocks = max(1, -(-items.count() // ITEM_BLOCK))
    if not totals.terms:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    n_docs, n_terms = totals.docs, totals.terms
    asked = asked_terms(items, blocks)
    counts = lists.select("term", "n").join(asked.select("term").distinct(), "term").groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1)))
    weighted = asked.join(counts.select("term", weight.alias("w")), "term").filter("w > 0")
    wanted = store(weighted.groupBy("term", "block", "w").agg(F.collect_list(F.struct("item_id")).alias("askers")), "lexical-wanted")
    pairs = wanted.agg(F.sum(F.size("askers"))).first()[0] or 0
    tasks = max(1, min(totals.segments * blocks, max(spark.sparkContext.defaultParallelism, -(-totals.segments * blocks // 8))))
    keyed = lambda df: df.repartition(tasks, "segment", "block").groupBy("segment", "block")
    met = lists.drop("ids").join(F.broadcast(wanted) if pairs <= SENT else wanted, "term")
    every = heads.select(*(F.col(c).alias(c) for c in ("segment", "ids", "tfs")), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if left.num_rows and right.num_rows:
            ids = right["ids"].combine_chunks().flatten()
            m = 10 + 90 * np.frombuffer(right["tfs"][0].as_py(), "<i8") * n_docs // n_terms
            of: dict[int | None, list[Postings]] = defaultdict(list)
            for docs, tfs, w, askers in zip(left["docs"], left["tfs"].to_pylist(), left["w"].to_pylist(), left["askers"].to_pylist(), strict=True):
                at, tf = np.frombuffer(docs.as_buffer(), "<u2").astype(np.int64), np.frombuffer(tfs, "<u4").astype(np.int64)
                gains = w * (scale * tf // (1000 * tf + 8 * m[at]))
                p = Postings(at, gains, int(gains.max()))
                for a in askers:
                    of[a["item_id"]].append(p)
            for item, held in of.items():
                docs, scores = hybrid_topk(held, len(m), k, work or Work())
                out += [(item, d, s) for d, s in zip(ids.take(pa.array(docs)).to_pylist(), scores.tolist(), strict=True)]
        columns = zip(*out, strict=True) if out else ((), (), ())
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["item_id", "doc_id", "score"])

    found = keyed(met).cogroup(keyed(every)).applyInArrow(best, "item_id long, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _lengths(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments, documents with a term, and terms with repeats, of head rows."""
    for b in frames:
        sizes = [np.frombuffer(x, "<i8") for x in b["tfs"].to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([len(sizes)], pa.int64()), pa.array([sum(int((s > 0).sum()) for s in sizes)], pa.int64()), pa.array([sum(int(s.sum()) for s in sizes)], pa.int64())], names=["segments", "docs", "terms"])


def ranked(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """Index all documents, search all items, and drop the index; the result is a table of its own."""
    index = build_index(docs)
    found = store(search(index, items, k), "lexical-hits")
    drop_table(index)
    return found


def lexical_sql(k: int = 10) -> str:
    """The same ranking in DuckDB SQL."""
    terms = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""
    WITH d AS (SELECT doc_id, {terms} AS t FROM documents), h AS (SELECT doc_id, t, CAST(len(t) AS BIGINT) AS n FROM d WHERE len(t) > 0),
    s AS (SELECT CAST(count(*) AS BIGINT) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM h),
    tf AS (SELECT doc_id, n, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT doc_id, n, unnest(t) AS term FROM h) GROUP BY ALL),
    w AS (SELECT term, CAST(floor(1000 * ln((2 * (SELECT big_n FROM s) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf GROUP BY term),
    q AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({terms}) AS term FROM benchmark)),
    m AS (SELECT doc_id, term, tf, 10 + (90 * n * big_n) // big_l AS m FROM tf, s),
    r AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM q JOIN m USING (term) JOIN w USING (term) GROUP BY item_id, doc_id)
    SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM
      (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0) WHERE rank <= {k}
    """
