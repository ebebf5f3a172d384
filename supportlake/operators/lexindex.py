"""BM25 over an inverted index with score bounds.

The index is a table. Each task cuts its chunks into blocks and inverts them, so building it reads the text once and shuffles
nothing. A row is the list of one term in one block (places of chunks in the block and occurrences), and a
block's head row, under an empty term, lists its chunks and their lengths. Lengths and frequencies are kept, not
weights, so one index serves any constants.

A search reads only the lists of the questions' terms. Chunks of a block stand in order of length, so that short
stretches of it hold chunks alike and each list's highest weight in a stretch is a close bound. Stretches are
taken from the highest sum of bounds down, with a running k-th score; the first that cannot reach it ends the block, and in
a stretch the terms that together cannot reach it bring up no chunk. An index that serves one search alone (`bm25_topk`) keeps the lists
of that search's terms only; it reads the same text, and lengths count all words. With many blocks a first round over a share of
them gives every question a k-th score that the second round starts from, so whole blocks end at once.

Defined results: a null text holds no term but counts as a chunk; a null chunk_id is dropped; chunks that share a chunk_id are
one each; a question without a known term has no rows; questions that share a query_id are one, with the
terms of all; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from supportlake.functions.tables import OwnTable
from supportlake.functions.text import tokens

#: Chunks of a block at most, and words after which it ends.
BLOCK, WORDS = 4096, 2_000_000
#: Chunks that come to a task at once; a block takes those of several such batches, so a task holds one block and one batch.
BATCH, RECORDS = 512, "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Questions whose scores one group computes.
QUESTIONS = 512
#: Blocks from which a first round pays, and its share of them.
MANY, SHARE = 64, 16
#: (term, question) pairs up to which they, or terms up to which these, are sent to all tasks, some 60 bytes each; beyond it both sides are shuffled.
SENT = 200_000
#: Chunks of a stretch, and stretches of the first group that is summed up at once.
STRETCH, GROUP = 64, 4
#: Scores are compared after rounding to six digits; bounds allow for that.
DIGITS, SLACK = 6, 2e-6
HEAD = ""


def _terms(queries: DataFrame) -> DataFrame:
    """(query_id, term), each pair once."""
    return queries.select("query_id", F.explode_outer(F.array_distinct(tokens(F.col("query")))).alias("term")).filter("term is not null").distinct()


def _invert(b: pa.RecordBatch, block: int, asked: pa.Array | None = None) -> pa.RecordBatch:
    """The rows of one block from (chunk_id, words), its head first. Places go by length. With `asked` the other words have no lists."""
    lists, n = b["words"], b.num_rows
    starts = lists.offsets.to_numpy().astype(np.int64)
    lengths = np.diff(starts)
    sorted_by = np.argsort(lengths, kind="stable")
    place = np.empty(n, np.int64)
    place[sorted_by] = np.arange(n)
    if asked is None:
        coded = lists.flatten().dictionary_encode()
        code, known = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
        pairs = code * n + np.repeat(place, lengths)
    else:
        code, known = pc.fill_null(pc.index_in(lists.flatten(), value_set=asked), -1).to_numpy(zero_copy_only=False), asked
        own = np.flatnonzero(code >= 0)
        pairs = code[own].astype(np.int64) * n + np.repeat(place, lengths)[own]
    pairs, tfs = np.unique(pairs, return_counts=True)
    first = np.flatnonzero(np.diff(pairs // n, prepend=-1)) if n else np.zeros(0, np.int64)
    edges = np.append(first, len(pairs))
    numbers = lambda x: pa.array(x.astype(np.int32))
    listed = lambda head, flat: pa.ListArray.from_arrays(numbers(np.append(0, edges + len(head))), numbers(np.append(head, flat)))
    ids = pa.ListArray.from_arrays(numbers(np.append(0, np.full(len(first) + 1, n))), b["chunk_id"].take(pa.array(sorted_by)))
    terms = pa.concat_arrays([pa.array([HEAD]), known.take(pa.array(pairs[first] // n))])
    none = np.zeros(0, np.int64)
    columns = [pa.array(np.full(len(terms), block)), terms, numbers(np.append(0, np.diff(edges))), listed(none, pairs % n), listed(lengths[sorted_by], tfs), ids]
    return pa.RecordBatch.from_arrays(columns, names=["block", "term", "df", "places", "tfs", "ids"])


class LexicalIndex:
    """The stored index of `chunks` (chunk_id, text); with `asked`, of these terms alone."""

    def __init__(self, chunks: DataFrame, block: int = BLOCK, asked: Sequence[str] | None = None):
        self.id_type = dict(chunks.dtypes)["chunk_id"]
        conf = chunks.sparkSession.conf
        rows = conf.get(RECORDS)
        conf.set(RECORDS, min(BATCH, int(rows)) if int(rows) > 0 else BATCH)
        try:
            self.table = OwnTable(self._lists(chunks, block, asked), "lexical-index")
        finally:
            conf.set(RECORDS, rows)
        self.lists, self.heads = self.table.df.filter(F.col("term") != HEAD), self.table.df.filter(F.col("term") == HEAD)
        length = F.aggregate("tfs", F.lit(0).cast("long"), lambda s, x: s + x)
        known = self.heads.agg(F.count("*").alias("blocks"), F.sum(F.size("ids")).alias("n"), F.sum(length).alias("words")).first()
        self.blocks, self.n, self.length = known.blocks, known.n or 0, (known.words or 0) / max(1, known.n or 0)  # `length` is the mean one

    def _lists(self, chunks: DataFrame, block: int, asked: Sequence[str] | None) -> DataFrame:
        rows = chunks.filter("chunk_id is not null").select("chunk_id", "text")
        cores = rows.sparkSession.sparkContext.defaultParallelism
        if rows.rdd.getNumPartitions() < 4 * cores:  # a small table, whose rows may lie in one file's only row group
            rows = rows.repartition(2 * cores, "chunk_id")

        sent = None if asked is None else rows.sparkSession.sparkContext.broadcast(list(asked))

        def run(frames):
            from pyspark import TaskContext

            wanted = None if sent is None else pa.array(sent.value, pa.string())
            at = TaskContext.get().partitionId() << 32
            held, n, words = [], 0, 0  # slices of batches that make up the next block

            def inverted() -> pa.RecordBatch:
                out = _invert(pa.Table.from_batches(held).combine_chunks().to_batches()[0], at, wanted)
                held.clear()
                return out

            for b in frames:
                ends = b["words"].offsets.to_numpy().astype(np.int64)
                start = 0
                while start < b.num_rows:
                    end = min(start + block - n, int(np.searchsorted(ends, ends[start] + WORDS - words, side="right")) - 1, b.num_rows)
                    end = max(end, start + (not held))
                    if end > start:
                        held.append(b.slice(start, end - start))
                        n, words, start = n + end - start, words + int(ends[end] - ends[start]), end
                    if start < b.num_rows or n == block:
                        yield inverted()
                        n, words, at = 0, 0, at + 1
                        pa.default_memory_pool().release_unused()
            if held:
                yield inverted()

        shape = f"block long, term string, df int, places array<int>, tfs array<int>, ids array<{self.id_type}>"
        return rows.select("chunk_id", tokens(F.col("text")).alias("words")).mapInArrow(run, shape)

    def drop(self) -> None:
        self.table.drop()

    def search(self, queries: DataFrame, k: int = 20, settings: Sequence[tuple[float, float]] = ((1.2, 0.75),), scored=None) -> DataFrame:
        """(query_id, setting, chunk_id, score, rank) for each of `settings` (k1, b), scored from the same lists.

        `scored` is an accumulator that gets the number of (question, chunk) pairs whose score was summed up.
        """
        found = OwnTable(self._search(queries, k, tuple(settings), scored), "lexical-found")
        return found.df

    def _search(self, queries: DataFrame, k: int, settings: tuple[tuple[float, float], ...], scored) -> DataFrame:
        terms = _terms(queries)
        groups = max(1, -(-queries.select("query_id").distinct().count() // QUESTIONS))
        df = self.lists.select("term", "df").join(terms.select("term").distinct(), "term").groupBy("term").agg(F.sum("df").alias("df"))
        idf = F.log(1 + (F.lit(float(self.n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        known = terms.join(df.select("term", idf.alias("idf")), "term").withColumn("group", F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int"))
        asked = OwnTable(known.groupBy("term", "group", "idf").agg(F.collect_list("query_id").alias("askers")), "lexical-asked")
        pairs = asked.df.agg(F.sum(F.size("askers"))).first()[0] or 0
        wanted = F.broadcast(asked.df) if pairs <= SENT else asked.df
        kind = dict(queries.dtypes)["query_id"]
        floors, first = None, F.lit(True)
        if self.blocks >= MANY:
            first = F.pmod(F.xxhash64("block"), F.lit(SHARE)) == 0
            top = self._round(wanted, first, groups, k, settings, scored, kind, None)
            ranked = _ranked(top, k).filter(F.col("rank") == k)
            floors = OwnTable(ranked.select("query_id", "setting", "score").groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("setting", "score"))).alias("floors")), "lexical-floors").df
            floors = floors.withColumn("group", F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int"))
        every = self._round(wanted, F.lit(True), groups, k, settings, scored, kind, floors)
        return _ranked(every, k).withColumn("score", F.round("score", DIGITS))

    def _round(self, wanted: DataFrame, where: Column, groups: int, k: int, settings, scored, kind: str, floors: DataFrame | None) -> DataFrame:
        """The k best of each question in each of the blocks."""
        lists = self.lists.filter(where).select("block", "term", "places", "tfs").join(wanted, "term")
        if floors is not None:
            groups_of = floors.groupBy("group").agg(F.collect_list(F.struct("query_id", "floors")).alias("held"))  # QUESTIONS entries a row, about
        heads = self.heads.filter(where).select(F.col("block").alias("block"), F.col("ids").alias("ids"), F.col("tfs").alias("lengths"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
        heads = heads.join(F.broadcast(groups_of) if groups == 1 else groups_of, "group", "left") if floors is not None else heads.withColumn("held", F.lit(None).cast(f"array<struct<query_id:{kind},floors:map<int,double>>>"))
        cells = max(1, self.blocks * groups)
        n = min(cells, max(-(-cells // 8), 4 * self.table.spark.sparkContext.defaultParallelism))
        dealt = lambda x: x.repartition(n, "block", "group").groupBy("block", "group")
        mean, shape = self.length, f"query_id {kind}, setting int, chunk_id {self.id_type}, score double"
        typed = to_arrow_schema(_parse_datatype_string(shape))

        def best(left: pa.Table, right: pa.Table) -> pa.Table:
            out: list[tuple] = []
            if left.num_rows and right.num_rows:
                ids, lengths = right["ids"][0].values, right["lengths"][0].values.to_numpy().astype(np.float64)
                order = np.argsort(np.asarray(ids.to_pylist(), dtype=object), kind="stable").argsort()
                floor = {h["query_id"]: dict(h["floors"]) for h in right["held"][0].as_py() or []}
                askers, idf = left["askers"].to_pylist(), left["idf"].to_pylist()
                joined = lambda name: pa.concat_arrays(left[name].chunks)
                listed, edges = joined("places").flatten().to_numpy(), np.append(0, np.cumsum(pc.list_value_length(joined("places")).to_numpy()))
                tfs, weights = joined("tfs").flatten().to_numpy(), np.repeat(idf, np.diff(edges))
                for number, (k1, b) in enumerate(settings):
                    of, drag = defaultdict(list), k1 * (1 - b + b * lengths / mean) if mean else np.zeros(len(lengths))
                    entries = Postings.several(listed, weights * tfs * (k1 + 1) / (tfs + drag[listed]), edges, len(lengths))
                    for entry, who in zip(entries, askers, strict=True):
                        for q in who:
                            of[q].append(entry)
                    for q, held in of.items():
                        places, scores, touched = block_best(held, len(lengths), k, order, floor.get(q, {}).get(number, 0.0))
                        out += [(q, number, c, s) for c, s in zip(ids.take(pa.array(places)).to_pylist(), scores.tolist(), strict=True)]
                        if scored is not None:
                            scored.add(touched)
            columns = list(zip(*out, strict=True)) or [()] * 4
            return pa.table([pa.array(c, f.type) for c, f in zip(columns, typed, strict=True)], schema=typed)

        return dealt(lists).cogroup(dealt(heads)).applyInArrow(best, shape)


def _ranked(df: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id", "setting").orderBy(F.desc(F.round("score", DIGITS)), F.col("chunk_id"))
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


class Postings:
    """One term's list in a block, with the highest gain in each stretch of STRETCH places."""

    __slots__ = ("gains", "highest", "places", "top")

    def __init__(self, places: np.ndarray, gains: np.ndarray, n: int):
        whole = next(iter(self.several(places, gains, np.array([0, len(places)]), n)))
        self.places, self.gains, self.highest, self.top = whole.places, whole.gains, whole.highest, whole.top

    @classmethod
    def several(cls, places: np.ndarray, gains: np.ndarray, edges: np.ndarray, n: int) -> Iterator[Postings]:
        """The lists of a block that stand one after another, each not empty and from `edges` on."""
        stretches = -(-n // STRETCH)
        cell = np.repeat(np.arange(len(edges) - 1) * stretches, np.diff(edges)) + places // STRETCH
        first = np.flatnonzero(np.diff(cell, prepend=-1))
        highest = np.zeros((len(edges) - 1, stretches))
        highest.ravel()[cell[first]] = np.maximum.reduceat(gains, first)
        for start, end, row, top in zip(edges[:-1].tolist(), edges[1:].tolist(), highest, highest.max(axis=1).tolist(), strict=True):
            one = cls.__new__(cls)
            one.places, one.gains, one.highest, one.top = places[start:end], gains[start:end], row, top
            yield one


def block_best(lists: list[Postings], n: int, k: int, order: np.ndarray, floor: float = 0.0) -> tuple[np.ndarray, np.ndarray, int]:
    """(places, scores) of the k best sums of a block that reach `floor`, and how many chunks were brought up.

    Stretches of places are taken by the sum of their lists' highest gains, highest first, in groups that grow (with a floor, which other
    blocks gave, all that reach it are one group); each group is summed up at once, and the first that cannot reach the k-th score ends the block. In a stretch, the lists that together cannot
    reach it bring up no chunk. Equal scores (rounded) go by `order` of the place. The sums of the heaviest short lists alone give
    a first k-th score: what a chunk has there it has at least in the end.
    """
    highest = np.stack([x.highest for x in lists])
    totals = highest.sum(axis=0)
    rising = np.argsort(highest, axis=0, kind="stable")
    reach = np.cumsum(np.take_along_axis(highest, rising, axis=0), axis=0)
    above = np.empty_like(rising)  # a list's place among those of a stretch, by highest gain
    np.put_along_axis(above, rising, np.arange(len(lists))[:, None], axis=0)
    at, gains = np.concatenate([x.places for x in lists]), np.concatenate([x.gains for x in lists])
    cell = np.repeat(np.arange(len(lists)) * len(totals), [len(x.places) for x in lists]) + at // STRETCH
    falling, taken, group = np.argsort(-totals, kind="stable"), 0, GROUP if floor <= 0 else len(totals)
    places, scores, least, touched = np.zeros(0, np.int64), np.zeros(0), floor if floor > 0 else _sure(lists, n, k), 0
    while taken < len(falling):
        here = falling[taken : taken + group]
        here = here[(totals[here] >= least - SLACK) & (totals[here] > 0)]
        if not len(here):
            break
        taken, group = taken + group, group * 2
        lead = np.zeros(len(totals), np.int64)  # lists of a stretch that bring up nothing
        lead[here] = (reach[:, here] <= least - SLACK).sum(axis=0)
        rest = np.where(lead > 0, reach[np.maximum(lead, 1) - 1, np.arange(len(totals))], 0.0)
        part = np.zeros(above.shape, np.uint8)  # of a list in a stretch: 2 brings up, 1 adds to what is brought up, 0 for stretches of other groups
        part[:, here] = 1 + (above[:, here] >= lead[here])
        part = part.ravel()[cell]
        some, others = np.flatnonzero(part == 2), np.flatnonzero(part == 1)
        sums = np.bincount(at[some], gains[some], n)
        found = sums > 0
        touched += int(found.sum())
        found &= sums + np.repeat(rest, STRETCH)[:n] > least - SLACK
        others = others[found[at[others]]]
        sums += np.bincount(at[others], gains[others], n)
        found = np.flatnonzero(found & (sums > least - SLACK))
        if len(found):
            places, scores = np.concatenate([places, found]), np.concatenate([scores, sums[found]])
            best = np.lexsort((order[places], -np.round(scores, DIGITS)))[:k]
            places, scores = places[best], scores[best]
            least = max(least, float(scores[-1])) if len(scores) == k else least
    return places, scores, touched


def _sure(lists: list[Postings], n: int, k: int) -> float:
    """A score that k chunks reach for certain: the k-th of the sums over the heaviest lists that together hold at most an eighth of the block."""
    sums, held = np.zeros(n), 0
    for x in sorted(lists, key=lambda x: -x.top):
        if held + len(x.places) > n // 8 or n < k:
            break
        held += len(x.places)
        sums[x.places] += x.gains
    return float(np.partition(sums, -k)[-k]) if held >= k else 0.0


def bm25_topk(queries: DataFrame, chunks: DataFrame, k: int = 20, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """R1 for one ranking: index, search, and drop the index. (query_id, chunk_id, score, rank); ties by chunk_id."""
    asked = [r.term for r in _terms(queries).select("term").distinct().limit(SENT + 1).collect()]
    index = LexicalIndex(chunks, BLOCK, asked if len(asked) <= SENT else None)
    found = index.search(queries, k, ((k1, b),)).drop("setting")
    index.drop()
    return found
