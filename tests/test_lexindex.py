"""The lexical index against plain sums, in one block and in many, and the pairs that bounds leave out."""

import collections
import math
import random
import re

import numpy as np
import pytest

from supportlake.operators import lexindex
from supportlake.plans import registry
from supportlake.plans.derived import chunks, questions


def words(text):
    return [w for w in re.split(r"[^a-z0-9]+", (text or "").lower()) if w]


def plain(chunks, queries, k, k1, b):
    bags = {i: collections.Counter(words(t)) for i, t in chunks if i is not None}
    n, mean = len(bags), sum(sum(x.values()) for x in bags.values()) / max(1, len(bags))
    df = collections.Counter(t for x in bags.values() for t in x)
    asked = collections.defaultdict(set)
    for q, t in queries:
        asked[q] |= set(words(t))
    out = {}
    for q, own in asked.items():
        rows = []
        for i, x in bags.items():
            long = sum(x.values())
            s = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * x[t] * (k1 + 1) / (x[t] + k1 * (1 - b + b * long / mean)) for t in own if x[t])
            if s > 0:
                rows.append((-round(s, 6), i))
        out |= {(q, r + 1): (i, -s) for r, (s, i) in enumerate(sorted(rows)[:k])}
    return out


@pytest.fixture(scope="module")
def data(spark):
    rnd = random.Random(8)
    word = lambda: f"w{int(rnd.paretovariate(0.6))}"
    texts = [(f"c{i:03}", " ".join(word() for _ in range(rnd.choice([2, 10, 50])))) for i in range(500)]
    texts += [("d1", None), ("d2", ""), ("d3", " ?! "), ("e1", "same words w1"), ("e2", "same words w1"), ("f", "w1 " * 5000)]
    asked = [("a", "w1 w2 w5 w1"), ("b", "same words"), ("c", "unknown"), ("d", None), ("e", " ".join(f"w{i}" for i in range(1, 40))), ("a", "w77")]
    return texts, asked, spark.createDataFrame([*texts, (None, "w1")], "chunk_id string, text string").repartition(3), spark.createDataFrame(asked, "query_id string, query string")


@pytest.mark.parametrize("many", [64, 4])
def test_search_equals_plain_sums(data, many, monkeypatch):
    texts, asked, chunked, queries = data
    monkeypatch.setattr(lexindex, "MANY", many)
    monkeypatch.setattr(lexindex, "SHARE", 3)
    monkeypatch.setattr(lexindex, "QUESTIONS", 512 if many == 64 else 2)
    index = lexindex.LexicalIndex(chunked, 4096 if many == 64 else 40)
    assert (index.blocks >= many) == (many == 4)
    rows = index.search(queries, 7, ((1.2, 0.75), (0.6, 0.3))).collect()
    for number, (k1, b) in enumerate(((1.2, 0.75), (0.6, 0.3))):
        want = plain(texts, asked, 7, k1, b)
        got = {(r.query_id, r["rank"]): (r.chunk_id, r.score) for r in rows if r.setting == number}
        assert got.keys() == want.keys() and all(got[x][0] == want[x][0] and abs(got[x][1] - want[x][1]) < 2e-6 for x in want)
    index.drop()


def test_index_of_empty_tables(data):
    _, _, chunked, queries = data
    assert lexindex.bm25_topk(queries, chunked.filter("chunk_id = 'x'")).count() == lexindex.bm25_topk(queries.filter("query_id = 'x'"), chunked).count() == 0
    assert lexindex.bm25_topk(queries, chunked.filter("chunk_id = 'd1'")).count() == 0


def test_block_best_equals_full_sums():
    rnd = np.random.RandomState(3)
    for _ in range(80):
        n, k = int(rnd.choice([30, 900, 5000])), int(rnd.choice([1, 5]))
        lists = []
        for _ in range(rnd.randint(1, 8)):
            p = np.flatnonzero(rnd.rand(n) < rnd.choice([0.01, 0.3, 0.9]))
            if len(p):
                g = rnd.choice([0.25, 0.5, 1.0, 4.0], len(p))
                lists.append(lexindex.Postings(p, g, n))
        sums, back = np.zeros(n), rnd.permutation(n)
        for x in lists:
            sums[x.places] += x.gains
        if not lists:
            continue
        order = np.lexsort((back, -sums))[:k]
        order = order[sums[order] > 0]
        places, scores, touched = lexindex.block_best(lists, n, k, back)
        assert places.tolist() == order.tolist() and scores.tolist() == sums[order].tolist() and touched <= (sums > 0).sum()
        if len(order) == k:  # a floor at the k-th score loses nothing
            assert lexindex.block_best(lists, n, k, back, float(scores[-1]))[0].tolist() == order.tolist()


def test_bounds_leave_most_pairs_out(spark):
    """Of all pairs of question and chunk that share a word, some are brought up: 0.35 on sf0.1, where the fifth score lies low."""
    folder = "/root/testdata/sf0.1"
    c, q = chunks(spark, folder), questions(spark, folder)
    index = lexindex.LexicalIndex(c)
    scored = spark.sparkContext.accumulator(0)
    index.search(q, 5, scored=scored).count()
    every = spark.sparkContext.accumulator(0)
    index.search(q, 10**6, scored=every).count()
    index.drop()
    assert scored.value * 5 <= 2 * every.value


def test_blocks_gather_small_batches(spark, data, monkeypatch):
    """Few chunks come to a task at once, whatever the session says; blocks are full all the same, and the setting is put back."""
    texts, asked, chunked, queries = data
    monkeypatch.setattr(lexindex, "BATCH", 7)
    before = spark.conf.get(lexindex.RECORDS)
    index = lexindex.LexicalIndex(chunked.coalesce(1).repartition(16), 20)
    sizes = sorted(len(r.ids) for r in index.heads.select("ids").collect())
    assert sum(sizes) == len(texts) and sizes[-1] == 20 and len(sizes) <= 16 * 2 and spark.conf.get(lexindex.RECORDS) == before
    got = {(r.query_id, r["rank"]): r.chunk_id for r in index.search(queries, 7).collect()}
    assert got == {x: i for x, (i, _) in plain(texts, asked, 7, 1.2, 0.75).items()}
    index.drop()


def test_gate_builds_one_index(spark, monkeypatch):
    built, plain_init = [], lexindex.LexicalIndex.__init__
    monkeypatch.setattr(lexindex.LexicalIndex, "__init__", lambda self, *a: built.append(1) or plain_init(self, *a))
    assert registry.queries()["e11_gate"](spark, "/root/testdata/sf0.001").count() == 3 and len(built) == 1


def test_stretches_are_summed_up_in_groups(monkeypatch):
    """A block of many stretches takes a few sums over whole groups of them, not some for each stretch."""
    rnd = np.random.RandomState(4)
    lists = [lexindex.Postings(p, rnd.rand(len(p)), 40_000) for p in (np.flatnonzero(rnd.rand(40_000) < s) for s in (0.3, 0.2, 0.01))]
    groups, plain_bincount = [], np.bincount
    monkeypatch.setattr(lexindex.np, "bincount", lambda *a, **k: groups.append(1) or plain_bincount(*a, **k))
    places, scores, _ = lexindex.block_best(lists, 40_000, 40_000, np.arange(40_000))
    sums = sum(plain_bincount(x.places, x.gains, 40_000) for x in lists)
    assert 2 <= len(groups) <= 20 and sorted(places.tolist()) == np.flatnonzero(sums).tolist() and np.allclose(scores, sums[places])


def test_cascade_ranks_the_first_alone(spark, monkeypatch):
    asked, plain_search = [], lexindex.LexicalIndex.search
    monkeypatch.setattr(lexindex.LexicalIndex, "search", lambda self, q, k=20, *a: asked.append(k) or plain_search(self, q, k, *a))
    assert registry.queries()["r17_cascade"](spark, "/root/testdata/sf0.001").count() > 0 and asked == [1]


def test_single_search_keeps_lists_of_its_terms(data, monkeypatch):
    """The index of one search alone holds no other terms, and gives the same rows as one of all terms."""
    texts, asked, chunked, queries = data
    held, plain_search = [], lexindex.LexicalIndex.search
    monkeypatch.setattr(lexindex.LexicalIndex, "search", lambda self, q, k=20, *a: held.append({r.term for r in self.lists.select("term").distinct().collect()}) or plain_search(self, q, k, *a))
    want = plain(texts, asked, 7, 1.2, 0.75)
    for sent in (lexindex.SENT, 3):
        monkeypatch.setattr(lexindex, "SENT", sent)
        got = {(r.query_id, r["rank"]): (r.chunk_id, r.score) for r in lexindex.bm25_topk(queries, chunked, 7).collect()}
        assert got.keys() == want.keys() and all(got[x][0] == want[x][0] and abs(got[x][1] - want[x][1]) < 2e-6 for x in want)
    every = {w for _, t in texts for w in words(t)} | {"w1"}
    assert held == [every & {w for _, t in asked for w in words(t)}, every] and len(held[0]) < len(held[1])


def test_a_floor_makes_one_group(monkeypatch):
    """Where other blocks gave a k-th score, all stretches that reach it are summed up at once."""
    rnd = np.random.RandomState(6)
    lists = [lexindex.Postings(p, rnd.rand(len(p)), 40_000) for p in (np.flatnonzero(rnd.rand(40_000) < s) for s in (0.3, 0.2, 0.01))]
    places, scores, _ = lexindex.block_best(lists, 40_000, 5, np.arange(40_000))
    sums, plain_bincount = [], np.bincount
    monkeypatch.setattr(lexindex.np, "bincount", lambda *a, **k: sums.append(1) or plain_bincount(*a, **k))
    again = lexindex.block_best(lists, 40_000, 5, np.arange(40_000), float(scores[-1]) / 2)
    assert len(sums) == 2 and again[0].tolist() == places.tolist() and again[1].tolist() == scores.tolist()
