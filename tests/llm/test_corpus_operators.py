"""Near-duplicates, vector links, language model, rollups, packing and the pipeline against brute force."""

import collections
import math
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from supportlake.llm import components, covertree, lm, minhash, packing, rollups
from supportlake.llm.common import scratch

VOCABULARY = P.path("byte_bpe_50k.json")


class Groups:
    def __init__(self, items):
        self.up = {i: i for i in items}

    def root(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


@pytest.fixture(scope="module")
def corpus():
    """Prose with copies, near copies around one base, short and odd texts."""
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 5)))
    text = lambda n: " ".join(word() for _ in range(n))
    base, rows = text(120).split(), [None, "", "one", "two words", "Two  WORDS", "a b c", "a b c"]
    for k in range(60):
        w = list(base)
        for _ in range(k % 9):
            w[rnd.randrange(len(w))] = word()
        rows.append(" ".join(w))
    rows += [base and " ".join(base)] * 25
    rows += [text(rnd.randint(5, 200)) for _ in range(80)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, corpus):
    rows = [(i, t, "src0" if i % 3 else "src1", "en", "mine") for i, t in enumerate(corpus)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_shingles string").repartition(3)


def shingle_groups(corpus, width, percent):
    sets = {}
    for i, t in enumerate(corpus):
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    g = Groups(sets)
    for a in sets:
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                g.join(a, b)
    return {i: (len(sets[i]), g.root(i)) for i in sets}


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(docs, corpus, width, percent):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, width, percent).collect()}
    assert got == shingle_groups(corpus, width, percent)


def test_near_duplicates_in_small_blocks(docs, corpus, monkeypatch):
    monkeypatch.setattr(minhash, "BUCKET_BLOCK", 4)
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 300)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, 3, 85).collect()}
    assert got == shingle_groups(corpus, 3, 85)


def test_near_duplicates_odd_rows(spark, docs):
    df = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (5, "a b c d"), (3, "a b c d"), (3, "a b c d")], "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in minhash.near_duplicates(df).collect())
    assert got == [("3", "3", True), ("3", "3", True), ("5", "3", False), ("None", "None", True), ("None", "None", True)]
    assert minhash.near_duplicates(docs.filter("doc_id < 0")).count() == 0
    assert minhash.drop_near_duplicates(docs).columns == docs.columns


def test_rows_that_share_an_id_are_one_document(spark):
    a, b, c = ("all of these words make one text number " + x for x in ("one", "two and more of it than before", "three which is not like any other of them"))
    rows = [(3, a), (3, b), (5, a), (9, b), (5, c), (12, c), (20, "something else entirely here now"), (3, a)]
    got = {(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert got == {(3, 3, True), (5, 3, False), (9, 3, False), (12, 3, False), (20, 20, True)}


def test_estimate_lets_every_true_pair_through(docs, corpus, monkeypatch):
    """Pairs are judged by packed signatures before any text is compared; far ones never get there."""
    seen = []
    real = minhash.confirm
    monkeypatch.setattr(minhash, "confirm", lambda pairs, *rest: (seen.append(pairs.selectExpr("explode(a) x").count()), real(pairs, *rest))[1])
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, 3, 85).collect()}
    assert got == {i: c for i, (_, c) in shingle_groups(corpus, 3, 85).items()} and sum(seen) < 1000


def test_components(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)] + [(7, 7)]
    g = Groups({x for e in edges for x in e})
    for a, b in edges:
        g.join(a, b)
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: g.root(x) for x in {x for a, b in edges if a != b for x in (a, b)}}


@pytest.mark.parametrize("block", [2048, 16])
def test_vector_links(spark, block, monkeypatch):
    monkeypatch.setattr(covertree, "BLOCK", block)
    monkeypatch.setattr(covertree.cells, "__defaults__", (block,))
    monkeypatch.setattr(covertree, "PLACED", 50)
    rnd = np.random.RandomState(0)
    seeds = rnd.randn(20, 8)
    rows = [(i, [float(x) for x in seeds[i % 20] + rnd.randn(8) * rnd.choice([0, 0.05, 0.2])], i % 3) for i in range(200)]
    rows += [(900, None, 1), (901, [0.0] * 8, 1), (902, [1.0, None] + [0.0] * 6, 1), (903, [float("nan")] * 8, 1), (904, rows[0][1], None), (905, rows[0][1], 0), (906, [2 * x for x in rows[0][1]], 0)]
    good = [(i, np.array(v), c) for i, v, c in rows if i < 900 or i > 904]
    g, links = Groups([r[0] for r in rows]), collections.Counter()
    for a, (i, v, c) in enumerate(good):
        for j, w, d in good[:a]:
            if c == d and v @ w / math.sqrt((v @ v) * (w @ w)) >= 0.98:
                links[i] += 1
                links[j] += 1
                g.join(i, j)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id) for r in covertree.near_vectors(df, 0.98).collect()}
    assert got == {r[0]: (links[r[0]], g.root(r[0])) for r in rows}
    assert covertree.near_vectors(df.filter("vec_id < 0")).count() == 0


def test_vectors_that_share_an_id_and_the_exact_threshold(spark):
    rows = [(3, [1.0, 0.0], "a"), (3, [0.0, 1.0], "a"), (5, [2.0, 0.0], "a"), (9, [0.0, 3.0], "a"), (3, [1.0, 0.0], "a"), (20, [0.6, 0.8], "b"), (21, [1.0, 0.0], "b"), (30, [1.0, 0.0, 0.0], "b")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").withColumn("key", F.lit("mine"))
    got = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in covertree.near_vectors(df, 0.6).collect()}
    assert got == {(3, 2, 3, True), (5, 1, 3, False), (9, 1, 3, False), (20, 1, 20, True), (21, 1, 20, False), (30, 0, 30, True)}


def test_vectors_of_extreme_length(spark):
    rows = [(i, [s * 3.0, s * 4.0, s * 1e-3], 1) for i, s in enumerate([1.0, 1e200, 1e-200, 2.5e307, 1e-310, 7e150])] + [(9, [1e200, -1e200, 0.0], 1)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in covertree.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), 0.98).collect()}
    assert got == {i: (5, 0) for i in range(6)} | {9: (0, 9)}


@pytest.mark.parametrize("chunk", [16_000_000, 3_000])
def test_language_model(docs, corpus, chunk, monkeypatch):
    learned = []
    real = lm.learn_weights
    monkeypatch.setattr(lm, "learn_weights", lambda cells: (learned.append(real(cells)), learned[-1])[1])
    got = {r.doc_id: r for r in lm.lm_scores(docs, chunk).collect()}
    fold = {i: zlib.crc32(str(i).encode()) % 7 for i in range(len(corpus))}
    words = {i: [*(t or "").encode().lower().split(), b" "] for i, t in enumerate(corpus)}
    one = collections.Counter(w for i, d in words.items() if fold[i] != 2 for w in d)
    two = collections.Counter(p for i, d in words.items() if fold[i] != 2 for p in zip([b" ", *d], d, strict=False))
    n, v = sum(one.values()), len(one)
    for i, d in words.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(d), sum(w in one for w in d), n, fold[i] == 2)
        assert r.base_score == pytest.approx(sum(math.log10((one[w] + 1) / (n + v + 1)) for w in d))
        score, before = 0.0, b" "
        for w in d:  # deleted interpolation with the learned weights, from plain counts
            c = one[before]
            l2, l1, l0 = learned[0][min(math.ceil(math.log2(c + 1)), lm.TOP_BUCKET)]
            score += math.log10(l2 * two[before, w] / max(c, 1) + l1 * one[w] / n + l0 / (v + 1))
            before = w
        assert r.score == pytest.approx(score)
    kept = lm.Totals(0, 0, n, v)
    weights = lm.learn_weights([(3, 10.0, 0.5, 0.01, 0.001), (3, 5.0, 0.0, 0.01, 0.001), (3, 1.0, 0.0, 0.0, 0.001)])
    assert kept.v == len(one) and weights.sum(axis=1) == pytest.approx(np.ones(len(weights))) and weights[3][0] > weights[3][2]
    assert sum(two.values()) == n


def test_model_beats_the_base_on_held_out_text(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    r = lm.lm_scores(df).filter("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert r.s > r.b
    assert lm.lm_scores(df.filter("doc_id < 0")).count() == 0


def test_rollups_are_idempotent(spark):
    change = "source string, lang string, tokenizer string, op string, n_tokens long, old_tokens long"
    r = rollups.Rollup(spark, scratch(spark, "rollup-test"))
    first = spark.createDataFrame([("a", "en", "v1", "insert", 10, None), ("a", "en", "v1", "insert", 5, None), (None, None, "v1", "insert", 7, None)], change)
    second = spark.createDataFrame([("a", "en", "v1", "delete", 5, None), ("a", "en", "v1", "revise", 12, 10), (None, None, "v1", "delete", 7, None)], change)
    assert r.commit("1", first) and not r.commit("1", first) and r.commit("2", second) and not r.commit("2", second)
    want = [("a", "en", "v1", 1, 12)]
    assert [tuple(x) for x in r.totals().collect()] == want
    r.compact("c1")
    assert [tuple(x) for x in r.totals().collect()] == want and r.committed() == ["1", "2"] and not r.commit("2", second)
    assert r.commit("3", first.limit(0)) and [tuple(x) for x in r.totals().collect()] == want
    with pytest.raises(Exception, match="unknown change"):
        r.commit("4", spark.createDataFrame([("a", "en", "v1", "odd", 1, None)], change))


def test_a_lost_race_leaves_nothing(spark):
    change = "source string, lang string, tokenizer string, op string, n_tokens long, old_tokens long"
    rows = spark.createDataFrame([("a", "en", "v1", "insert", 10, None)], change)
    r = rollups.Rollup(spark, scratch(spark, "rollup-race"))
    assert r._put("batches", "1", ["1"], rollups.deltas(rows)) and not r._put("batches", "1", ["1"], rollups.deltas(rows))
    assert [tuple(x) for x in r.totals().collect()] == [("a", "en", "v1", 1, 10)] and r.committed() == ["1"]


def test_compactions_and_batches_may_share_a_name(spark):
    change = "source string, lang string, tokenizer string, op string, n_tokens long, old_tokens long"
    rows = spark.createDataFrame([("a", "en", "v1", "insert", 10, None)], change)
    r = rollups.Rollup(spark, scratch(spark, "rollup-names"))
    assert r.commit("b1", rows) and r.commit("b2", rows)
    r.compact("b3")
    assert r.commit("b3", rows) and [tuple(x) for x in r.totals().collect()] == [("a", "en", "v1", 3, 30)] and r.committed() == ["b1", "b2", "b3"]
    r.compact("b3")  # the name is taken: nothing happens
    assert [tuple(x) for x in r.totals().collect()] == [("a", "en", "v1", 3, 30)]
    sums = r.totals()
    assert r._put("compacted", "x", ["b1", "b2", "b3"], sums) and r._put("compacted", "y", ["b1", "b2", "b3"], sums)
    assert [tuple(x) for x in r.totals().collect()] == [("a", "en", "v1", 3, 30)]
    r.compact("z")
    assert r.commit("b4", rows) and not r.commit("b2", rows)
    r.compact("w")
    assert [tuple(x) for x in r.totals().collect()] == [("a", "en", "v1", 4, 40)] and r._names() == [("compacted", "w")]


def test_corpus_rollup_counts_ids(spark, docs, corpus):
    import base64

    import tiktoken

    t = Tokenizer.from_file(VOCABULARY)
    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = collections.defaultdict(lambda: [0, 0])
    for i, x in enumerate(corpus):
        a, b = len(t.encode(x or "", add_special_tokens=False).ids), len(other.encode_ordinary(x or ""))
        if a >= 20:
            for key, n in (("byte-50k", a + 1), ("byte-multi-50k", b)):
                got = want["src0" if i % 3 else "src1", "en", key]
                got[0], got[1] = got[0] + 1, got[1] + n
    first, second = (VOCABULARY, None), (path, P.PATTERN)
    rows = rollups.corpus_rollup(spark, docs, first, second).collect()
    assert {(r.source, r.lang, r.tokenizer): [r.n_docs, r.n_tokens] for r in rows} == dict(want)
    assert rollups.corpus_rollup(spark, docs.filter("doc_id < 0"), first, second).count() == 0


def check_pieces(rows, texts, end_id, window=2048):
    t = Tokenizer.from_file(VOCABULARY)
    by = collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    for i, x in texts.items():
        ids, at = np.array([*t.encode(x or "", add_special_tokens=False).ids, end_id], "<u4"), 0
        for r in sorted(by[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    windows = collections.defaultdict(list)
    for r in rows:
        windows[r.sequence_id].append((r.offset, r.length))
    ends = []
    for parts in windows.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and n > 0
            at += n
        ends.append(at)
    assert max(ends) <= window
    return sum(e < window for e in ends)


@pytest.mark.parametrize("shard", [1_000_000, 3_000])
def test_packing(docs, corpus, shard):
    rows = packing.pack(docs, VOCABULARY, 1, shard_tokens=shard).collect()
    short = check_pieces(rows, dict(enumerate(corpus)), 1)
    assert short <= len({r.sequence_id >> 32 for r in rows})
    assert packing.pack(docs.filter("doc_id < 0"), VOCABULARY).count() == 0


def test_packing_prefers_lexical_neighbours():
    a, b = np.arange(100, 160, dtype="<u2"), np.arange(500, 560, dtype="<u2")
    idf = np.ones(1 << 16)
    pieces = packing.fill_windows([a, b, b[::-1].copy(), a[::-1].copy()], idf, 60.0, window=120)
    assert {w: {d for d, _, _, k, _ in pieces if k == w} for w in (0, 1)} == {0: {0, 3}, 1: {1, 2}}


def test_packing_deals_related_documents_to_one_shard(spark):
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("bcdfghjklmnpqrstvwxz") for _ in range(7))
    topics = [[word() for _ in range(12)] for _ in range(60)]
    texts = [" ".join(rnd.sample(t, 12)) for t in topics for _ in range(4)] + ["one and the same text of a large group"] * 400
    rows = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5), VOCABULARY, 1, window=64, shard_tokens=1500).collect()
    check_pieces(rows, dict(enumerate(texts)), 1, 64)
    shards, sizes = collections.defaultdict(set), collections.Counter()
    for r in rows:
        shards[r.doc_id].add(r.sequence_id >> 32)
        sizes[r.sequence_id >> 32] += r.length
    pairs = [(4 * k + i, 4 * k + j) for k in range(60) for i in range(4) for j in range(i)]
    assert len(sizes) >= 10 and max(sizes.values()) <= 2 * 1500
    assert sum(shards[a] == shards[b] for a, b in pairs) >= 0.6 * len(pairs)


def test_pipeline_on_odd_rows(spark, tmp_path):
    good = " ".join(f"the word{i} and it{i}" for i in range(60))
    other = " ".join(f"a thing{i} in place{i}" for i in range(60))
    long = " ".join(f"the item{i} of that{i}" for i in range(40_000))
    rows = [(1, good), (2, good), (2, other), (7, other), (None, good), (9, None), (10, ""), (11, "short"), (12, good + " password=hunter22abc"), (1, good), (13, long)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text"), "kept": F.lit("mine"), "node": F.lit(5)})
    df.write.parquet(f"{tmp_path}/documents.parquet")
    found = df
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, found, str(tmp_path))
        assert found.columns == df.columns, name
    assert sorted((str(r.doc_id), r.kept, r.node) for r in found.collect()) == [("1", "mine", 5), ("1", "mine", 5), ("13", "mine", 5), ("None", "mine", 5)]
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in pieces} == {1, None, 13} and sum(r.length for r in pieces if r.doc_id == 13) > 100_000
    empty = df.filter("doc_id < 0")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0, name
    nulls = spark.createDataFrame([(None, None), (4, None)], df.select("doc_id", "text").schema)
    assert corpus_pipeline.near_duplicate_stage(spark, nulls, "").count() == 2 and corpus_pipeline.secret_stage(spark, nulls, "").filter("text is null").count() == 2
    assert sorted((str(r.doc_id), r.length) for r in corpus_pipeline.packing_stage(spark, nulls, "").collect()) == [("4", 1), ("None", 1)]


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    found = spark.read.parquet(f"{sf}/documents.parquet")
    columns = found.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in found.collect()}
        found = stage(spark, found, sf)
        after = {r.doc_id: r.text for r in found.collect()}
        assert found.columns == columns and after.keys() <= before.keys(), name
        if name == "near_duplicates":
            ids = sorted(before)
            groups = shingle_groups([before[i] for i in ids], 5, 80)
            assert after.keys() == {i for k, i in enumerate(ids) if groups[k][1] == k}
        if name == "secrets":
            assert after.keys() == before.keys() and not any("password=" in t for t in after.values())
            assert all(after[i] == before[i] for i in after if "[secret:" not in after[i])
    rows = corpus_pipeline.run(spark, sf).collect()
    check_pieces(rows, after, 50256)
