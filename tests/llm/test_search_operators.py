"""Lexical search, hard negatives and web archives against brute force and their SQL."""

import collections
import gzip
import hashlib
import math
import random
import re

import duckdb
import numpy as np
import pyarrow.fs
import pytest
from pyspark.sql import functions as F

from supportlake.llm import lexical, negatives, warc
from supportlake.llm.common import scratch, shared_dir

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(SMALL))


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(11)
    word = lambda: rnd.choice(["the", "The", "of", "É", "é", "日本", "x1", "a_b", "q"]) if rnd.random() < 0.4 else f"w{int(rnd.paretovariate(0.7))}"
    found = [" ".join(word() for _ in range(rnd.choice([1, 3, 20, 60]))) for _ in range(300)]
    return [*found, None, "", " ,;\n", "Same text twice", "Same text twice", "the " * 3000, "\x85the\xa0 İI"]


def best(texts, ids, items, k):
    """Every score by plain integers."""
    bags = [collections.Counter(terms(t)) for t in texts]
    held = [b for b in bags if b]
    big_n, big_l = len(held), sum(sum(b.values()) for b in held)
    df = collections.Counter(t for b in held for t in b)
    out = {}
    for item, own in items.items():
        rows = []
        for i, b in zip(ids, bags, strict=True):
            m = 10 + 90 * sum(b.values()) * big_n // big_l
            s = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t in own if b[t])
            if s > 0:
                rows.append((-s, i is None, i))
        out |= {(item, r + 1): (i, -s) for r, (s, _, i) in enumerate(sorted(rows, key=lambda x: (x[0], x[1], x[2] or 0))[:k])}
    return out


@pytest.mark.parametrize("segment", [4_000_000, 700])
def test_ranked_search(spark, texts, segment, monkeypatch):
    monkeypatch.setattr(lexical, "SEGMENT_BYTES", segment)
    ids = [None if i == 7 else 1000 - i for i in range(len(texts))]
    asked = [(1, "the W1 w2 w3"), (1, "é 日本 w1"), (2, texts[5]), (3, "unknown"), (4, None), (None, "same TEXT"), (6, "w40 w41 of"), (7, ", ;")]
    docs = spark.createDataFrame(list(zip(ids, texts, ids, strict=True)), "doc_id long, text string, term long").repartition(3)
    items = spark.createDataFrame([(i, t, 0.5) for i, t in asked], "item_id long, text string, score double")
    want: dict = collections.defaultdict(set)
    for i, t in asked:
        want[i] |= set(terms(t))
    rows = lexical.ranked(docs, items, 10).collect()
    assert {(r.item_id, r["rank"]): (r.doc_id, r.score) for r in rows} == best(texts, ids, want, 10) and len(rows) == len({(r.item_id, r["rank"]) for r in rows})
    con = duckdb.connect()
    con.register("documents", docs.filter("doc_id is not null").toPandas())
    con.register("benchmark", items.filter("item_id is not null").toPandas())
    part = lexical.ranked(docs.filter("doc_id is not null"), items.filter("item_id is not null"), 10).collect()
    assert sorted((r.item_id, r["rank"], r.doc_id, r.score) for r in part) == sorted(con.execute(lexical.lexical_sql()).fetchall())


def test_search_of_empty_tables(spark, texts):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    none = docs.filter("doc_id < 0"), items.filter("item_id < 0")
    assert lexical.ranked(none[0], items).count() == lexical.ranked(docs, none[1]).count() == lexical.ranked(*none).count() == 0
    assert lexical.ranked(spark.createDataFrame([(1, None), (2, " . ")], "doc_id long, text string"), items).collect() == []
    assert [tuple(r) for r in lexical.ranked(docs, items.withColumn("doc_id", F.lit(9))).collect()] == [(1, 1, 1, math.floor(1000 * math.log(4 / 3)) * (10**9 // (1000 + 8 * 100)))]


def test_hybrid_equals_full_sums_and_skips(spark):
    rnd = np.random.RandomState(2)
    for trial in range(60):
        n, k = int(rnd.choice([50, 3000, 40_000])), int(rnd.choice([1, 10]))
        lists = []
        for _ in range(rnd.randint(1, 9)):
            docs = np.flatnonzero(rnd.rand(n) < rnd.choice([0.001, 0.05, 0.8]))
            if len(docs):
                gains = rnd.randint(0, int(rnd.choice([3, 1000])) + 1, len(docs)).astype(np.int64)
                lists.append(lexical.Postings(docs, gains, int(gains.max())))
        sums = np.zeros(n, np.int64)
        for p in lists:
            sums[p.docs] += p.gains
        order = np.lexsort((np.arange(n), -sums))[:k]
        order = order[sums[order] > 0]
        docs, scores = lexical.hybrid_topk(lists, n, k, lexical.Work())
        assert docs.tolist() == order.tolist() and scores.tolist() == sums[order].tolist(), trial
    rare, work = np.arange(0, 40_000, 900), lexical.Work()
    lists = [lexical.Postings(rare, np.full(len(rare), 900), 900)] + [lexical.Postings(np.arange(40_000), rnd.randint(1, 40, 40_000), 39) for _ in range(3)]
    lexical.hybrid_topk(lists, 40_000, 10, work)
    assert work.summed == len(rare) and work.scanned + work.probed < 40_000  # of 120,045 postings


def plain_negatives(rows):
    v = {i: ((c + 1) % 10 if i % 7 == 0 else c, [math.floor(256 * x) for x in e]) for i, e, c in rows}
    out = set()
    for a, (label, q) in v.items():
        if a % 50:
            continue
        s = sorted((-sum(x * y for x, y in zip(q, w, strict=True)), i, c == label) for i, (c, w) in v.items() if i != a and len(w) == len(q))
        for p, i, _ in [x for x in s if x[2]][:5]:
            for r, (m, j, _) in enumerate([x for x in s if not x[2] and -50 * p <= -100 * x[0] <= -95 * p][:3]):
                out.add((a, i, r + 1, j, -p, -m))
    return out


@pytest.mark.parametrize("block", [16_384, 40])
def test_hard_negatives(spark, block, monkeypatch):
    monkeypatch.setattr(negatives, "ROW_BLOCK", block)
    monkeypatch.setattr(negatives, "ANCHOR_BLOCK", max(2, block // 20))
    rnd = np.random.RandomState(4)
    base = rnd.randn(6, 8)
    rows = [(i, [float(x) for x in (base[rnd.randint(6)] + rnd.choice([0.0, 0.4, 1.5]) * rnd.randn(8)).round(1)], int(rnd.randint(10))) for i in range(-100, 400)]
    rows += [(i, [0.0] * 8, i % 3) for i in range(400, 420)] + [(450, [1.0, 2.0], 1), (451, [1.0, 1.0], 1), (452, [0.5, 1.0], 2), (500, [], 1), (501, [], 2), (503, [], 1)]
    odd = [(None, [1.0] * 8, 1), (600, None, 1), (650, [1.0] * 7 + [None], 1), (700, [float("inf")] * 8, 1), (750, [1.0] * 8, None), (800, [float("nan")] * 8, 2)]
    df = spark.createDataFrame([(*r, 1) for r in rows + odd + rows[:60]], "vec_id long, embedding array<double>, label int, score int").repartition(3)
    got = [tuple(r) for r in negatives.hard_negatives(df).collect()]
    assert set(got) == plain_negatives(rows) and len(got) == len(set(got)) > 100
    assert negatives.hard_negatives(df.filter("vec_id > 9000")).count() == 0 and negatives.hard_negatives(df.filter("vec_id = 3")).count() == 0


def test_negatives_equal_sql_and_stand_large_numbers(spark):
    rnd = np.random.RandomState(5)
    df = spark.createDataFrame([(i, [float(x) for x in rnd.randn(6)], int(rnd.randint(4))) for i in range(300)], "vec_id long, embedding array<float>, label int")
    con = duckdb.connect()
    con.register("embeddings", df.toPandas())
    assert sorted(tuple(r) for r in negatives.hard_negatives(df).collect()) == sorted(con.execute(negatives.negatives_sql()).fetchall())
    big = spark.createDataFrame([(0, [1e12, 1e12], 1), (1, [1e12, 1e12], 2), (2, [1e300, 0.0], 1), (50, [3e12, 1.0], 2), (52, [1e12, 1.0], 2), (53, [9e11, 1.0], 3)], "vec_id long, embedding array<double>, label int")
    assert negatives.hard_negatives(big).count() >= 0
    a, b = np.array([[1 << 40, 3]], np.int64), np.array([[1 << 40, 1], [-(1 << 40), 5], [7, 2]], np.int64)
    assert negatives.products(a, b).tolist() == [[(1 << 63) - 1, -(1 << 63), (7 << 40) + 6]]


def test_keys_sort_as_their_parts():
    rnd = random.Random(1)
    parts = [(rnd.choice([-50, 0, 3]), rnd.choice([-9, 0, 4, 1 << 60]), rnd.randrange(2), rnd.randint(-5, 5)) for _ in range(200)]
    keys = [negatives.pack(a, np.array([s]), k, np.array([i])).tobytes() for a, s, k, i in parts]
    ordered = sorted(parts, key=lambda p: (p[0], -p[1], p[2], p[3]))
    assert list(negatives.unpacked(sorted(keys))) == ordered


def pages_of(spark):
    long = "<p>é 日本</p>" * 90
    rows = [(1, "http://a/1", long), (5, "http://a/5", long), (3, "http://a/ x\r\nInjected: y", long), (9, None, "x" * 1000), (4, "u", "x" * 1000), (7, "u", "x" * 999), (8, "u", "x" * 999)]
    rows += [(10, "u", None), (11, "u", ""), (None, "n", long), (5, "http://a/5", long), (12, "u", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 40), (None, "m", "z" * 2000), (None, "m", "z" * 2000)]
    return rows, spark.createDataFrame([(*r, "p", 1) for r in rows], "page_id long, url string, html string, payload string, size int").repartition(2)


def test_archives_round_trip(spark):
    rows, pages = pages_of(spark)
    want = []
    for i, _, html in rows:
        raw = (html or "").encode()
        top = max((j for j, _, h in rows if h == html and j is not None), default=None)
        revisit = len(raw) >= 1000 and top is not None and (i is None or i < top)
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", top if revisit else None))
    got = [tuple(r) for r in warc.archive_digest(spark, pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert warc.archive_digest(spark, pages.filter("page_id < 0")).count() == 0
    con = duckdb.connect()
    known = pages.filter("page_id is not null").dropDuplicates(["page_id"])
    con.register("pages", known.toPandas())
    both = [sorted(map(repr, x)) for x in ([tuple(r) for r in warc.archive_digest(spark, known).collect()], con.execute(warc.archive_sql()).fetchall())]
    assert both[0] == both[1]


def test_archives_hold_payloads_and_addresses(spark, monkeypatch):
    monkeypatch.setattr(warc, "SENT", 0)  # the shuffled way
    rows, pages = pages_of(spark)
    folder = scratch(spark, "warc-test")
    index = warc.write_archives(pages, folder)
    read = warc.read_archives(index)
    assert warc.gaps(read).count() == 0 and index.count() == len(rows)
    back = warc.restored(warc.records(read)).collect()
    assert sorted((r.page_id, bytes(r.payload)) for r in back if r.page_id) == sorted((i, (h or "").encode()) for i, _, h in rows if i)
    assert {r.url for r in back if r.page_id == 3} == {"http://a/%20x%0D%0AInjected:%20y"} and {r.url for r in back if r.page_id == 9} == {None}
    first = index.filter("page_id = 12").first()
    with pyarrow.fs.FileSystem.from_uri(first.path)[0].open_input_file(pyarrow.fs.FileSystem.from_uri(first.path)[1]) as f:
        member = gzip.decompress(f.read_at(first.bytes, first.offset))
    assert member.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and member.endswith(b"\r\n\r\n")


def kept(data):
    return [(b, e, why and why.split(":")[0], r and int(r.headers["page-id"])) for b, e, why, r in warc.salvage(lambda n, o: data[o : o + n], len(data))]


def test_salvage_of_gzip_members():
    rnd = random.Random(3)
    parts = [warc.page_record(i, "u", "".join(rnd.choice("abcdefg <>") for _ in range(3000)).encode(), None, 6) for i in range(6)]
    at = [0, *np.cumsum([len(p) for p in parts]).tolist()]
    whole = b"".join(parts)
    assert kept(whole) == [(at[i], at[i + 1], None, i) for i in range(6)]
    damaged = bytearray(whole)
    damaged[at[2] + 700] ^= 0xFF
    assert kept(bytes(damaged)) == [*[(at[i], at[i + 1], None, i) for i in (0, 1)], (at[2], at[3], "gzip", None), *[(at[i], at[i + 1], None, i) for i in (3, 4, 5)]]
    junk = b"\x1f\x8b\x08 not a member WARC/1.1\r\n\r\n" + bytes(300)
    mixed = junk + parts[0] + junk + parts[1][:-20] + parts[2] + parts[3][:40]
    got = kept(mixed)
    assert [x[3] for x in got] == [None, 0, None, 2, None] and got[-1][1] == len(mixed) and [b for b, *_ in got[1:]] == [e for _, e, *_ in got[:-1]]
    assert kept(b"") == [] and [x[3] for x in kept(b"nothing here")] == [None]
    inside = bytearray(gzip.decompress(parts[1]))
    inside[-100] ^= 1
    wrong = gzip.compress(bytes(inside))  # sound gzip, another digest
    assert [(x[2], x[3]) for x in kept(parts[0] + wrong + parts[2])] == [(None, 0), ("warc-block-digest differs", None), (None, 2)]
    several = gzip.compress(gzip.decompress(parts[3]) + gzip.decompress(parts[4]))
    assert [x[3] for x in kept(several + parts[5])] == [3, 4, 5]


def test_salvage_of_plain_files():
    rnd = random.Random(4)
    parts = [gzip.decompress(warc.page_record(i, "u", "".join(rnd.choice("abc ") for _ in range(500)).encode(), None, 6)) for i in range(4)]
    nested = gzip.decompress(warc.page_record(9, "u", parts[0] + b"tail" * 50, None, 6))
    at = [0, *np.cumsum([len(p) for p in (parts[0], nested, parts[2])]).tolist()]
    whole = parts[0] + nested + parts[2]
    assert [x[3] for x in kept(whole)] == [0, 9, 2]
    damaged = bytearray(whole)
    damaged[at[2] - 10] ^= 1  # the nested record is inside the damaged one and must not come out
    assert kept(bytes(damaged)) == [(0, at[1], None, 0), (at[1], at[2], "warc-block-digest differs", None), (at[2], at[3], None, 2)]
    no_length = whole.replace(b"Content-Length: 5", b"Content-Lengthy: 5", 1)
    assert [x[3] for x in kept(no_length)][-2:] == [9, 2] and kept(no_length)[0][2] is not None
    assert [x[3] for x in kept(parts[0] + parts[1][:-100] + parts[2])] == [0, None, 2] and [x[3] for x in kept(parts[0] + parts[1][:-7])] == [0, None]


def test_gaps_of_damaged_files_are_logged(spark):
    folder = shared_dir(spark) + "/" + scratch(spark, "warc-damage").rsplit("/", 1)[1]
    files, target = pyarrow.fs.FileSystem.from_uri(folder)
    files.create_dir(target, recursive=True)
    parts = [warc.page_record(i, "u", (b"%d" % i) * 2000, None, 6) for i in range(3)]
    data = parts[0] + parts[1][:30] + b"?" * 17 + parts[2]
    with files.open_output_stream(f"{target}/a.warc.gz", compression=None) as f:
        f.write(data)
    read = warc.read_archives(spark.createDataFrame([(f"{folder}/a.warc.gz", 1)], "path string, begin long"))
    assert [(r.page_id, bytes(r.payload)) for r in warc.records(read).collect()] == [(0, b"0" * 2000), (2, b"2" * 2000)]
    assert [(r.begin, r.end) for r in warc.gaps(read).collect()] == [(len(parts[0]), len(parts[0]) + 47)]
