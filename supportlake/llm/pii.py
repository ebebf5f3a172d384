"""Personal data: base patterns, high-recall candidates, boosted trees, calibrated thresholds.

Everything on the main path is a built-in function over one row: a pattern's spans come from the gaps
between its matches, candidates carry their features as structs, and the trees are compiled into one
SQL expression that scores them in place. So the plan is scan -> project, without a shuffle.

Training: what the base patterns find is known, so the trees must learn what they cannot find. Valid base
spans of a bounded sample of rows (`TRAIN_ROWS`, `SPANS_PER_TEXT`) are disguised where they stand: an
address as `a (at) b.org`, a phone without its plus, a card in dotted groups. The same places hold decoys:
dates, versions, short numbers, cards with a wrong check digit, `(at)` without a domain. Candidates that cover
a disguised span are positive; those on decoys and those of the plain texts that touch no base span are
negative. No candidate that touches a base span takes part, so trees and thresholds see the population they
choose from. Features describe format and context: digits, marks, neighbours, cue words, check digit. Half of
the sample grows the trees; on the other half each kind's threshold is the lowest score from which on
precision is at least `PRECISION`. A kind without enough examples adds nothing. Selected candidates that touch
no base span are added to the spans. A model can be saved and given instead of being trained.

Defined results: a null or empty text has no spans; repeated rows each get their own row; an empty
table (or one without base spans) is served without trees; other columns are ignored; a very long text
is one row's work, of order n ** 1.5 in its number of matches.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from supportlake.llm.common import drop_table, let, store

KINDS = ("email", "ip", "card", "phone")
#: Possessive forms of the base patterns: the same matches, without deep recursion or repeated scans of a run.
_LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Strings of which any match of a pattern holds one; texts without them skip the pattern. None: digits.
MARK = {"email": ("@",), "ip": (".",), "card": None, "phone": ("+",), "at": ("@", "(at)", "(AT)", "[at]", "[AT]"), "wide": None, "tight": None}
#: High-recall generators; their spans overlap freely.
GENERATORS = {
    "at": r"[^\s@<>\"']{1,64}(?:@|\s?\((?:at|AT)\)\s?|\s?\[(?:at|AT)\]\s?)[^\s@<>\"']{2,255}",
    "wide": r"\+?\(?[0-9][0-9() ./-]{5,40}[0-9]",
    "tight": r"[0-9]{2,19}(?:[.:-][0-9]{1,6}){0,8}",
}
CUES = r"(?i)(mail|contact|write|tel|phone|call|fax|mobile|card|visa|account|iban|ip|host|server|addr)"

#: Bounds of the training sample: rows, and base spans (and as many other candidates) of one text.
TRAIN_ROWS, SPANS_PER_TEXT = 12_000, 100
#: Characters of context kept on each side of a training span.
CONTEXT = 80
PRECISION = 0.98
MIN_POSITIVE = 20
TREES, DEPTH = 12, 3


def scan(items: Column, zero: Column, step) -> Column:
    """The results of step(state, item) -> (state, out), both used twice, over the bound array `items` in order.

    Results are gathered in blocks of about sqrt(n), so that growing arrays stay short.
    """
    size = F.greatest(F.lit(64), F.ceil(F.sqrt(F.size(items))).cast("int"))
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(items) - 1) / size), F.lit(0)).cast("int")), lambda i: F.slice(items, i * size + 1, size))
    none = F.transform(F.slice(items, 1, 0), lambda x: step(zero, x)[1])
    row = lambda state, out: F.struct(state.alias("state"), out.alias("out"))

    def inside(a: Column, x: Column) -> Column:
        state, out = step(a["state"], x)
        return row(state, F.concat(a["out"], F.array(out)))

    across = lambda a, block: F.aggregate(block, row(a["state"], none), inside, lambda r: row(r["state"], F.concat(a["out"], r["out"])))
    return F.aggregate(blocks, row(zero, none), across, lambda a: a["out"])


def raw_spans(text: Column, pattern: str, marks: tuple[str, ...] | None, keep, extra=lambda m, before, after: ()) -> Column:
    """Spans (s, e, fields of `extra`) of the matches that `keep` accepts, in code points."""
    span = lambda m, before, after, at: F.struct(at.alias("s"), (at + F.length(m)).alias("e"), *extra(m, before, after))

    def located(parts: Column, found: Column) -> Column:
        def step(at: Column, m: Column) -> tuple[Column, Column]:
            start = at + F.length(m["g"])
            return start + F.length(m["m"]), F.struct(m["m"].alias("m"), m["g"].alias("g"), m["n"].alias("n"), start.alias("at"))

        rows = F.transform(found, lambda m, i: F.struct(m.alias("m"), F.get(parts, i).alias("g"), F.get(parts, i + 1).alias("n")))
        placed = let(rows, lambda rs: scan(rs, F.expr("0").cast("int"), step))
        return F.transform(F.filter(placed, lambda x: keep(x["m"])), lambda x: span(x["m"], x["g"], x["n"], x["at"]))

    both = F.struct(F.split(text, pattern, -1).alias("parts"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    has = reduce(or_, (F.contains(text, F.lit(m)) for m in marks)) if marks else text.rlike("[0-9]")
    none = F.filter(F.array(F.struct(F.lit(0).alias("s"), F.lit(0).alias("e"), *extra(F.lit(""), F.lit(""), F.lit("")))), lambda x: F.lit(False))
    return F.when(has, let(both, lambda b: F.when(F.size(b["found"]) > 0, located(b["parts"], b["found"])).otherwise(none))).otherwise(none)


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def valid(kind: str, m: Column) -> Column:
    n = F.length(digits(m))
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: let(F.regexp_replace(p, "^0+", ""), lambda q: (F.length(q) < 3) | ((F.length(q) == 3) & (q <= "255"))))
    if kind == "card":
        return n.between(12, 19) & F.call_function("luhn_check", digits(m))
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """All base spans as (s, k, e), k the kind's place, sorted by start, then kind."""
    def of_kind(k: int, kind: str) -> Column:
        found = raw_spans(text, BASE[kind], MARK[kind], lambda m: valid(kind, m))
        return F.transform(found, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e")))

    each = [of_kind(k, kind) for k, kind in enumerate(KINDS)]
    return F.sort_array(F.concat(*each))


@dataclass(frozen=True)
class Model:
    """Trees with their weights, and a threshold for each kind; None where a kind adds nothing."""

    trees: tuple = ()
    thresholds: tuple[float | None, ...] = (None,) * len(KINDS)


def _flag(c: Column) -> Column:
    return c.cast("double")


#: Name and value of each feature of a match with the text before and after it.
def features(generator: str, m: Column, before: Column, after: Column) -> list[tuple[str, Column]]:
    left, right, count = F.right(before, F.lit(24)), F.left(after, F.lit(8)), lambda c: (F.length(m) - F.length(F.replace(m, F.lit(c), F.lit("")))).cast("double")
    d = digits(m)
    return [
        ("generator", F.lit(float(list(GENERATORS).index(generator)))),
        ("length", F.length(m).cast("double")),
        ("digits", F.length(d).cast("double")),
        ("dots", count(".")), ("dashes", count("-")), ("spaces", count(" ")), ("parens", count("(")), ("ats", count("@")),
        ("plus", _flag(F.startswith(m, F.lit("+")))),
        ("check", _flag(F.length(d).between(2, 40) & F.coalesce(F.call_function("luhn_check", d), F.lit(False)))),
        ("cue", _flag(left.rlike(CUES))),
        ("joined_left", _flag(left.rlike(r"[A-Za-z0-9._%+-]$"))),
        ("joined_right", _flag(right.rlike(r"^[A-Za-z0-9]"))),
        ("quote", _flag(left.rlike(r"[\"'=:]\s?$"))),
        ("domain", _flag(m.rlike(r"[@)\]]\s?[A-Za-z0-9-]+\.[A-Za-z]{2,}"))),
        ("octets", _flag(m.rlike(r"^[0-9]{1,3}([.:-][0-9]{1,3}){3}$") & ~m.rlike(r"(^|[.:-])([3-9][0-9]{2}|2[6-9][0-9]|25[6-9])([.:-]|$)"))),
        ("date", _flag(m.rlike(r"^((19|20)[0-9]{2}[-./: ][0-9]{1,2}[-./: ]|[0-9]{1,2}[-./][0-9]{1,2}[-./](19|20)?[0-9]{2}([^0-9]|$)|[0-9]{1,2}:[0-9]{2}(:|$))"))),
    ]


#: The features' names in order.
NAMES = ["generator", "length", "digits", "dots", "dashes", "spaces", "parens", "ats", "plus", "check", "cue", "joined_left", "joined_right", "quote", "domain", "octets", "date"]


def candidates(text: Column) -> Column:
    """Spans (s, e, features) of all generators."""
    every = [raw_spans(text, p, MARK[g], lambda m: F.lit(True), lambda m, b, a, g=g: [c.alias(n) for n, c in features(g, m, b, a)]) for g, p in GENERATORS.items()]
    return F.concat(*every)


def guess(c: Column) -> Column:
    """The kind a candidate would have, by its form; one past the last kind: none."""
    ip = (c["digits"] <= 12) & (c["spaces"] == 0) & ((c["dots"] == 3) | ((c["octets"] == 1) & (c["date"] == 0)))
    return F.when(c["generator"] == 0, 0).when(ip, 1).when(c["digits"] < 7, len(KINDS)).when((c["digits"] >= 12) & (c["plus"] == 0), 2).otherwise(3)


def untouched(df: DataFrame) -> DataFrame:
    """The column `c` of candidates without those that overlap a span of the column `base`.

    One scan in order of starts for spans that begin before a candidate, one backwards for those that begin after.
    """

    def marks(key) -> Column:
        bases = F.transform("base", lambda b: F.struct(key(b["s"]).alias("key"), F.lit(0).alias("kind"), b["s"].alias("s"), b["e"].alias("e"), F.lit(-1).alias("i")))
        return F.sort_array(F.concat(bases, F.transform("c", lambda c, i: F.struct(key(c["s"]).alias("key"), F.lit(1).alias("kind"), c["s"].alias("s"), c["e"].alias("e"), i.alias("i")))))

    def forward(reach: Column, x: Column) -> tuple[Column, Column]:
        return F.when(x["kind"] == 0, F.greatest(reach, x["e"])).otherwise(reach), F.when((x["kind"] == 1) & (reach > x["s"]), x["i"]).otherwise(-1)

    def backward(nearest: Column, x: Column) -> tuple[Column, Column]:
        return F.when(x["kind"] == 0, F.least(nearest, x["s"])).otherwise(nearest), F.when((x["kind"] == 1) & (nearest < x["e"]), x["i"]).otherwise(-1)

    some = (F.size("base") > 0) & (F.size("c") > 0)
    none = F.array().cast("array<int>")
    df = df.withColumns({"_f": marks(lambda s: s), "_b": marks(lambda s: -s)})
    df = df.withColumns({"_f": F.when(some, scan(F.col("_f"), F.lit(-1), forward)).otherwise(none), "_b": F.when(some, scan(F.col("_b"), F.lit(2147483647), backward)).otherwise(none)})
    df = df.withColumn("_cuts", F.sort_array(F.array_distinct(F.concat(F.filter(F.concat("_f", "_b"), lambda i: i >= 0), F.array(F.lit(-1), F.size("c"))))))
    runs = F.transform(F.slice("_cuts", F.lit(2), F.size("_cuts")), lambda b, j: F.slice("c", F.get("_cuts", j) + 2, b - F.get("_cuts", j) - 1))
    return df.withColumn("c", F.flatten(runs)).drop("_f", "_b", "_cuts")


def _parsed(printed: str):
    """A tree's printed form as nested (feature, limit, yes, no) with numbers as leaves."""
    lines = [x.strip() for x in printed.splitlines()[1:] if x.strip()]

    def node(i: int):
        if lines[i].startswith("Predict:"):
            return float(lines[i].split(":")[1]), i + 1
        f, limit = re.match(r"If \(feature (\d+) <= (.+)\)", lines[i]).groups()
        yes, i = node(i + 1)
        no, i = node(i + 1)
        return (NAMES[int(f)], float(limit), yes, no), i

    return node(0)[0]


def _compiled(tree, c: Column) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    name, limit, yes, no = tree
    return F.when(c[name] <= limit, _compiled(yes, c)).otherwise(_compiled(no, c))


def score(model: Model, c: Column) -> Column:
    """The boosted trees' probability for a candidate."""
    margin = F.lit(0.0)
    for tree, weight in model.trees:
        margin = margin + _compiled(tree, c) * weight
    return 1 / (1 + F.exp(-2 * margin))


def disguises(kind: Column, m: Column, salt: Column) -> Column:
    """(label, form): ways to write a base span that the base pattern does not match, labelled 1, and decoys in its place, labelled 0."""
    d = digits(m)
    tail, n = F.right(d, F.lit(10)), F.pmod(salt, F.lit(9000)) + 1000
    two = lambda k, most: F.lpad((F.pmod(F.shiftright(salt, k), F.lit(most)) + 1).cast("string"), 2, "0")
    quad = lambda sep: F.regexp_replace(d, "([0-9]{4})(?=[0-9])", f"$1{sep}")
    cut = lambda *at: [F.substring(tail, a, b) for a, b in at]
    yes = lambda c: F.struct(F.lit(1.0).alias("label"), c.alias("form"))
    no = lambda c: F.struct(F.lit(0.0).alias("label"), c.alias("form"))
    a, b, c = cut((1, 3), (4, 3), (7, 4))
    wrong = F.concat(F.left(d, F.length(d) - 1), F.pmod(F.right(d, F.lit(1)).cast("int") + 1 + F.pmod(salt, F.lit(8)).cast("int"), F.lit(10)).cast("string"))
    date = F.concat_ws("-", F.concat(F.lit("20"), two(3, 29)), two(7, 12), two(11, 28))
    decoys = [no(date), no(F.concat_ws(".", two(2, 9), two(5, 40), two(9, 30))), no(F.concat(two(4, 23), F.lit(":"), two(8, 59), F.lit(":"), two(12, 59))), no(F.concat(F.lit("No. "), n.cast("string"), F.left(d, F.lit(3))))]
    stem, host = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    forms = {
        0: [yes(F.concat(stem, F.lit(" (at) "), host)), yes(F.concat(stem, F.lit("[at]"), host)), yes(F.concat(stem, F.lit("(at)"), host)), no(F.concat(stem, F.lit(" (at) "), F.substring_index(host, ".", 1))), *decoys[:1]],
        1: [yes(F.replace(m, F.lit("."), F.lit("-"))), yes(F.replace(m, F.lit("."), F.lit(":"))), no(F.concat(F.lit("4"), n.cast("string").substr(2, 2), F.lit("-"), F.replace(F.substring_index(m, ".", -3), F.lit("."), F.lit("-")))), *decoys],
        2: [yes(quad(".")), yes(quad(" - ")), yes(quad("/")), no(F.regexp_replace(wrong, "([0-9]{4})(?=[0-9])", "$1.")), no(F.regexp_replace(wrong, "([0-9]{4})(?=[0-9])", "$1 - ")), *decoys[:2]],
        3: [yes(F.concat(F.lit("("), a, F.lit(") "), b, F.lit("-"), c)), yes(F.concat_ws(".", a, b, c)), yes(F.concat_ws("-", a, b, c)), yes(F.concat(F.lit("00"), F.regexp_replace(F.substring(m, 2, 40), r"[()]", ""))), no(F.concat(b, c)), *decoys],
    }
    none = F.filter(F.array(yes(m)), lambda x: F.lit(False))
    out = none
    for k, each in forms.items():
        out = F.when(kind == k, F.array(*each)).otherwise(out)
    return out


def examples(docs: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """The training table: candidates that touch no base span, their features, label, kind and half.

    Rows are taken by a hash of id and text, about `rows` of them and never more than twice as many; equal rows count once.
    """
    share = min(1.0, rows / max(1, docs.count()))
    h = F.xxhash64("doc_id", "text")
    taken = docs.select(h.alias("h"), "text").filter(F.pmod("h", F.lit(1_000_000)) < int(share * 1_000_000)).filter("text is not null").dropDuplicates(["h"]).limit(2 * rows)
    scored = lambda df: untouched(df.withColumns({"base": base_spans(F.col("text")), "c": candidates(F.col("text"))}))
    # explode_outer: from a plain explode Spark infers a filter that repeats the whole expression below it.
    plain = scored(taken).select("h", F.lit(0.0).alias("label"), F.explode_outer(F.slice("c", 1, SPANS_PER_TEXT)).alias("c")).filter("c is not null")

    # Each span with the text around it, from the gaps so that no text is searched from its beginning for each span.
    around = lambda k, kind: F.transform(
        F.slice(raw_spans(F.col("text"), BASE[kind], MARK[kind], lambda m: valid(kind, m), lambda m, b, a: (m.alias("m"), F.right(b, F.lit(CONTEXT)).alias("left"), F.left(a, F.lit(CONTEXT)).alias("right"))), 1, SPANS_PER_TEXT),
        lambda x: F.struct(F.lit(k).alias("kind"), x["m"].alias("m"), x["left"].alias("left"), x["right"].alias("right"), x["s"].alias("s")),
    )
    spans = taken.select("h", F.explode_outer(F.concat(*(around(k, kind) for k, kind in enumerate(KINDS)))).alias("x")).filter("x is not null")
    each = spans.select("h", "x", F.explode_outer(disguises(F.col("x.kind"), F.col("x.m"), F.abs(F.xxhash64("h", "x.s")))).alias("d"))
    made = each.select("h", F.col("d.label").alias("label"), F.length("x.left").alias("s"), (F.length("x.left") + F.length("d.form")).alias("e"), F.concat("x.left", "d.form", "x.right").alias("text"))
    made = scored(made).select("h", "label", "s", "e", F.explode_outer("c").alias("c"))
    inside = F.least(F.col("e"), F.col("c.e")) - F.greatest(F.col("s"), F.col("c.s"))
    covers = (inside * 100 >= (F.col("c.e") - F.col("c.s")) * 80) & (inside * 100 >= (F.col("e") - F.col("s")) * 80)
    made = made.filter("c.s < e and s < c.e").select("h", F.when(covers, F.col("label")).otherwise(0.0).alias("label"), "c")
    half = F.pmod(F.xxhash64("h", F.lit("half")), F.lit(2))
    return plain.union(made).select("h", "c.*", "label", guess(F.col("c")).alias("kind"), half.alias("half"))


def train(docs: DataFrame, rows: int = TRAIN_ROWS, precision: float = PRECISION) -> Model:
    table = store(examples(docs, rows), "pii-sample")
    try:
        per_half = {r.half: (r.p, r.n) for r in table.groupBy("half").agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("n")).collect()}
        if min(*per_half.get(0, (0, 0)), *per_half.get(1, (0, 0))) < MIN_POSITIVE:
            return Model()
        found = VectorAssembler(inputCols=NAMES, outputCol="features").transform(table.filter("half = 0"))
        one = found.select("h", "s", "e", "generator", "label", "features").coalesce(1).sortWithinPartitions("h", "s", "e", "generator", "label")
        gbt: GBTClassificationModel = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7).fit(one)
        model = Model(tuple((_parsed(t.toDebugString), w) for t, w in zip(gbt.trees, gbt.treeWeights, strict=True)))
        bins = F.floor(score(model, F.struct(*NAMES)) * 50).alias("bin")
        held = table.filter("half = 1").groupBy("kind", bins).agg(F.sum("label").alias("p"), F.count("*").alias("n")).collect()
    finally:
        drop_table(table)
    limits: list[float | None] = []
    for k in range(len(KINDS)):
        best, p, n = None, 0.0, 0
        for r in sorted((r for r in held if r.kind == k), key=lambda r: -r.bin):
            p, n = p + r.p, n + r.n
            if p >= MIN_POSITIVE and p >= precision * n and r.bin >= 25:  # even odds at least
                best = r.bin / 50
        limits.append(best)
    return Model(model.trees, tuple(limits))


def save_model(spark: SparkSession, model: Model, path: str) -> None:
    spark.createDataFrame([(json.dumps([model.trees, model.thresholds]),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_model(spark: SparkSession, path: str) -> Model:
    trees, thresholds = json.loads(spark.read.text(path).first().value)
    node = lambda t: t if isinstance(t, float) else (t[0], t[1], node(t[2]), node(t[3]))
    return Model(tuple((node(t), w) for t, w in trees), tuple(thresholds))


def with_spans(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns of `keep`, `_text`, `base` and `spans`: arrays of (s, k, e), sorted by start, then kind."""
    based = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text")).select("*", base_spans(F.col("_text")).alias("base"))
    if all(t is None for t in model.thresholds):
        return based.select("*", F.col("base").alias("spans"))

    def selected(c: Column) -> Column:
        limit = F.element_at(F.array(*(F.lit(2.0 if t is None else t) for t in (*model.thresholds, None))), guess(c) + 1)
        return score(model, c) >= limit

    found = untouched(based.withColumn("c", candidates(F.col("_text"))))
    # By start, the longest first: a span inside another one goes.
    spans = F.sort_array(F.array_distinct(F.transform(F.filter("c", selected), lambda c: F.struct(c["s"].alias("s"), (-c["e"]).alias("e"), guess(c).alias("k")))))

    def outer(last: Column, x: Column) -> tuple[Column, Column]:
        keep = (-x["e"] > last["e"]) | ((x["s"] == last["s"]) & (-x["e"] == last["e"]))
        return F.when(keep, F.struct(x["s"].alias("s"), (-x["e"]).alias("e"))).otherwise(last), F.when(keep, F.struct(x["s"].alias("s"), x["k"].alias("k"), (-x["e"]).alias("e")))

    first = F.struct(F.lit(-1).alias("s"), F.lit(-1).alias("e"))
    found = found.withColumn("_a", spans).withColumn("_a", F.when(F.size("_a") > 0, F.array_compact(scan(F.col("_a"), first, outer))).otherwise(F.array().cast("array<struct<s:int,k:int,e:int>>")))
    return found.select(*keep, "_text", "base", F.sort_array(F.concat("base", "_a")).alias("spans"))


def printed(spans: Column) -> Column:
    name = lambda x: F.element_at(F.array(*map(F.lit, KINDS)), x["k"] + 1)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name(x), x["s"].cast("string"), x["e"].cast("string"))), ",")


def pii_digest(docs: DataFrame, model: Model | None = None) -> DataFrame:
    found = with_spans(docs, model or train(docs))
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    counts = [count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(printed(F.col("base")), 256).alias("base_sha256"), printed(F.col("spans")).alias("spans"))


def redact_pii(docs: DataFrame, model: Model | None = None, text: str = "text") -> DataFrame:
    """The input rows with each run of overlapping spans replaced by [<kind>] of its first span; nulls stay null."""
    packed = docs.select(F.struct("*").alias("_row"), F.col(text).alias("_raw"))
    found = with_spans(packed, model or train(docs), "_raw", ("_row", "_raw"))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        name = F.element_at(F.array(*map(F.lit, KINDS)), x["k"] + 1)
        added = F.concat(acc["out"], F.substring(F.col("_text"), acc["at"] + 1, x["s"] - acc["at"]), F.lit("["), name, F.lit("]"))
        return F.when(x["s"] >= acc["at"], F.struct(x["e"].alias("at"), added.alias("out"))).otherwise(F.struct(F.greatest(acc["at"], x["e"]).alias("at"), acc["out"].alias("out")))

    whole = F.aggregate("spans", start, step, lambda a: F.concat(a["out"], F.substring(F.col("_text"), a["at"] + 1, F.lit(2147483647))))
    out = F.when(F.col("_raw").isNotNull(), whole)
    return found.select(*(out.alias(text) if c == text else F.col(f"_row.`{c}`").alias(c) for c in docs.columns))
