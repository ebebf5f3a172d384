"""Chunking (H4-H13). Everything up to the numbered, overlapped chunks of a text is one expression over its row."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from supportlake.functions import lexicons as lex
from supportlake.functions.text import HAN, WHITE, bind, empty, est_tokens, exploded, faq_like, han_count, has_headings, headings, section_title, short_id, strip_inline_images, stripped


def choose_strategy(text: Column, doc_type: Column) -> Column:
    """H4: the text's form first, then its type."""
    kinds = F.create_map(*[F.lit(x) for kv in lex.STRATEGIES.items() for x in kv])
    return F.when(faq_like(text, lex.FAQ_MARKS), "faq").when(has_headings(text), "markdown").otherwise(F.coalesce(kinds[doc_type], F.lit("recursive")))


def _some(parts: Column) -> Column:
    """Parts that are not blank."""
    return F.filter(parts, lambda p: stripped(p) != "")


def _stripped_all(parts: Column) -> Column:
    return F.filter(F.transform(parts, stripped), lambda p: p != "")


def _joined(units: Column, starts: Column, joiner: str) -> Column:
    """The runs of units that begin at `starts`, each joined; every unit is copied once."""
    part = lambda s: lambda p, j: F.array_join(F.slice(units, p + 1, F.coalesce(F.get(s, j + 1), F.size(units)) - p), joiner)
    return bind(starts, lambda s: F.transform(s, part(s)))


def pack(units: Column, limit: int, joiner: str = "", size: Callable[[Column], Column] = est_tokens) -> Column:
    """P: a unit joins the chunk before it while the sum of their sizes stays within `limit`, else it begins a new one.

    A unit above the limit stands alone. The fold carries sums and starts, not text.
    """

    def starts(us: Column) -> Column:
        sized = F.transform(us, lambda u: size(u).cast("long"))
        zero = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).cast("long").alias("sum"), F.lit(0).alias("i"))

        def step(a: Column, n: Column) -> Column:
            fits = (a["i"] > 0) & (a["sum"] + n <= limit)
            begun = F.when(fits, a["starts"]).otherwise(F.concat(a["starts"], F.array(a["i"])))
            return F.struct(begun.alias("starts"), F.when(fits, a["sum"] + n).otherwise(n).alias("sum"), (a["i"] + 1).alias("i"))

        return F.aggregate(sized, zero, step, lambda a: a["starts"])

    return bind(units, lambda us: _joined(us, starts(us), joiner))


#: Separators from coarse to fine. The ones with a space cut English sentences, clauses and words.
SEPARATORS = ("\n\n", "\n", "。", "；", "！", "？", ". ", "; ", "! ", "? ", "，", ", ", " ")
#: Separators that go; the others stay at the end of the part before them.
DROPPED = ("\n\n", "\n", " ")


UNITS = "array<struct<b:int,t:int,h:int,n:int,x:string,target:int,most:int>>"

# The level passes are written as SQL text: they nest deeply, and text reaches the analyser in one call.


def _bound(value: str, name: str, body: str) -> str:
    """`value` evaluated once as `name` in `body`."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _han_sql(x: str) -> str:
    return f"CASE WHEN {x} RLIKE '{HAN}' THEN length(regexp_replace({x}, '[^{HAN[1:]}', '')) ELSE 0 END"


def _fields(boundary: str, text: str, target: str, most: str) -> str:
    """A unit with `h` Han characters of `n`: the level of the separator before it (the first part has that of the whole), its size, both counts, its text, and the sizes it is cut to."""
    return f"named_struct('b', {boundary}, 't', CAST(floor(h / 1.5D + (n - h) / 3.5D) AS INT), 'h', h, 'n', n, 'x', {text}, 'target', {target}, 'most', {most})"


def _unit(text: str, boundary: str, han: str) -> str:
    """A part of unit `u` that has `han` Han characters."""
    return _bound(text, "x", _bound(han, "h", _bound("length(x)", "n", _fields(boundary, "x", "u.target", "u.most"))))


#: Parts of a text without Han characters are not searched for any.
HAN_OF_PART = f"CASE WHEN u.h = 0 THEN 0 ELSE {_han_sql('x')} END"


def _cut_level(units: str, level: int) -> str:
    """Units that are too large, cut by the separator of `level`; the rest stays."""
    sep = SEPARATORS[level]
    marks = "".join({".": r"\.", "?": r"\?", "\n": r"\n"}.get(c, c) for c in sep)
    pieces = f"filter(split(u.x, r'{marks if sep in DROPPED else f'(?<={marks})'}'), p -> trim(LEADING '{WHITE}' FROM p) <> '')"  # stops at the first other character
    part = _unit("p", f"CASE WHEN i = 0 THEN u.b ELSE {level} END", HAN_OF_PART)
    return f"flatten(transform({units}, u -> CASE WHEN u.t <= u.most THEN array(u) ELSE transform({pieces}, (p, i) -> {part}) END))"


def _last_cut(units: str) -> str:
    """What no separator made small enough, by number of characters; then outer white space goes."""
    chars = "CAST(floor(1.5D * u.target) AS INT)"
    pieces = f"transform(sequence(0, CAST(floor((length(u.x) - 1) / {chars}) AS INT)), i -> substring(u.x, i * {chars} + 1, {chars}))"
    part = _unit("p", f"CASE WHEN i = 0 THEN u.b ELSE {len(SEPARATORS)} END", HAN_OF_PART)
    cut = f"flatten(transform({units}, u -> CASE WHEN u.t <= u.most OR length(u.x) <= {chars} THEN array(u) ELSE transform({pieces}, (p, i) -> {part}) END))"
    bare = _unit(f"btrim(u.x, '{WHITE}')", "u.b", "u.h")
    clean = f"locate(substring(u.x, 1, 1), '{WHITE}') = 0 AND locate(substring(u.x, -1, 1), '{WHITE}') = 0"
    return f"filter(transform({cut}, u -> CASE WHEN {clean} THEN u ELSE {bare} END), u -> u.x <> '')"


def _merge_level(units: str, level: int, min_size: int, texts: bool) -> str:
    """Neighbours that one part was cut into at `level` or below join while their sizes add up to their limit at most.

    A unit below min_size is judged by the true size of the joined text instead, joiners included. The fold
    carries sums and starts, not text, and a joined unit's counts are sums too. Without `texts` its text is left empty.
    """
    small = f"v.t < {min_size}"
    total = f"CASE WHEN {small} THEN CAST(floor((a.h + v.h) / 1.5D + (a.o + 2 + v.n - v.h) / 3.5D) AS INT) ELSE a.t + v.t END"
    state = (
        "CASE WHEN a.i > 0 AND v.b >= {level} AND total <= v.most"
        " THEN named_struct('starts', a.starts, 'h', a.h + v.h, 'o', a.o + 2 + v.n - v.h, 't', total, 'i', a.i + 1)"
        " ELSE named_struct('starts', concat(a.starts, array(a.i)), 'h', v.h, 'o', v.n - v.h, 't', v.t, 'i', a.i + 1) END"
    ).format(level=level)
    zero = "named_struct('starts', CAST(array() AS array<int>), 'h', 0, 'o', 0, 't', 0, 'i', 0)"
    starts = f"aggregate(us, {zero}, (a, v) -> {_bound(total, 'total', state)}, a -> a.starts)"
    run = "slice(us, p + 1, coalesce(get(s, j + 1), size(us)) - p)"
    text = "array_join(transform(run, u -> u.x), '\n\n')" if texts else "''"
    fields = _fields("run[0].b", text, "run[0].target", "run[0].most")
    joined = _bound("aggregate(run, 0, (a, u) -> a + u.h)", "h", _bound("aggregate(run, 2 * size(run) - 2, (a, u) -> a + u.n)", "n", fields))
    part = _bound(run, "run", f"CASE WHEN size(run) = 1 THEN run[0] ELSE {joined} END")
    merged = _bound(starts, "s", f"transform(s, (p, j) -> {part})")
    return _bound(units, "us", f"CASE WHEN exists(us, u -> u.b >= {level}) THEN {merged} ELSE us END")


#: Levels that one projection holds: the analyser resolves nested array functions step by step, and a limited number of steps.
LEVELS = 5


def refined(df: DataFrame, min_size: int, texts: bool = True) -> DataFrame:
    """H8: the units in column `_u` cut from coarse to fine, then merged from fine to coarse over a flat array. Only what was cut here merges.

    Each text is searched and counted where it is cut; merging goes by the counts. Without `texts` joined units keep their counts alone.
    """
    cuts = [lambda u, k=k: _cut_level(u, k) for k in range(len(SEPARATORS))]
    merges = [lambda u, k=k: _merge_level(u, k, min_size, texts) for k in reversed(range(len(SEPARATORS)))]
    for steps, some in ((cuts, "u.t > u.most"), ([_last_cut], None), (merges, "u.b >= 0")):
        for at in range(0, len(steps), LEVELS):
            units = "_u"
            for step in steps[at : at + LEVELS]:
                units = step(units)
            df = df.withColumn("_u", F.expr(f"CASE WHEN exists(_u, u -> {some}) THEN {units} ELSE _u END" if some else units))
    return df


def _part(text: Column, target: int, most: int, size: Column | None = None) -> Column:
    """A unit that was not cut by any level."""
    return bind(text, lambda x: bind(han_count(x), lambda h: _uncut(x, h, target, most, size)))


def _uncut(x: Column, h: Column, target: int, most: int, size: Column | None = None) -> Column:
    n = F.length(x)
    size = F.floor(h / 1.5 + (n - h) / 3.5).cast("int") if size is None else size
    return F.struct(F.lit(-1).alias("b"), size.alias("t"), h.alias("h"), n.alias("n"), x.alias("x"), F.lit(target).alias("target"), F.lit(most).alias("most"))


def _whole(text: Column, target: int, most: int) -> Column:
    """The text as its only unit; a blank text has none."""
    return F.when(stripped(text) == "", F.array().cast(UNITS)).otherwise(F.array(_part(text, target, most)))


def _contents(units: Column) -> Column:
    return F.transform(units, lambda u: u["x"])


def split_recursive(df: DataFrame, target: int = 512, max_size: int = 1024, min_size: int = 80, overlap: int = 0) -> DataFrame:
    """H8."""
    units = refined(df.withColumn("_u", _whole(empty(F.col("text")), target, max_size)), min_size)
    return _chunks(units, _contents(F.col("_u")), "recursive", overlap).drop("_u")


#: Where a sentence and a clause end, before a capital, kana or Han character.
SENTENCE_END = r"(?U)(?<=[。！？.!?])\s*(?=[A-Z一-鿿぀-ゟ゠-ヿ])"
CLAUSE_END = r"(?U)(?<=[；，;,])\s*(?=[一-鿿A-Z])"


def sentence_units(text: Column, target: int, max_size: int) -> Column:
    """H9 for one text: sentences, long ones cut at clauses, packed to max_size. A clause above it stands alone and is left to refined()."""
    clauses = lambda s: F.when(est_tokens(s) > max_size, _stripped_all(F.split(s, CLAUSE_END))).otherwise(F.array(s))
    units = F.flatten(F.transform(_stripped_all(F.split(text, SENTENCE_END)), clauses))
    # A packed chunk that its joiners carry above max_size stays whole: its size is set to the limit.
    one = lambda run: F.when(F.size(run) == 1, _part(F.get(run, 0), target, max_size)).otherwise(_part(stripped(F.array_join(run, "\n")), target, max_size, F.lit(max_size)))
    packed = bind(units, lambda us: F.transform(_runs(us, max_size), one))
    return F.when((stripped(text) == "") | (est_tokens(text) <= max_size), _whole(text, target, max_size)).otherwise(packed)


def _runs(units: Column, limit: int) -> Column:
    """The runs of units that pack() would join, as arrays."""
    sized = F.transform(units, lambda u: est_tokens(u).cast("long"))
    zero = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).cast("long").alias("sum"), F.lit(0).alias("i"))

    def step(a: Column, n: Column) -> Column:
        fits = (a["i"] > 0) & (a["sum"] + n <= limit)
        begun = F.when(fits, a["starts"]).otherwise(F.concat(a["starts"], F.array(a["i"])))
        return F.struct(begun.alias("starts"), F.when(fits, a["sum"] + n).otherwise(n).alias("sum"), (a["i"] + 1).alias("i"))

    starts = F.aggregate(sized, zero, step, lambda a: a["starts"])
    return bind(starts, lambda s: F.transform(s, lambda p, j: F.slice(units, p + 1, F.coalesce(F.get(s, j + 1), F.size(units)) - p)))


def split_sentences(df: DataFrame, max_size: int = 1024, target: int = 512, min_size: int = 80, overlap: int = 0) -> DataFrame:
    """H9: what is still too long after clauses takes the recursive split."""
    units = refined(df.withColumn("_u", sentence_units(empty(F.col("text")), target, max_size)), min_size)
    return _chunks(units, _contents(F.col("_u")), "semantic", overlap).drop("_u")


#: Boundaries for a hard cut in order of preference.
BOUNDARIES = ("\n\n", "\n", "。", "；", "！", "？", r"\. ", "; ")
#: A fenced code block, or a run of lines that begin and end with a bar.
PROTECTED = r"(?m)```[\s\S]*?```|(?:^\|.+\|$\n?)+"
#: Stands for a line end inside a protected block while paragraphs are cut; not used by any script.
KEPT_LINE_END = "\ue000"


def boundary_cut(text: Column, chars: int) -> Column:
    """Pieces of at most `chars` characters, each cut at the last of the best boundaries in its second half, or at its end."""
    half = chars // 2
    width = lambda b: 2 if b in ("\n\n", r"\. ", "; ") else 1
    ways = [rf".{{1,{chars}}}\z", *(f".{{{half},{chars - width(b)}}}{b}" for b in BOUNDARIES), f".{{{chars}}}"]
    return F.regexp_extract_all(text, F.lit("(?s)" + "|".join(f"(?:{w})" for w in ways)), F.lit(0))


def paragraph_parts(text: Column, target: int, max_size: int) -> Column:
    """Paragraphs packed to max_size; code blocks and tables are not cut, and what is too long takes the hard cut near 1.2 x target."""
    between, blocks = F.split(text, PROTECTED), F.regexp_extract_all(text, F.lit(PROTECTED), F.lit(0))
    kept = lambda b: F.concat(F.lit("\n"), F.replace(b, F.lit("\n"), F.lit(KEPT_LINE_END)), F.lit("\n"))
    marked = F.array_join(F.transform(between, lambda g, i: F.concat(g, F.coalesce(kept(F.get(blocks, i)), F.lit("")))), "")
    paras = F.transform(_some(F.split(marked, "\n\n")), lambda p: F.replace(p, F.lit(KEPT_LINE_END), F.lit("\n")))
    long = lambda p: F.when((est_tokens(p) > max_size) & (F.length(p) > int(1.2 * target)), _stripped_all(boundary_cut(p, int(1.2 * target)))).otherwise(F.array(stripped(p)))
    return bind(paras, lambda ps: F.flatten(F.transform(_runs(ps, max_size), lambda run: F.when(F.size(run) == 1, long(F.get(run, 0))).otherwise(F.array(stripped(F.array_join(run, "\n\n")))))))


def markdown_parts(text: Column, target: int, max_size: int) -> Column:
    """H7 for one text: sections by headings of level 1, 2, 3; a section within max_size stays whole, a text without any goes to paragraphs."""

    def sections(part: Column, level: int) -> Column:
        if level > 3:
            return paragraph_parts(part, target, max_size)
        found = F.split(part, f"\n(?={'#' * level} )")
        each = lambda n: lambda s: F.when((n > 1) & (est_tokens(s) <= max_size), F.array(stripped(s))).otherwise(sections(s, level + 1))
        return bind(found, lambda f: F.flatten(F.transform(_some(f), each(F.size(f)))))

    return F.filter(sections(text, 1), lambda c: c != "")


def split_markdown(df: DataFrame, target: int = 512, max_size: int = 1024, overlap: int = 0) -> DataFrame:
    """H7."""
    return _chunks(df, markdown_parts(empty(F.col("text")), target, max_size), "markdown", overlap)


#: How a question begins, in order; the first that occurs cuts the text.
QUESTION_MARKS = (r"##\s*Q\d+[：:]", r"###\s*Q", r"\*\*Q\d*[：:]", r"Q\d+[.、\s：:]", "问[：:]")
PAGE_HEADING = r"^#{1,6}\s*第\s*\d+\s*页\s*$"
QUESTION_LINES = (r"^#{2,6}\s*Q?\d*[：:\s]*(.+?)$", r"^(?:Q\d*|问)[.、\s：:]+\s*(.+?)$")


def question_of(part: Column) -> Column:
    """The text of the first question line, page headings passed over; else the first 100 characters of the first line."""
    lines = F.filter(F.transform(F.split(part, "\n"), stripped), lambda x: (x != "") & ~x.rlike(PAGE_HEADING))
    asked = lambda x: F.coalesce(*(F.nullif(F.regexp_extract(x, p, 1), F.lit("")) for p in QUESTION_LINES))
    return bind(lines, lambda ls: F.coalesce(F.get(F.array_compact(F.transform(ls, asked)), 0), F.substring(F.get(ls, 0), 1, 100), F.lit("")))


def faq_parts(text: Column, target: int, max_size: int) -> Column:
    """H5, H6 for one text."""

    def pair(p: Column) -> Column:
        parts = pack(F.split(p, "\n\n"), max_size, "\n\n")
        led = bind(question_of(p), lambda q: F.transform(parts, lambda x, i: F.when(i == 0, stripped(x)).otherwise(F.concat(F.lit("_（接上问："), q, F.lit("）_\n\n"), stripped(x)))))
        return F.when(est_tokens(p) <= max(max_size, 2 * target), F.array(p)).otherwise(led)

    def by(mark: str) -> Column:
        return F.when(text.rlike(f"(?m)^{mark}"), F.flatten(F.transform(_stripped_all(F.split(text, f"(?m)(?=^{mark})")), pair)))

    chars = int(1.5 * target)
    sentences = lambda p: _stripped_all(pack(_some(F.split(p, r"(?U)(?<=[。！？.!?])\s*")), chars, "", F.length))
    long = lambda p: F.when((est_tokens(p) > max_size) & (F.length(p) > chars), sentences(p)).otherwise(F.array(p))
    plain = bind(_stripped_all(F.split(text, "\n\n")), lambda ps: F.flatten(F.transform(_runs(ps, max_size), lambda run: F.when(F.size(run) == 1, long(F.get(run, 0))).otherwise(F.array(F.array_join(run, "\n\n"))))))
    return F.coalesce(*(by(m) for m in QUESTION_MARKS), plain)


def split_faq(df: DataFrame, target: int = 512, max_size: int = 1024, overlap: int = 0) -> DataFrame:
    """H5, H6: pairs by the first question mark that occurs, long answers by paragraphs that repeat the question; without any mark, paragraphs, long ones by sentences."""
    return _chunks(df, faq_parts(empty(F.col("text")), target, max_size), "faq", overlap)


def split_chosen(df: DataFrame, target: int = 512, max_size: int = 1024, min_size: int = 80, overlap: int = 0, doc_type: str = "doc_type") -> DataFrame:
    """H4 and the split it chooses, for texts of any kind; one pass, `strategy` tells which."""
    t, way = empty(F.col("text")), F.col("_way")
    chosen = df.withColumn("_way", choose_strategy(F.col("text"), F.col(doc_type)))
    units = F.when(way == "semantic", sentence_units(t, target, max_size)).when(way == "recursive", _whole(t, target, max_size)).otherwise(F.array().cast(UNITS))
    parts = F.when(way == "faq", faq_parts(t, target, max_size)).when(way == "markdown", markdown_parts(t, target, max_size)).otherwise(_contents(F.col("_u")))
    return _chunks(refined(chosen.withColumn("_u", units), min_size), parts, "", overlap).withColumn("strategy", way).drop("_way", "_u")


def _chunks(df: DataFrame, parts: Column, strategy: str, overlap: int) -> DataFrame:
    """Rows (…, chunk_index, content, overlap_text, chunk_total, strategy); inline images out, and with `overlap` the last characters of the previous chunk's own content beside."""
    rows = F.filter(F.transform(parts, lambda c, i: F.struct(i.alias("chunk_index"), strip_inline_images(c).alias("content"))), lambda x: stripped(x["content"]) != "")
    before = lambda xs, j: F.coalesce(F.when(j > 0, F.right(F.get(xs, j - 1)["content"], F.lit(overlap))), F.lit("")) if overlap else F.lit("")
    whole = lambda xs: F.transform(xs, lambda x, j: F.struct(x["chunk_index"].alias("chunk_index"), x["content"].alias("content"), before(xs, j).alias("overlap_text"), F.size(xs).alias("chunk_total")))
    keep = [c for c in df.columns if c != "text"]
    return exploded(df, keep, bind(rows, whole), "_c").select(*keep, "_c.*", F.lit(strategy).alias("strategy"))


def with_overlap(chunks: DataFrame) -> DataFrame:
    """`text` is the chunk with the overlap in front."""
    return chunks.withColumn("text", F.when(F.col("overlap_text") == "", F.col("content")).otherwise(F.concat("overlap_text", F.lit("\n"), "content")))


def add_overlap(chunks: DataFrame, n: int = 80) -> DataFrame:
    """H10 for a table of chunks that was split elsewhere: the last n characters of the previous chunk's own content in front."""
    before = F.lag("content").over(Window.partitionBy("source_file").orderBy("chunk_index"))
    return with_overlap(chunks.withColumn("overlap_text", F.coalesce(F.right(before, F.lit(n)), F.lit(""))))


def number_chunks(chunks: DataFrame, text: str = "content") -> DataFrame:
    """Id, sizes, headings and section title of each chunk; the total is counted only where the split has not left it."""
    out = chunks.select("*", short_id(F.col("source_file"), "chunk", F.col("chunk_index")).alias("chunk_id"), F.length(text).alias("char_count"), est_tokens(F.col(text)).alias("token_count"))
    out = out.withColumn("heading_path", headings(F.col("content"))).withColumn("section_title", section_title(F.col("content")))
    return out if "chunk_total" in chunks.columns else out.withColumn("chunk_total", F.count("*").over(Window.partitionBy("source_file")))


def chunk_summary(chunks: DataFrame, by: Sequence[str] = ("source_file",)) -> DataFrame:
    """Number, sizes, mean and population deviation of characters."""
    n = F.length("content")
    return chunks.groupBy(*by).agg(
        F.count("*").alias("n_chunks"), F.sum(n).alias("total_chars"), F.sum(est_tokens(F.col("content"))).alias("total_tokens"),
        F.round(F.avg(n), 6).alias("avg_size"), F.round(F.stddev_pop(n), 6).alias("std_size"),
    )


def sweep_score(n: Column, avg: Column, std: Column, target: Column) -> Column:
    """0.4 evenness + 0.3 nearness to the target + 0.3 for 5 to 50 chunks, less on either side."""
    even = F.when(avg > 0, F.greatest(F.lit(0.0), 1 - std / avg)).otherwise(0.0)
    near = F.greatest(F.lit(0.0), 1 - F.abs(avg - target) / target)
    count = F.when(n.between(5, 50), 1.0).when(n < 5, n / 5.0).otherwise(F.greatest(F.lit(0.0), 1 - (n - 50) / 100.0))
    return 0.4 * even + 0.3 * near + 0.3 * count


def chunk_sweep(docs: DataFrame, targets: Sequence[int] = (256, 512, 768, 1024)) -> DataFrame:
    """For each source the recursive split at every target size, scored and ranked in its row."""

    def measured(t: int) -> Column:
        sizes = F.transform(F.filter("_u", lambda u: u["target"] == t), lambda u: u["n"].cast("double"))

        def of(s: Column) -> Column:
            n, total = F.size(s), F.aggregate(s, F.lit(0.0), lambda a, x: a + x)
            avg = F.coalesce(F.try_divide(total, n), F.lit(0.0))
            spread = F.sqrt(F.coalesce(F.try_divide(F.aggregate(s, F.lit(0.0), lambda a, x: a + (x - avg) * (x - avg)), n), F.lit(0.0)))
            return F.struct(F.round(-sweep_score(n, avg, spread, F.lit(t)), 6).alias("order"), F.lit(t).alias("target"), n.alias("n_chunks"), F.round(avg, 4).alias("avg_size"), F.round(spread, 4).alias("std_size"))

        return bind(sizes, of)

    every = lambda x: bind(han_count(x), lambda h: F.array(*(_uncut(x, h, t, 2 * t) for t in targets)))
    whole = bind(empty(F.col("text")), lambda x: F.when(stripped(x) == "", F.array().cast(UNITS)).otherwise(every(x)))
    units = refined(docs.select("source_file", whole.alias("_u")), 80, texts=False)
    units = exploded(units, ["source_file"], F.array("_u"), "_u")  # made once: an explode is not merged into what follows
    ranked = F.transform(F.sort_array(F.array(*map(measured, targets))), lambda r, i: F.struct((i + 1).alias("rank"), r.alias("r")))
    found = exploded(units, ["source_file"], ranked, "_r").select("source_file", "_r.*")
    return found.select("source_file", "rank", "r.target", "r.n_chunks", "r.avg_size", "r.std_size", (-F.col("r.order")).alias("score"))
