"""Paragraph cleaning (C1-C10). Rows are (source_file, text); all work on a document stays in its row, without a shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from supportlake.functions import lexicons as lex
from supportlake.functions.text import bind, empty, exploded, is_noise, normalise_space, short_id, stripped


def paragraphs_of(text: Column) -> Column:
    """Paragraphs of a text as an array.

    Blank lines split; a block that starts and ends with a table bar stays whole; headings, short bold
    lines and table lines stand alone; other lines of a block are joined by a space. A line begins a
    paragraph if it or the line before it stands alone, so each line is looked at once.
    """

    def lines(block: Column) -> Column:
        trimmed = F.filter(F.transform(F.split(block, "\n"), stripped), lambda x: x != "")
        bold = lambda x: F.startswith(x, F.lit("**")) & F.endswith(x, F.lit("**")) & (F.length(x) <= 60) & (F.regexp_count(x, F.lit(r"\*\*")) == 2)
        alone = lambda x: F.startswith(x, F.lit("#")) | F.startswith(x, F.lit("|")) | bold(x)

        def joined(xs: Column, flags: Column) -> Column:
            begins = F.filter(F.transform(flags, lambda f, i: F.when((i == 0) | f | F.get(flags, i - 1), i)), lambda i: i.isNotNull())
            part = lambda b: lambda p, j: F.array_join(F.slice(xs, p + 1, F.coalesce(F.get(b, j + 1), F.size(xs)) - p), " ")
            return bind(begins, lambda b: F.transform(b, part(b)))

        return bind(trimmed, lambda xs: bind(F.transform(xs, alone), lambda flags: joined(xs, flags)))

    blocks = F.filter(F.transform(F.split(empty(text), "\n\n"), stripped), lambda b: b != "")
    table = lambda b: F.startswith(b, F.lit("|")) & F.endswith(b, F.lit("|"))
    return F.flatten(F.transform(blocks, lambda b: F.when(table(b), F.array(b)).otherwise(lines(b))))


def split_paragraphs(df: DataFrame, text: str = "text") -> DataFrame:
    """One row a paragraph, `para_index` from 0; texts without any leave no row."""
    keep = [c for c in df.columns if c != text]
    rows = F.transform(paragraphs_of(F.col(text)), lambda p, i: F.struct(i.alias("para_index"), p.alias(text)))
    return exploded(df, keep, rows, "_p").select(*keep, "_p.*")


def without_noise(text: Column, rules: Sequence[tuple[str, str]] = lex.NOISE) -> Column:
    """(t, hits): patterns in order, each on the output of the one before, and the kinds that hit.

    A text that no pattern finds is left by one search for all of them.
    """
    flags = "(?iU)"
    none = F.array().cast("array<string>")

    def by(pattern: str, kind: str):
        p = f"{flags}{pattern}"
        return lambda s: F.when(s["t"].rlike(p), F.struct(F.regexp_replace(s["t"], p, "").alias("t"), F.concat(s["hits"], F.array(F.lit(kind))).alias("hits"))).otherwise(s)

    state = F.struct(empty(text).alias("t"), none.alias("hits"))
    for pattern, kind in rules:
        state = bind(state, by(pattern, kind))
    any_rule = flags + "|".join(f"(?:{p})" for p, _ in rules)
    found = F.when(empty(text).rlike(any_rule), state).otherwise(F.struct(empty(text).alias("t"), none.alias("hits"))) if rules else state
    return bind(found, lambda s: F.struct(normalise_space(s["t"]).alias("t"), s["hits"].alias("hits")))


def strip_noise(df: DataFrame, rules: Sequence[tuple[str, str]] = lex.NOISE, text: str = "text") -> DataFrame:
    """Noise out; `removed_noise` lists the kinds that hit."""
    found = exploded(df, [c for c in df.columns if c != text], F.array(without_noise(F.col(text), rules)), "_n")
    return found.select(*[c for c in df.columns if c != text], F.col("_n.t").alias(text), F.col("_n.hits").alias("removed_noise"))


def fingerprint(c: Column, chars: int | None = 200) -> Column:
    """md5 of the first characters without Markdown marks; `chars=None` takes the whole paragraph."""
    return F.md5(F.regexp_replace(c if chars is None else F.substring(c, 1, chars), r"[#*`\[\]()|_\-]", ""))


def first_of_each(items: Column, key) -> Column:
    """Places of the items whose key no earlier item has, in order: a sort of (key, place), so n log n."""
    keyed = F.sort_array(F.transform(items, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"))))
    first = bind(keyed, lambda ks: F.filter(ks, lambda x, j: (j == 0) | (F.get(ks, j - 1)["k"] != x["k"])))
    return F.sort_array(F.transform(first, lambda x: x["i"]))


def dedup_paragraphs(df: DataFrame, chars: int | None = 200, text: str = "text") -> DataFrame:
    """C6 for a table of paragraphs: the first of those of a source that share a fingerprint."""
    keyed = df.withColumn("_fp", fingerprint(F.col(text), chars))
    order = Window.partitionBy("source_file", "_fp").orderBy("para_index")
    return keyed.withColumn("_rn", F.row_number().over(order)).filter("_rn = 1").drop("_fp", "_rn")


def good_paragraphs(parts: Column, min_chars: int, chars: int | None) -> Column:
    """C4-C6 over an array of (para_index, text, …): short and noise-only ones out, then the first of each fingerprint."""
    good = F.filter(parts, lambda p: (F.length(p["text"]) >= min_chars) & ~is_noise(p["text"]))
    return bind(good, lambda g: F.transform(first_of_each(g, lambda p: fingerprint(p["text"], chars)), lambda i: F.get(g, i)))


def clean(df: DataFrame, rules: Sequence[tuple[str, str]] = lex.NOISE, min_chars: int = 10, chars: int | None = 200) -> DataFrame:
    """Split, strip noise, drop short and noise-only paragraphs, de-duplicate within the text, number and name them."""

    def part(p: Column, i: Column) -> Column:
        return bind(without_noise(p, rules), lambda n: F.struct(i.alias("para_index"), n["t"].alias("text"), n["hits"].alias("removed_noise")))

    keep = [c for c in df.columns if c != "text"]
    rows = exploded(df, keep, good_paragraphs(F.transform(paragraphs_of(F.col("text")), part), min_chars, chars), "_p").select(*keep, "_p.*")
    return rows.withColumn("chunk_id", short_id(F.col("source_file"), "p", F.col("para_index"))).withColumn("char_count", F.length("text"))


def clean_lines(df: DataFrame, min_chars: int = 10, chars: int | None = 200) -> DataFrame:
    """C4-C7 with each line as a paragraph."""
    lines = F.transform(F.split(empty(F.col("text")), "\n"), lambda x, i: F.struct(i.alias("para_index"), x.alias("text")))
    keep = [c for c in df.columns if c != "text"]
    rows = exploded(df, keep, good_paragraphs(lines, min_chars, chars), "_p").select(*keep, "_p.*")
    return rows.withColumn("chunk_id", short_id(F.col("source_file"), "p", F.col("para_index")))


def clean_text(c: Column, rules: Sequence[tuple[str, str]] = lex.NOISE, min_chars: int = 10, chars: int | None = 200) -> Column:
    """C8 as one text: the paragraphs that stay, joined by blank lines."""
    parts = F.transform(paragraphs_of(c), lambda p, i: F.struct(i.alias("para_index"), without_noise(p, rules)["t"].alias("text")))
    return F.array_join(F.transform(good_paragraphs(parts, min_chars, chars), lambda p: p["text"]), "\n\n")


def merge_docs(a: DataFrame, b: DataFrame, key_chars: int | None = 100) -> DataFrame:
    """Two lists (query_id, pos, text), the first of the texts that start alike kept, in order; `key_chars=None` compares whole texts."""
    every = a.select("query_id", F.lit(0).alias("part"), "pos", "text").union(b.select("query_id", F.lit(1), "pos", "text"))
    key = F.col("text") if key_chars is None else F.substring("text", 1, key_chars)
    order = Window.partitionBy("query_id", key).orderBy("part", "pos")
    return every.withColumn("_rn", F.row_number().over(order)).filter("_rn = 1").drop("_rn")
