"""Text measures as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from supportlake.functions.words import FEW, group_numbers

HAN = "[一-鿿]"


def empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def bind(value: Column, body) -> Column:
    """Evaluate `value` once and use it in `body` (an array lambda binds it)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def exploded(df, keep, items: Column, name: str):
    """Columns of `keep` and one row for each item, none of which is null.

    From a plain explode Spark infers a filter that repeats the whole expression below it, so the outer form is used.
    """
    return df.select(*keep, F.explode_outer(items).alias(name)).filter(F.col(name).isNotNull())


#: White space of all scripts.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def stripped(c: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(c, F.lit(WHITE))


def han_count(c: Column) -> Column:
    """Han characters; texts without any are only searched."""
    return F.when(c.rlike(HAN), F.length(F.regexp_replace(c, f"[^{HAN[1:]}", ""))).otherwise(0)


def est_tokens(c: Column) -> Column:
    """H1: int(han / 1.5 + other / 3.5)."""
    t = empty(c)
    return F.floor(han_count(t) / 1.5 + (F.length(t) - han_count(t)) / 3.5).cast("int")


def tokens(c: Column) -> Column:
    """L1: lower-case runs of letters and digits; runs of Han characters as bigrams. Texts without Han take no second look at their words."""
    t = F.lower(empty(c))
    words = F.array_remove(F.split(t, r"[^\p{L}\p{N}]+"), "")
    pairs = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: F.substring(w, i, F.lit(2)))
    return F.when(t.rlike(HAN), F.flatten(F.transform(words, lambda w: F.when(w.rlike(HAN) & (F.length(w) > 1), pairs(w)).otherwise(F.array(w))))).otherwise(words)


def bigrams(c: Column) -> Column:
    """Distinct pairs of neighbouring characters, in time linear in the text."""
    chars = F.split(c, "")
    pairs = F.zip_with(chars, F.slice(chars, F.lit(2), F.size(chars)), lambda a, b: F.concat(a, b))
    return F.array_distinct(F.filter(pairs, lambda p: F.length(p) == 2))


def bigram_overlap(q: Column, t: Column) -> Column:
    """L2: share of the query's distinct character bigrams that the text has; 0 for an empty query."""
    a = bigrams(empty(q))
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, bigrams(empty(t)))) / F.size(a)).otherwise(0.0)


def _doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """L3: 0 where either vector has no length."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def word_overlap(a: Column, s: Column) -> Column:
    """L4: share of distinct lower-case words of `a` that are in `s`."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(empty(c)), r"\s+"), lambda w: w != ""))
    return F.when(F.size(words(a)) > 0, F.size(F.array_intersect(words(a), words(s))) / F.size(words(a))).otherwise(0.0)


def hits(c: Column, words: Sequence[str]) -> Column:
    """Those of `words` that the text holds, in order."""
    listed = F.array(*map(F.lit, words))
    if len(words) > FEW:
        return F.transform(group_numbers(c, [(w,) for w in words]), lambda i: F.get(listed, i))
    return F.filter(listed, lambda w: F.contains(empty(c), w))


def any_of(c: Column, words: Sequence[str]) -> Column:
    if len(words) > FEW:
        return F.size(group_numbers(c, [words])) > 0
    found = F.lit(False)
    for w in words:
        found = found | F.contains(empty(c), F.lit(w))
    return found


def faq_like(c: Column, marks: Sequence[str]) -> Column:
    """H2: two hits or more over the question marks of a FAQ."""
    return sum((F.regexp_count(empty(c), F.lit(f"(?m){p}")) for p in marks), F.lit(0)) >= 2


def has_headings(c: Column) -> Column:
    """H3."""
    return empty(c).rlike(r"(?m)^#{1,6}\s+\S")


def headings(c: Column) -> Column:
    """Heading texts in order."""
    return F.regexp_extract_all(empty(c), F.lit(r"(?m)^#{1,6}\s+(.+)$"), F.lit(1))


def section_title(c: Column) -> Column:
    return F.get(headings(c), 0)


def normalise_space(c: Column) -> Column:
    """Runs of blanks to one, three or more line ends to two, outer space gone."""
    return stripped(F.regexp_replace(F.regexp_replace(empty(c), "\n{3,}", "\n\n"), "[ \t]{2,}", " "))


def is_noise(c: Column) -> Column:
    """Blank, punctuation alone, or fewer than three word characters."""
    marks = r"^[\s　-〿＀-￯ -⁯\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+$"
    return (F.trim(c) == "") | c.rlike(marks) | (F.length(F.regexp_replace(c, r"(?U)\W", "")) < 3)


def short_id(source: Column, tag: str, index: Column) -> Column:
    """First 12 hex digits of md5(source#tag index)."""
    return F.substring(F.md5(F.concat(source, F.lit(f"#{tag}"), index.cast("string"))), 1, 12)


def strip_inline_images(c: Column) -> Column:
    """C9."""
    return F.regexp_replace(c, r"!\[[^\]]*\]\(data:image/[^;)]+;base64,[A-Za-z0-9+/=]+\)", "![图片]")


def first_label(c: Column, rules: Sequence[tuple], default: Column, at: int = 1) -> Column:
    """The label (or the entry `at` another place) of the first rule (priority, label, ..., words) of which the text holds a word."""
    ordered = sorted(rules, key=lambda r: r[0])
    if sum(len(r[-1]) for r in ordered) > FEW:
        first = F.get(group_numbers(c, [r[-1] for r in ordered]), 0)
        return F.coalesce(F.get(F.array(*(F.lit(r[at]) for r in ordered)), first), default)
    out = default
    for rule in reversed(ordered):
        out = F.when(any_of(c, rule[-1]), F.lit(rule[at])).otherwise(out)
    return out


def access_rank(c: Column) -> Column:
    """0, 1 or 2 for a level's name or number; anything else is public."""
    name = F.lower(F.trim(c.cast("string")))
    return F.when(name.isin("member", "1"), 1).when(name.isin("vip", "2"), 2).otherwise(0).cast("tinyint")
