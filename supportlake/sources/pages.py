"""Web pages and tables to text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from supportlake.functions.text import bind, empty

DROPPED = ("script", "style", "nav", "footer", "header", "aside", "noscript")


#: Regions in order of preference, each with its tag's name. A region ends at the closing tag of its own depth.
REGIONS = (
    (r"main\b[^>]*", "main"), (r"article\b[^>]*", "article"), (r"div\b[^>]*\bclass\s*=\s*[\"'](?:[^\"'>]*\s)?detail(?:\s[^\"'>]*)?[\"'][^>]*", "div"),
    (r"div\b[^>]*\bid\s*=\s*[\"']detail[\"'][^>]*", "div"), (r"body\b[^>]*", "body"),
)


def inside(html: Column, begin: str, name: str) -> Column:
    """What the first tag `begin` encloses, tags of its name as line ends: a fold over the tags of that name keeps the depth, and the
    region ends where it falls to zero. An unclosed region reaches to the end of the page."""
    tag = F.lit(rf"(?is)</?{name}\b[^>]*>")
    rest = F.regexp_extract(html, rf"(?is)<{begin}>(.*)", 1)

    def step(a: Column, t: Column) -> Column:
        depth = F.when(a["depth"] == 0, 0).otherwise(a["depth"] + F.when(t.startswith("</"), -1).otherwise(1))
        return F.struct(depth.alias("depth"), (a["seen"] + (a["depth"] > 0).cast("int")).alias("seen"))

    start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("seen"))
    folded = lambda r: F.aggregate(F.regexp_extract_all(r, tag, F.lit(0)), start, step)
    cut = lambda r, end: F.array_join(F.slice(F.split(r, tag), F.lit(1), F.when(end["depth"] == 0, end["seen"]).otherwise(F.length(r) + 1)), "\n")
    return bind(rest, lambda r: bind(folded(r), lambda end: cut(r, end)))


def main_text(html: Column) -> Column:
    """Boilerplate regions out; the first of main, article, a detail division, body, else all; tags out; stripped lines of more than 2 characters."""
    c = empty(html)
    for tag in DROPPED:
        c = F.regexp_replace(c, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")

    def text_of(page: Column) -> Column:
        body = page
        for begin, name in reversed(REGIONS):
            body = F.when(page.rlike(rf"(?is)<{begin}>"), inside(page, begin, name)).otherwise(body)
        text = F.regexp_replace(body, r"(?s)<[^>]*>", "\n")
        for name, mark in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
            text = F.replace(text, F.lit(name), F.lit(mark))
        lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
        return F.array_join(F.filter(lines, lambda x: F.length(x) > 2), "\n")

    return bind(c, text_of)


def table_markdown(df: DataFrame, sheet: str, order: str, columns: Sequence[str], cap: int | None = 5000) -> DataFrame:
    """One Markdown table a sheet: header, separator and at most `cap` rows (`truncated` tells of more); None takes all."""
    n = F.count("*").over(Window.partitionBy(sheet))
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(sheet).orderBy(order))).withColumn("_n", n)
    ranked = ranked if cap is None else ranked.filter(F.col("_rn") <= cap)
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), F.lit(" |"))
    head = f"| {' | '.join(columns)} |\n| {' | '.join('---' for _ in columns)} |"
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_rn", row.alias("x")))), lambda s: s["x"]), "\n")
    return ranked.groupBy(sheet).agg(F.concat(F.lit(head + "\n"), lines).alias("markdown"), (F.lit(False) if cap is None else F.max("_n") > cap).alias("truncated"))
