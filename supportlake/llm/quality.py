"""Quality rules: a threshold table compiled into one projection, without user functions.

Every metric is a built-in array or string function over one row, so the plan is scan -> project:
no shuffle, no state, and one very long text costs only its own task.

Defined results: a null text counts as empty (no words, fails); an empty table gives an empty
table; repeated rows each get their own row; other columns of the input are ignored by `quality`
and kept untouched by `keep_good`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supportlake.llm.common import SPACE, let

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "a", "and", "are", "as", "at", "be", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with",
    "das", "dem", "den", "der", "des", "die", "ein", "eine", "ist", "mit", "nicht", "sich", "und", "von", "zu",
    "de", "en", "est", "et", "la", "le", "les", "pas", "pour", "que", "qui", "un", "une",
    "con", "el", "los", "las", "no", "por", "se", "una", "y",
)


SYMBOLS = "#*$%&|<>"
#: Latin capitals: A-Z, À-Ö and Ø-Þ.
CAPITALS = "".join(chr(c) for c in (*range(0x41, 0x5B), *range(0xC0, 0xD7), *range(0xD8, 0xDF)))


@dataclass(frozen=True)
class Rule:
    """low <= 100 * part / whole <= high, in whole numbers; None leaves a side open."""

    name: str
    part: str
    whole: str
    low: int | None = None
    high: int | None = None

    def passed(self, m: Column) -> Column:
        scaled, whole, ok = m[self.part] * 100, m[self.whole], F.lit(True)
        if self.low is not None:
            ok = ok & (scaled >= whole * self.low)
        if self.high is not None:
            ok = ok & (scaled <= whole * self.high)
        return ok


#: Length, symbol, stop-word and line ratios. The base rules (50 words, half of the words in repeated windows) stand apart.
RULES = (
    Rule("word_length", "word_chars", "n_words", 200, 1200),
    Rule("symbols", "n_symbols", "n_words", None, 15),
    Rule("exclamations", "n_exclaim", "n_words", None, 20),
    Rule("capitals", "n_upper", "word_chars", None, 40),
    Rule("stop_words", "n_stop", "n_words", 5, None),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 50),
)


def repeated_words(words: Column, n: int = 3, few: int = 64) -> Column:
    """Words inside windows of n words that occur twice or more in the text.

    Windows are compared by 64-bit hash within one row. Sorting the hashes yields those that repeat;
    with up to `few` of them a membership test marks their starts in order, beyond that a sort of
    (hash, position) pairs does. A fold over the sorted starts counts each covered word once.
    O(words * log words), and nothing leaves the row.
    """

    def marked(h: Column) -> Column:
        again = lambda s: F.array_distinct(F.filter(s, lambda x, i: x == F.get(s, i - 1)))
        return let(let(F.sort_array(h), again), lambda dup: starts(h, dup))

    def starts(h: Column, dup: Column) -> Column:
        by_test = F.array_compact(F.transform(h, lambda x, i: F.when(F.array_contains(dup, x), i)))
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(dup) == 0, F.array().cast("array<int>")).when(F.size(dup) <= few, by_test).otherwise(let(pairs, neighbours))

    def neighbours(s: Column) -> Column:
        def mark(x: Column, i: Column) -> Column:
            same = F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))
            return F.when(same, x["i"])

        return F.sort_array(F.array_compact(F.transform(s, mark)))

    first = F.struct(F.lit(-n).alias("last"), F.lit(0).cast("long").alias("n"))
    step = lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(n), p - a["last"])).alias("n"))
    full = F.transform(words, lambda w, i: F.xxhash64(w, *(F.get(words, i + k) for k in range(1, n))))
    hashes = F.slice(full, F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(0)))  # the last ones lack a word
    return F.when(F.size(words) <= n, F.lit(0).cast("long")).otherwise(F.aggregate(let(hashes, marked), first, step, lambda a: a["n"]))


def measured(text: Column) -> Column:
    """The metrics as a struct. Words, lines and counted characters are bound once, so a filter may evaluate this in place."""
    t = F.coalesce(text, F.lit(""))

    def metrics(w: Column, lines: Column, marks: Column) -> Column:
        gone = lambda chars: (F.length(marks) - F.length(F.translate(marks, chars, ""))).cast("long")
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            gone(SYMBOLS).alias("n_symbols"),
            gone("!").alias("n_exclaim"),
            gone(CAPITALS).alias("n_upper"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(*STOP_WORDS))).cast("long").alias("n_stop"),
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            repeated_words(w).alias("n_repeat_words"),
        )

    words = F.array_remove(F.split(t, f"{SPACE}+"), "")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{SPACE[1:]}"))
    marks = F.regexp_replace(t, f"[^{SYMBOLS}!A-ZÀ-ÖØ-Þ]+", "")
    return let(words, lambda w: let(lines, lambda x: let(marks, lambda m: metrics(w, x, m))))


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 50) | (m["n_repeat_words"] * 100 > m["n_words"] * 50)


def accepted(m: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    ok = ~base_failed(m)
    for r in rules:
        ok = ok & r.passed(m)
    return ok


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns of `keep`, the metrics, `base_failed`, `kept`, and `failed_rules`: names of the failed table rows, comma-joined."""
    m = F.col("_m")
    failed = F.array_join(F.array_compact(F.array(*(F.when(~r.passed(m), F.lit(r.name)) for r in rules))), ",")
    found = docs.select(*keep, measured(F.col(text)).alias("_m"))
    return found.select(*keep, "_m.*", base_failed(m).alias("base_failed"), accepted(m, rules).alias("kept"), failed.alias("failed_rules"))


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The input rows that pass, with the input's own columns."""
    return docs.filter(let(measured(F.col(text)), lambda m: accepted(m, rules)))


def quality_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The same table as DuckDB SQL over `documents`."""
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    checks = []
    for r in rules:
        if r.low is not None:
            checks.append(f"100 * {r.part} >= {r.low} * {r.whole}")
        if r.high is not None:
            checks.append(f"100 * {r.part} <= {r.high} * {r.whole}")
    return rf"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
    w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
                 list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
    g AS (SELECT r, i, list_slice(w, i, i + 2) AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
    p AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c > 1),
    c AS (SELECT r, count(DISTINCT i + k) AS n FROM p, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
    m AS (SELECT doc_id, len(w) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
                 length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
                 length(t) - length(replace(t, '!', '')) AS n_exclaim,
                 length(regexp_replace(t, '[^A-ZÀ-ÖØ-Þ]+', '', 'g')) AS n_upper,
                 len(list_filter(w, lambda x: lower(x) IN ({stop}))) AS n_stop,
                 len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
          FROM w LEFT JOIN c USING (r)),
    b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND {" AND ".join(checks)} AS kept FROM b
    """
