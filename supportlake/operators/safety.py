"""Privacy and guards."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supportlake.functions import lexicons as lex
from supportlake.functions.text import empty


def redact(c: Column, rules: Sequence[tuple[str, str, int]] = lex.PII) -> Column:
    """G1: patterns in order, each on the output of the one before; a rule of group 2 keeps its group 1."""
    for label, pattern, group in rules:
        c = F.regexp_replace(c, pattern, f"$1[{label}]" if group == 2 else f"[{label}]")
    return c


def merged_rules(custom: dict[str, str], rules: Sequence[tuple[str, str, int]] = lex.PII) -> list[tuple[str, str, int]]:
    """Custom patterns replace those of their label or come last."""
    base = {label: (label, p, g) for label, p, g in rules}
    return list((base | {label: (label, p, 0) for label, p in custom.items()}).values())


def _mask(v: Column) -> Column:
    n = F.length(v)
    return F.when(n <= 4, "***").when(n <= 8, F.concat(F.substring(v, 1, 2), F.lit("***"), F.right(v, F.lit(1)))).otherwise(F.concat(F.substring(v, 1, 3), F.lit("***"), F.right(v, F.lit(2))))


def _needed(df: DataFrame, c: Column, rules: Sequence[tuple[str, str, int]]) -> tuple[DataFrame, dict[str, Column]]:
    """Columns that tell what a text must hold for each pattern; most texts hold none of it and are spared the patterns."""
    needs = {p: lex.PII_NEEDS[p] for _, p, _ in rules if p in lex.PII_NEEDS}
    names = {need: f"_need{i}" for i, need in enumerate(dict.fromkeys(needs.values()))}
    return df.withColumns({n: c.rlike(need) for need, n in names.items()}), {p: F.col(names[need]) for p, need in needs.items()}


def _by_rule(df: DataFrame, text: str, rules: Sequence[tuple[str, str, int]]) -> tuple[DataFrame, list[str]]:
    """A column for each rule with what it finds; that is blanked for the later ones. A step a rule, so that each pattern runs once.

    A find holds no blank, so it stands in the text itself: the needs are asked of the text.
    """
    columns, found = [F.col(c) for c in df.columns], []
    df, need = _needed(df.withColumn("_rest", empty(F.col(text))), F.col("_rest"), rules)
    needs = [c for c in df.columns if c.startswith("_need")]
    for i, (_, pattern, group) in enumerate(rules):
        values = F.regexp_extract_all("_rest", F.lit(pattern), F.lit(group))
        df = df.withColumn(f"_found{i}", F.when(need.get(pattern, F.lit(True)), values).otherwise(F.array().cast("array<string>")))
        found.append(f"_found{i}")
        rest = F.when(F.size(f"_found{i}") > 0, F.regexp_replace("_rest", pattern, "□")).otherwise(F.col("_rest"))
        df = df.select(*columns, *found, *needs, rest.alias("_rest"))
    return df.select(*columns, *found), found


def pii_findings(df: DataFrame, text: str = "text", rules: Sequence[tuple[str, str, int]] = lex.PII, key: str = "id") -> DataFrame:
    """(key, type, pos, original, masked); what an earlier rule found is blanked for the later ones."""
    held, found = _by_rule(df.select(key, text), text, rules)
    every = F.concat(*(F.transform(c, _typed(label)) for c, (label, _, _) in zip(found, rules, strict=True)))
    rows = held.select(F.col(key), F.posexplode_outer(every).alias("pos", "f")).filter("f is not null")
    return rows.select(key, "f.type", "pos", F.col("f.original"), _mask(F.col("f.original")).alias("masked"))


def detect_pii(df: DataFrame, text: str = "text", rules: Sequence[tuple[str, str, int]] = lex.PII) -> DataFrame:
    """`found`: the kinds a text holds, by rule, without changing it; what an earlier rule found counts for no later one."""
    held, found = _by_rule(df, text, rules)
    kinds = F.array_compact(F.array(*(F.when(F.size(c) > 0, F.lit(label)) for c, (label, _, _) in zip(found, rules, strict=True))))
    return held.select(*df.columns, kinds.alias("found"))


def _typed(label: str):
    return lambda v: F.struct(F.lit(label).alias("type"), v.alias("original"))


def is_safe(c: Column, rules: Sequence[tuple[str, str, int]] = lex.PII) -> Column:
    """G4."""
    ok = F.lit(True)
    for _, pattern, _ in rules:
        held = empty(c).rlike(pattern)
        ok = ok & ~(empty(c).rlike(lex.PII_NEEDS[pattern]) & held if pattern in lex.PII_NEEDS else held)
    return ok


def _any_case(patterns: Sequence[str]) -> str:
    return "(?iu)" + "|".join(f"(?:{p})" for p in patterns)


def _folded(c: Column) -> Column:
    """Lower case, with the letters that (?iu) takes for i, s and k."""
    return F.lower(F.translate(empty(c), "\u0130\u0131\u017f\u212a", "iisk"))


def _says(c: Column, patterns: Sequence[str]) -> Column:
    """Whether a folded text holds a pattern, a row of words on one line with `.*` between them.

    A line is read once from its beginning, to the first place of each word after the one before: later places find nothing more.
    Texts that lack a word are only searched for it. A pattern of another form is asked as it is.
    """
    out = F.lit(False)
    for p in patterns:
        words = [w.lower() for w in p.split(".*")]
        if not all(words) or any(re.escape(w).replace("\\ ", " ") != w for w in words):
            out = out | c.rlike(_any_case([p]))
            continue
        held = F.contains(c, F.lit(words[-1]))
        for w in words[-2::-1]:
            held = held & F.contains(c, F.lit(w))
        out = out | (held & c.rlike("(?m)^" + "".join(f"(?>.*?{w})" for w in words)) if len(words) > 1 else held)
    return out


def check_input(df: DataFrame, text: str = "text", limit: int | None = 5000) -> DataFrame:
    """Attacks are blanked and flagged with a message, other input is cut to the limit (None: whole) and flagged `truncated`."""
    columns = df.columns
    df = df.withColumn("_folded", _folded(F.col(text))).select(*columns, _says(F.col("_folded"), lex.INPUT_ATTACKS).alias("flagged"))
    bad = F.col("flagged")
    kept = empty(F.col(text)) if limit is None else F.substring(empty(F.col(text)), 1, limit)
    long = F.lit(False) if limit is None else F.length(empty(F.col(text))) > limit
    return df.withColumn("safe_text", F.when(bad, "").otherwise(kept)).withColumn("truncated", ~bad & long).withColumn("message", F.when(bad, lex.ATTACK_MESSAGE))


def check_document(df: DataFrame, text: str = "text") -> DataFrame:
    """Attacks inside documents are replaced by a notice."""
    columns = df.columns
    df = df.withColumn("_folded", _folded(F.col(text))).select(*columns, _says(F.col("_folded"), lex.DOCUMENT_ATTACKS).alias("suspicious"))
    return df.withColumn("safe_text", F.when(F.col("suspicious"), lex.REMOVED).otherwise(F.col(text)))


def check_output(df: DataFrame, text: str = "text") -> DataFrame:
    """Warnings by category; on any, lines with a leak phrase go."""
    c = empty(F.col(text))
    columns = df.columns
    warnings = F.array_compact(F.array(*(F.when(_says(F.col("_folded"), p), F.lit(name)) for name, p in lex.OUTPUT_LEAKS)))
    df = df.withColumn("_folded", _folded(F.col(text))).select(*columns, warnings.alias("warnings"))
    kept = F.array_join(F.filter(F.split(c, "\n"), lambda x: ~x.rlike(_any_case(lex.LEAK_LINES))), "\n")
    return df.withColumn("safe_text", F.when(F.size("warnings") > 0, kept).otherwise(c))


def high_stakes(c: Column) -> Column:
    """Categories of promises in an answer."""
    return F.array_compact(F.array(*(F.when(empty(c).rlike("|".join(f"(?:{p})" for p in patterns)), F.lit(name)) for name, patterns in lex.HIGH_STAKES)))


def needs_review(c: Column, faithfulness: Column, min_score: float = 0.85) -> Column:
    """G9."""
    return (F.size(high_stakes(c)) > 0) & (faithfulness < min_score)


def role_rank(role: Column) -> Column:
    """A role's rank; unknown and missing roles are public."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in lex.ROLE_RANKS.items() for x in kv])[F.lower(F.trim(empty(role)))], F.lit(0)).cast("tinyint")


def rank_name(rank: Column) -> Column:
    return F.when(rank == 1, "member").when(rank == 2, "vip").otherwise("public")


def is_admin(role: Column) -> Column:
    return F.lower(F.trim(empty(role))) == "admin"


def redacted_write(df: DataFrame, columns: Sequence[str], path: str, rules: Sequence[tuple[str, str, int]] = lex.PII) -> None:
    """Redact before anything is kept."""
    df.withColumns({c: redact(F.col(c), rules) for c in columns}).write.mode("append").parquet(path)
