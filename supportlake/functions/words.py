"""Many words at once: which groups of a rule table a text holds, by one automaton and one pass over the text.

Small tables stay expressions, a search for each word. Above `FEW` words the table becomes an automaton (Aho-Corasick), built once
for each worker and table, which reads a batch of texts; its work follows the text and the matches, not the number of words. Both forms give the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words up to which a search for each stays an expression.
FEW = 200

Groups = tuple[tuple[str, ...], ...]


@lru_cache(maxsize=16)
def automaton(groups: Groups):
    """The automaton, whose values are the numbers of the groups that hold a word, and the groups that hold the empty word, which every text has."""
    import ahocorasick

    owners: dict[str, set[int]] = {}
    for number, words in enumerate(groups):
        for w in words:
            owners.setdefault(w, set()).add(number)
    always = owners.pop("", set())
    found = ahocorasick.Automaton()
    for w, numbers in owners.items():
        found.add_word(w, frozenset(numbers))
    if owners:
        found.make_automaton()
    return found if owners else None, always


def _numbers(groups: Groups):
    @F.pandas_udf("array<int>")
    def scan(texts: pd.Series) -> pd.Series:
        found, always = automaton(groups)
        n, out = len(groups), []
        for t in texts:
            held = set(always)
            if found is not None and t:
                for _, numbers in found.iter(t):
                    held |= numbers
                    if len(held) == n:
                        break
            out.append(sorted(held))
        return pd.Series(out, index=texts.index, dtype=object)

    return scan


def group_numbers(c: Column, groups: Sequence[Sequence[str]], few: int = FEW) -> Column:
    """The numbers (from 0, ascending) of the groups of which the text holds a word; a null text is an empty one, a group without words is held by none."""
    whole: Groups = tuple(tuple(g) for g in groups)
    text = F.coalesce(c, F.lit(""))
    if sum(map(len, whole)) > few:
        return _numbers(whole)(text)
    found = lambda g: F.exists(F.array(*map(F.lit, g)), lambda w: F.contains(text, w)) if g else F.lit(False)
    return F.array_compact(F.array(*(F.when(found(g), F.lit(k)) for k, g in enumerate(whole)))).cast("array<int>")
