"""Secret scans by a trigram inverted index.

Each rule's regular expression gives a Boolean query over lower-case trigrams that every match must
contain. The texts of one block (some hundred documents of a partition) form an index segment: the
postings of the trigrams that any rule asks for. A rule's query intersects and unites postings, and
only the surviving documents are searched with the regular expression; a rule without mandatory
trigrams (long hexadecimal strings) searches every text. Segments are local to a partition, so
nothing is shuffled and memory follows the block.

Defined results: a null or empty text has no spans; repeated rows each get their own row; an empty
table gives an empty one; a very long text is indexed and searched whole; `redact_secrets` keeps all
columns and their order, `secret_spans` reads doc_id and text alone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import product
from re import _constants as op
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from supportlake.llm.common import batches


@dataclass(frozen=True)
class SecretRule:
    kind: str
    pattern: str
    any_case: bool = False
    group: int = 0
    least: int = 1  # characters of that group
    base: bool = False

    @cached_property
    def regex(self) -> re.Pattern:
        return re.compile(self.pattern, re.A | (re.I if self.any_case else 0))

    @cached_property
    def query(self):
        return trigram_query(self.pattern)

    def spans(self, text: str) -> list[tuple[int, int]]:
        return [m.span() for m in self.regex.finditer(text) if len(m[self.group]) >= self.least]


#: The three base kinds in their listed order, then kinds of well-known key formats.
RULES = (
    SecretRule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 6, True),
    SecretRule("access", r"AKIA[A-Z0-9]+", least=20, base=True),
    SecretRule("hex", r"[0-9a-f]{24,}", least=24, base=True),
    SecretRule("pem", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----"),
    SecretRule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    SecretRule("slack", r"xox[abprs]-[0-9A-Za-z-]{10,}"),
    SecretRule("google", r"AIza[0-9A-Za-z_-]{35}"),
    SecretRule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)

ANY = None  # the query that every text answers
MAX_STRINGS = 64


def _all_of(*queries):
    parts = frozenset(q for q in queries if q is not ANY)
    return ANY if not parts else next(iter(parts)) if len(parts) == 1 else ("and", parts)


def _one_of(queries):
    parts = frozenset(queries)
    return ANY if ANY in parts else next(iter(parts)) if len(parts) == 1 else ("or", parts)


def _of_string(s: str):
    raw = s.lower().encode()
    return _all_of(*(raw[i : i + 3] for i in range(len(raw) - 2)))


def trigram_query(pattern: str):
    """A query of bytes (one trigram), ("and", parts), ("or", parts) or ANY that each match satisfies."""
    strings, query, _ = _walk(_parser.parse(pattern))
    return _all_of(query, _one_of(_of_string(s) for s in strings))


def _walk(items) -> tuple[set[str], object, bool]:
    """Strings that end what was read since the last gap, the query so far, and whether there was no gap at all."""
    strings, query, exact = {""}, ANY, True

    def gap(*more) -> None:
        nonlocal strings, query, exact
        query = _all_of(query, _one_of(_of_string(s) for s in strings), *more)
        strings, exact = {""}, False

    def extend(more: set[str]) -> None:
        nonlocal strings
        if len(more) > MAX_STRINGS:
            gap(_one_of(_of_string(s) for s in more))
        else:
            if len(strings) * len(more) > MAX_STRINGS:
                gap()
            strings = {a + b for a, b in product(strings, more)}

    def take(inner: set[str], inside, whole: bool) -> None:
        if whole:
            extend(inner)
        else:
            gap(inside, _one_of(_of_string(s) for s in inner))

    for kind, value in items:
        if kind is op.LITERAL:
            extend({chr(value).lower()})
        elif kind is op.IN:
            chars = {chr(v).lower() for k, v in value if k is op.LITERAL}
            if len(value) <= 8 and all(k is op.LITERAL for k, _ in value):
                extend(chars)
            else:
                gap()
        elif kind is op.SUBPATTERN:
            take(*_walk(value[3]))
        elif kind is op.BRANCH:
            arms = [_walk(arm) for arm in value[1]]
            if all(whole for *_, whole in arms):
                extend(set().union(*(s for s, *_ in arms)))
            else:
                gap(_one_of(_all_of(q, _one_of(_of_string(x) for x in s)) for s, q, _ in arms))
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT):
            low, high, body = value
            inner, inside, whole = _walk(body)
            if whole and (low, high) == (0, 1):
                extend(inner | {""})
            else:
                for _ in range(min(low, 3)):
                    take(inner, inside, whole)
                if low != high or low > 3:
                    gap()
        elif kind is not op.AT:
            gap()
    return strings, query, exact


def trigrams_of(query) -> set[bytes]:
    if query is ANY:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*map(trigrams_of, query[1]))


class Segment:
    """Postings of the wanted trigrams over the texts of one block."""

    def __init__(self, texts: list[str], wanted: np.ndarray):
        raw = [t.encode().lower() for t in texts]
        joined = np.frombuffer(b"\0".join([*raw, b"\0\0"]), dtype=np.uint8).astype(np.uint32)
        codes = (joined[:-2] << 16) | (joined[1:-1] << 8) | joined[2:]
        hits = np.flatnonzero(wanted[codes])
        ends = np.cumsum([len(r) + 1 for r in raw])
        pairs = np.unique((codes[hits].astype(np.int64) << 32) | np.searchsorted(ends, hits, side="right"))
        trigrams, starts = np.unique(pairs >> 32, return_index=True)
        self.n = len(texts)
        self.postings = {int(t): p & 0xFFFFFFFF for t, p in zip(trigrams, np.split(pairs, starts[1:]), strict=True)} if len(pairs) else {}

    def answer(self, query) -> np.ndarray:
        """Sorted numbers of the texts that satisfy the query."""
        if query is ANY:
            return np.arange(self.n)
        if isinstance(query, bytes):
            return self.postings.get(int.from_bytes(query, "big"), np.zeros(0, dtype=np.int64))
        found = [self.answer(q) for q in query[1]]
        out = found[0]
        for f in found[1:]:
            out = np.intersect1d(out, f, assume_unique=True) if query[0] == "and" else np.union1d(out, f)
        return out


def scanner(rules: tuple[SecretRule, ...]):
    """A function from texts to their spans (rule number, start, end), sorted by start, then rule."""
    wanted = np.zeros(1 << 24, dtype=bool)
    for r in rules:
        for t in trigrams_of(r.query):
            wanted[int.from_bytes(t, "big")] = True

    def scan(texts: list[str]) -> list[list[tuple[int, int, int]]]:
        segment, found = Segment(texts, wanted), [[] for _ in texts]
        for n, r in enumerate(rules):
            for i in segment.answer(r.query):
                inside = found[i] if not r.base else ()
                found[i] += [(n, a, b) for a, b in r.spans(texts[i]) if not any(a < y and x < b for _, x, y in inside)]
        return [sorted(f, key=lambda s: (s[1], s[0])) for f in found]

    return scan


def joined(rules: tuple[SecretRule, ...], spans: list[tuple[int, int, int]], base_only: bool = False) -> str:
    return ",".join(f"{rules[n].kind}:{a}:{b}" for n, a, b in spans if rules[n].base or not base_only)


def secret_spans(docs: DataFrame, rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """doc_id and spans: an array of (kind, start, end) in code points, end exclusive."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(rules)
        span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for b in batches(frames, 256):
            found = scan([t or "" for t in b["text"].to_pylist()])
            rows = [[{"kind": rules[n].kind, "start": x, "end": y} for n, x, y in f] for f in found]
            yield pa.RecordBatch.from_arrays([b["doc_id"].cast(pa.int64()), pa.array(rows, pa.list_(span))], names=["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def secret_digest(docs: DataFrame, rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """Counts of the base kinds, the base spans' digest, and all spans as text."""
    kinds = [n for n, r in enumerate(rules) if r.base]
    schema = "doc_id long, " + "".join(f"n_{rules[n].kind} long, " for n in kinds) + "base_sha256 string, spans string"

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(rules)
        for b in batches(frames, 256):
            found = scan([t or "" for t in b["text"].to_pylist()])
            counts = [pa.array([sum(s[0] == n for s in f) for f in found], pa.int64()) for n in kinds]
            base = pa.array([hashlib.sha256(joined(rules, f, True).encode()).hexdigest() for f in found], pa.string())
            every = pa.array([joined(rules, f) for f in found], pa.string())
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"].cast(pa.int64()), *counts, base, every], names=["doc_id", *(f"n_{rules[n].kind}" for n in kinds), "base_sha256", "spans"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def redact_secrets(docs: DataFrame, rules: tuple[SecretRule, ...] = RULES, text: str = "text") -> DataFrame:
    """The same rows with each run of overlapping spans replaced by [secret:<kind>] of its first span."""
    at = docs.columns.index(text)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(rules)
        for b in batches(frames, 256):
            texts = b.column(at).to_pylist()
            out = []
            for t, spans in zip(texts, scan([t or "" for t in texts]), strict=True):
                if not spans:
                    out.append(t)
                    continue
                parts, end = [], 0
                for k, x, y in spans:
                    if x >= end:
                        parts += [t[end:x], f"[secret:{rules[k].kind}]"]
                    end = max(end, y)
                out.append("".join(parts) + t[end:])
            yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(out, pa.string()), *b.columns[at + 1 :]], schema=b.schema)

    return docs.mapInArrow(run, docs.schema)
