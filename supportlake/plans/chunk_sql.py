"""The splitters as DuckDB SQL: lists of units, a step a level, for comparison with the registered chunk queries."""

from __future__ import annotations

from supportlake.operators.chunk import DROPPED, SEPARATORS

STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def tokens(x: str) -> str:
    other = f"length(regexp_replace({x}, '[一-鿿]', '', 'g'))"
    return f"CAST(floor((length({x}) - {other}) / 1.5 + {other} / 3.5) AS INTEGER)"


def unit(x: str, b: str, g: str, m: str, t: str | None = None) -> str:
    return f"{{'b': CAST({b} AS INTEGER), 't': {t or tokens(x)}, 'x': {x}, 'g': CAST({g} AS INTEGER), 'm': CAST({m} AS INTEGER)}}"


def steps(first: str, min_size: int = 80) -> str:
    """CTEs from u0 (s, u) = `first` to `done` (s, u), the units of the recursive split."""
    out, n = [f"u0 AS ({first})"], 0

    def add(u: str) -> None:
        nonlocal n
        n += 1
        out.append(f"u{n} AS (SELECT s, {u} AS u FROM u{n - 1})")

    for level, sep in enumerate(SEPARATORS):
        text = "'" + sep.replace("\n", "'||chr(10)||'") + "'"
        pieces = f"string_split(q.x, {text})" if sep in DROPPED else f"string_split(replace(q.x, {text}, {text} || chr(1)), chr(1))"
        part = unit("p", f"CASE WHEN i = 1 THEN q.b ELSE {level} END", "q.g", "q.m")
        add(f"flatten(list_transform(u, lambda q: CASE WHEN q.t <= q.m THEN [q] ELSE list_transform(list_filter({pieces}, lambda p: {STRIP.format('p')} <> ''), lambda p, i: {part}) END))")
    chars = "CAST(floor(1.5 * q.g) AS INTEGER)"
    part = unit(f"substring(q.x, CAST(k AS INTEGER) * {chars} + 1, {chars})", f"CASE WHEN k = 0 THEN q.b ELSE {len(SEPARATORS)} END", "q.g", "q.m")
    add(f"flatten(list_transform(u, lambda q: CASE WHEN q.t <= q.m OR length(q.x) <= {chars} THEN [q] ELSE list_transform(range(0, (length(q.x) - 1) // {chars} + 1), lambda k: {part}) END))")
    add(f"list_filter(list_transform(u, lambda q: {unit(STRIP.format('q.x'), 'q.b', 'q.g', 'q.m', 'CASE WHEN ' + STRIP.format('q.x') + ' = q.x THEN q.t ELSE ' + tokens(STRIP.format('q.x')) + ' END')}), lambda q: q.x <> '')")
    for level in reversed(range(len(SEPARATORS))):
        other = "length(regexp_replace(q.x, '[一-鿿]', '', 'g'))"
        sized = f"list_transform(u, lambda q, i: {{'ss': [CAST(i AS INTEGER)], 'h': CAST(length(q.x) - {other} AS INTEGER), 'o': CAST({other} AS INTEGER), 't': q.t, 'b': q.b, 'm': q.m}})"
        total = f"CASE WHEN v.t < {min_size} THEN CAST(floor((a.h + v.h) / 1.5 + (a.o + 2 + v.o) / 3.5) AS INTEGER) ELSE a.t + v.t END"
        both = f"{{'ss': a.ss, 'h': a.h + v.h, 'o': a.o + 2 + v.o, 't': {total}, 'b': a.b, 'm': a.m}}"
        new = "{'ss': list_concat(a.ss, v.ss), 'h': v.h, 'o': v.o, 't': v.t, 'b': v.b, 'm': v.m}"
        starts = f"CASE WHEN len(u) = 0 THEN CAST([] AS INTEGER[]) ELSE list_reduce({sized}, lambda a, v: CASE WHEN v.b >= {level} AND {total} <= v.m THEN {both} ELSE {new} END).ss END"
        out.append(f"s{n} AS (SELECT s, u, {starts} AS st FROM u{n})")
        run = "u[st[k]:coalesce(st[k + 1], len(u) + 1) - 1]"
        text = f"array_to_string(list_transform({run}, lambda z: z.x), chr(10) || chr(10))"
        joined = f"CASE WHEN coalesce(st[k + 1], len(u) + 1) - st[k] = 1 THEN u[st[k]] ELSE {unit(text, 'u[st[k]].b', 'u[st[k]].g', 'u[st[k]].m')} END"
        n += 1
        out.append(f"u{n} AS (SELECT s, list_transform(range(1, len(st) + 1), lambda k: {joined}) AS u FROM s{n - 1})")
    return ", ".join([*out, f"done AS (SELECT s, u FROM u{n})"])


def whole(x: str, target: int, most: int) -> str:
    return f"CASE WHEN {STRIP.format(x)} = '' THEN [] ELSE [{unit(x, '-1', str(target), str(most))}] END"


DOCS = "(SELECT CAST(doc_id AS VARCHAR) AS s, coalesce(text, '') AS t FROM documents)"


def recursive_sql() -> str:
    return f"""WITH {steps(f"SELECT s, {whole('t', 512, 1024)} AS u FROM {DOCS}")}
    SELECT s AS source_file, k - 1 AS chunk_index, substring(md5(s || '#chunk' || (k - 1)), 1, 12) AS chunk_id, length(u[k].x) AS char_count, {tokens('u[k].x')} AS token_count, len(u) AS chunk_total FROM (SELECT s, u, unnest(range(1, len(u) + 1)) AS k FROM done)"""


def sentence_sql() -> str:
    cut = lambda x, ends, before: f"list_filter(list_transform(string_split(regexp_replace({x}, '([{ends}])\\s*([{before}])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda y: {STRIP.format('y')}), lambda y: y <> '')"
    sentences = cut("t", "。！？.!?", "A-Z一-鿿぀-ゟ゠-ヿ")
    units = f"flatten(list_transform({sentences}, lambda c: CASE WHEN {tokens('c')} > 1024 THEN {cut('c', '；，;,', '一-鿿A-Z')} ELSE [c] END))"
    starts = f"list_reduce(list_transform(w, lambda c, i: {{'ss': [CAST(i AS INTEGER)], 't': {tokens('c')}}}), lambda a, v: CASE WHEN a.t + v.t <= 1024 THEN {{'ss': a.ss, 't': a.t + v.t}} ELSE {{'ss': list_concat(a.ss, v.ss), 't': v.t}} END).ss"
    run = "w[st[k]:coalesce(st[k + 1], len(w) + 1) - 1]"
    packed = f"list_transform(range(1, len(st) + 1), lambda k: CASE WHEN coalesce(st[k + 1], len(w) + 1) - st[k] = 1 THEN {unit('w[st[k]]', '-1', '512', '1024')} ELSE {unit(STRIP.format(f'array_to_string({run}, chr(10))'), '-1', '512', '1024', '1024')} END)"
    first = f"SELECT s, CASE WHEN {STRIP.format('t')} = '' OR {tokens('t')} <= 1024 THEN {whole('t', 512, 1024)} ELSE {packed} END AS u FROM (SELECT *, CASE WHEN len(w) > 0 THEN {starts} END AS st FROM (SELECT s, t, {units} AS w FROM {DOCS}))"
    return f"""WITH {steps(first)}, c AS (SELECT s, u, unnest(range(1, len(u) + 1)) AS k FROM done)
    SELECT s AS source_file, k - 1 AS chunk_index, md5(CASE WHEN k = 1 THEN u[k].x ELSE right(u[k - 1].x, 80) || chr(10) || u[k].x END) AS text_md5, CASE WHEN k = 1 THEN 0 ELSE least(80, length(u[k - 1].x)) END AS overlap FROM c"""


def sweep_sql() -> str:
    every = " UNION ALL ".join(f"SELECT s || '/{t}' AS s, {whole('t', t, 2 * t)} AS u FROM {DOCS}" for t in (256, 512, 768, 1024))
    return f"""WITH {steps(every)}, x AS (SELECT split_part(s, '/', 1) AS source_file, CAST(split_part(s, '/', 2) AS INTEGER) AS target, list_transform(u, lambda q: CAST(length(q.x) AS DOUBLE)) AS z FROM done),
    m AS (SELECT source_file, target, len(z) AS n, coalesce(list_avg(z), 0) AS a, coalesce(list_stddev_pop(z), 0) AS d FROM x),
    c AS (SELECT *, round(0.4 * CASE WHEN a > 0 THEN greatest(0, 1 - d / a) ELSE 0 END + 0.3 * greatest(0, 1 - abs(a - target) / target) + 0.3 * CASE WHEN n BETWEEN 5 AND 50 THEN 1 WHEN n < 5 THEN n / 5.0 ELSE greatest(0, 1 - (n - 50) / 100.0) END, 6) AS score FROM m)
    SELECT source_file, row_number() OVER (PARTITION BY source_file ORDER BY score DESC, target) AS rank, target, n AS n_chunks, round(a, 4) AS avg_size, round(d, 4) AS std_size, score FROM c"""


def packed(items: str, limit: int) -> str:
    """The starts (1-based) of runs of `items` whose token sums stay within the limit."""
    sized = f"list_transform({items}, lambda c, i: {{'ss': [CAST(i AS INTEGER)], 't': {tokens('c')}}})"
    return f"list_reduce({sized}, lambda a, v: CASE WHEN a.t + v.t <= {limit} THEN {{'ss': a.ss, 't': a.t + v.t}} ELSE {{'ss': list_concat(a.ss, v.ss), 't': v.t}} END).ss"


#: A conversation as one text: a user's turn is a question, a paragraph begins after each full stop.
TALK = r"""(SELECT CAST(conv_id AS VARCHAR) AS s, string_agg(CASE WHEN role = 'user' THEN '## Q' || turn || ': ' ELSE '' END || regexp_replace(coalesce(text, ''), '\.\s+', '.' || chr(10) || chr(10), 'g'), chr(10)
 ORDER BY turn, role, coalesce(text, '')) AS t FROM conversations GROUP BY conv_id)"""


def faq_sql(target: int, most: int) -> str:
    """Pairs cut before each question mark; a long pair by paragraphs, later ones led by the question."""
    marked = r"regexp_replace(t, '(?m)^(##\s*Q[0-9]+[：:])', chr(1) || '\1', 'g')"
    pairs = f"list_filter(list_transform(string_split({marked}, chr(1)), lambda x: {STRIP.format('x')}), lambda x: x <> '')"
    first = "string_split(p, chr(10))[1]"
    asked = rf"coalesce(nullif(regexp_extract({first}, '^#{{2,6}}\s*Q?[0-9]*[：:\s]*(.+)$', 1), ''), substring({first}, 1, 100))"
    run = "array_to_string(w[st[k]:coalesce(st[k + 1], len(w) + 1) - 1], chr(10) || chr(10))"
    led = f"CASE WHEN k = 1 THEN '' ELSE '_（接上问：' || q || '）_' || chr(10) || chr(10) END || {STRIP.format(run)}"
    return f"""WITH a AS (SELECT s, unnest({pairs}) AS p, unnest(range(0, len({pairs}))) AS n FROM {TALK}), b AS (SELECT *, string_split(p, chr(10) || chr(10)) AS w, {asked} AS q FROM a),
    c AS (SELECT *, {packed('w', most)} AS st FROM b),
    d AS (SELECT s, n, CASE WHEN {tokens('p')} <= {max(most, 2 * target)} THEN [p] ELSE list_transform(range(1, len(st) + 1), lambda k: {led}) END AS x FROM c), e AS (SELECT s, n, unnest(x) AS x, unnest(range(0, len(x))) AS k FROM d)
    SELECT s AS source_file, row_number() OVER (PARTITION BY s ORDER BY n, k) - 1 AS chunk_index, md5(x) AS text_md5 FROM e"""


def markdown_sql(most: int) -> str:
    """Sections by second-level headings; a section above the limit by its paragraphs. No paragraph of these conversations is longer, so the hard cut is left to the literal rows of the tests."""
    sections = f"list_filter(string_split(regexp_replace(t, '\n(## )', chr(1) || '\\1', 'g'), chr(1)), lambda x: {STRIP.format('x')} <> '')"
    paras = f"list_filter(string_split(p, chr(10) || chr(10)), lambda x: {STRIP.format('x')} <> '')"
    run = STRIP.format("array_to_string(w[st[k]:coalesce(st[k + 1], len(w) + 1) - 1], chr(10) || chr(10))")
    return f"""WITH z AS (SELECT s, {sections} AS z FROM {TALK}), a AS (SELECT s, unnest(z) AS p, unnest(range(0, len(z))) AS n, len(z) AS m FROM z), b AS (SELECT *, {paras} AS w FROM a), c AS (SELECT *, {packed('w', most)} AS st FROM b),
    d AS (SELECT s, n, CASE WHEN m > 1 AND {tokens('p')} <= {most} THEN [{STRIP.format('p')}] ELSE list_transform(range(1, len(st) + 1), lambda k: {run}) END AS x FROM c), e AS (SELECT s, n, unnest(x) AS x, unnest(range(0, len(x))) AS k FROM d)
    SELECT s AS source_file, row_number() OVER (PARTITION BY s ORDER BY n, k) - 1 AS chunk_index, md5(x) AS text_md5 FROM e WHERE x <> ''"""
