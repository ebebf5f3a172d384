"""Queries for sources (S*), triage (T*), cleaning (C*), chunking (H*), the index (K*), privacy (G*) and rules (X*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from supportlake.functions import text as tx
from supportlake.operators import chunk as ck
from supportlake.operators import clean as cl
from supportlake.operators import index as ix
from supportlake.operators import rules as ru
from supportlake.operators import safety as sa
from supportlake.plans import chunk_sql
from supportlake.plans.derived import CHUNKS, chunks, table, vectors
from supportlake.sources import files, pages


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("source_file"), "text")


def s02_doc_type(spark, sf_dir):
    """Type and title of each page's address."""
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", files.doc_type(F.col("url")).alias("doc_type"), files.title(F.col("url")).alias("title"))


S02_SQL = r"""SELECT page_id, CASE lower(regexp_extract(regexp_extract(url, '([^/]*)$', 1), '\.([A-Za-z0-9]+)$', 1)) WHEN 'pdf' THEN 'pdf' WHEN 'html' THEN 'web' WHEN 'htm' THEN 'web' WHEN 'txt' THEN 'plain_text' WHEN 'json' THEN 'faq_json' WHEN 'png' THEN 'image'
 ELSE CASE WHEN url LIKE 'http%' THEN 'web' ELSE 'plain_text' END END AS doc_type,
 coalesce(nullif(regexp_extract(regexp_replace(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/+$', ''), '([^/]*)$', 1), ''), regexp_extract(url, '^https?://([^/?#]+)', 1)) AS title FROM pages"""


def s07_main_text(spark, sf_dir):
    t = pages.main_text(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.md5(t).alias("text_md5"), F.length(t).alias("n_chars"))


def _main_sql() -> str:
    c = "coalesce(html, '')"
    for tag in pages.DROPPED:
        c = rf"regexp_replace({c}, '(?is)<{tag}\b[^>]*>.*?</{tag}\s*>', '', 'g')"
    quoted = [(begin.replace("'", "''"), name) for begin, name in pages.REGIONS]
    each = lambda value: " ".join(f"WHEN {k} THEN {value(begin, name)}" for k, (begin, name) in enumerate(quoted, 1))
    first = " ".join(f"WHEN regexp_matches(c, '(?is)<{begin}>') THEN {k}" for k, (begin, _) in enumerate(quoted, 1))
    rest = each(lambda begin, _: f"regexp_extract(c, '(?is)<{begin}>(.*)', 1)")
    tags = each(lambda _, name: rf"regexp_extract_all(r, '(?is)</?{name}\b[^>]*>')")
    parts = each(lambda _, name: rf"string_split_regex(r, '(?is)</?{name}\b[^>]*>')")
    opened = "2 * len(list_filter(g[1:i], lambda y: y NOT LIKE '</%')) - i"
    t = r"regexp_replace(r, '(?s)<[^>]*>', chr(10), 'g')"
    for name, mark in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        t = f"replace({t}, '{name}', '{mark}')"
    return rf"""WITH a AS (SELECT page_id, {c} AS c FROM pages), k AS (SELECT page_id, c, CASE {first} ELSE 0 END AS k FROM a), e AS (SELECT page_id, k, CASE k {rest} ELSE c END AS r FROM k),
    g AS (SELECT page_id, CASE k {tags} ELSE [] END AS g, CASE k {parts} ELSE [r] END AS p FROM e),
    b AS (SELECT page_id, array_to_string(p[1:coalesce(list_min(list_filter(range(1, len(g) + 1), lambda i: 1 + {opened} = 0)), len(p))], chr(10)) AS r FROM g),
    t AS (SELECT page_id, coalesce(array_to_string(list_filter(list_transform(string_split({t}, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) > 2), chr(10)), '') AS t FROM b)
    SELECT page_id, md5(t) AS text_md5, length(t) AS n_chars FROM t"""


def s08_table_markdown(spark, sf_dir):
    """Line items as one sheet a supplier."""
    li = table(spark, sf_dir, "lineitem").withColumn("_key", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"))
    out = pages.table_markdown(li, "l_suppkey", "_key", ["l_orderkey", "l_linenumber", "l_partkey"], None)
    return out.select("l_suppkey", F.md5("markdown").alias("markdown_md5"), "truncated")


S08_SQL = """WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS rn, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem)
SELECT l_suppkey, md5('| l_orderkey | l_linenumber | l_partkey |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || l_orderkey || ' | ' || l_linenumber || ' | ' || l_partkey || ' |', chr(10) ORDER BY rn)) AS markdown_md5, false AS truncated
FROM r GROUP BY l_suppkey"""


def t03_page_triage(spark, sf_dir):
    """Quality, route and cost of pages, a file being a host."""
    p = ix.page_stats(table(spark, sf_dir, "pages")).withColumn("file", F.regexp_extract("url", r"^https?://([^/?#]+)", 1)).withColumn("page", F.col("page_id"))
    routed = ix.page_route(p.select("page_id", "file", "page", "text_length", "image_count"), largest=30)
    size = F.col("text_length"), F.col("image_count")
    return routed.select("page_id", ix.page_triage(*size).alias("quality"), ix.page_issue(*size).alias("issue"), "route", "over_limit", "file_cost")


T03_SQL = r"""WITH s AS (SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS f, length(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script\b.*?</script>', '', 'g'), '(?is)<style\b.*?</style>', '', 'g'), '(?s)<[^>]*>', '', 'g'), '\s+', '', 'g')) AS t,
 len(regexp_extract_all(coalesce(html, ''), '(?i)<img')) AS i FROM pages), r AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY page_id) AS rn FROM s)
SELECT page_id, CASE WHEN t < 50 AND i >= 1 THEN 'fair' WHEN t < 20 AND i = 0 THEN 'poor' ELSE 'good' END AS quality,
 CASE WHEN t < 50 AND i >= 1 THEN 'scanned' WHEN t = 0 AND i = 0 THEN 'blank' WHEN t < 20 AND i = 0 THEN 'little text' END AS issue, CASE WHEN rn > 50 THEN NULL WHEN t >= 50 AND i = 0 THEN 'text' ELSE 'ocr' END AS route, rn > 50 AS over_limit,
 round(sum(CASE WHEN rn > 50 OR (t >= 50 AND i = 0) THEN 0.0 ELSE 0.005 END) OVER (PARTITION BY f), 4) AS file_cost FROM r"""


def c01_paragraphs(spark, sf_dir):
    """Lines of the documents, which hold no blank lines, are joined to one paragraph each."""
    out = cl.split_paragraphs(_docs(spark, sf_dir))
    return out.select("source_file", "para_index", F.md5(tx.normalise_space(F.col("text"))).alias("text_md5"))


def c06_dedup_lines(spark, sf_dir):
    """Lines as paragraphs: short and noise lines out, lines of a document that are alike but for Markdown marks once."""
    return cl.clean_lines(_docs(spark, sf_dir), chars=None).select("source_file", "para_index", "chunk_id")


C06_SQL = r"""WITH l AS (SELECT CAST(doc_id AS VARCHAR) AS s, unnest(string_split(coalesce(text, ''), chr(10))) AS t, unnest(range(0, len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents),
g AS (SELECT *, regexp_replace(t, '[#*`\[\]()|_\-]', '', 'g') AS k FROM l WHERE length(t) >= 10 AND length(regexp_replace(t, '[^\p{L}\p{N}\p{M}_]', '', 'g')) >= 3)
SELECT s AS source_file, i AS para_index, substring(md5(s || '#p' || i), 1, 12) AS chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY s, k ORDER BY i) AS rn FROM g) WHERE rn = 1"""


def c08_clean(spark, sf_dir):
    """The whole cleaning of all documents."""
    return cl.clean(_docs(spark, sf_dir)).select("source_file", "para_index", "chunk_id", "char_count", F.array_join("removed_noise", ",").alias("removed"))


def h01_token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.est_tokens(F.col("text")).alias("tokens"), ck.choose_strategy(F.col("text"), F.lit("pdf")).alias("strategy"))


H01_SQL = r"""SELECT doc_id, CAST(floor(length(regexp_replace(coalesce(text, ''), '[^一-鿿]', '', 'g')) / 1.5 + length(regexp_replace(coalesce(text, ''), '[一-鿿]', '', 'g')) / 3.5) AS INTEGER) AS tokens, 'markdown' AS strategy FROM documents"""


def _talks(spark, sf_dir):
    """Conversations as one text each: a user's turn is a question, a paragraph begins after each full stop."""
    said = F.regexp_replace(tx.empty(F.col("text")), r"\.\s+", ".\n\n")
    line = F.concat(F.when(F.col("role") == "user", F.concat(F.lit("## Q"), F.col("turn").cast("string"), F.lit(": "))).otherwise(""), said)
    place = [x for c in ("turn", "role") for x in (F.col(c).isNull().alias(f"no_{c}"), F.col(c))]  # nulls last, as in the SQL
    ordered = F.sort_array(F.collect_list(F.struct(*place, tx.empty(F.col("text")).alias("text"), line.alias("x"))))
    return table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").cast("string").alias("source_file")).agg(F.array_join(F.transform(ordered, lambda r: r["x"]), "\n").alias("text"))


FAQ_SIZES, SECTION_SIZE = (24, 40), 300


def h05_faq(spark, sf_dir):
    """H5, H6: question and answer pairs of conversations, long ones by paragraphs that repeat the question."""
    return ck.split_faq(_talks(spark, sf_dir), *FAQ_SIZES).select("source_file", "chunk_index", F.md5("content").alias("text_md5"))


def h07_markdown(spark, sf_dir):
    """H7: the same texts by headings, long sections by paragraphs."""
    return ck.split_markdown(_talks(spark, sf_dir), SECTION_SIZE, SECTION_SIZE).select("source_file", "chunk_index", F.md5("content").alias("text_md5"))


def h08_recursive(spark, sf_dir):
    out = ck.number_chunks(ck.split_recursive(_docs(spark, sf_dir), 512, 1024))
    return out.select("source_file", "chunk_index", "chunk_id", "char_count", "token_count", "chunk_total")


def h09_sentences(spark, sf_dir):
    out = ck.with_overlap(ck.split_sentences(_docs(spark, sf_dir), 1024, overlap=80))
    return out.select("source_file", "chunk_index", F.md5("text").alias("text_md5"), F.length("overlap_text").alias("overlap"))


def h12_chunk_summary(spark, sf_dir):
    """H12 over documents taken as chunks of their source."""
    return ck.chunk_summary(table(spark, sf_dir, "documents").select(F.col("source").alias("source_file"), F.col("text").alias("content")))


H12_SQL = r"""WITH t AS (SELECT source, length(text) AS n, floor(length(regexp_replace(coalesce(text, ''), '[^一-鿿]', '', 'g')) / 1.5 + length(regexp_replace(coalesce(text, ''), '[一-鿿]', '', 'g')) / 3.5) AS t FROM documents)
SELECT source AS source_file, count(*) AS n_chunks, CAST(sum(n) AS BIGINT) AS total_chars, CAST(sum(t) AS BIGINT) AS total_tokens, round(avg(n), 6) AS avg_size, round(stddev_pop(n), 6) AS std_size FROM t GROUP BY source"""


def h13_chunk_sweep(spark, sf_dir):
    return ck.chunk_sweep(_docs(spark, sf_dir))


def k01_index_rows(spark, sf_dir):
    """K1 with whole texts."""
    return ix.index_rows(chunks(spark, sf_dir), None).select("chunk_id", F.length("text").alias("n_chars"), "truncated", F.col("access_level").cast("int").alias("access_level"))


def k02_replace_by_source(spark, sf_dir):
    """The sources of all French documents replaced by their French rows alone."""
    c = chunks(spark, sf_dir).select("chunk_id", "source_file", "doc_type")
    return ix.replace_by_source(c, c.filter("doc_type = 'fr'")).groupBy("source_file").agg(F.count("*").alias("n"), F.sum("chunk_id").alias("ids"))


K02_SQL = f"""WITH c AS {CHUNKS}, b AS (SELECT * FROM c WHERE doc_type = 'fr')
SELECT source_file, count(*) AS n, CAST(sum(chunk_id) AS BIGINT) AS ids FROM (SELECT chunk_id, source_file FROM c WHERE source_file NOT IN (SELECT source_file FROM b) UNION ALL SELECT chunk_id, source_file FROM b) GROUP BY source_file"""


def k03_delete_sources(spark, sf_dir):
    c = chunks(spark, sf_dir)
    left, gone = ix.delete_sources(c, c.filter("doc_type = 'es'").select("source_file"))
    return gone.withColumn("left", F.lit(0).cast("long")).unionByName(left.agg(F.lit("(left)").alias("source_file"), F.lit(0).cast("long").alias("deleted"), F.count("*").alias("left")))


K03_SQL = f"""WITH c AS {CHUNKS}, g AS (SELECT DISTINCT source_file FROM c WHERE doc_type = 'es')
SELECT source_file, count(*) AS deleted, 0 AS "left" FROM c SEMI JOIN g USING (source_file) GROUP BY source_file UNION ALL SELECT '(left)', 0, (SELECT count(*) FROM c ANTI JOIN g USING (source_file))"""


def k05_index_stats(spark, sf_dir):
    return ix.index_stats(ix.drop_bad_vectors(vectors(spark, sf_dir)), model="given")


def k08_content_hash(spark, sf_dir):
    """K8: each document's cleaned lines as its chunks."""
    return ix.content_hash(cl.clean_lines(_docs(spark, sf_dir)).withColumnRenamed("para_index", "chunk_index"))


K08_SQL = r"""WITH l AS (SELECT CAST(doc_id AS VARCHAR) AS s, unnest(string_split(coalesce(text, ''), chr(10))) AS t, unnest(range(0, len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents),
g AS (SELECT *, regexp_replace(substring(t, 1, 200), '[#*`\[\]()|_\-]', '', 'g') AS k FROM l WHERE length(t) >= 10 AND length(regexp_replace(t, '[^\p{L}\p{N}\p{M}_]', '', 'g')) >= 3)
SELECT s AS source_file, substring(sha256(string_agg(t, chr(10) ORDER BY i)), 1, 16) AS content_hash FROM (SELECT *, row_number() OVER (PARTITION BY s, k ORDER BY i) AS rn FROM g) WHERE rn = 1 GROUP BY s"""


def k09_unique_source(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", ix.unique_source(tx.empty(F.col("text")).cast("binary"), F.concat("source", F.lit(".txt"))).alias("name"))


def k11_index_report(spark, sf_dir):
    """All chunks against those that a reader of rank 1 sees."""
    c = chunks(spark, sf_dir)
    return ix.index_report(c, c.filter("access_level <= 1"))


K11_SQL = f"""SELECT source_file, count(*) AS total, count(*) FILTER (access_level <= 1) AS inserted, CASE WHEN count(*) = count(*) FILTER (access_level <= 1) THEN 'ok' WHEN count(*) FILTER (access_level <= 1) > 0 THEN 'partial' ELSE 'failed' END AS status FROM {CHUNKS} GROUP BY source_file"""


def g01_redact(spark, sf_dir):
    """Address, card and e-mail patterns over all documents."""
    return table(spark, sf_dir, "documents").select("doc_id", sa.redact(F.col("text")).alias("t")).select("doc_id", F.md5("t").alias("text_md5"), F.regexp_count("t", F.lit(r"\[(?:邮箱|IP地址|银行卡|身份证|手机号|订单号|姓名)\]")).alias("n_marks"))


def _g01_sql() -> str:
    from supportlake.plans.rulesets import redacted_sql

    marks = "len(regexp_extract_all(t, '\\[(?:邮箱|IP地址|银行卡|身份证|手机号|订单号|姓名)\\]'))"
    return f"SELECT doc_id, md5(t) AS text_md5, {marks} AS n_marks FROM (SELECT doc_id, {redacted_sql('text')} AS t FROM documents)"


def _g02_sql() -> str:
    """Each rule over what the earlier ones left; bounding characters are doubled first, so that two neighbours do not share one."""
    from supportlake.plans.rulesets import BOUNDED

    inner = {"邮箱": "A-Za-z0-9._%+@-", "IP地址": "0-9.", "订单号": "A-Za-z0-9"}
    rest, found = "coalesce(text, '')", []
    for label, p in BOUNDED:
        doubled = f"regexp_replace({rest}, '([^{inner.get(label, '0-9Xx')}])', '\\1\\1', 'g')"
        found.append(f"SELECT doc_id, '{label}' AS type, unnest(regexp_extract_all({doubled}, '{p}', 2)) AS original FROM documents")
        for _ in range(2):
            rest = f"regexp_replace({rest}, '{p}', '\\1□\\3', 'g')"
    mask = "CASE WHEN length(original) <= 4 THEN '***' WHEN length(original) <= 8 THEN substring(original, 1, 2) || '***' || right(original, 1) ELSE substring(original, 1, 3) || '***' || right(original, 2) END"
    return f"SELECT doc_id, type, original, {mask} AS masked FROM ({' UNION ALL '.join(found)})"


def _c08_sql() -> str:
    """Paragraphs by where they begin, noise patterns one after the other, then the filters and the first of each fingerprint."""
    from supportlake.functions import lexicons as lex

    strip = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
    alone = lambda x: f"(starts_with({x}, '#') OR starts_with({x}, '|') OR (starts_with({x}, '**') AND ends_with({x}, '**') AND length({x}) <= 60 AND len(string_split({x}, '**')) = 3))"
    steps, last = [], "p0"
    for k, (pattern, kind) in enumerate(lex.NOISE, 1):
        p = f"(?i){pattern}"
        steps.append(f"p{k} AS (SELECT s, i, regexp_replace(t, '{p}', '', 'g') AS t, CASE WHEN regexp_matches(t, '{p}') THEN list_append(hits, '{kind}') ELSE hits END AS hits FROM p{k - 1})")
        last = f"p{k}"
    space = strip(f"regexp_replace(regexp_replace(t, '\\n{{3,}}', chr(10) || chr(10), 'g'), '[ \\t]{{2,}}', ' ', 'g')")
    return f"""WITH b AS (SELECT CAST(doc_id AS VARCHAR) AS s, unnest(list_filter(list_transform(string_split(coalesce(text, ''), chr(10) || chr(10)), lambda x: {strip("x")}), lambda x: x <> '')) AS b,
     unnest(range(0, len(list_filter(list_transform(string_split(coalesce(text, ''), chr(10) || chr(10)), lambda x: {strip("x")}), lambda x: x <> '')))) AS bi FROM documents),
    l AS (SELECT s, bi, b, list_filter(list_transform(string_split(b, chr(10)), lambda x: {strip("x")}), lambda x: x <> '') AS l FROM b),
    a AS (SELECT *, list_filter(range(1, len(l) + 1), lambda i: i = 1 OR {alone("l[i]")} OR {alone("l[i - 1]")}) AS st FROM l),
    j AS (SELECT s, bi, CASE WHEN starts_with(b, '|') AND ends_with(b, '|') THEN [b] ELSE list_transform(range(1, len(st) + 1), lambda k: array_to_string(l[st[k]:coalesce(st[k + 1], len(l) + 1) - 1], ' ')) END AS ps FROM a),
    u AS (SELECT s, bi, unnest(ps) AS t, unnest(range(0, len(ps))) AS k FROM j), p0 AS (SELECT s, row_number() OVER (PARTITION BY s ORDER BY bi, k) - 1 AS i, t, CAST([] AS VARCHAR[]) AS hits FROM u), {", ".join(steps)},
    c AS (SELECT s, i, {space} AS t, hits FROM {last}), g AS (SELECT *, regexp_replace(substring(t, 1, 200), '[#*`\\[\\]()|_\\-]', '', 'g') AS f FROM c WHERE length(t) >= 10 AND length(regexp_replace(t, '[^\\p{{L}}\\p{{N}}\\p{{M}}_]', '', 'g')) >= 3)
    SELECT s AS source_file, i AS para_index, substring(md5(s || '#p' || i), 1, 12) AS chunk_id, length(t) AS char_count, coalesce(array_to_string(hits, ','), '') AS removed
    FROM (SELECT *, row_number() OVER (PARTITION BY s, f ORDER BY i) AS rn FROM g) WHERE rn = 1"""


def _g05_sql() -> str:
    from supportlake.functions import lexicons as lex

    bad = "regexp_matches(t, '(?i)" + "|".join(f"(?:{p})" for p in lex.INPUT_ATTACKS) + "')"
    return f"SELECT conv_id, turn, {bad} AS flagged, NOT {bad} AND length(t) > 5000 AS truncated, CASE WHEN {bad} THEN 0 ELSE least(5000, length(t)) END AS n, {bad} AS told FROM (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations)"


C01_SQL = r"""SELECT CAST(doc_id AS VARCHAR) AS source_file, 0 AS para_index, md5(trim(regexp_replace(array_to_string(l, ' '), '[ 	]{2,}', ' ', 'g'))) AS text_md5
FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents) WHERE len(l) > 0"""


def g02_findings(spark, sf_dir):
    """Findings of all rules with their masks."""
    return sa.pii_findings(table(spark, sf_dir, "documents"), key="doc_id").select("doc_id", "type", "original", "masked")


def g05_input_guard(spark, sf_dir):
    """Turns of conversations that look like attacks on the prompt."""
    return sa.check_input(table(spark, sf_dir, "conversations"), "text").select("conv_id", "turn", "flagged", "truncated", F.length("safe_text").alias("n"), F.col("message").isNotNull().alias("told"))


def x05_emotion(spark, sf_dir):
    """Exclamation marks and English words as a lexicon of the data's language."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ru.emotion(d, "text", ("idiot", "stupid"), ("disgusting", "trash"), ("slow",)).select("doc_id", "emotion", "emotion_confidence")


X05_SQL = """WITH h AS (SELECT doc_id, coalesce(text, '') AS t, CAST(contains(t, 'idiot') AS INT) + CAST(contains(t, 'stupid') AS INT) AS x, CAST(contains(t, 'disgusting') AS INT) + CAST(contains(t, 'trash') AS INT) AS a, CAST(contains(t, 'slow') AS INT) AS d,
 length(t) - length(replace(replace(t, '!', ''), '！', '')) AS m FROM documents)
SELECT doc_id, CASE WHEN t = '' THEN 'calm' WHEN x > 0 THEN 'extreme' WHEN a > 0 OR m >= 2 THEN 'angry' WHEN d > 0 THEN 'dissatisfied' ELSE 'calm' END AS emotion,
 round(CASE WHEN t = '' THEN 0 WHEN x > 0 THEN least(0.95, 0.7 + 0.15 * x) WHEN a > 0 OR m >= 2 THEN least(0.85, 0.6 + 0.1 * a + 0.05 * m) WHEN d > 0 THEN least(0.7, 0.5 + 0.1 * d) ELSE 0.3 END, 4) AS emotion_confidence FROM h"""


def x01_intent(spark, sf_dir):
    """Intents of conversation turns by a rule table of the data's words."""
    rules = ((1, "return_refund", 0.6, ("the ",)), (2, "logistics", 0.6, ("que", "der ")), (3, "order_query", 0.5, ("le ",)))
    out = ru.classify_intent(table(spark, sf_dir, "conversations"), rules)
    return out.select("conv_id", "turn", "role", "intent", "confidence")


X01_SQL = """SELECT conv_id, turn, role, CASE WHEN contains(t, 'the ') THEN 'return_refund' WHEN contains(t, 'que') OR contains(t, 'der ') THEN 'logistics' WHEN contains(t, 'le ') THEN 'order_query' ELSE 'chitchat' END AS intent,
 CASE WHEN contains(t, 'the ') OR contains(t, 'que') OR contains(t, 'der ') THEN 0.6 WHEN contains(t, 'le ') THEN 0.5 ELSE 0.4 END AS confidence FROM (SELECT *, lower(coalesce(text, '')) AS t FROM conversations)"""

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}"
QUERIES = {
    f.__name__: f
    for f in (
        s02_doc_type, s07_main_text, s08_table_markdown, t03_page_triage, c01_paragraphs, c06_dedup_lines, c08_clean, h01_token_estimate, h05_faq, h07_markdown, h08_recursive, h09_sentences, h12_chunk_summary, h13_chunk_sweep, k01_index_rows,
        k02_replace_by_source, k03_delete_sources, k05_index_stats, k08_content_hash, k09_unique_source, k11_index_report, g01_redact, g02_findings, g05_input_guard, x01_intent, x05_emotion,
    )
}
ORACLES = {
    "s02_doc_type": S02_SQL, "s07_main_text": _main_sql(), "s08_table_markdown": S08_SQL, "t03_page_triage": T03_SQL, "c06_dedup_lines": C06_SQL, "h01_token_estimate": H01_SQL, "h12_chunk_summary": H12_SQL,
    "k01_index_rows": f"SELECT chunk_id, length(text) AS n_chars, false AS truncated, access_level FROM {CHUNKS}", "k02_replace_by_source": K02_SQL, "k03_delete_sources": K03_SQL,
    "c01_paragraphs": C01_SQL, "g05_input_guard": _g05_sql(), "g01_redact": _g01_sql(), "g02_findings": _g02_sql(), "h05_faq": chunk_sql.faq_sql(*FAQ_SIZES), "h07_markdown": chunk_sql.markdown_sql(SECTION_SIZE), "h08_recursive": chunk_sql.recursive_sql(), "h09_sentences": chunk_sql.sentence_sql(), "h13_chunk_sweep": chunk_sql.sweep_sql(), "c08_clean": _c08_sql(), "k05_index_stats": "SELECT count(*) > 0 AS present, count(*) AS n_rows, max(len(embedding)) AS dimension, 'given' AS model FROM embeddings", "k08_content_hash": K08_SQL,
    "k09_unique_source": "SELECT doc_id, substring(sha256(coalesce(text, '')), 1, 12) || '_' || source || '.txt' AS name FROM documents", "k11_index_report": K11_SQL, "x01_intent": X01_SQL, "x05_emotion": X05_SQL,
}
