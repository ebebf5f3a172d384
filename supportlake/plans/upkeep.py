"""Queries for index upkeep (K*, T*, S14), chunk forms (C9, C10, H4, H11), retrieval parts (R10, R13, R14, R18, L3), memory (M4-M12), orders and tickets (B*) and streams run over tables (W*)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from supportlake.functions import text as tx
from supportlake.operators import chunk as ck
from supportlake.operators import clean as cl
from supportlake.operators import index as ix
from supportlake.operators import oplog as ol
from supportlake.operators import orders as od
from supportlake.operators import retrieve as rt
from supportlake.operators import sessions as se
from supportlake.plans.derived import CHUNKS, INDEXED, LOG, chunks, indexed, log, messages, table, vectors
from supportlake.plans.retrieval import ARMS_SQL, DOT, _arms, _bm25
from supportlake.plans.service import M06_SQL, MSG, N02_SQL, TURNS, _since_epoch, _turns, m06_entities
from supportlake.sources import files
from supportlake.streaming import jobs


def k04_chunks_of(spark, sf_dir):
    """K4: the chunks of one source in order."""
    return ix.chunks_of(indexed(spark, sf_dir), "src0").select("chunk_id", "chunk_index")


def k06_migration(spark, sf_dir):
    """K6: a level column added where it is missing, filled where it is null."""
    c = chunks(spark, sf_dir).withColumn("access_level", F.when(F.col("access_level") > 0, F.col("access_level")))
    done = [ix.migration_report(df, ix.ensure_column(df, "access_level", 0), "access_level") for df in (c, c.drop("access_level"))]
    return done[0].union(done[1])


K06_SQL = f"""SELECT 'access_level' AS field, 'already_exists' AS status, count(*) FILTER (access_level = 0) AS filled, count(*) AS n_rows FROM {CHUNKS} UNION ALL SELECT 'access_level', 'migrated', count(*), count(*) FROM {CHUNKS}"""


def k07_stamp(spark, sf_dir):
    """K7: document-level values win where they are not null."""
    c = chunks(spark, sf_dir).select("chunk_id", "source_file", "doc_type", "access_level")
    meta = c.groupBy("source_file").agg(F.max("chunk_id").alias("m")).select("source_file", F.when(F.pmod("m", F.lit(2)) == 0, "manual").alias("doc_type"), F.pmod("m", F.lit(5)).alias("version"))
    return ix.stamp(c, meta, "2024-05-01 00:00:00", "given", 64).select("chunk_id", "doc_type", "version", "access_level", "model", "dim", F.col("ingested_at").cast("string").alias("at"))


K07_SQL = f"""WITH c AS {CHUNKS}, m AS (SELECT source_file, max(chunk_id) AS m FROM c GROUP BY source_file)
SELECT chunk_id, CASE WHEN m % 2 = 0 THEN 'manual' ELSE doc_type END AS doc_type, m % 5 AS version, access_level, 'given' AS model, 64 AS dim, '2024-05-01 00:00:00' AS at FROM c JOIN m USING (source_file)"""


def k10_drift(spark, sf_dir):
    """Settings of one half of the sources that the other half lacks."""
    c = chunks(spark, sf_dir).withColumn("strategy", F.col("doc_type")).withColumn("target_size", F.pmod(F.length("text"), F.lit(97)))
    new = F.substring("source_file", -1, 1).isin("0", "2", "4", "6", "8")
    return ix.chunking_drift(c.filter(~new), c.filter(new))


K10_SQL = f"""WITH c AS (SELECT doc_type AS strategy, length(text) % 97 AS target_size, right(source_file, 1) IN ('0', '2', '4', '6', '8') AS fresh FROM {CHUNKS})
SELECT DISTINCT strategy, target_size FROM c WHERE fresh EXCEPT SELECT strategy, target_size FROM c WHERE NOT fresh"""


def k13_stale_results(spark, sf_dir):
    a = _bm25(spark, sf_dir, 10)  # the first arm alone
    c = chunks(spark, sf_dir).select("chunk_id", "source_file", "doc_type")
    return ix.stale_results(a.join(c, "chunk_id"), c.filter("doc_type = 'fr'")).select("query_id", "chunk_id")


K13_SQL = f"""{ARMS_SQL}, c AS {CHUNKS} SELECT query_id, chunk_id FROM a JOIN c USING (chunk_id) WHERE source_file IN (SELECT source_file FROM c WHERE doc_type = 'fr')"""


def k14_source_digest(spark, sf_dir):
    """Sources of any size: equal digests for the table and for the same rows dealt anew."""
    c = chunks(spark, sf_dir)
    both = ix.source_digest(c).withColumnRenamed("xor", "x").join(ix.source_digest(c.repartition(7)).select("source_file", "xor", F.col("total").alias("t")), "source_file")
    return both.select("source_file", "n_chunks", ((F.col("x") == F.col("xor")) & (F.col("t") == F.col("total"))).alias("same"))


def t01_files(spark, sf_dir):
    """Page sources as files: size limits, leading bytes and a warning where they differ from the type."""
    p = table(spark, sf_dir, "pages")
    head = F.when(F.pmod("page_id", F.lit(5)) == 0, F.unhex(F.lit("255044462D312E37"))).when(F.pmod("page_id", F.lit(5)) == 1, F.unhex(F.lit("504B0304"))).otherwise(F.col("html").cast("binary"))
    kind = F.element_at(F.array(*map(F.lit, ("pdf", "word", "image"))), F.pmod("page_id", F.lit(3)).cast("int") + 1)
    size = F.when(F.pmod("page_id", F.lit(11)) == 0, 0).when(F.pmod("page_id", F.lit(13)) == 0, None).otherwise(F.length("html") * 1000).cast("long")
    f = p.select("page_id", head.alias("content"), kind.alias("doc_type"), size.alias("length"))
    return ix.validate_files(f, {"pdf": 1, "word": 2}, 3).select("page_id", "reason", "valid", ix.sniff_type(F.col("content")).alias("sniffed"), ix.type_warning(F.col("content"), F.col("doc_type")).alias("warning"))


T01_SQL = """WITH f AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'zip' END AS sniffed, ['pdf', 'word', 'image'][page_id % 3 + 1] AS kind, CASE WHEN page_id % 11 = 0 THEN 0 WHEN page_id % 13 = 0 THEN NULL ELSE length(html) * 1000 END AS n FROM pages),
r AS (SELECT *, CASE WHEN n IS NULL THEN 'missing' WHEN n = 0 THEN 'empty' WHEN n > 1048576 * CASE kind WHEN 'pdf' THEN 1 WHEN 'word' THEN 2 ELSE 3 END THEN 'too large' END AS reason FROM f)
SELECT page_id, reason, reason IS NULL AS valid, sniffed, CASE WHEN (kind = 'pdf' AND sniffed <> 'pdf') OR (kind = 'word' AND sniffed <> 'zip') OR (kind = 'image') THEN 'content is ' || sniffed || ', not ' || kind END AS warning FROM r"""


def s14_load_report(spark, sf_dir):
    """Pages as a load: status by their text, paragraphs, cost and errors."""
    p = ix.page_stats(table(spark, sf_dir, "pages"))
    status = F.when(F.col("text_length") == 0, "failed").when(F.col("text_length") < 200, "partial").otherwise("success")
    parsed = p.select(status.alias("status"), F.size(F.split(tx.empty(F.col("html")), "\n")).alias("n_paragraphs"), (F.col("image_count") * 0.005).alias("api_cost"), F.when(F.col("text_length") < 200, F.array(F.concat(F.lit("short: "), "url"))).alias("errors"))
    return files.load_report(parsed).withColumn("errors", F.md5(F.array_join("errors", ",")))


S14_SQL = r"""WITH s AS (SELECT url, html, length(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script\b.*?</script>', '', 'g'), '(?is)<style\b.*?</style>', '', 'g'), '(?s)<[^>]*>', '', 'g'), '\s+', '', 'g')) AS t, len(regexp_extract_all(coalesce(html, ''), '(?i)<img')) AS i FROM pages)
SELECT count(*) FILTER (t >= 200) AS success, count(*) FILTER (t > 0 AND t < 200) AS partial, count(*) FILTER (t = 0) AS failed, 0 AS skipped, CAST(sum(len(string_split(coalesce(html, ''), chr(10)))) AS BIGINT) AS n_paragraphs, round(sum(i * 0.005), 4) AS api_cost,
 md5(coalesce(string_agg('short: ' || url, ',' ORDER BY 'short: ' || url) FILTER (t < 200), '')) AS errors FROM s"""


def h04_strategies(spark, sf_dir):
    """Strategies, headings and images of documents whose lines are given marks by their number."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))
    mark = F.element_at(F.array(*map(F.lit, ("Q1: ", "# ", "", "问：", "![a](data:image/png;base64,QUJD) ", "## Q2: "))), F.pmod("doc_id", F.lit(6)).cast("int") + 1)
    t = F.concat(mark, F.replace("text", F.lit("\n"), F.concat(F.lit("\n"), mark)))
    kind = F.when(F.col("lang") == "en", "pdf").when(F.col("lang") == "fr", "web").when(F.col("lang") == "de", "ppt")
    d = d.withColumn("t", F.when(F.col("text") == "", "").otherwise(t))
    return d.select("doc_id", ck.choose_strategy(F.col("t"), kind).alias("strategy"), F.size(tx.headings(F.col("t"))).alias("headings"), F.md5(F.coalesce(tx.section_title(F.col("t")), F.lit(""))).alias("title_md5"), F.md5(tx.strip_inline_images(F.col("t"))).alias("text_md5"))


H04_SQL = r"""WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS x, ['Q1: ', '# ', '', '问：', '![a](data:image/png;base64,QUJD) ', '## Q2: '][doc_id % 6 + 1] AS m FROM documents), t AS (SELECT doc_id, lang, CASE WHEN x = '' THEN '' ELSE m || replace(x, chr(10), chr(10) || m) END AS t FROM d),
n AS (SELECT *, len(regexp_extract_all(t, '(?m)^#{2,6}\s*Q\d*[：:.]\s*\S')) + len(regexp_extract_all(t, '(?m)^Q\d+[、.．\s：:]\s*\S')) + len(regexp_extract_all(t, '(?m)^问[：:]\s*\S')) + len(regexp_extract_all(t, '(?m)^\*\*Q\d*[：:.]')) AS q, regexp_extract_all(t, '(?m)^#{1,6}\s+(.+)$', 1) AS h FROM t)
SELECT doc_id, CASE WHEN q >= 2 THEN 'faq' WHEN regexp_matches(t, '(?m)^#{1,6}\s+\S') THEN 'markdown' WHEN lang = 'en' THEN 'markdown' WHEN lang IN ('fr', 'de') THEN 'semantic' ELSE 'recursive' END AS strategy, len(h) AS headings,
 md5(coalesce(h[1], '')) AS title_md5, md5(regexp_replace(t, '!\[[^\]]*\]\(data:image/[^;)]+;base64,[A-Za-z0-9+/=]+\)', '![图片]', 'g')) AS text_md5 FROM n"""


def c10_merged_hits(spark, sf_dir):
    """Texts of both rankings, whole texts compared."""
    a, b = _arms(spark, sf_dir)
    t = chunks(spark, sf_dir).select("chunk_id", "text")
    side = lambda x: x.join(t, "chunk_id").select("query_id", F.col("rank").alias("pos"), "text")
    return cl.merge_docs(side(a), side(b), None).select("query_id", "part", "pos")


C10_SQL = f"""{ARMS_SQL}, u AS (SELECT query_id, 0 AS part, rank AS pos, text FROM a JOIN documents ON doc_id = chunk_id UNION ALL SELECT query_id, 1, rank, text FROM b JOIN documents ON doc_id = chunk_id)
SELECT query_id, part, pos FROM (SELECT *, row_number() OVER (PARTITION BY query_id, text ORDER BY part, pos) AS rn FROM u) WHERE rn = 1"""


def l03_cosine(spark, sf_dir):
    """L3: each vector with the next one."""
    v = vectors(spark, sf_dir)
    n = v.select((F.col("chunk_id") - 1).alias("chunk_id"), F.col("vector").alias("other"))
    return v.join(n, "chunk_id").select("chunk_id", F.round(tx.cosine(F.col("vector"), F.col("other")), 6).alias("cosine"))


L03_SQL = f"""SELECT a.vec_id AS chunk_id, round({DOT.format(a="a.embedding", b="b.embedding")} / sqrt({DOT.format(a="a.embedding", b="a.embedding")} * {DOT.format(a="b.embedding", b="b.embedding")}), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"""

GROUPS = {"ther": ("ough", "tion"), "und": ("ung",)}


def r10_expanded(spark, sf_dir):
    """Questions with the absent members of synonym groups of the data's syllables; two strong markers make them complex or not."""
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    marked = F.when(F.pmod("query_id", F.lit(4)) == 0, F.concat("query", F.lit("对比"))).when(F.pmod("query_id", F.lit(4)) == 1, F.concat("query", F.lit("和"))).when(F.pmod("query_id", F.lit(4)) == 2, F.concat("query", F.lit("和与"))).otherwise(F.col("query"))
    return rt.expand_synonyms(q, GROUPS).select("query_id", F.md5("expanded").alias("expanded_md5"), rt.is_complex(marked).alias("complex"))


R10_SQL = """WITH q AS (SELECT item_id AS query_id, text AS q, list_filter(['ther', 'ough', 'tion'], lambda w: NOT contains(text, w)) AS a, ['ther', 'ough', 'tion'] AS ga, list_filter(['und', 'ung'], lambda w: NOT contains(text, w)) AS b FROM benchmark)
SELECT query_id, md5(array_to_string(list_concat([q], CASE WHEN len(a) < 3 THEN a ELSE [] END, CASE WHEN len(b) < 2 THEN b ELSE [] END), ' ')) AS expanded_md5, query_id % 4 IN (0, 2) AS complex FROM q"""


def r14_weighted_batch(spark, sf_dir):
    """Dense and sparse arms of questions with a vector of the same number, weighted."""
    v = vectors(spark, sf_dir)
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")).join(v.select(F.col("chunk_id").alias("query_id"), F.col("vector").alias("qvec")), "query_id")
    return rt.search(q, chunks(spark, sf_dir), v, 2, None, 5, "weighted", 10, 0.2).select("query_id", "rank", "chunk_id", F.round("score", 4).alias("score"))


def _r14_sql() -> str:
    from supportlake.plans.retrieval import bm25_sql

    return f"""WITH s AS (SELECT * FROM ({bm25_sql(10)}) WHERE query_id IN (SELECT vec_id FROM embeddings)), d AS (SELECT query_id, chunk_id, round(raw, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 6) DESC, chunk_id) AS rank FROM (
     SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, {DOT.format(a="q.embedding", b="v.embedding")} AS raw FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id, embeddings v SEMI JOIN documents c ON c.doc_id = v.vec_id)) WHERE rank <= 10 AND raw >= 0.2),
    x AS (SELECT query_id, chunk_id, score / max(score) OVER (PARTITION BY query_id) AS s FROM s), y AS (SELECT query_id, chunk_id, score / max(score) OVER (PARTITION BY query_id) AS d FROM d),
    z AS (SELECT query_id, chunk_id, round(0.3 * coalesce(s, 0) + 0.7 * coalesce(d, 0), 6) AS score FROM x FULL JOIN y USING (query_id, chunk_id))
    SELECT query_id, rank, chunk_id, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM z) WHERE rank <= 5"""


def r18_external(spark, sf_dir):
    """Pages as outside results of their host, the first five."""
    p = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("query_id"), F.col("page_id").alias("position"), F.col("url").alias("title"), F.lit("s").alias("snippet"))
    return rt.external_hits(p, 5).select("query_id", "rank", "chunk_id", "score", F.md5("text").alias("text_md5"))


R18_SQL = """SELECT query_id, rank, 'web_' || page_id AS chunk_id, 0.5 AS score, md5(url || chr(10) || 's') AS text_md5 FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY page_id) AS rank FROM (SELECT *, regexp_extract(url, '^https?://([^/?#]+)', 1) AS query_id FROM pages)) WHERE rank <= 5"""


def m04_sessions(spark, sf_dir):
    """M4, M5: users' events as messages: sessions keyed by user and kind, newest first; later messages raise last_active, replaced and deleted ones go."""
    e = table(spark, sf_dir, "events").select(se.session_key(F.col("user_id"), F.col("event_type")).alias("session_id"), "ts", "event_id")
    late = F.pmod("event_id", F.lit(10)) == 0
    s = se.append_messages(se.sessions(e.filter(~late)), e.filter(late))
    fresh = e.filter("event_id % 1000 = 1").groupBy("session_id").agg(F.min("ts").alias("last_active")).withColumn("n_messages", F.lit(0).cast("long"))
    s = se.upsert_sessions(s, fresh)
    gone = e.filter("event_id % 1000 = 2")
    return se.delete_sessions(s, gone).select("session_id", _since_epoch("MICROSECOND", "last_active").alias("last_active"), "n_messages")


M04_SQL = """WITH e AS (SELECT user_id || ':' || event_type AS session_id, ts, event_id FROM events), s AS (SELECT session_id, max(ts) AS last_active, count(*) AS n_messages FROM e WHERE event_id % 10 <> 0 GROUP BY session_id),
a AS (SELECT session_id, greatest(last_active, coalesce(t, last_active)) AS last_active, n_messages FROM s LEFT JOIN (SELECT session_id, max(ts) AS t FROM e WHERE event_id % 10 = 0 GROUP BY session_id) USING (session_id)),
f AS (SELECT session_id, min(ts) AS last_active, 0 AS n_messages FROM e WHERE event_id % 1000 = 1 GROUP BY session_id), u AS (SELECT * FROM a WHERE session_id NOT IN (SELECT session_id FROM f) UNION ALL SELECT * FROM f)
SELECT session_id, epoch_us(last_active) AS last_active, n_messages FROM u WHERE session_id NOT IN (SELECT session_id FROM e WHERE event_id % 1000 = 2)"""


def m08_relevant(spark, sf_dir):
    """M8: ledger entries that a session's last user turn names."""
    t = _turns(spark, sf_dir)
    word = F.when(F.pmod("session_id", F.lit(3)) == 0, " 金额").when(F.pmod("session_id", F.lit(3)) == 1, " 订单").otherwise("")
    q = t.groupBy("session_id").agg(F.max_by("user_text", "turn").alias("query")).withColumn("query", F.concat("query", word)).withColumn("query_id", F.col("session_id"))
    return se.relevant_entities(q, m06_entities(spark, sf_dir), 5).select("query_id", "rank", "type", "value")


M08_SQL = f"""WITH l AS ({M06_SQL}), q AS (SELECT session_id, arg_max(user_text, turn) || CASE session_id % 3 WHEN 0 THEN ' 金额' WHEN 1 THEN ' 订单' ELSE '' END AS query, CASE session_id % 3 WHEN 0 THEN 'amount' WHEN 1 THEN 'order' END AS asked FROM {TURNS} GROUP BY session_id),
h AS (SELECT session_id AS query_id, type, value, row_number() OVER (PARTITION BY session_id ORDER BY first_msg, type, value) AS rank FROM q JOIN l USING (session_id) WHERE (length(value) > 0 AND contains(query, value)) OR type = asked)
SELECT query_id, rank, type, value FROM h WHERE rank <= 5"""


def m12_context(spark, sf_dir):
    """Context of each session from its ledger, its summary and its last two turns of those retained."""
    t = se.retain(_turns(spark, sf_dir), 60)
    facts = m06_entities(spark, sf_dir).groupBy("session_id").agg(F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("- "), "type", F.lit(": "), "value"))), "\n").alias("entities"))
    parts = se.recent_text(t, 2).join(se.rolling_summary(t, 2), "session_id", "left").join(facts, "session_id", "left").select(F.col("session_id").alias("query_id"), "entities", F.lit("").alias("history"), "summary", "recent")
    return se.build_context(parts, 300).select("query_id", F.md5("context").alias("context_md5"))


M12_SQL = f"""WITH t AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS rn FROM {TURNS}),
r AS (SELECT session_id, string_agg(concat_ws(chr(10), CASE WHEN length(coalesce(user_text, '')) > 0 THEN '用户: ' || substring(user_text, 1, 120) END, CASE WHEN length(coalesce(assistant_text, '')) > 0 THEN '客服: ' || substring(assistant_text, 1, 200) END), chr(10) ORDER BY turn) AS recent FROM t WHERE rn <= 2 GROUP BY session_id),
s AS (SELECT session_id, string_agg('[' || substring(coalesce(user_text, ''), 1, 40) || ']', chr(10) ORDER BY turn) AS summary FROM t WHERE rn > 2 AND rn <= 60 GROUP BY session_id),
e AS (SELECT session_id, string_agg('- ' || type || ': ' || value, chr(10) ORDER BY '- ' || type || ': ' || value) AS entities FROM ({M06_SQL}) GROUP BY session_id),
c AS (SELECT session_id, concat_ws(chr(10) || chr(10), CASE WHEN length(entities) > 0 THEN '【相关实体】' || chr(10) || entities END, CASE WHEN length(summary) > 0 THEN '【旧对话摘要】' || summary END, CASE WHEN length(recent) > 0 THEN '【最近对话】' || chr(10) || recent END) AS c FROM r LEFT JOIN s USING (session_id) LEFT JOIN e USING (session_id))
SELECT session_id AS query_id, md5(CASE WHEN length(c) <= 600 THEN c ELSE substring(c, 1, 600) || chr(10) || '[上下文过长，已截断]' END) AS context_md5 FROM c"""


def b02_tracking(spark, sf_dir):
    """B2: line items as parcels with events in both notations or none; owners and admins see them."""
    li = table(spark, sf_dir, "lineitem").filter("l_linenumber = 1").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("d"))
    key, day = F.col("l_orderkey").cast("string"), F.date_format("d", "yyyy-MM-dd")
    forms = [F.concat(F.lit('[{"time":"'), day, F.lit('","desc":"out"},{"time":"x","desc":"in"}]')), F.concat(F.lit('[["'), day, F.lit('","out"]]')), F.lit("broken")]
    t = li.select(F.concat(F.lit("T"), key).alias("tracking_number"), F.col("l_orderkey").alias("order_no"), F.element_at(F.array(*forms), F.pmod("l_orderkey", F.lit(3)).cast("int") + 1).alias("events_json"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_no"), F.col("o_custkey").alias("user_id"))
    asked = o.select(F.col("order_no").alias("request_id"), F.concat(F.lit("T"), F.col("order_no").cast("string")).alias("tracking_number"), (F.col("user_id") + F.pmod("order_no", F.lit(2))).alias("user_id"), (F.pmod("order_no", F.lit(10)) == 1).alias("is_admin"))
    return od.tracking_lookup(asked, t, o).select("request_id", F.size("events").alias("n_events"), F.coalesce(F.get("events", 0)["desc"], F.lit("")).alias("first"))


B02_SQL = """WITH l AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_linenumber = 1) SELECT o_orderkey AS request_id, [2, 1, 0][o_orderkey % 3 + 1] AS n_events, ['out', 'out', ''][o_orderkey % 3 + 1] AS first
FROM orders JOIN l ON l_orderkey = o_orderkey WHERE o_orderkey % 2 = 0 OR o_orderkey % 10 = 1"""


def _tickets(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    priority = F.when(F.col("o_orderpriority").startswith("1"), "high").when(F.col("o_orderpriority").startswith("2"), "medium").otherwise("low")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("session_id"), priority.alias("priority"), F.when(F.col("o_orderstatus") == "O", "pending").otherwise("resolved").alias("status"), F.col("o_orderdate").alias("created_at"), F.lit("").alias("resolution"), F.lit(None).cast("timestamp").alias("resolved_at"))


def b05_resolved_queue(spark, sf_dir):
    """The queue of pending tickets after every third one was resolved, with each ticket's place."""
    t = _tickets(spark, sf_dir)
    updates = t.filter("id % 3 = 0 and status = 'pending'").select("id", F.lit("done").alias("resolution"), F.to_timestamp(F.lit("2024-01-01")).alias("resolved_at"))
    after = od.resolve(t, updates)
    counts = after.groupBy("status", "resolution").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("session_id").orderBy(F.when(F.col("priority") == "high", 0).when(F.col("priority") == "medium", 1).otherwise(2), F.desc("created_at"), "id"))
    queue = od.ticket_queue(after).withColumn("place", place).select(F.lit("queue").alias("part"), F.col("id").cast("string").alias("name"), F.col("place").cast("long").alias("n"))
    return queue.union(counts.select(F.lit("count"), F.concat_ws("/", "status", "resolution"), "n"))


B05_SQL = """WITH t AS (SELECT o_orderkey AS id, o_custkey AS s, CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 0 WHEN '2' THEN 1 ELSE 2 END AS p, o_orderdate AS d, o_orderstatus = 'O' AND o_orderkey % 3 <> 0 AS pending, o_orderstatus = 'O' AND o_orderkey % 3 = 0 AS done FROM orders)
SELECT 'queue' AS part, CAST(id AS VARCHAR) AS name, row_number() OVER (PARTITION BY s ORDER BY p, d DESC, id) AS n FROM t WHERE pending UNION ALL
SELECT 'count', CASE WHEN pending THEN 'pending/' WHEN done THEN 'resolved/done' ELSE 'resolved/' END, count(*) FROM t GROUP BY 2"""


def b06_threads(spark, sf_dir):
    """Messages of each session after the third id."""
    m = messages(spark, sf_dir).withColumnRenamed("msg_id", "id")
    return od.thread(m, 3).select("session_id", "id", "place")


def w01_stream_days(spark, sf_dir):
    """The stream's daily statistics and alerts, run over the table."""
    rows = ol.with_cost(log(spark, sf_dir))
    d = jobs.stream_daily_stats(rows).withColumn("day", F.col("day").cast("date").cast("string"))
    a = jobs.stream_alerts(rows, {"hallucination_rate": 0.05, "cost": 10.0}).groupBy(F.col("day").cast("date").cast("string").alias("day")).agg(F.count("*").alias("alerts"))
    return d.join(a, "day", "left").select("day", "n_queries", "avg_ms", "cost", "hallucination_rate", "cache_hit_rate", "total_tokens", F.coalesce("alerts", F.lit(0)).alias("alerts"))


W01_SQL = f"""SELECT day, n_queries, avg_ms, cost, hallucination_rate, cache_hit_rate, total_tokens, CAST(hallucination_rate > 0.05 AS INT) + CAST(cost > 10 AS INT) AS alerts FROM ({N02_SQL})"""

QUERIES = {
    f.__name__: f
    for f in (
        k04_chunks_of, k06_migration, k07_stamp, k10_drift, k13_stale_results, k14_source_digest, t01_files, s14_load_report, h04_strategies, c10_merged_hits, l03_cosine, r10_expanded, r14_weighted_batch, r18_external,
        m04_sessions, m08_relevant, m12_context, b02_tracking, b05_resolved_queue, b06_threads, w01_stream_days,
    )
}
ORACLES = {
    "k04_chunks_of": f"SELECT chunk_id, chunk_index FROM {INDEXED} WHERE source_file = 'src0'", "k06_migration": K06_SQL, "k07_stamp": K07_SQL, "k10_drift": K10_SQL, "k13_stale_results": K13_SQL,
    "k14_source_digest": f"SELECT source_file, count(*) AS n_chunks, true AS same FROM {CHUNKS} GROUP BY source_file", "t01_files": T01_SQL, "s14_load_report": S14_SQL, "h04_strategies": H04_SQL, "c10_merged_hits": C10_SQL,
    "l03_cosine": L03_SQL, "r10_expanded": R10_SQL, "r14_weighted_batch": _r14_sql(), "r18_external": R18_SQL, "m04_sessions": M04_SQL, "m08_relevant": M08_SQL, "m12_context": M12_SQL, "b02_tracking": B02_SQL,
    "b05_resolved_queue": B05_SQL, "b06_threads": f"SELECT session_id, msg_id AS id, row_number() OVER (PARTITION BY session_id ORDER BY msg_id) AS place FROM {MSG} WHERE msg_id > 3", "w01_stream_days": W01_SQL,
}
