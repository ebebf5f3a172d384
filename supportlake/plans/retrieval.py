"""Queries for retrieval (R*), lexical measures (L*) and evaluation (E*)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from supportlake.functions import text as tx
from supportlake.functions.tables import OwnTable
from supportlake.operators import evaluate as ev
from supportlake.operators import retrieve as rt
from supportlake.operators.lexindex import LexicalIndex, bm25_topk
from supportlake.plans.derived import CHUNKS, INDEXED, chunks, indexed, messages, questions, table, vector_queries, vectors

TOKENS = r"list_filter(string_split_regex(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"


def _bm25(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    """The best chunks for every question, over all chunks."""
    return bm25_topk(questions(spark, sf_dir), chunks(spark, sf_dir), k)


def bm25_sql(k: int, where: str = "true", k1: float = 1.2, b: float = 0.75) -> str:
    return f"""
    WITH c AS (SELECT chunk_id, {TOKENS.format("coalesce(text, '')")} AS w FROM {CHUNKS} WHERE {where}),
    n AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM c),
    p AS (SELECT chunk_id, len(w) AS dl, unnest(w) AS term FROM c), tf AS (SELECT term, chunk_id, dl, count(*) AS tf FROM p GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    q AS (SELECT DISTINCT item_id AS query_id, unnest({TOKENS.format("text")}) AS term FROM benchmark),
    s AS (SELECT query_id, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * ({k1} + 1) / (tf + {k1} * (1 - {b} + {b} * dl / avgdl))), 6) AS score
          FROM q JOIN tf USING (term) JOIN df USING (term), n GROUP BY query_id, chunk_id)
    SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= {k}
    """


def r02_dense_topk(spark, sf_dir):
    return rt.dense_topk(vector_queries(spark, sf_dir), vectors(spark, sf_dir), 10, 0.3)


DOT = "list_sum(list_transform(range(1, len({a}) + 1), lambda i: CAST({a}[i] AS DOUBLE) * CAST({b}[i] AS DOUBLE)))"
DENSE_SQL = f"""
SELECT query_id, chunk_id, round(raw, 4) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 6) DESC, chunk_id) AS rank
 FROM (SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, {DOT.format(a="q.embedding", b="v.embedding")} AS raw FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0))
WHERE rank <= 10 AND raw >= 0.3
"""


def r03_l2_normalise(spark, sf_dir):
    df = rt.l2_normalise(vectors(spark, sf_dir))
    return df.select("chunk_id", F.round(tx.norm(F.col("vector")), 6).alias("length"), F.round(F.get("vector", 0), 5).alias("first"))


R03_SQL = f"""SELECT vec_id AS chunk_id, round(sqrt({DOT.format(a="u", b="u")}), 6) AS length, round(u[1], 5) AS first
FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt({DOT.format(a="embedding", b="embedding")})) AS u FROM embeddings)"""


def _arms(spark, sf_dir, k: int = 10):
    """Two full rankings of all chunks for all questions, with different saturation and length constants, scored from one index."""
    index = LexicalIndex(chunks(spark, sf_dir))
    both = index.search(questions(spark, sf_dir), k, ((1.2, 0.75), (0.6, 0.3)))
    index.drop()
    return tuple(both.filter(F.col("setting") == i).drop("setting") for i in (0, 1))


FORCE = "access_level <= 1 AND effective_from <= DATE '2024-04-01' AND effective_to >= DATE '2024-04-01'"
ARMS_SQL = f"WITH a AS ({bm25_sql(10)}), b AS ({bm25_sql(10, k1=0.6, b=0.3)})"


def r04_weighted_hybrid(spark, sf_dir):
    a, b = _arms(spark, sf_dir)
    return rt.weighted_hybrid(a, b, k=5)


R04_SQL = f"""{ARMS_SQL}, x AS (SELECT query_id, chunk_id, score / max(score) OVER (PARTITION BY query_id) AS s FROM a), y AS (SELECT query_id, chunk_id, score / max(score) OVER (PARTITION BY query_id) AS d FROM b),
z AS (SELECT query_id, chunk_id, round(0.3 * coalesce(s, 0) + 0.7 * coalesce(d, 0), 6) AS score FROM x FULL JOIN y USING (query_id, chunk_id))
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM z) WHERE rank <= 5"""


def r05_rrf(spark, sf_dir):
    a, b = _arms(spark, sf_dir)
    arms = a.select("query_id", F.lit(0).alias("arm"), "rank", "chunk_id", "score").union(b.select("query_id", F.lit(1), "rank", "chunk_id", "score"))
    return rt.rrf(arms)


R05_SQL = f"""{ARMS_SQL}, u AS (SELECT query_id, 0 AS arm, rank, chunk_id, score FROM a UNION ALL SELECT query_id, 1, rank, chunk_id, score FROM b),
g AS (SELECT query_id, chunk_id, round(sum(1.0 / (60 + rank)), 10) AS rrf, arg_min(score, arm) AS score, min(arm) AS arm FROM u GROUP BY query_id, chunk_id)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, arm, chunk_id) AS rank FROM g"""


def r06_visible_by_role(spark, sf_dir):
    """Visible English chunks of each rank."""
    ranks = [rt.where_equal(rt.visible(chunks(spark, sf_dir), r), doc_type="en").agg(F.lit(r).alias("user_rank"), F.count("*").alias("n"), F.max("access_level").alias("highest")) for r in (0, 1, 2)]
    return ranks[0].union(ranks[1]).union(ranks[2])


R06_SQL = f"SELECT r AS user_rank, count(*) AS n, max(access_level) AS highest FROM {CHUNKS}, (SELECT unnest([0, 1, 2]) AS r) WHERE access_level <= r AND doc_type = 'en' GROUP BY r"


def r08_in_force(spark, sf_dir):
    return rt.in_force(chunks(spark, sf_dir), "2024-04-01").groupBy("source_file").agg(F.count("*").alias("n"))


R08_SQL = f"SELECT source_file, count(*) AS n FROM {CHUNKS} WHERE effective_from <= DATE '2024-04-01' AND effective_to >= DATE '2024-04-01' GROUP BY source_file"


def r11_merge_max(spark, sf_dir):
    a, b = _arms(spark, sf_dir)
    return rt.merge_max(a, b, 5)


R11_SQL = f"""{ARMS_SQL}, m AS (SELECT query_id, chunk_id, max(score) AS score FROM (SELECT query_id, chunk_id, score FROM a UNION ALL SELECT query_id, chunk_id, score FROM b) GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM m) WHERE rank <= 5"""


def r12_merge_first(spark, sf_dir):
    a, b = _arms(spark, sf_dir)
    return rt.merge_first(a.select("query_id", F.lit(0).alias("part"), "chunk_id", "score").union(b.select("query_id", F.lit(1), "chunk_id", "score")), 5)


R12_SQL = f"""{ARMS_SQL}, m AS (SELECT query_id, chunk_id, arg_min(score, p) AS score FROM (SELECT query_id, 0 AS p, chunk_id, score FROM a UNION ALL SELECT query_id, 1, chunk_id, score FROM b) GROUP BY query_id, chunk_id)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM m) WHERE rank <= 5"""


def r15_neighbours(spark, sf_dir):
    hits = _bm25(spark, sf_dir, 3).select("query_id", "chunk_id", "rank").join(indexed(spark, sf_dir).select("chunk_id", "source_file", "chunk_index"), "chunk_id")
    out = rt.with_neighbours(hits, indexed(spark, sf_dir), 1)
    return out.select("query_id", "rank", "chunk_id", F.md5("context").alias("context_md5"))


R15_SQL = f"""WITH a AS ({bm25_sql(3)}), i AS {INDEXED}, h AS (SELECT a.query_id, a.rank, a.chunk_id, i.source_file, i.chunk_index FROM a JOIN i USING (chunk_id))
SELECT query_id, rank, h.chunk_id, md5(string_agg(i.text, chr(10) ORDER BY i.chunk_index)) AS context_md5 FROM h JOIN i ON i.source_file = h.source_file AND abs(i.chunk_index - h.chunk_index) <= 1 GROUP BY query_id, rank, h.chunk_id"""


def r16_rerank(spark, sf_dir):
    """The ten best by BM25, ordered anew by shared character pairs with the question."""
    q = questions(spark, sf_dir)
    hits = _bm25(spark, sf_dir, 10).join(q, "query_id").join(chunks(spark, sf_dir).select("chunk_id", "text"), "chunk_id")
    return rt.rerank(hits, F.round(tx.bigram_overlap(F.col("query"), F.col("text")), 6), 5).select("query_id", "chunk_id", "score", "original_rank", "relevance", "rank")


PAIRS = "list_distinct(list_transform(range(1, length({a})), lambda i: substring({a}, i, 2)))"
R16_SQL = f"""WITH a AS ({bm25_sql(10)}), t AS (SELECT a.*, b.text AS q, d.text AS t FROM a JOIN benchmark b ON b.item_id = a.query_id JOIN documents d ON d.doc_id = a.chunk_id),
s AS (SELECT query_id, chunk_id, score, rank AS original_rank, round(len(list_intersect({PAIRS.format(a="q")}, {PAIRS.format(a="t")})) / len({PAIRS.format(a="q")}), 6) AS relevance FROM t)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, original_rank) AS rank FROM s) WHERE rank <= 5"""


def r17_cascade(spark, sf_dir):
    """All five stages from two rankings: a third of the questions were decomposed, two rewrites and an expansion scale the second ranking, a fifth have web results."""
    a, b = _arms(spark, sf_dir, 1)  # the highest score of ten is the first's
    top = lambda df, name: df.groupBy("query_id").agg(F.max("score").alias(name))
    s = top(a, "a").join(top(b, "b"), "query_id")
    third, fifth = F.pmod("query_id", F.lit(3)) == 0, F.pmod("query_id", F.lit(5)) == 0
    stages = [("decomposed", 0, F.when(third, F.col("b") / 60), 1.0), ("original", 0, F.col("b") / 55, 1.0), ("rewritten", 0, F.col("a") / 58, 1.0), ("rewritten", 1, F.col("a") / 52, 1.0), ("expanded", 0, F.col("a") / 45, 0.9), ("web", 0, F.when(fifth, F.lit(0.5)), 1.0)]
    rows = F.array(*(F.struct(F.lit(n).alias("stage"), F.lit(i).alias("attempt"), F.round(v * part, 6).alias("first_score"), F.round(v, 6).alias("max_score")) for n, i, v, part in stages))
    return rt.cascade(s.select("query_id", F.explode(rows).alias("c")).select("query_id", "c.*").filter("max_score is not null"))


R17_SQL = f"""{ARMS_SQL}, s AS (SELECT query_id, sa, sb FROM (SELECT query_id, max(score) AS sa FROM a GROUP BY query_id) JOIN (SELECT query_id, max(score) AS sb FROM b GROUP BY query_id) USING (query_id)),
v AS (SELECT query_id, CASE WHEN query_id % 3 = 0 THEN round(sb / 60, 6) ELSE 0 END AS d, round(sb / 55, 6) AS o, round(sa / 58, 6) AS r1, round(sa / 52, 6) AS r2, round(sa / 45, 6) AS e, round(sa / 45 * 0.9, 6) AS ef, query_id % 5 = 0 AS web FROM s),
t1 AS (SELECT *, CASE WHEN r1 > o + 0.05 THEN r1 ELSE o END AS b1 FROM v), t2 AS (SELECT *, CASE WHEN r2 > b1 + 0.05 THEN r2 ELSE b1 END AS b2 FROM t1), t3 AS (SELECT *, CASE WHEN e > b2 + 0.05 THEN e ELSE b2 END AS b3 FROM t2),
w AS (SELECT *, CASE WHEN d >= 0.7 THEN 'decomposed' WHEN o >= 0.7 THEN 'original' WHEN r1 > o + 0.05 AND r1 >= 0.7 THEN 'rewritten' WHEN r2 > b1 + 0.05 AND r2 >= 0.7 THEN 'rewritten again' WHEN e > b2 + 0.05 AND ef >= 0.7 THEN 'expanded' WHEN web THEN 'web' ELSE 'none' END AS m FROM t3)
SELECT query_id, CASE m WHEN 'decomposed' THEN 1 WHEN 'original' THEN 1 WHEN 'rewritten' THEN 2 WHEN 'rewritten again' THEN 2 WHEN 'expanded' THEN 3 WHEN 'web' THEN 4 ELSE 5 END AS level, CASE m WHEN 'rewritten again' THEN 'rewritten' ELSE m END AS method,
 round(CASE m WHEN 'decomposed' THEN d WHEN 'original' THEN o WHEN 'rewritten' THEN b1 WHEN 'rewritten again' THEN b2 ELSE b3 END, 6) AS best FROM w"""


def _judged(spark, sf_dir):
    """A hit is relevant if it holds the question's passage."""
    q, c = table(spark, sf_dir, "benchmark"), chunks(spark, sf_dir).select("chunk_id", "text")
    hits = _bm25(spark, sf_dir, 10).join(c, "chunk_id").join(q.select(F.col("item_id").alias("query_id"), F.col("text").alias("truth")), "query_id")
    return ev.relevance(hits.withColumn("vec", F.lit(None).cast("array<double>")).withColumn("truth_vec", F.lit(None).cast("array<double>")))


JUDGED_SQL = f"WITH a AS ({bm25_sql(10)}), j AS (SELECT a.query_id, rank, CAST(contains(lower(d.text), lower(b.text)) AS INTEGER) AS rel FROM a JOIN benchmark b ON b.item_id = a.query_id JOIN documents d ON d.doc_id = a.chunk_id)"
METRICS_SQL = f"""{JUDGED_SQL}, m AS (SELECT query_id, CAST(max(CASE WHEN rank <= 5 THEN rel ELSE 0 END) AS DOUBLE) AS recall, round(max(rel / rank), 6) AS rr, round(coalesce(avg(CASE WHEN rank <= 5 THEN rel END), 0), 6) AS precision,
 sum(CASE WHEN rank <= 5 THEN rel / log2(rank + 1) ELSE 0 END) AS dcg, sum(CASE WHEN rank <= 5 THEN rel ELSE 0 END) AS n FROM j GROUP BY query_id),
r AS (SELECT query_id, recall, rr, precision, round(CASE WHEN n > 0 THEN dcg / list_sum(list_transform(range(1, CAST(n AS BIGINT) + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END, 6) AS ndcg FROM m)"""


def e02_ranking_metrics(spark, sf_dir):
    return ev.ranking_metrics(_judged(spark, sf_dir), 5)


def _stored(spark, sf_dir) -> DataFrame:
    """The judged hits, ten a question, written once for all that is measured on them."""
    return OwnTable(_judged(spark, sf_dir).drop("vec", "truth_vec"), "judged").df


def _cases(every: DataFrame) -> DataFrame:
    """A case a question: ranking metrics, the best hit as the answer, its length as a latency, no relevant hit as a hallucination."""
    judged = every.filter("rank = 1")
    words = F.array_distinct(F.filter(F.split(F.lower("truth"), r"\s+"), lambda x: F.length(x) >= 8))
    ms = F.length("text") / 10.0
    answers = judged.select(
        "query_id", ev.faithfulness(F.col("truth"), F.col("text")).alias("faithfulness"), ev.keyword_coverage(F.col("text"), words).alias("coverage"), ms.alias("latency_ms"),
        ev.latency_score(ms).alias("latency_score"), (~F.col("rel")).cast("int").alias("hallucination"), F.pmod("query_id", F.lit(3)).alias("rounds"),
    )
    return ev.ranking_metrics(every, 5).join(answers, "query_id")


def e10_summary(spark, sf_dir):
    return ev.summary(_cases(_stored(spark, sf_dir)))


def e11_gate(spark, sf_dir):
    """Cases without any hit count as failed; they do not decide."""
    judged = _stored(spark, sf_dir)
    failed = questions(spark, sf_dir).join(judged.select("query_id"), "query_id", "left_anti")
    return ev.gate(ev.summary(_cases(judged)), {"recall": 0.70, "rr": 0.65, "precision": 0.55}, failed)


_W = r"list_distinct(list_filter(string_split_regex(lower({}), '\s+'), lambda x: x <> ''))"
_K = r"list_distinct(list_filter(string_split_regex(lower(q), '\s+'), lambda x: length(x) >= 8))"
CASES_SQL = rf""", t AS (SELECT a.query_id, b.text AS q, d.text AS t FROM a JOIN benchmark b ON b.item_id = a.query_id JOIN documents d ON d.doc_id = a.chunk_id WHERE rank = 1),
x AS (SELECT query_id, len(list_intersect({_W.format("q")}, {_W.format("t")})) / len({_W.format("q")}) AS faithfulness, CASE WHEN len({_K}) > 0 THEN len(list_filter({_K}, lambda x: contains(lower(t), x))) / len({_K}) ELSE 1 END AS coverage,
 length(t) / 10.0 AS ms, CASE WHEN length(t) = 0 THEN 1 WHEN length(t) >= 30000 THEN 0 ELSE 1 - length(t) / 30000.0 END AS ls, CAST(NOT contains(lower(t), lower(q)) AS INTEGER) AS h, query_id % 3 AS rounds FROM t), z AS (SELECT * FROM r JOIN x USING (query_id))"""
E10 = """SELECT count(*) AS n, round(avg(recall), 4) AS recall, round(avg(rr), 4) AS rr, round(avg(precision), 4) AS precision, round(avg(ndcg), 4) AS ndcg, round(avg(faithfulness), 4) AS faithfulness, round(avg(coverage), 4) AS coverage,
 round(avg(ls), 4) AS latency_score, round(avg(h), 4) AS hallucination, round(avg(rounds), 4) AS rounds, round(avg(ms), 1) AS avg_ms, round(quantile_cont(ms, 0.5), 1) AS p50_ms, round(quantile_cont(ms, 0.95), 1) AS p95_ms, round(quantile_cont(ms, 0.99), 1) AS p99_ms FROM z"""
E11_SQL = f"""{METRICS_SQL}{CASES_SQL}, s AS ({E10}) SELECT metric, value, at_least, value >= at_least AS passed, (SELECT count(*) FROM benchmark WHERE item_id NOT IN (SELECT query_id FROM r)) AS failed_cases FROM (SELECT 'recall' AS metric, recall AS value, 0.7::DOUBLE AS at_least FROM s UNION ALL SELECT 'rr', rr, 0.65::DOUBLE FROM s UNION ALL SELECT 'precision', precision, 0.55::DOUBLE FROM s)"""


def e09_latency_percentiles(spark, sf_dir):
    return ev.latency_percentiles(table(spark, sf_dir, "events"), "value", ["event_type"])


E09_SQL = "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type"


def e07_answer_scores(spark, sf_dir):
    """An assistant's turn against the turn before it, with that turn's longest words as keywords, and a latency from the text's length."""
    w = Window.partitionBy("session_id").orderBy("msg_id")
    m = messages(spark, sf_dir).withColumn("before", F.lag("content").over(w)).filter("role = 'assistant' and before is not null")
    words = F.array_distinct(F.filter(F.split(F.lower("before"), r"\s+"), lambda x: F.length(x) >= 8))
    return m.select(
        "session_id", "msg_id", F.round(ev.faithfulness(F.col("content"), F.col("before")), 6).alias("faithfulness"), F.round(ev.keyword_coverage(F.col("content"), words), 6).alias("coverage"),
        F.round(ev.latency_score(F.length("content") * 10.0), 6).alias("latency"),
    )


LWORDS = r"list_distinct(list_filter(string_split_regex(lower({}), '\s+'), lambda x: x <> ''))"
E07_SQL = rf"""WITH m AS (SELECT conv_id AS session_id, turn AS msg_id, role, text AS c, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations),
k AS (SELECT *, list_distinct(list_filter(string_split_regex(lower(b), '\s+'), lambda x: length(x) >= 8)) AS w, {LWORDS.format("c")} AS cw, {LWORDS.format("b")} AS bw FROM m WHERE role = 'assistant' AND b IS NOT NULL)
SELECT session_id, msg_id, round(CASE WHEN len(cw) > 0 THEN len(list_intersect(cw, bw)) / len(cw) ELSE 0 END, 6) AS faithfulness,
 round(CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x: contains(lower(c), x))) / len(w) ELSE 1 END, 6) AS coverage,
 round(CASE WHEN length(c) = 0 THEN 1 WHEN length(c) * 10.0 >= 3000 THEN 0 ELSE 1 - length(c) * 10.0 / 3000 END, 6) AS latency FROM k"""


def l01_term_statistics(spark, sf_dir):
    """L1: document and corpus frequency of each term."""
    return rt.term_statistics(chunks(spark, sf_dir))


L01_SQL = f"SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest({TOKENS.format('text')}) AS term FROM documents) GROUP BY term"


def r09_search(spark, sf_dir):
    """Each benchmark question with a vector of the same number: both arms, fused."""
    v = vectors(spark, sf_dir)
    q = questions(spark, sf_dir).join(v.select(F.col("chunk_id").alias("query_id"), F.col("vector").alias("qvec")), "query_id")
    return rt.search(q, chunks(spark, sf_dir), v, 1, "2024-04-01", 5, "rrf", 20, 0.3)


R09_SQL = f"""WITH s AS ({bm25_sql(20, FORCE)}), d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 6) DESC, chunk_id) AS rank FROM (
 SELECT b.item_id AS query_id, v.vec_id AS chunk_id, {DOT.format(a="q.embedding", b="v.embedding")} AS raw FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id, embeddings v SEMI JOIN {CHUNKS.replace("FROM documents)", "FROM documents) c")} ON c.chunk_id = v.vec_id AND {FORCE})) WHERE rank <= 20 AND raw >= 0.3),
u AS (SELECT query_id, 0 AS arm, rank, chunk_id, round(raw, 4) AS score FROM d UNION ALL SELECT query_id, 1, rank, chunk_id, score FROM s WHERE query_id IN (SELECT vec_id FROM embeddings)),
g AS (SELECT query_id, chunk_id, round(sum(1.0 / (60 + rank)), 10) AS rrf, arg_min(score, arm) AS score, min(arm) AS arm FROM u GROUP BY query_id, chunk_id)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, arm, chunk_id) AS rank FROM g) WHERE rank <= 5"""

QUERIES = {"r01_bm25_topk": _bm25} | {
    f.__name__: f
    for f in (
        r02_dense_topk, r03_l2_normalise, r04_weighted_hybrid, r05_rrf, r06_visible_by_role, r08_in_force, r09_search, r11_merge_max, r12_merge_first, r15_neighbours, r16_rerank,
        r17_cascade, e02_ranking_metrics, e07_answer_scores, e09_latency_percentiles, e10_summary, e11_gate, l01_term_statistics,
    )
}
ORACLES = {
    "r01_bm25_topk": bm25_sql(5), "r02_dense_topk": DENSE_SQL, "r03_l2_normalise": R03_SQL, "r04_weighted_hybrid": R04_SQL, "r05_rrf": R05_SQL, "r06_visible_by_role": R06_SQL, "r08_in_force": R08_SQL,
    "r09_search": R09_SQL, "r11_merge_max": R11_SQL, "r12_merge_first": R12_SQL, "r15_neighbours": R15_SQL, "r16_rerank": R16_SQL, "r17_cascade": R17_SQL, "e02_ranking_metrics": f"{METRICS_SQL} SELECT * FROM r",
    "e07_answer_scores": E07_SQL, "e09_latency_percentiles": E09_SQL, "e10_summary": f"{METRICS_SQL}{CASES_SQL} {E10}", "e11_gate": E11_SQL, "l01_term_statistics": L01_SQL,
}
