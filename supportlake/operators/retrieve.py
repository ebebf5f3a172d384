"""Lexical and vector retrieval over tables of questions.

Filters for permission and validity come before any ranking, since a filter does not commute with
top-k. Ranking windows are of the form row_number() <= k over the query, which Spark cuts early.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from supportlake.functions import lexicons as lex
from supportlake.functions.text import any_of, dot, empty, exploded, norm, tokens
from supportlake.functions.words import FEW, group_numbers
from supportlake.operators.lexindex import bm25_topk
from supportlake.operators.vectors import dense_topk

ROUND = 6


def top(df: DataFrame, k: int, *order: Column, by: str = "query_id") -> DataFrame:
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    return ranked.filter(F.col("rank") <= k)


def postings(chunks: DataFrame, text: str = "text") -> DataFrame:
    """(term, chunk_id, tf)."""
    return chunks.select("chunk_id", F.explode(tokens(F.col(text))).alias("term")).groupBy("term", "chunk_id").agg(F.count("*").alias("tf"))


def term_statistics(chunks: DataFrame, text: str = "text") -> DataFrame:
    """L1: (term, df, cf): chunks that hold a term, and its occurrences in all.

    Counted up in each task, so that a row a task and term is shuffled. Rows that share a chunk_id are one chunk; where there are such, pairs of term and chunk are counted.
    """
    if not chunks.groupBy("chunk_id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        return postings(chunks, text).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    one = lambda df, cf: lambda t: F.struct(t.alias("term"), F.lit(df).cast("long").alias("df"), F.lit(cf).cast("long").alias("cf"))
    words = chunks.select(tokens(F.col(text)).alias("_w"))
    both = words.select(F.concat(F.transform(F.array_distinct("_w"), one(1, 0)), F.transform("_w", one(0, 1))).alias("_b"))
    return exploded(both, [], F.col("_b"), "_t").groupBy("_t.term").agg(F.sum("_t.df").alias("df"), F.sum("_t.cf").alias("cf"))


def l2_normalise(df: DataFrame, vec: str = "vector") -> DataFrame:
    """Unit length; a vector without length stays as it is."""
    v = F.col(vec).cast("array<double>")
    n = norm(F.col(vec))
    return df.withColumn(vec, F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v))


def weighted_hybrid(sparse: DataFrame, dense: DataFrame, ws: float = 0.3, wd: float = 0.7, k: int = 5) -> DataFrame:
    """Each arm scaled to [0, 1] by the query's best score, weighted, missing sides count 0."""
    best = lambda df, name: df.select("query_id", "chunk_id", (F.col("score") / F.max("score").over(Window.partitionBy("query_id"))).alias(name))
    both = best(sparse, "s").join(best(dense, "d"), ["query_id", "chunk_id"], "full")
    score = F.round(ws * F.coalesce("s", F.lit(0.0)) + wd * F.coalesce("d", F.lit(0.0)), ROUND)
    return top(both.select("query_id", "chunk_id", score.alias("score")), k, F.desc("score"), F.col("chunk_id"))


def rrf(arms: DataFrame, k0: int = 60) -> DataFrame:
    """Arms (query_id, arm, rank, chunk_id, score), arm 0 dense and 1 sparse; the dense score is kept where there is one."""
    fused = arms.groupBy("query_id", "chunk_id").agg(F.round(F.sum(1.0 / (k0 + F.col("rank"))), 10).alias("rrf"), F.min_by("score", "arm").alias("score"), F.min("arm").alias("arm"))
    order = Window.partitionBy("query_id").orderBy(F.desc("rrf"), "arm", "chunk_id")
    return fused.withColumn("rank", F.row_number().over(order))


def visible(df: DataFrame, user_rank: int | Column) -> DataFrame:
    """Rows at or below the user's rank; a missing level is public."""
    return df.filter(F.coalesce("access_level", F.lit(0)) <= user_rank)


def where_equal(df: DataFrame, doc_type: str | None = None, source: str | None = None) -> DataFrame:
    """Plain equality, so that it reaches the scan."""
    for name, value in (("doc_type", doc_type), ("source_file", source)):
        df = df if value is None else df.filter(F.col(name) == value)
    return df


def in_force(df: DataFrame, today: str) -> DataFrame:
    """Both ends inclusive, a missing end is open."""
    day = F.to_date(F.lit(today))
    return df.filter((F.coalesce("effective_from", day) <= day) & (F.coalesce("effective_to", day) >= day))


def expand_synonyms(queries: DataFrame, groups: dict[str, tuple[str, ...]] = lex.SYNONYMS) -> DataFrame:
    """For each group of which the query holds a member, its absent members are appended in order."""
    q, extra = empty(F.col("query")), F.array().cast("array<string>")
    members = [(head, *variants) for head, variants in groups.items()]
    if sum(map(len, members)) > FEW:
        listed = F.array(*(F.array(*map(F.lit, m)) for m in members))
        extra = F.flatten(F.transform(group_numbers(q, members), lambda g: F.filter(F.get(listed, g), lambda w: ~F.contains(q, w))))
        return queries.withColumn("expanded", F.concat_ws(" ", q, F.array_distinct(extra)))
    for head, variants in groups.items():
        members = (head, *variants)
        absent = F.filter(F.array(*map(F.lit, members)), lambda w: ~F.contains(q, w))
        extra = F.concat(extra, F.when(any_of(q, members), absent).otherwise(F.array().cast("array<string>")))
    return queries.withColumn("expanded", F.concat_ws(" ", q, F.array_distinct(extra)))


def merge_max(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """Union of two result lists, the higher score of a chunk kept, top k."""
    every = a.select("query_id", "chunk_id", "score").union(b.select("query_id", "chunk_id", "score"))
    return top(every.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score")), k, F.desc("score"), F.col("chunk_id"))


def merge_first(parts: DataFrame, k: int) -> DataFrame:
    """Parts (query_id, part, chunk_id, score): the first part's score of a chunk is kept, top k."""
    return top(parts.groupBy("query_id", "chunk_id").agg(F.min_by("score", "part").alias("score")), k, F.desc("score"), F.col("chunk_id"))


def is_complex(c: Column) -> Column:
    """One strong marker or two weak ones."""
    weak = sum((F.contains(empty(c), F.lit(w)).cast("int") for w in lex.COMPLEX_WEAK), F.lit(0))
    return any_of(c, lex.COMPLEX_STRONG) | (weak >= 2)


def with_neighbours(hits: DataFrame, chunks: DataFrame, w: int = 1) -> DataFrame:
    """Texts of the chunks within w places in the same source, in order; what is missing is left out."""
    around = hits.select("*", F.explode(F.sequence(F.col("chunk_index") - w, F.col("chunk_index") + w)).alias("near"))
    near = chunks.select(F.col("source_file"), F.col("chunk_index").alias("near"), F.col("text").alias("near_text"))
    parts = around.join(near, ["source_file", "near"]).groupBy(*hits.columns).agg(F.sort_array(F.collect_list(F.struct("near", "near_text"))).alias("p"))
    return parts.withColumn("context", F.array_join(F.transform("p", lambda x: x["near_text"]), "\n")).drop("p")


def rerank(hits: DataFrame, relevance: Column, n: int = 5, cap: int | None = 100) -> DataFrame:
    """The first `cap` results (None: all) ordered by `relevance`, top n, with the original rank and score."""
    first = hits if cap is None else hits.filter(F.col("rank") <= cap)
    old = first.withColumnRenamed("rank", "original_rank").withColumn("relevance", relevance)
    order = Window.partitionBy("query_id").orderBy(F.desc("relevance"), "original_rank")
    return old.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


STAGES = ("decomposed", "original", "rewritten", "expanded", "web")


def cascade(candidates: DataFrame, threshold: float = 0.7, gain: float = 0.05, tries: int = 2) -> DataFrame:
    """Candidates (query_id, stage, attempt, first_score, max_score) to (query_id, level, method, best).

    Stages in order: decomposed, original, rewritten (the first `tries` attempts), expanded, web. A stage is enough if its first score
    reaches the threshold. A decomposed try that is not enough is forgotten. The original's highest score is the best so
    far; a rewritten or expanded try counts only if it beats that by more than `gain`, becomes the best then, and wins if it is
    enough. Web results win if there are any; else the level is 5. Missing stages are skipped, null scores are 0.
    """
    place = F.create_map(*[x for i, s in enumerate(STAGES) for x in (F.lit(s), F.lit(i))])
    entry = F.struct(place[F.col("stage")].alias("p"), F.coalesce("attempt", F.lit(0)).alias("attempt"), F.coalesce("first_score", F.lit(0.0)).alias("first"), F.coalesce("max_score", F.lit(0.0)).alias("most"))
    steps = candidates.groupBy("query_id").agg(F.sort_array(F.collect_list(entry)).alias("steps"))
    start = F.struct(F.lit(0.0).alias("best"), F.lit(5).alias("level"), F.lit("none").alias("method"), F.lit(0).alias("tried"))

    def step(a: Column, x: Column) -> Column:
        again, enough = x["p"].isin(2, 3), x["first"] >= threshold
        late = (x["p"] == 2) & (a["tried"] >= tries)
        better = again & ~late & (x["most"] > a["best"] + gain)
        won = ((x["p"] <= 1) & enough) | (better & enough) | (x["p"] == 4)
        skip = (a["level"] < 5) | late
        raised = (x["p"] == 1) | better | ((x["p"] == 0) & enough)
        return F.struct(
            F.when(~skip & raised, x["most"]).otherwise(a["best"]).alias("best"),
            F.when(~skip & won, F.greatest(x["p"], F.lit(1))).otherwise(a["level"]).cast("int").alias("level"),
            F.when(~skip & won, F.element_at(F.array(*map(F.lit, STAGES)), x["p"] + 1)).otherwise(a["method"]).alias("method"),
            (a["tried"] + (x["p"] == 2).cast("int")).alias("tried"),
        )

    return steps.select("query_id", F.aggregate("steps", start, step).alias("r")).select("query_id", "r.level", "r.method", F.round("r.best", ROUND).alias("best"))


def external_hits(rows: DataFrame, k: int) -> DataFrame:
    """Outside results (query_id, position, title, snippet) as hits with a fixed score."""
    hits = rows.select("query_id", F.concat(F.lit("web_"), F.col("position").cast("string")).alias("chunk_id"), F.concat_ws("\n", "title", "snippet").alias("text"), F.lit(0.5).alias("score"), F.lit("web").alias("doc_type"), "position")
    return top(hits, k, F.col("position")).drop("position")


def search(queries: DataFrame, chunks: DataFrame, vectors: DataFrame, user_rank: int = 0, today: str | None = None, k: int = 5, fusion: str = "rrf", over: int = 20, threshold: float = 0.0, relevance: Column | None = None) -> DataFrame:
    """Permission and validity, both arms over-fetched, fused, re-ranked by `relevance` (of query and text) where given, cut to k.

    queries (query_id, query, qvec), chunks (chunk_id, text, access_level, effective_from, effective_to).
    """
    allowed = visible(chunks, user_rank)
    allowed = in_force(allowed, today) if today else allowed
    sparse = bm25_topk(expand_synonyms(queries).select("query_id", F.col("expanded").alias("query")), allowed, max(k, over))
    dense = dense_topk(queries.select("query_id", "qvec"), vectors.join(allowed.select("chunk_id"), "chunk_id", "left_semi"), max(k, over), threshold)
    if fusion == "weighted":
        return weighted_hybrid(sparse, dense, k=k)
    arms = dense.select("query_id", F.lit(0).alias("arm"), "rank", "chunk_id", "score").union(sparse.select("query_id", F.lit(1), "rank", "chunk_id", "score"))
    fused = rrf(arms)
    if relevance is None:
        return fused.filter(F.col("rank") <= k)
    known = fused.filter(F.col("rank") <= max(k, over)).join(allowed.select("chunk_id", "text"), "chunk_id").join(queries.select("query_id", "query"), "query_id")
    return rerank(known, relevance, k).drop("text", "query")
