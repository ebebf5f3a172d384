"""The queries opN_<name> over whole tables, with DuckDB SQL where SQL can say the same.

Operators are imported inside the functions so that each query loads only what it needs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from supportlake.llm.common import documents


def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from supportlake.llm.pii import pii_digest

    return pii_digest(documents(spark, sf_dir))


def op2_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from supportlake.llm.records import record_digest

    return record_digest(spark, documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from supportlake.llm.bpe import round_trip_digest

    return round_trip_digest(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_cover_tree_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from supportlake.llm.covertree import near_vectors

    return near_vectors(documents(spark, sf_dir, "embeddings"), cosine=0.98)


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from supportlake.llm.lm import lm_scores

    return lm_scores(documents(spark, sf_dir))


def op6_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from supportlake.llm.rollups import corpus_rollup

    first, second = (public_tokenizers.path("byte_bpe_50k.json"), None), (public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return corpus_rollup(spark, documents(spark, sf_dir), first, second)


def op7_lexical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from supportlake.llm.packing import pack

    return pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=1, with_ids=False)


def op8_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from supportlake.llm.minhash import near_duplicates

    return near_duplicates(documents(spark, sf_dir), width=3, percent=85)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from supportlake.llm.secrets import secret_digest

    return secret_digest(documents(spark, sf_dir))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from supportlake.llm.quality import quality

    return quality(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from supportlake.llm.lexical import ranked

    return ranked(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"), k=10)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from supportlake.llm.negatives import hard_negatives

    return hard_negatives(documents(spark, sf_dir, "embeddings"))


def op13_web_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from supportlake.llm.warc import archive_digest

    return archive_digest(spark, documents(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    from supportlake.llm.lexical import lexical_sql
    from supportlake.llm.negatives import negatives_sql
    from supportlake.llm.quality import quality_sql
    from supportlake.llm.warc import archive_sql

    return {"op10_quality_rules": quality_sql(), "op11_ranked_search": lexical_sql(), "op12_hard_negatives": negatives_sql(), "op13_web_archives": archive_sql()}
