"""Documents to packed training windows: quality rules, near-duplicates, secrets, packing.

Each stage reads what its predecessor kept; run() writes each stage's result to the shared folder and
reads it back, so a lost executor never repeats more than one stage.

Defined results, for each stage and for run():
- a null text counts as an empty one: the quality rules reject it; near-duplicates and secrets leave it as it is
  (null), packing gives it the end id alone;
- a null doc_id is a document like others: it is never a duplicate, and its pieces carry a null doc_id;
- repeated rows and ties: rows that share a doc_id are one document for near-duplicates, so the rows of the smallest
  doc_id of a group stay, all of them; the other stages treat each row by itself;
- very long texts are read whole in every stage and cut only into windows;
- an empty table gives an empty one, with the stage's columns;
- further columns pass through all stages but the last, under their own names, also those that clash with names used inside.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from supportlake.llm.common import documents, drop_table, store
from supportlake.llm.minhash import drop_near_duplicates
from supportlake.llm.packing import pack
from supportlake.llm.quality import keep_good
from supportlake.llm.secrets import redact_secrets


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the threshold table."""
    return keep_good(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each group linked by a Jaccard similarity of 0.8 on five-word shingles."""
    return drop_near_duplicates(docs, width=5, percent=80)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with each secret replaced by its kind."""
    return redact_secrets(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 2048 ids, end id 50256."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=50256)


STAGES = [("quality", quality_stage), ("near_duplicates", near_duplicate_stage), ("secrets", secret_stage), ("packing", packing_stage)]

#: Packing and the connected groups have no SQL form; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            drop_table(before)
        before = docs
    packed = STAGES[-1][1](spark, docs, sf_dir)
    drop_table(docs)  # packing has written its own token table
    return packed
