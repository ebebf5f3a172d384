"""Token counts as delta-maintained rollups.

A change row says that a document's count under one tokenizer version was inserted, deleted or
revised; a revision carries the old count. Each batch becomes signed deltas, summed by source,
language and tokenizer version before anything is stored, and is committed as one folder under its
batch id. Totals are the sum of committed deltas, so a batch can be added in any order. A batch is
written aside and moved into place: one that is already there stays as it is, so a retried or
replayed commit changes nothing. `compact` folds committed batches into one, which remembers their ids;
batches and compactions may share a name.

Defined results: null source, language or version are keys of their own; a null count is 0; repeated
rows count each time (the change feed says what happened); an empty batch commits no deltas but its
id; groups whose documents are all gone are left out of totals; unknown kinds of change raise. Counts are
of whole texts, whatever their length; a null text has no ids; an empty table gives empty totals.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from supportlake.llm.common import scratch, store

KEYS = ("source", "lang", "tokenizer")
DELTA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def deltas(changes: DataFrame) -> DataFrame:
    """Signed sums of a change feed (op: insert, delete or revise; n_tokens; old_tokens for revisions).

    Partial sums are made before the shuffle, so a source with a third of all rows is one row a task.
    """
    op, n = F.col("op"), F.coalesce("n_tokens", F.lit(0)).cast("long")
    unknown = F.raise_error(F.concat(F.lit("unknown change: "), F.coalesce("op", F.lit("null"))))
    docs = F.when(op == "insert", 1).when(op == "delete", -1).when(op == "revise", 0).otherwise(unknown.cast("int"))
    tokens = F.when(op == "insert", n).when(op == "delete", -n).when(op == "revise", n - F.coalesce("old_tokens", F.lit(0)))
    return changes.groupBy(*KEYS).agg(F.sum(docs).cast("long").alias("n_docs"), F.sum(tokens).cast("long").alias("n_tokens"))


class Rollup:
    """Committed deltas below one folder of a file system that all nodes share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self) -> list[tuple[str, str]]:
        """(kind, name) of all folders. Batches and compactions have name spaces of their own."""
        found = []
        for kind in ("batches", "compacted"):
            top = self._path(f"{self.folder}/{kind}")
            found += [(kind, s.getPath().getName()) for s in self._fs.listStatus(top)] if self._fs.exists(top) else []
        return sorted(found)

    def _held(self) -> dict[tuple[str, str], set[str]]:
        """Batch ids of each folder, read in one job."""
        names = self._names()
        if not names:
            return {}
        rows = self.spark.read.text([f"{self.folder}/{k}/{n}/ids" for k, n in names]).select("value", F.col("_metadata.file_path").alias("path")).collect()
        ids: dict[tuple[str, str], set[str]] = {n: set() for n in names}
        for r in rows:
            kind, name = r.path.rsplit("/", 4)[1:3]
            ids[kind, unquote(name)].add(r.value)
        return ids

    def _live(self) -> dict[tuple[str, str], set[str]]:
        """Folders that count. One whose ids are all in a larger one is superseded; of those with equal ids the last in order counts, so of two compactions one."""
        ids = self._held()
        return {n: own for n, own in ids.items() if not any(own < other or (own == other and n < m) for m, other in ids.items())}

    def committed(self) -> list[str]:
        """Ids of all committed batches, those folded by compaction too."""
        return sorted(set().union(*self._held().values()))

    def _put(self, kind: str, name: str, ids: list[str], rows: DataFrame) -> bool:
        """Write aside, then rename into place. Of two committers one wins: a rename onto a folder fails, or on some file systems lands inside it, and is then taken back."""
        aside, place = self._path(scratch(self.spark, "rollup")), self._path(f"{self.folder}/{kind}/{name}")
        rows.write.parquet(f"{aside}/deltas")
        self.spark.createDataFrame([(i,) for i in ids], "value string").coalesce(1).write.text(f"{aside}/ids")
        self._fs.mkdirs(place.getParent())
        inside = self._path(f"{self.folder}/{kind}/{name}/{aside.getName()}")
        won = not self._fs.exists(place) and self._rename(aside, place) and not self._fs.exists(inside)
        for left in (aside, inside) if not won else ():
            self._fs.delete(left, True)
        return won

    def _rename(self, old, new) -> bool:
        try:
            return self._fs.rename(old, new)
        except Py4JJavaError:  # some file systems raise where the target is there
            if not self._fs.exists(new):
                raise
            return False

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Commit a batch once; False if it was there already."""
        if batch in self.committed():
            return False
        return self._put("batches", batch, [batch], deltas(changes))

    def totals(self) -> DataFrame:
        return self._sums(list(self._live()))

    def _sums(self, names: list[tuple[str, str]]) -> DataFrame:
        parts = [self.spark.read.schema(DELTA).parquet(f"{self.folder}/{k}/{n}/deltas") for k, n in names]
        every = reduce(DataFrame.unionByName, parts, self.spark.createDataFrame([], DELTA))
        return every.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).filter("n_docs <> 0 or n_tokens <> 0")

    def compact(self, name: str) -> None:
        """Fold all committed batches into one folder of its own name space. It is put in place first and supersedes the others, which then go."""
        old = self._live()
        every = set().union(*old.values())
        if len(old) < 2 or not self._put("compacted", name, sorted(every), self._sums(list(old))):
            return
        for (kind, n), ids in self._held().items():
            if ids <= every and (kind, n) != ("compacted", name) and (kind, n) not in self._live():
                self._fs.delete(self._path(f"{self.folder}/{kind}/{n}"), True)


def token_counts(docs: DataFrame, vocabularies: dict[str, tuple[str, str | None]], keep: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """Columns of `keep` and one column a vocabulary with the number of ids of each whole text (null: none).

    vocabularies: name -> (path, split pattern); with a pattern the file holds ranks for tiktoken, else a tokenizers file.
    """
    shape = ", ".join(f"{c} {t}" for c, t in docs.select(*keep).dtypes) + "".join(f", {name} long" for name in vocabularies)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from supportlake.llm.tokens import by_bytes, library_encoder, rank_encoder

        for b in by_bytes(frames):
            counts = [np.diff((rank_encoder(path, pattern) if pattern else library_encoder(path)).encode_column(b["text"])[1]) for path, pattern in vocabularies.values()]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in keep), *map(pa.array, counts)], names=[*keep, *vocabularies])

    return docs.select(*keep, "text").mapInArrow(run, shape)


def corpus_rollup(spark: SparkSession, docs: DataFrame, first: tuple[str, str | None], second: tuple[str, str | None], least: int = 20) -> DataFrame:
    """Four commits over all documents and the totals after them.

    All documents arrive under the first vocabulary; those of fewer than `least` ids are deleted; all that are
    left are counted under the second one as well; the first counts of English documents are revised to
    hold an end id. Every batch is committed twice, which must not matter.
    """
    docs = store(token_counts(docs, {"a": first, "b": second}), "rollup-counts")
    one, old = docs.withColumn("tokenizer", F.lit("byte-50k")), F.lit(None).cast("long").alias("old_tokens")
    left = one.filter(F.col("a") >= least)
    batches = {
        "0001-arrival": one.select(*KEYS, F.lit("insert").alias("op"), F.col("a").alias("n_tokens"), old),
        "0002-short": one.filter(F.col("a") < least).select(*KEYS, F.lit("delete").alias("op"), F.col("a").alias("n_tokens"), old),
        "0003-second-version": left.withColumn("tokenizer", F.lit("byte-multi-50k")).select(*KEYS, F.lit("insert").alias("op"), F.col("b").alias("n_tokens"), old),
        "0004-end-ids": left.filter("lang = 'en'").select(*KEYS, F.lit("revise").alias("op"), (F.col("a") + 1).alias("n_tokens"), F.col("a").alias("old_tokens")),
    }
    rollup = Rollup(spark, scratch(spark, "token-rollup"))
    for _ in range(2):
        for name, changes in batches.items():
            rollup.commit(name, changes)
    return rollup.totals()
