"""The index on disk (K1-K3): copy-on-write buckets behind a manifest.

A folder holds `data/`, written once and never changed, and `manifests/`, one file a version, which names the data
folders of every bucket. A commit reads the buckets of the touched sources, writes what they become beside them, and
puts the next manifest in place by a rename that fails if it is there. So readers see one version or the next,
a job that stops between two steps changes nothing, and of two writers one starts over from the other's version.
A manifest remembers the batch ids applied so far (some 40 bytes each), so a repeated batch has no effect.

Buckets are a hash of the source. Their number is fixed when the folder is new; a commit rewrites the buckets it
touches, so choose it such that a bucket is a few GB. A bucket is written by several tasks, dealt by chunk.

Defined results: a null source_file is a source like others; a batch without rows for a named source deletes it, and with versions a
mark of its version stays; rows of a version older than the stored one of their source are left out, equal ones replace; columns that
only some batches have are null elsewhere; a folder without a version reads as None.
"""

from __future__ import annotations

import json
import time
from functools import reduce
from uuid import uuid4

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tasks that write one bucket at most.
SPREAD = 8


class IndexStore:
    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        self.spark, self.folder, self._new_buckets = spark, folder.rstrip("/"), buckets
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, below: str):
        return self._hadoop.Path(f"{self.folder}/{below}" if below else self.folder)

    def _list(self, below: str) -> list:
        return list(self._fs.listStatus(self._path(below))) if self._fs.exists(self._path(below)) else []

    # -- versions

    def versions(self) -> list[int]:
        return sorted(int(s.getPath().getName()[:-5]) for s in self._list("manifests") if s.getPath().getName().endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """The manifest of a version (None: the newest); before the first one, an empty one of version 0."""
        known = self.versions()
        if not known:
            return {"version": 0, "n_buckets": self._new_buckets, "schema": None, "buckets": {}, "batches": []}
        name = self._path(f"manifests/{known[-1] if version is None else version:012d}.json").toString()
        return json.loads("".join(r.value for r in self.spark.read.text(name, wholetext=True).collect()))

    def _publish(self, manifest: dict) -> bool:
        """Put a manifest in place; False if its version is taken."""
        aside, place = self._path(f"manifests/.{uuid4().hex}"), self._path(f"manifests/{manifest['version']:012d}.json")
        out = self._fs.create(aside)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if self._fs.exists(place):
            self._fs.delete(aside, False)
            return False
        option = getattr(self._hadoop, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(option, 1)
        options[0] = option.valueOf("NONE")  # never onto an existing file
        try:
            self._hadoop.FileContext.getFileContext(aside.toUri(), self.spark._jsc.hadoopConfiguration()).rename(self._fs.makeQualified(aside), self._fs.makeQualified(place), options)
        except Py4JJavaError:
            self._fs.delete(aside, False)
            if not self._fs.exists(place):
                raise
            return False
        return True

    # -- reading

    def _rows(self, manifest: dict, buckets: set[int] | None = None) -> DataFrame | None:
        if not manifest["schema"]:
            return None
        schema = T.StructType.fromJson(manifest["schema"])
        paths = [f"{self.folder}/{p}" for b, held in sorted(manifest["buckets"].items()) if buckets is None or int(b) in buckets for p in held]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*paths)

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of one version, whatever is committed meanwhile."""
        rows = self._rows(self.manifest(version))
        return rows if rows is None else rows.filter(~F.col("_gone")).drop("_gone", "_version")

    # -- writing

    def _bucket(self, n: int):
        return F.pmod(F.xxhash64("source_file"), F.lit(n)).cast("int")

    def replace(self, batch_id: str, rows: DataFrame, sources: DataFrame | None = None, version: str | None = None) -> bool:
        """K1, K2: all rows of `sources` (None: those of the batch) become the batch's; False if the batch was applied before.

        `version` names a column of both that orders the versions of a source.
        """
        rows = rows.drop("source_bucket")
        sources = rows if sources is None else sources
        named = sources.groupBy("source_file").agg(F.max(version if version else F.lit(None)).cast("long").alias("_version"))
        stamped = rows.withColumn("_version", (F.col(version) if version else F.lit(None)).cast("long")).withColumn("_gone", F.lit(False))
        return self._commit(batch_id, stamped, named, marks=version is not None)

    def delete(self, batch_id: str, sources: DataFrame) -> DataFrame:
        """K3: remove sources; returns the number of rows of each that went (empty for a repeated batch)."""
        names, old = sources.select("source_file").distinct(), self.read()
        none = self.spark.createDataFrame([], "source_file string, deleted long")
        if old is None:
            return none
        counted = old.join(names, old["source_file"].eqNullSafe(names["source_file"]), "left_semi").groupBy("source_file").agg(F.count("*").alias("deleted"))
        found = self.spark.createDataFrame(counted.collect(), none.schema)  # one row a named source
        return found if self._commit(batch_id, None, names.withColumn("_version", F.lit(None).cast("long")), marks=False) else none

    def _commit(self, batch_id: str, fresh: DataFrame | None, named: DataFrame, marks: bool) -> bool:
        while True:
            base = self.manifest()
            if batch_id in base["batches"]:
                return False
            n = base["n_buckets"]
            touched = {r[0] for r in named.select(self._bucket(n)).distinct().collect()}  # n_buckets numbers at most
            old = self._rows(base, touched)
            merged = self._merge(old, fresh, named, marks)
            data = f"data/{uuid4().hex}"
            bucket, spread = self._bucket(n), F.pmod(F.xxhash64(*[c for c in ("source_file", "chunk_id", "chunk_index") if c in merged.columns]), F.lit(SPREAD))
            merged.withColumn("source_bucket", bucket).repartition("source_bucket", spread).write.partitionBy("source_bucket").parquet(f"{self.folder}/{data}")
            written = {int(s.getPath().getName().partition("=")[2]) for s in self._list(data) if s.isDirectory()}
            held = {b: p for b, p in base["buckets"].items() if int(b) not in touched} | {str(b): [f"{data}/source_bucket={b}"] for b in written}
            schema = json.loads(merged.schema.json())
            if self._publish({"version": base["version"] + 1, "n_buckets": n, "schema": schema, "buckets": held, "batches": [*base["batches"], batch_id]}):
                return True
            self._fs.delete(self._path(data), True)  # another writer was first

    @staticmethod
    def _merge(old: DataFrame | None, fresh: DataFrame | None, named: DataFrame, marks: bool) -> DataFrame:
        """The touched buckets' rows after the batch."""
        same = lambda a, b: a["source_file"].eqNullSafe(b["source_file"])
        if old is not None:
            kept = old.groupBy("source_file").agg(F.max("_version").alias("_stored")).alias("k")
            pairs = named.alias("n").join(kept, F.expr("n.source_file <=> k.source_file"), "left")
            named = pairs.filter("k._stored is null or n._version is null or n._version >= k._stored").select("n.source_file", "n._version")
        parts = []
        if old is not None:
            parts.append(old.join(named, same(old, named), "left_anti"))
        if fresh is not None:
            chosen = named.withColumnsRenamed({"source_file": "_s", "_version": "_v"})
            parts.append(fresh.join(chosen, fresh["source_file"].eqNullSafe(chosen["_s"]) & fresh["_version"].eqNullSafe(chosen["_v"]), "left_semi"))
        if marks and fresh is not None:
            without = named.alias("n").join(fresh.select(F.col("source_file").alias("_s"), F.col("_version").alias("_v")).distinct(), F.expr("n.source_file <=> _s and n._version <=> _v"), "left_anti")
            parts.append(without.select("source_file", "_version", F.lit(True).alias("_gone")))
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    def vacuum(self, keep: int = 2, older_than_seconds: int = 86_400) -> list[str]:
        """Delete manifests but the last `keep`, and data that none of these names and no running writer can still need."""
        versions = self.versions()
        for v in versions[:-keep]:
            self._fs.delete(self._path(f"manifests/{v:012d}.json"), False)
        used = {p.split("/")[1] for v in versions[-keep:] for held in self.manifest(v)["buckets"].values() for p in held}
        limit, gone = (time.time() - older_than_seconds) * 1000, []
        for s in self._list("data"):
            name = s.getPath().getName()
            if name not in used and s.getModificationTime() <= limit:
                self._fs.delete(s.getPath(), True)
                gone.append(name)
        return gone
