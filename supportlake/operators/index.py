"""Index maintenance (K1-K13) and triage."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from supportlake.functions.text import empty, norm
from supportlake.operators import segments
from supportlake.operators.indexstore import IndexStore

#: The reference's column width. Longer texts are cut to it and flagged; None keeps them whole.
MAX_TEXT = 8000
BUCKETS = 64


def index_rows(chunks: DataFrame, max_text: int | None = MAX_TEXT) -> DataFrame:
    """K1: text cut to the column's width (`truncated` tells), typed columns, source bucket for partitioned writes."""
    long = F.lit(False) if max_text is None else F.coalesce(F.length("text") > max_text, F.lit(False))
    cut = chunks.withColumn("truncated", long)
    cut = cut if max_text is None else cut.withColumn("text", F.substring("text", 1, max_text))
    return cut.withColumn("access_level", F.coalesce("access_level", F.lit(0)).cast("tinyint")).withColumn("source_bucket", F.pmod(F.xxhash64("source_file"), F.lit(BUCKETS)).cast("int"))


def write_index(chunks: DataFrame, path: str, max_text: int | None = MAX_TEXT, batch_id: str | None = None) -> IndexStore:
    """K1, K2 on disk: the batch's sources are replaced, all others stay. Returns the store, whose `read` gives the rows; a repeated batch id has no effect."""
    store = IndexStore(chunks.sparkSession, path, BUCKETS)
    store.replace(batch_id or uuid4().hex, index_rows(chunks, max_text))
    return store


def replace_by_source(index: DataFrame, batch: DataFrame) -> DataFrame:
    """K2: rows of other sources and the batch."""
    return index.join(batch.select("source_file").distinct(), "source_file", "left_anti").unionByName(batch, allowMissingColumns=True)


def delete_sources(index: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """K3: what is left, and the number of deleted rows of each source."""
    gone = sources.select("source_file").distinct()
    return index.join(gone, "source_file", "left_anti"), index.join(gone, "source_file", "left_semi").groupBy("source_file").agg(F.count("*").alias("deleted"))


def chunks_of(index: DataFrame, source: str) -> DataFrame:
    """K4."""
    return index.filter(F.col("source_file") == source).orderBy("chunk_index")


def index_stats(index: DataFrame, vec: str = "vector", model: str = "") -> DataFrame:
    """K5."""
    return index.agg((F.count("*") > 0).alias("present"), F.count("*").alias("n_rows"), F.max(F.size(vec)).alias("dimension"), F.lit(model).alias("model"))


def ensure_column(df: DataFrame, name: str, default) -> DataFrame:
    """K6: add a column or fill its nulls."""
    value = F.coalesce(F.col(name), F.lit(default)) if name in df.columns else F.lit(default)
    return df.withColumn(name, value)


def migration_report(before: DataFrame, after: DataFrame, name: str) -> DataFrame:
    """K6: whether the column was there, and how many rows hold a value they did not hold before."""
    there = name in before.columns
    filled = before.agg(F.count_if(F.col(name).isNull() if there else F.lit(True)).alias("n"))
    return filled.select(F.lit(name).alias("field"), F.lit("already_exists" if there else "migrated").alias("status"), F.col("n").alias("filled")).join(after.agg(F.count("*").alias("n_rows")))


def stamp(chunks: DataFrame, doc_meta: DataFrame, ingested_at: str, model: str, dim: int) -> DataFrame:
    """K7: one time for the batch; document-level values win where they are not null."""
    meta = doc_meta.select("source_file", *(F.col(c).alias(f"_{c}") for c in doc_meta.columns if c != "source_file"))
    j = chunks.join(meta, "source_file", "left")
    over = {c: F.coalesce(f"_{c}", c) if c in chunks.columns else F.col(f"_{c}") for c in doc_meta.columns if c != "source_file"}
    kept = [over.pop(c).alias(c) if c in over else F.col(c) for c in chunks.columns]
    return j.select(*kept, *(v.alias(c) for c, v in over.items()), F.to_timestamp(F.lit(ingested_at)).alias("ingested_at"), F.lit(model).alias("model"), F.lit(dim).alias("dim"))


def content_hash(chunks: DataFrame) -> DataFrame:
    """K8: 16 hex digits of sha256 over a document's chunk texts in order, joined by line ends. A source is one document here, so a row holds it."""
    seq = F.transform(F.sort_array(F.collect_list(F.struct("chunk_index", "text"))), lambda x: x["text"])
    return chunks.groupBy("source_file").agg(F.substring(F.sha2(F.array_join(seq, "\n"), 256), 1, 16).alias("content_hash"))


def source_digest(chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """An order-free digest of sources of any size: number of chunks, xor and sum of their hashes, added up before the shuffle. Equal content gives equal digests."""
    h = F.xxhash64(key, "text")
    return chunks.groupBy("source_file").agg(F.count("*").alias("n_chunks"), F.bit_xor(h).alias("xor"), F.sum(F.pmod(h, F.lit(1 << 32))).alias("total"))


def unique_source(content: Column, name: Column) -> Column:
    """K9."""
    return F.concat(F.substring(F.sha2(content, 256), 1, 12), F.lit("_"), name)


def chunking_drift(index: DataFrame, batch: DataFrame) -> DataFrame:
    """Settings of the batch that the index lacks."""
    pair = ["strategy", "target_size"]
    return batch.select(*pair).distinct().join(index.select(*pair).distinct(), pair, "left_anti")


def index_report(chunks: DataFrame, inserted: DataFrame) -> DataFrame:
    """K11."""
    want = chunks.groupBy("source_file").agg(F.count("*").alias("total"))
    got = inserted.groupBy("source_file").agg(F.count("*").alias("inserted"))
    n = F.coalesce("inserted", F.lit(0))
    return want.join(got, "source_file", "left").select("source_file", "total", n.alias("inserted"), F.when(n == F.col("total"), "ok").when(n > 0, "partial").otherwise("failed").alias("status"))


def drop_bad_vectors(df: DataFrame, vec: str = "vector") -> DataFrame:
    """Null, empty and zero vectors go."""
    return df.filter(F.col(vec).isNotNull() & (F.size(vec) > 0)).filter(norm(F.col(vec)) > 0)


def stale_results(results: DataFrame, changed: DataFrame) -> DataFrame:
    """Kept results whose source has changed."""
    return results.join(changed.select("source_file").distinct(), "source_file", "left_semi")


def validate_files(df: DataFrame, caps_mb: dict[str, int], default_mb: int = 50) -> DataFrame:
    """Missing, empty or over the cap of its type."""
    cap = F.coalesce(F.create_map(*[F.lit(x) for kv in caps_mb.items() for x in kv])[F.col("doc_type")], F.lit(default_mb)) * 1048576
    reason = F.when(F.col("length").isNull(), "missing").when(F.col("length") == 0, "empty").when(F.col("length") > cap, "too large")
    return df.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull())


def sniff_type(content: Column) -> Column:
    """Type by leading bytes."""
    h = F.hex(F.substring(content, 1, 16))
    return (
        F.when(h.startswith("25504446"), "pdf").when(h.startswith("504B0304"), "zip").when(h.startswith("89504E47"), "png").when(h.startswith("FFD8FF"), "jpeg")
        .when(h.startswith("47494638"), "gif").when(h.startswith("52494646") & (F.substring(h, 17, 8) == "57454250"), "webp").when(h.startswith("D0CF11E0"), "ole")
    )


def type_warning(content: Column, doc_type: Column) -> Column:
    """A warning where the leading bytes tell another family than the extension's type; unknown bytes and types give none."""
    family = {"pdf": ("pdf",), "word": ("zip", "ole"), "excel": ("zip", "ole"), "ppt": ("zip", "ole"), "image": ("png", "jpeg", "gif", "webp")}
    found, wrong = sniff_type(content), F.lit(False)
    for name, allowed in family.items():
        wrong = wrong | ((doc_type == name) & ~found.isin(*allowed))
    return F.when(wrong, F.concat(F.lit("content is "), found, F.lit(", not "), doc_type))


def page_triage(text_length: Column, images: Column) -> Column:
    """Fair for pages that look scanned, poor for blank or nearly blank ones, else good."""
    return F.when((text_length < 50) & (images >= 1), "fair").when((text_length < 20) & (images == 0), "poor").otherwise("good")


def page_issue(text_length: Column, images: Column) -> Column:
    """What is the matter with a page, null if nothing is."""
    return F.when((text_length < 50) & (images >= 1), "scanned").when((text_length == 0) & (images == 0), "blank").when((text_length < 20) & (images == 0), "little text")


def page_route(df: DataFrame, max_pages: int | None = 50, cost: float = 0.005, largest: int = segments.LARGEST) -> DataFrame:
    """T4: (file, page, text_length, image_count): text or OCR for each page, and the file's cost.

    Pages after the first `max_pages` stay, flagged `over_limit`; they are not routed and cost nothing. None routes all pages.
    Files of more than `largest` pages are numbered and added up by ranges. Pages of a file have numbers of their own.
    """
    wide = segments.giant(df, "file", largest)
    w = Window.partitionBy("file")
    if max_pages is None:
        numbered = df.withColumn("over_limit", F.lit(False))
    elif wide:
        numbered = segments.with_sums(df, "file", [F.col("page")], running={"_n": F.lit(1)}).withColumn("over_limit", F.col("_n") > max_pages).drop("_n")
    else:
        numbered = df.withColumn("over_limit", F.row_number().over(w.orderBy("page")) > max_pages)
    route = F.when(~F.col("over_limit"), F.when((F.col("text_length") >= 50) & (F.col("image_count") == 0), "text").otherwise("ocr"))
    routed, price = numbered.withColumn("route", route), F.when(F.col("route") == "ocr", cost).otherwise(0.0)
    summed = segments.with_sums(routed, "file", [F.col("page")], totals={"file_cost": price}) if wide else routed.withColumn("file_cost", F.sum(price).over(w))
    return summed.withColumn("file_cost", F.round("file_cost", 4))


def page_stats(pages: DataFrame, html: str = "html") -> DataFrame:
    """Text length and image count of web pages, so that T3 and T4 can judge them."""
    text = F.regexp_replace(F.regexp_replace(empty(F.col(html)), r"(?is)<(script|style)\b.*?</\1>", ""), r"(?s)<[^>]*>", "")
    return pages.withColumn("text_length", F.length(F.regexp_replace(text, r"\s+", ""))).withColumn("image_count", F.regexp_count(empty(F.col(html)), F.lit("(?i)<img")))
