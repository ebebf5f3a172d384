"""Files to text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from supportlake.functions import lexicons as lex
from supportlake.functions.text import empty, stripped


def _name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def _extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(_name(path), r"\.([A-Za-z0-9]+)$", 1))


def scan_files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """Binary files of known extensions, hidden and temporary names left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return files.filter(~_name(F.col("path")).rlike(r"^[.~]") & _extension(F.col("path")).isin(*lex.DOC_TYPES))


def doc_type(path: Column) -> Column:
    """By extension, else web for addresses, else plain text."""
    kind = F.create_map(*[F.lit(x) for kv in lex.DOC_TYPES.items() for x in kv])[_extension(path)]
    return F.coalesce(kind, F.when(F.startswith(path, F.lit("http")), "web"), F.lit("plain_text"))


def title(path: Column) -> Column:
    """S3: an address's last path segment, else its host; a file's stem."""
    host = F.regexp_extract(path, r"^https?://([^/?#]+)", 1)
    segment = F.regexp_extract(F.regexp_replace(F.regexp_extract(path, r"^https?://[^/?#]+([^?#]*)", 1), "/+$", ""), r"([^/]*)$", 1)
    return F.when(F.startswith(path, F.lit("http")), F.when(segment != "", segment).otherwise(host)).otherwise(F.regexp_replace(_name(path), r"\.[^.]*$", ""))


FAQ = "array<struct<question:string,answer:string,keywords:array<string>>>"


def explode_faq(df: DataFrame, content: str = "content") -> DataFrame:
    """(…, n, question, answer, keywords); n counts skipped items, bad JSON leaves one row with status failed."""
    items = F.from_json(F.col(content).cast("string"), FAQ)
    keep = [c for c in df.columns if c != content]
    rows = df.select(*keep, F.when(items.isNull(), "failed").otherwise("ok").alias("status"), F.posexplode_outer(items).alias("p", "q"))
    good = (F.length(empty(F.col("q.question"))) > 0) & (F.length(empty(F.col("q.answer"))) > 0)
    return rows.filter((F.col("status") == "failed") | good).select(*keep, "status", (F.col("p") + 1).alias("n"), "q.question", "q.answer", "q.keywords")


def faq_markdown(faq: DataFrame, by: str = "source_file") -> DataFrame:
    """One Markdown text a file."""
    words = F.when(F.size("keywords") > 0, F.concat(F.lit("\n*关键词: "), F.array_join("keywords", ", "), F.lit("*"))).otherwise("")
    part = F.concat(F.lit("## Q"), F.col("n").cast("string"), F.lit(": "), "question", F.lit("\n"), "answer", words)
    return faq.filter("status = 'ok'").groupBy(by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", part.alias("x")))), lambda s: s["x"]), "\n\n").alias("text"))


def _other_charset(content: bytes) -> str:
    """The first charset that takes all bytes; latin-1 takes any. GB 2312 is a part of GBK."""
    try:
        return content.decode("gbk")
    except UnicodeDecodeError:
        return content.decode("latin-1")


def decode_text(df: DataFrame) -> DataFrame:
    """UTF-8 where valid, else GBK, else Latin-1; .txt gets its stem as a header; blank content is partial."""

    @F.pandas_udf("string")
    def other(content: pd.Series) -> pd.Series:
        return content.map(lambda x: None if x is None else _other_charset(x))

    utf8 = F.col("content").cast("string")
    valid = F.is_valid_utf8(utf8)
    text = F.when(valid, utf8).otherwise(other(F.when(~valid, F.col("content"))))  # valid files do not go to Python
    stem = F.regexp_replace(_name(F.col("path")), r"\.[^.]*$", "")
    blank = F.trim(F.regexp_replace(text, r"\s+", "")) == ""
    body = F.when((_extension(F.col("path")) == "txt") & ~blank, F.concat(F.lit("# "), stem, F.lit("\n\n"), text)).otherwise(text)
    return df.withColumn("text", body).withColumn("status", F.when(blank, "partial").otherwise("success"))


ELEMENT = "struct<bbox:array<int>,category:string,text:string>"
LAYOUT = f"array<{ELEMENT}>"


def _mended(c: Column) -> Column:
    """Missing commas between objects put in, commas before a closing bracket taken out."""
    return F.regexp_replace(F.regexp_replace(c, r"\}\s*\{", "},{"), r",\s*([\]}])", "$1")


def _strictly(c: Column, shape: str) -> Column:
    """Parsed if the whole text is sound JSON, else null; a lenient parse would keep a part and lose the rest."""
    return F.when(F.try_parse_json(c).isNotNull(), F.from_json(c, shape))


def repair_json(c: Column) -> Column:
    """The layout elements of a model's output, null if nothing can be read.

    The fence goes. An array that is sound as it stands is taken. Else each object that holds a bbox is salvaged, parsed and mended by
    itself, so one damaged object costs no other. Else the whole text is mended and its array brackets are completed.
    """
    bare = F.regexp_replace(F.regexp_replace(stripped(c), r"^```(?:json)?\s*", ""), r"\s*```$", "")
    objects = F.regexp_extract_all(bare, F.lit(r"\{[^{}]*\"bbox\"\s*:\s*\[[^\]]*\][^{}]*\}"), F.lit(0))
    salvaged = F.filter(F.transform(objects, lambda o: F.coalesce(_strictly(o, ELEMENT), _strictly(_mended(o), ELEMENT))), lambda e: e.isNotNull())
    whole = _mended(bare)
    opened = F.when(whole.startswith("["), whole).otherwise(F.concat(F.lit("["), whole))
    closed = F.when(opened.endswith("]"), opened).otherwise(F.concat(F.regexp_replace(opened, r"[,\s]+$", ""), F.lit("]")))
    return F.coalesce(F.when(bare.startswith("["), _strictly(bare, LAYOUT)), F.when(F.size(salvaged) > 0, salvaged), _strictly(closed, LAYOUT))


def layout_markdown(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Elements by category as Markdown; what cannot be parsed stays as plain text."""
    cells = lambda row: F.array_join(F.transform(F.regexp_extract_all(row, F.lit(r"(?s)<t[hd][^>]*>(.*?)</t[hd]>"), F.lit(1)), F.trim), " | ")

    def table(html: Column) -> Column:
        rows = F.transform(F.regexp_extract_all(html, F.lit(r"(?s)<tr[^>]*>(.*?)</tr>"), F.lit(1)), lambda r: F.concat(F.lit("| "), cells(r), F.lit(" |")))
        return F.array_join(rows, "\n")

    def line(e: Column) -> Column:
        t, k = empty(e["text"]), e["category"]
        return (
            F.when(k.isin("Page-header", "Page-footer") | (t == ""), F.lit(None).cast("string")).when(k == "Title", F.concat(F.lit("# "), t)).when(k == "Section-header", F.concat(F.lit("## "), t))
            .when(k == "List-item", F.concat(F.lit("- "), t)).when(k == "Formula", F.concat(F.lit("$$\n"), t, F.lit("\n$$"))).when(k == "Table", table(t)).otherwise(t)
        )

    parsed = repair_json(F.col(raw))
    return df.withColumn("markdown", F.coalesce(F.array_join(F.array_compact(F.transform(parsed, line)), "\n\n"), F.col(raw)))


CASES = T.StructType([T.StructField(c, T.StringType()) for c in ("question", "ground_truth_answer")] + [T.StructField("must_contain_keywords", T.ArrayType(T.StringType()))] + [T.StructField(c, T.StringType()) for c in ("intent", "difficulty")])


def read_eval_cases(spark: SparkSession, path: str, default: DataFrame | None = None) -> DataFrame:
    """The labelled question set; where there is none at the path, the caller's default cases."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if default is not None and not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return default
    return spark.read.schema(CASES).option("multiLine", True).json(path)


def write_eval_cases(cases: DataFrame, path: str) -> None:
    """The set written back, one JSON object a line, which read_eval_cases reads too."""
    cases.select(*CASES.names).write.mode("overwrite").json(path)


#: The catalogue's columns.
CATALOGUE = ("商品ID", "名称", "类别", "品牌", "价格", "库存", "颜色", "材质", "尺寸", "重量", "保修月数", "上架时间")


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """A product list with the catalogue's header: price, stock, months and date are typed (null where they do not parse); a byte-order mark goes; missing columns are null, others stay."""
    df = spark.read.option("header", True).csv(path)
    df = df.toDF(*(c.lstrip("\ufeff") for c in df.columns))
    types = {"价格": "decimal(10,2)", "库存": "int", "保修月数": "int", "上架时间": "date"}
    known = [(F.col(c).try_cast(types[c]) if c in types else F.col(c)).alias(c) if c in df.columns else F.lit(None).cast(types.get(c, "string")).alias(c) for c in CATALOGUE]
    return df.select(*known, *(c for c in df.columns if c not in CATALOGUE))


def _read_jdbc(spark: SparkSession, url: str, table: str, props: dict[str, str], column: str, bounds: tuple[int, int] | None, parts: int) -> DataFrame:
    if bounds is None or parts == 1:
        return spark.read.jdbc(url, table, properties=props)
    return spark.read.jdbc(url, table, column=column, lowerBound=bounds[0], upperBound=bounds[1] + 1, numPartitions=parts, properties=props)


def key_bounds(spark: SparkSession, url: str, table: str, props: dict[str, str], column: str) -> tuple[int, int] | None:
    """The least and greatest key of a table, asked of the database in one row; None for a table without keys."""
    asked = f"(SELECT MIN({column}) AS lo, MAX({column}) AS hi FROM {table}) b"
    least, greatest = spark.read.jdbc(url, asked, properties=props).first()
    return None if least is None else (int(least), int(greatest))


def read_jdbc_table(spark: SparkSession, url: str, table: str, props: dict[str, str], column: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 1) -> DataFrame:
    """Orders and tracking from a database; filters and columns are pushed down.

    With a whole-number `column`, `parts` tasks read ranges of it; bounds that are not given are asked of the database. All rows are read, whatever the bounds,
    and rows without a key are in the first range.
    """
    if column is None:
        return spark.read.jdbc(url, table, properties=props)
    return _read_jdbc(spark, url, table, props, column, bounds or key_bounds(spark, url, table, props, column), parts)


class NewRows:
    """S11 in steps: rows of a database table above the last key that was read, which the folder `marks` remembers.

    `read()` gives the rows and their greatest key; `done(key)` is called once they are stored. A stop between the two reads the same rows
    again; a mark is a folder named by its key, made in one step, and never goes back. Rows without a key, and changes of rows read
    before, are not seen: the whole read has them.
    """

    def __init__(self, spark: SparkSession, url: str, table: str, props: dict[str, str], key: str, marks: str, parts: int = 1):
        self.spark, self.source, self.key, self.parts = spark, (url, table, props), key, parts
        self.path = spark._jvm.org.apache.hadoop.fs.Path(marks)
        self.files = self.path.getFileSystem(spark._jsc.hadoopConfiguration())

    def last(self) -> int | None:
        if not self.files.exists(self.path):
            return None
        return max((int(s.getPath().getName().removeprefix("key=")) for s in self.files.listStatus(self.path)), default=None)

    def read(self) -> tuple[DataFrame, int | None]:
        """New rows up to the greatest key of this moment, and that key (None: no new rows)."""
        url, table, props = self.source
        last = self.last()
        above = f"(SELECT * FROM {table} WHERE {self.key} > {last}) n" if last is not None else table
        bounds = key_bounds(self.spark, url, above, props, self.key)
        rows = _read_jdbc(self.spark, url, above, props, self.key, bounds, self.parts)
        upto = bounds[1] if bounds else None
        return rows.filter(F.col(self.key) <= upto if bounds else F.lit(False)), upto

    def done(self, key: int | None) -> None:
        if key is not None:
            self.files.mkdirs(self.spark._jvm.org.apache.hadoop.fs.Path(self.path, f"key={key}"))


def load_report(parsed: DataFrame, errors: str = "errors") -> DataFrame:
    """Counts by status, paragraphs, cost, and the errors of all files (an array column, one entry an error) in order."""
    by = [F.count_if(F.col("status") == s).alias(s) for s in ("success", "partial", "failed", "skipped")]
    told = F.sort_array(F.flatten(F.collect_list(errors))) if errors in parsed.columns else F.array().cast("array<string>")
    return parsed.agg(*by, F.sum("n_paragraphs").alias("n_paragraphs"), F.round(F.sum("api_cost"), 4).alias("api_cost"), told.alias("errors"))
