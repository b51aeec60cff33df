"""Readers and writers: directories of documents, JSON stores, Markdown pages."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V
from . import jvm
from .durable import cut, exists, filesystem

_FUNCTIONS = {"Read": "binary", "Write": "bigint"}


def resolved(spark: SparkSession, root: str, shared: bool = False) -> str:
    """A store's root with its scheme, by the session's default file system where it has none.

    ``file:`` on a cluster is an error unless the folder is ``shared``, that is mounted by the driver and all executors.
    """
    fs, where = filesystem(spark, root.rstrip("/"))
    found = fs.makeQualified(where).toString().rstrip("/")
    if found.startswith("file:") and not shared and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError(f"{found} is a folder of each machine's own; name one in a store that all share, or say shared=True")
    return found.replace("file:/", "file:///", 1) if found.startswith("file:/") and not found.startswith("file:///") else found


def _settings(spark: SparkSession) -> Column:
    """What the session says about Hadoop's file systems, for tasks."""
    set_ = spark.sparkContext.getConf().getAll()
    return F.lit("\n".join(f"{k.removeprefix('spark.hadoop.')}={v}" for k, v in sorted(set_) if k.startswith("spark.hadoop.") and "\n" not in v))


def content(spark: SparkSession, path: Column) -> Column:
    """Bytes of the file at ``path``, read by the task; null where there is none."""
    return F.call_function(jvm.functions(spark, Path(__file__).with_name("StoreFiles.java"), _FUNCTIONS)["Read"], path, _settings(spark))


def decode(content: Column | str) -> Column:
    """UTF-8 text without undecodable bytes."""
    return F.replace(F.make_valid_utf8(F.col(content).cast("string") if isinstance(content, str) else content.cast("string")), F.lit("�"), F.lit(""))


def _pdf_text(content: Column) -> Column:
    """Text of PDF files where a reader is installed; else empty."""

    @F.pandas_udf("string")
    def run(blobs):
        import io

        def one(b):
            try:
                from pypdf import PdfReader

                return "\n".join(p.extract_text() or "" for p in PdfReader(io.BytesIO(b)).pages)
            except Exception:
                return ""

        return blobs.map(one)

    return run(content)


def scan(spark: SparkSession, path: str | list[str], pdf: bool = False) -> DataFrame:
    """Files of known kinds below ``path``, or one file: (path, suffix, stem, content, file_hash, text).

    Office files have no text; that of PDF files is read with ``pdf`` (a Python step). Markup stays.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    name = F.substring_index("path", "/", -1)
    dotted = F.instr(F.substring(name, 2, 10_000), ".") > 0
    f = files.withColumns({"suffix": F.when(dotted, F.lower(F.substring_index(name, ".", -1))).otherwise(""), "stem": F.when(dotted, F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)})
    f = f.where(F.col("suffix").isin(list(V.SOURCE_TYPE_BY_SUFFIX)))
    text = F.when(F.col("suffix").isin(V.TEXT_SUFFIXES), decode("content")).otherwise("")
    f = f.withColumn("text", F.when(F.col("suffix") == "pdf", _pdf_text(F.col("content"))).otherwise(text) if pdf else text)
    return f.select("path", "suffix", "stem", "content", F.sha2("content", 256).alias("file_hash"), "text")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array of records; no rows where the file is missing."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def write_json(df: DataFrame, path: str) -> None:
    """Records as JSON lines, replacing what was there, by Spark's committed writer."""
    df.write.mode("overwrite").json(path)


def read_graph(spark: SparkSession, path: str, node: str, edge: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a file of two arrays; a missing file or key is no rows."""
    both = read_json(spark, path, f"nodes array<struct<{_fields(node)}>>, edges array<struct<{_fields(edge)}>>")
    return both.select(F.inline("nodes")), both.select(F.inline("edges"))


def _fields(ddl: str) -> str:
    from pyspark.sql.types import _parse_datatype_string

    return ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in _parse_datatype_string(ddl))


def _placed(path: Column) -> list[Column]:
    """(path relative to the root, page_type, slug) of a page file."""
    rel = F.concat(F.lit("wiki/"), F.substring_index(path, "/wiki/", -1))
    return [rel.alias("path"), F.split(rel, "/")[1].alias("page_type"), F.regexp_replace(F.substring_index(rel, "/", -1), r"\.md$", "").alias("slug")]


def list_pages(spark: SparkSession, root: str) -> DataFrame:
    """(path, page_type, slug, modificationTime) of the Markdown files below ``root``/wiki; no file is opened."""
    got = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(f"{root}/wiki")
    return got.select(*_placed(F.col("path")), "modificationTime")


def read_pages(spark: SparkSession, root: str, since: int = 0) -> DataFrame:
    """(path, page_type, slug, text, modified) of the page files, paths relative to ``root``; of those changed at ``since``
    (milliseconds) or later. Spark skips the others before it opens them."""
    got = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(f"{root}/wiki")
    if since:
        got = got.where(F.col("modificationTime") >= F.timestamp_millis(F.lit(since)))
    return got.select(*_placed(F.col("path")), decode("content").alias("text"), F.unix_millis("modificationTime").alias("modified"))


def _written(files: DataFrame, root: str) -> DataFrame:
    spark = files.sparkSession
    name = jvm.functions(spark, Path(__file__).with_name("StoreFiles.java"), _FUNCTIONS)["Write"]
    done = F.call_function(name, F.concat(F.lit(f"{root}/"), "name"), F.col("content"), _settings(spark))
    return files.select(F.col("name").alias("path"), done.alias("modified"))


def write_files(files: DataFrame, root: str) -> None:
    """One file a row of (name, content): the task that holds the row writes ``root``/``name``, in any store that Hadoop
    reaches, and renames it into place when whole."""
    _written(files, root).write.format("noop").mode("overwrite").save()


def write_pages(pages: DataFrame, root: str) -> DataFrame:
    """One Markdown file a page of (page_type, slug, text), below ``root``/wiki: (path, modified), the times as written."""
    name = F.concat(F.lit("wiki/"), "page_type", F.lit("/"), "slug", F.lit(".md"))
    return cut(_written(pages.select(name.alias("name"), F.encode("text", "UTF-8").alias("content")), root))
