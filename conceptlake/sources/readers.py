"""Documents from folders: text, JSON, Markdown, HTML, PDF (by a plug-in), and job logs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from conceptlake.functions import text as X

STEM = r"([^/]+?)(?:\.[^./]*)?$"


def _files(spark: SparkSession, folder: str, pattern: str, recursive: bool) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(folder)


def text_files(spark: SparkSession, folder: str, pattern: str = "*.txt", recursive: bool = True) -> DataFrame:
    """One document a file; UTF-8, else Latin-1."""
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).otherwise(F.decode("content", "ISO-8859-1"))
    return _files(spark, folder, pattern, recursive).select(F.col("path").alias("file_path"), F.regexp_extract("path", STEM, 1).alias("title"), F.lit("Text File").alias("source"), text.alias("text"))


def json_files(spark: SparkSession, folder: str, schema: str | None = None, recursive: bool = True) -> DataFrame:
    """One object a file; ``text`` is the document, all other fields its metadata; empty texts and files without an object are left out.

    Without a schema no field need be known: values that are no strings stand in the metadata as JSON. With one, its
    fields alone are read.
    """
    if schema is None:
        raw = text_files(spark, folder, "*.json", recursive).withColumn("v", X.open_json(F.col("text")))
        meta = F.map_filter(X.open_fields(F.col("text")), lambda k, v: (k != "text") & v.isNotNull())
        rows = raw.select("file_path", F.try_variant_get("v", "$.text", "string").alias("text"), F.lit("JSON File").alias("source"), meta.alias("metadata"))
        return rows.where(F.length("text") > 0)
    rows = spark.read.schema(schema).option("multiLine", "true").option("pathGlobFilter", "*.json").option("recursiveFileLookup", str(recursive).lower()).json(folder)
    rest = [c for c in rows.columns if c != "text"]
    rows = rows.withColumn("file_path", F.col("_metadata.file_path"))
    meta = F.map_filter(F.create_map(*[x for c in rest for x in (F.lit(c), F.col(c).cast("string"))]), lambda k, v: v.isNotNull())
    return rows.where(F.length("text") > 0).select("file_path", "text", F.lit("JSON File").alias("source"), meta.alias("metadata"))


FRONT_MATTER = r"(?s)\A---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\z)"
CODE = r"(```.*?```|`[^`\n]+`)"


def _emphasis(mark: str, group: int) -> str:
    """What stands between two equal runs of a mark, with code inside as it is; no letter or digit stands before or after."""
    inner = rf"[^{mark}`]*+(?:`[^`\n]+`[^{mark}`]*+)*+"
    return rf"(?<![\p{{L}}\p{{N}}{mark}])([{mark}]{{1,3}})(?=[^\s{mark}])({inner})(?<!\s)\{group}(?![\p{{L}}\p{{N}}{mark}])"


def markdown_text(text: Column) -> Column:
    """Markdown without its marks: headings, emphasis at word borders, links and images as their text; code stays as it is written."""
    # code comes first in each pattern and is put back, so that no mark within it is touched
    text = F.regexp_replace(text, rf"(?sm){CODE}|^[ ]{{0,3}}#{{1,6}}[ \t]+", "$1")
    text = F.regexp_replace(text, rf"(?s){CODE}|!?\[([^\]\n]*)\]\([^)\n]*\)", "$1$2")
    for _ in range(2):  # emphasis within emphasis
        text = F.regexp_replace(text, f"(?s){CODE}|{_emphasis('*', 2)}|{_emphasis('_', 4)}", "$1$3$5")
    # code that looks like tags or references is no HTML
    escaped = lambda code: F.replace(F.replace(code, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    fence = lambda x: F.regexp_replace(x, r"(?s)\A```[^\n]*\n?(.*?)```\z", "$1")
    parts = F.regexp_extract_all(text, F.lit(rf"(?s)({CODE}|[^`]+|`)"), F.lit(1))
    plain = F.transform(parts, lambda x: F.when(x.startswith("```") & (F.length(x) > 5), escaped(fence(x))).when(x.startswith("`") & (F.length(x) > 2), escaped(F.substring(x, F.lit(2), F.length(x) - 2))).otherwise(x))
    return X.strip_html(F.array_join(plain, ""))


def markdown_files(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """Front matter as a metadata map; the body without marks."""
    rows = text_files(spark, folder, "*.md", recursive)
    front = F.regexp_extract("text", FRONT_MATTER, 1)
    meta = F.when(front != "", F.transform_values(F.str_to_map(front, F.lit("\r?\n"), F.lit(":")), lambda k, v: F.trim(v)))
    body = F.regexp_replace("text", FRONT_MATTER, "")
    return rows.select("file_path", "title", F.lit("Markdown File").alias("source"), markdown_text(body).alias("text"), meta.alias("metadata"))


def html_files(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    return text_files(spark, folder, "*.html", recursive).withColumn("text", X.strip_html(F.col("text")))


def pdf_files(spark: SparkSession, folder: str, parse: Callable[[bytes], tuple[str, dict[str, str]]], recursive: bool = True) -> DataFrame:
    """Text and metadata by ``parse``, which holds the PDF library."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [parse(c) for c in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t for t, _ in got]), pa.array([list(m.items()) for _, m in got], pa.map_(pa.string(), pa.string()))], ["file_path", "text", "metadata"])

    return _files(spark, folder, "*.pdf", recursive).select("path", "content").mapInArrow(run, "file_path string, text string, metadata map<string,string>")


#: Reader by file ending; JSON and PDF files take what they need from the arguments of ``folder``.
READERS = {".txt": text_files, ".md": markdown_files, ".html": html_files}


def folder(spark: SparkSession, path: str, endings: tuple[str, ...] = (".txt", ".md"), recursive: bool = True, json_schema: str | None = None, parse_pdf: Callable | None = None) -> DataFrame:
    """file_path, title, source, text of all files of the endings, a file once; an ending without a reader is an error."""
    out = None
    for e in dict.fromkeys(endings):
        if e in READERS:
            rows = READERS[e](spark, path, recursive=recursive)
        elif e == ".json":
            rows = json_files(spark, path, json_schema, recursive).withColumn("title", F.coalesce(F.col("metadata")["title"], F.regexp_extract("file_path", STEM, 1)))
        elif e == ".pdf" and parse_pdf:
            rows = pdf_files(spark, path, parse_pdf, recursive).select("*", F.coalesce(F.col("metadata")["title"], F.regexp_extract("file_path", STEM, 1)).alias("title"), F.lit("PDF File").alias("source"))
        else:
            raise ValueError(f"no reader for {e}")
        rows = rows.select("file_path", "title", "source", "text")
        out = rows if out is None else out.unionByName(rows)
    return out


def paths(spark: SparkSession, path: str, endings: tuple[str, ...], recursive: bool = True) -> DataFrame:
    """file_path of the files of the endings, each once, in order; no content is read."""
    pattern = "*{" + ",".join(dict.fromkeys(endings)) + "}"
    return _files(spark, path, pattern, recursive).select(F.col("path").alias("file_path")).distinct().orderBy("file_path")


def job_log(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Jobs from JSON files; those that ran when the log was left have failed."""
    return spark.read.schema(schema).json(folder).withColumn("status", F.when(F.col("status") == "running", "failed").otherwise(F.col("status")))


def by_ids(table: DataFrame, ids: list) -> DataFrame:
    return table.where(F.col("id").isin(ids))


def sample(table: DataFrame, n: int = 20, seed: int = 0) -> DataFrame:
    """The same ``n`` rows in every run."""
    return table.orderBy(F.xxhash64(F.col(table.columns[0]), F.lit(seed)), table.columns[0]).limit(n)
