"""Chunkers as expressions on a text: fixed windows, sentence splits, and greedy packing as a fold over the lengths of a text's parts."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from conceptlake.functions import text as X


def fixed_windows(text: Column, size: int = 1000, overlap: int = 200) -> Column:
    """Windows at a stride of size - overlap; the last reaches the end; a short text is one window."""
    stride = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.length(text) - size) / stride)).cast("int"))
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.transform(starts, lambda i: F.substring(text, i * stride + 1, F.lit(size))))


def sliding_windows(text: Column, size: int = 3000, overlap: int = 500) -> Column:
    """All windows whose start is in the text; the last may be suffixes."""
    stride = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(stride))
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.transform(starts, lambda i: F.substring(text, i + 1, F.lit(size))))


def sentences(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), r"(?<=[.!?])\s+")


#: White space of any script, and without the line end.
WS = r"[\s\x0B\x1c-\x1f\x85\p{Z}]"
BLANK = r"[\t\x0B\f\r\x1c-\x1f\x85\p{Z}]"
#: White space that isn't one blank.
RUNS = WS + r"{2,}|[\s\x0B\x1c-\x1f\x85\p{Z}&&[^ ]]"


class Space(NamedTuple):
    """White space: any, within a line, at a whole text's ends and at a chunk's ends."""

    any: str
    blank: str
    text_ends: str
    ends: str

    @property
    def sentence_end(self) -> str:
        """What follows a sentence's end; the class comes first, since it fails at most characters."""
        return f"{self.any}(?<=[.!?]{self.any}){self.any}*"


#: Of any script, and line ends go at both ends; and as the queries' SQL has it: ASCII, and a chunk loses blanks alone.
ANY_SPACE = Space(WS, BLANK, WS, WS)
SQL_SPACE = Space(r"[\t\n\f\r ]", r"[ \t\x0B\f\r]", r"[\n ]", r"\p{Zs}")
RANGES = "array<struct<a:int,b:int,over:boolean>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def strip(text: Column, ends: str = WS) -> Column:
    return let(text, lambda t: F.when(F.left(t, F.lit(1)).rlike(ends) | F.right(t, F.lit(1)).rlike(ends), F.regexp_replace(t, rf"\A{ends}+|{ends}+\z", "")).otherwise(t))


def pack_sentences(text: Column, size: int = 4000, overlap: int = 400) -> Column:
    """Greedy packing of sentences; a new chunk begins with the tail of the last one: what follows its last sentence end, else all of the tail."""
    parts = F.filter(F.split(F.trim(F.regexp_replace(text, RUNS, " ")), ANY_SPACE.sentence_end), lambda s: s != "")

    def tail(now: Column) -> Column:
        end = F.right(now, F.lit(overlap))
        open_end = F.trim(F.regexp_extract(end, r"(?:[.!?]\s+|^)([^.!?]*)$", 1))
        return let(F.when(open_end != "", open_end).otherwise(F.trim(end)), lambda t: F.when(t != "", F.concat(t, F.lit(" "))).otherwise(t))

    def add(acc: Column, s: Column) -> Column:
        more = F.struct(F.concat(acc["now"], s, F.lit(" ")).alias("now"), acc["out"].alias("out"))
        new = F.struct(F.concat(tail(acc["now"]) if overlap else F.lit(""), s, F.lit(" ")).alias("now"), F.array_append(acc["out"], F.trim(acc["now"])).alias("out"))
        return F.when((acc["now"] != "") & (F.length(acc["now"]) + F.length(s) + 1 > size), new).otherwise(more)

    begin = F.struct(F.lit("").alias("now"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(parts, begin, add, lambda acc: F.when(F.trim(acc["now"]) != "", F.array_append(acc["out"], F.trim(acc["now"]))).otherwise(acc["out"]))


def cleaned(text: Column, preserve_paragraphs: bool = True, space: Space = ANY_SPACE) -> Column:
    """Line ends as \\n, runs of blanks as one, blank lines as one; without ``preserve_paragraphs`` blank lines between texts are blanks too."""
    text = F.regexp_replace(text, r"\r\n?", "\n")
    # most texts have single blanks alone, which stay
    text = let(text, lambda t: F.when(t.rlike(RUNS), F.regexp_replace(t, rf"([^\n]){space.blank if preserve_paragraphs else space.any}+([^\n])", "$1 $2")).otherwise(t))
    return strip(F.regexp_replace(text, rf"\n{space.any}*\n{space.any}*", "\n\n"), space.text_ends)


def windows(text: Column, size: Column, overlap: Column, legacy_suffix: bool = False, space: Space = ANY_SPACE) -> Column:
    """Cuts of ``size`` of a longer text at a stride of size - overlap up to the first that reaches the end; a legacy suffix is one more cut within the last."""
    stride = size - overlap
    last = F.length(text) - 1 if legacy_suffix else F.ceil((F.length(text) - size) / stride).cast("int") * stride
    return F.transform(F.sequence(F.lit(0), last, stride), lambda a: strip(F.substring(text, a + 1, size), space.ends))


def packed(lengths: Column, size: Column, overlap: Column) -> Column:
    """Which parts make a chunk, from their lengths: ranges a to b, from 0, or one part that is over the size.

    Each part is followed by a blank, which counts. A new chunk begins with the last one's trailing whole parts of up to
    ``overlap``, if the last one is longer than that.
    """
    range_ = lambda a, b, over: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"), F.lit(over).alias("over"))
    state = lambda i, first, length, out: F.struct(i.cast("int").alias("i"), first.cast("int").alias("first"), length.cast("int").alias("length"), out.alias("out"))

    def closed(acc: Column) -> Column:
        return F.when(acc["length"] > 0, F.array_append(acc["out"], range_(acc["first"], acc["i"] - 1, False))).otherwise(acc["out"])

    def kept(acc: Column) -> Column:
        """Number and length of the trailing parts that go on."""
        last = F.reverse(F.slice(lengths, acc["first"] + 1, acc["i"] - acc["first"]))
        none = F.struct(F.lit(0).alias("n"), F.lit(0).alias("sum"), F.lit(True).alias("open"))
        one = lambda k, x: F.when(k["open"] & (k["sum"] + x <= overlap), F.struct((k["n"] + 1).alias("n"), (k["sum"] + x).alias("sum"), F.lit(True).alias("open"))).otherwise(F.struct(k["n"], k["sum"], F.lit(False).alias("open")))
        return F.aggregate(last, none, one)

    def add(acc: Column, n: Column) -> Column:
        i, length = acc["i"], acc["length"]
        over = state(i + 1, i + 1, F.lit(0), F.array_append(closed(acc), range_(i, i, True)))
        again = let(kept(acc), lambda k: state(i + 1, i - k["n"], F.greatest(F.lit(1), k["sum"] + k["n"]) + n + 1, closed(acc)))
        anew = state(i + 1, i, n + 1, closed(acc))
        more = state(i + 1, F.when(length == 0, i).otherwise(acc["first"]), length + n + 1, acc["out"])
        full = (length > 0) & (length + n > size)
        return F.when(n > size, over).when(full & (length > overlap), again).when(full, anew).otherwise(more)

    return F.aggregate(lengths, state(F.lit(0), F.lit(0), F.lit(0), F.array().cast(RANGES)), add, closed)


def semantic_chunks(text: Column, size: int | Column = 1000, overlap: int | Column = 200, preserve_paragraphs: bool = True, legacy_suffix: bool = False, space: Space = ANY_SPACE) -> Column:
    """Paragraphs, oversize ones as sentences, packed up to ``size`` with trailing whole parts of up to ``overlap`` again; oversize sentences are cut."""
    if isinstance(size, Column) or isinstance(overlap, Column):  # computed once a text
        both = F.struct(*(F.lit(x).alias(n) if isinstance(x, int) else x.alias(n) for x, n in ((size, "size"), (overlap, "overlap"))))
        return let(both, lambda v: _semantic(text, v["size"], v["overlap"], preserve_paragraphs, legacy_suffix, space))
    return _semantic(text, F.lit(size), F.lit(overlap), preserve_paragraphs, legacy_suffix, space)


def _semantic(text: Column, size: Column, overlap: Column, preserve_paragraphs: bool, legacy_suffix: bool, space: Space) -> Column:
    paragraphs = F.split(cleaned(text, preserve_paragraphs, space), rf"\n{space.any}*\n")
    parts = F.filter(F.flatten(F.transform(paragraphs, lambda p: F.when(F.length(p) <= size, F.array(p)).otherwise(F.split(p, space.sentence_end)))), lambda p: p != "")

    def chunk(parts: Column, r: Column) -> Column:
        cut = windows(F.get(parts, r["a"]), size, overlap, legacy_suffix, space)
        return F.when(r["over"], cut).otherwise(F.array(strip(F.array_join(F.slice(parts, r["a"] + 1, r["b"] - r["a"] + 1), " "), space.ends)))

    ranges = lambda parts: let(F.transform(parts, F.length), lambda lengths: packed(lengths, size, overlap))
    return F.filter(let(parts, lambda p: F.flatten(F.transform(ranges(p), lambda r: chunk(p, r)))), lambda x: x != "")


def break_chunks(text: Column, size: int = 4000) -> Column:
    """Cuts after the last blank line, else the last sentence end, else hard, within each window; the last piece keeps its blanks."""
    pieces = F.regexp_extract_all(text, F.lit(rf"(?s)(.{{1,{size}}}\z|.{{1,{size - 2}}}\n\n|.{{1,{size - 2}}}\. |.{{{size}}})"), F.lit(1))
    return F.filter(let(pieces, lambda p: F.transform(p, lambda x, i: F.when(i == F.size(p) - 1, x).otherwise(strip(x)))), lambda x: x != "")


def chunk_rows(docs: DataFrame, chunks: Column, id_col: str = "doc_id") -> DataFrame:
    """doc_id, chunk_id, chunk_index, total_chunks, chunk_size, chunk_hash, text of every chunk of an array of chunks; whole texts, no shuffle.

    Null and empty texts have no chunk.
    """
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), chunks.alias("_chunks"))
    rows = rows.select("doc_id", F.size("_chunks").alias("total_chunks"), F.posexplode("_chunks").alias("chunk_index", "text"))
    return rows.select("doc_id", F.concat("doc_id", F.lit("-chunk-"), F.col("chunk_index")).alias("chunk_id"), "chunk_index", "total_chunks", F.length("text").alias("chunk_size"), F.sha2(F.trim(F.lower(F.regexp_replace("text", r"\s+", " "))), 256).alias("chunk_hash"), "text")


def window_rows(docs: DataFrame, windows: Column, id_col: str = "doc_id") -> DataFrame:
    return docs.select(id_col, F.posexplode(windows).alias("chunk_index", "text"))


def rechunk(chunks: DataFrame, chunker: Callable[[Column], Column]) -> DataFrame:
    """Chunks joined by their source in index order and cut anew."""
    whole = chunks.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))), lambda x: x["text"]), " ").alias("text"))
    return chunk_rows(whole, chunker(F.col("text")))


def half(overlap: int) -> Column:
    """The overlap, half of a row's ``_size`` at most."""
    return F.least(F.lit(overlap), F.floor(F.col("_size") / 2).cast("int"))


def document_chunks(docs: DataFrame, size: int = 1000, overlap: int = 200, space: Space = ANY_SPACE) -> DataFrame:
    """Chunk rows of whole documents: doc_id, chunk_id, chunk_index, total_chunks, chunk_size, chunk_hash, text and the document's metadata.

    The size of a document's chunks follows from its text (``adaptive_chunk_size``). Metadata are all other columns, with
    content_hash and metadata_hash (of title, author, isbn and file_path as far as they exist), lists as one string, and
    lower-case forms of title, name, category and author. Null and empty texts have no chunk.
    """
    lists = {c for c, kind in docs.dtypes if kind == "array<string>"}
    sized = docs.withColumn("_size", X.adaptive_chunk_size(F.col("text"), size))
    about = X.lower_fields(X.with_hashes(docs.withColumns({c: X.metadata_text(F.col(c)) for c in lists}))).drop("text")
    chunks = chunk_rows(sized, semantic_chunks(F.col("text"), F.col("_size"), half(overlap), space=space))
    return chunks.join(about.withColumn("doc_id", F.col("doc_id").cast("string")), "doc_id")


def extraction_chunks(docs: DataFrame, size: int = 2500, overlap: int = 300) -> DataFrame:
    """Chunk rows for a model that extracts concepts: sized by the text, then semantic."""
    sized = docs.select("doc_id", "text", X.adaptive_chunk_size(F.col("text"), size).alias("_size"))
    return chunk_rows(sized, semantic_chunks(F.col("text"), F.col("_size"), half(overlap)))


def batches(df: DataFrame, order: str, size: int = 100, ranges: int | None = None) -> DataFrame:
    """Rows with the number of their batch in the order of a numeric or time column, for writers that need one.

    Each range of the column is numbered on its own and shifted by the rows of those before it, so no single task sorts
    all. Nulls come first; rows of equal values are ordered by a hash of all columns.
    """
    value = F.col(order).cast("double")
    ranges = ranges or max(64, df.count() // 1_000_000)  # a million rows each
    cuts = df.select(F.percentile_approx(value, [k / ranges for k in range(1, ranges)], max(10_000, 10 * ranges))).first()[0] or []
    of = sum((F.when(value > c, 1).otherwise(0) for c in sorted(set(cuts))), F.lit(0))
    rows = df.withColumn("_range", of)
    sums = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = rows.groupBy("_range").agg(F.count("*").alias("n")).select("_range", F.coalesce(F.sum("n").over(sums), F.lit(0)).alias("_shift"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(F.asc_nulls_first(order), F.xxhash64(*df.columns))) - 1
    # a row for each range is sent to all tasks
    out = rows.withColumn("_place", place).join(F.broadcast(shift), "_range")
    return out.withColumn("batch", F.floor((F.col("_place") + F.col("_shift")) / size)).drop("_range", "_place", "_shift")
