"""Document fingerprints by Order MinHash, in DataFrame expressions only.

A text's k-mers are runs of two words (the last word alone is one too), each with the
number of its earlier occurrences. Their hashes fall into ``BINS`` bins; of each bin
the two smallest numbered k-mers are selected, put back in text order, and hashed as a
tuple. A bin with one k-mer takes the smallest of the next filled bin as its second, so
that in short texts too each tuple holds two. Equal tuples in a bin need equal k-mers,
equal repetition and equal order, so the share of equal bins falls with the edit distance.

The bins take the place of independent hash functions: one pass over the k-mers
serves all, and a bin that neither text fills does not count. A fingerprint is a
string of 8 hex digits for each filled bin (2 of the bin, 6 of the tuple).

Null text is as empty; texts without words have an empty fingerprint, and are alike
(1) only among themselves. A null id has no next document: its edited text ends
where the replaced part began, and its likeness to the next is null. Of documents
that repeat an id, the smallest replacement counts as the text of the next, and the
smallest fingerprint as its fingerprint. Words beyond the first 2**24 of a text count
as standing at one place. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize, table, with_rank

BINS = 64
BIN_SHIFT = 57
#: Bits of a packed long that hold a k-mer's place in the text.
PLACE = 24
PLACES = (1 << PLACE) - 1


def _steps(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out``: an int for each filled bin (bin in the high byte, tuple hash below)."""
    rest = [c for c in df.columns if c != out]
    w, s, b, t, p = (f"_{out}_{x}" for x in "wsbtp")
    df = df.select(*rest, F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+"), "").alias(w))
    # hash of each k-mer above its place
    kmers = F.expr(f"sort_array(transform({w}, (x, i) -> shiftleft(xxhash64(x, get({w}, i + 1)), {PLACE}) | least(i, {PLACES})))")
    df = df.select(*rest, kmers.alias(s))
    begins = F.expr(f"filter(if(size({s}) = 0, cast(array() as array<int>), sequence(0, size({s}) - 1)), i -> i = 0 or shiftright(get({s}, i), {PLACE}) <> shiftright(get({s}, i - 1), {PLACE}))")
    df = df.select(*rest, s, begins.alias(b))
    # occurrence numbers 0, 1, ... within each run of equal k-mers; zip_with evaluates them once a row, a lambda would once an element
    numbers = f"flatten(transform({b}, (v, j) -> if(coalesce(get({b}, j + 1), size({s})) - v = 1, array(0), sequence(0, coalesce(get({b}, j + 1), size({s})) - v - 1))))"
    numbered = F.expr(f"sort_array(zip_with({s}, {numbers}, (v, o) -> (xxhash64(shiftright(v, {PLACE}), o) & {(1 << 63) - 1 - PLACES}L) | (v & {PLACES})))")
    df = df.select(*rest, numbered.alias(t))
    least = F.expr(f"filter({t}, (v, i) -> i < 2 or shiftright(get({t}, i - 2), {BIN_SHIFT}) <> shiftright(v, {BIN_SHIFT}))")
    df = df.select(*rest, least.alias(p))
    second = f"coalesce(get({p}, i + 1), get({p}, 0))"
    low, high = f"shiftright(v, {PLACE})", f"shiftright({second}, {PLACE})"
    pair = f"if(size({p}) = 1, xxhash64({low}), if((v & {PLACES}) < ({second} & {PLACES}), xxhash64({low}, {high}), xxhash64({high}, {low})))"
    tuples = F.expr(f"filter(transform({p}, (v, i) -> if(i = 0 or shiftright(get({p}, i - 1), {BIN_SHIFT}) <> shiftright(v, {BIN_SHIFT}), cast(shiftleft(shiftright(v, {BIN_SHIFT}), 24) | ({pair} & 16777215) as int), -1)), x -> x >= 0)")
    return df.select(*rest, tuples.alias(out))


def with_fingerprint(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """Adds the fingerprint string of a text column."""
    return _steps(df, text, "_omh").withColumn(out, rendered("_omh")).drop("_omh")


def rendered(bins: str) -> Column:
    return F.expr(f"array_join(transform({bins}, x -> lower(lpad(hex(x), 8, '0'))), '')")


def likeness(a: str, b: str) -> Column:
    """Share of equal tuples among the bins that either has; 1 for two empty fingerprints."""
    both = f"size(array_union(transform({a}, x -> shiftright(x, 24)), transform({b}, x -> shiftright(x, 24))))"
    return F.expr(f"if(size({a}) + size({b}) = 0, 1.0D, size(array_intersect({a}, {b})) / cast({both} as double))")


def neighbours(docs: DataFrame) -> DataFrame:
    """doc_id, next_id (after the last: the first), need: most code points of the next that the id's texts take."""
    ids = materialize(with_rank(docs, "doc_id", "rank"))
    n = ids.count()
    after = ids.select(F.col("doc_id").alias("next_id"), F.pmod(F.col("rank") - 1, F.lit(max(n, 1))).alias("rank"))
    need = docs.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.floor(F.length("text") / 4)).cast("int").alias("need"))
    return materialize(ids.join(after, "rank").join(need, "doc_id").select("doc_id", "next_id", F.coalesce("need", F.lit(0)).alias("need")))


def edited(docs: DataFrame, near: DataFrame) -> DataFrame:
    """doc_id, text and its edited text: the last quarter replaced by the beginning of the next document."""
    docs = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    asked = near.select(F.col("next_id").alias("doc_id"), F.col("doc_id").alias("prev"), "need")
    # both joins take the same rows by the same key, so that the texts are shuffled once
    known, rest = docs.where("doc_id is not null"), docs.where("doc_id is null")
    heads = known.join(asked, "doc_id").select("prev", F.substring("text", F.lit(1), F.col("need")).alias("head"))
    heads = heads.groupBy("prev").agg(F.min("head").alias("head")).withColumnRenamed("prev", "doc_id")
    cut = F.floor(F.length("text") / 4).cast("int")
    keep = F.substring("text", F.lit(1), F.length("text") - cut)
    both = known.join(heads, "doc_id", "left").unionByName(rest.withColumn("head", F.lit(None).cast("string")))
    return both.select("doc_id", "text", F.concat(keep, F.substring(F.coalesce("head", F.lit("")), F.lit(1), cut)).alias("edited"))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    # an id that is long already gets no cast: an alias on one side alone would keep the joins from sharing their shuffle
    docs = docs.select("doc_id" if dict(docs.dtypes)["doc_id"] == "bigint" else F.col("doc_id").cast("long"), "text")
    near = neighbours(docs)
    rows = edited(docs, near).select("doc_id", "text", "edited", F.length("text").cast("long").alias("n_chars"), F.sha2(F.encode("edited", "utf-8"), 256).alias("edited_sha256"))
    rows = _steps(rows, "text", "a").drop("text")
    rows = materialize(_steps(rows, "edited", "e").drop("edited"))
    nexts = near.join(rows.groupBy(F.col("doc_id").alias("next_id")).agg(F.min("a").alias("b")), "next_id").select("doc_id", "b")
    rows = rows.join(nexts, "doc_id", "left")
    return rows.select("doc_id", "n_chars", "edited_sha256", rendered("a").alias("fingerprint"), rendered("e").alias("edited_fingerprint"), likeness("a", "e").alias("near_edited"), F.when(F.col("b").isNotNull(), likeness("a", "b")).alias("near_next"))


def op1_document_fingerprints(spark, sf_dir) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))
