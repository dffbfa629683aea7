"""Duplicates by hash, by title, and the four-stage cascade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from conceptlake.functions import text as X


#: Characters of a title that one long holds; the sum of two such numbers stays in a long.
LIMB = 62
FULL = (1 << LIMB) - 1


def common_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence, by bit-parallel rows: bit i of a row is clear where a's character i adds one.

    A row is as many longs as ``a`` needs; each character of ``b`` takes one step over them, with the carry of one long's sum
    going on into the next.
    """
    limbs = F.transform(F.sequence(F.lit(0), F.floor((F.length(a) - 1) / LIMB).cast("int")), lambda k: F.split(F.substring(a, k * LIMB + 1, F.lit(LIMB)), ""))
    #: for each limb, a map from a character to the bits of its places
    places = F.transform(limbs, lambda chars: F.map_from_entries(F.transform(F.array_distinct(chars), lambda c: F.struct(c.alias("c"), F.aggregate(F.transform(chars, lambda x, i: F.when(x == c, F.expr("1L")).otherwise(F.lit(0).cast("long"))), F.struct(F.lit(0).cast("long").alias("bits"), F.lit(1).cast("long").alias("at")), lambda s, x: F.struct((s["bits"] + x * s["at"]).alias("bits"), (s["at"] * 2).alias("at")), lambda s: s["bits"]).alias("bits")))))

    def step(places: Column, row: Column, c: Column) -> Column:
        def limb(state: Column, pair: Column) -> Column:
            v = pair["row"]
            u = v.bitwiseAND(F.coalesce(pair["places"][c], F.lit(0).cast("long")))
            total = v + u + state["carry"]
            return F.struct(F.shiftrightunsigned(total, LIMB).alias("carry"), F.array_append(state["out"], total.bitwiseAND(F.lit(FULL)).bitwiseOR(v - u)).alias("out"))

        begin = F.struct(F.lit(0).cast("long").alias("carry"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(F.arrays_zip(row.alias("row"), places.alias("places")), begin, limb, lambda s: s["out"])

    def length(places: Column) -> Column:
        full = F.transform(places, lambda _: F.lit(FULL))
        last = F.aggregate(F.split(b, ""), full, lambda row, c: step(places, row, c))
        return F.aggregate(F.transform(last, lambda v: LIMB - F.bit_count(v)), F.lit(0), lambda s, x: s + x)

    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0).otherwise(F.transform(F.array(places), length)[0])


def title_similarity(a: Column | str, b: Column | str) -> Column:
    """0 to 100: twice the longest common subsequence over the lengths, in any case and without blanks around; null titles are empty, and two empty ones equal."""
    x, y = (F.lower(F.trim(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))) for c in (a, b))
    both = F.length(x) + F.length(y)
    return F.when(both == 0, 100).otherwise(F.bround(200 * common_length(x, y) / both).cast("int"))


def duplicate_sets(docs: DataFrame, key=X.compact_hash) -> DataFrame:
    """hash, n, first: texts that occur more than once."""
    return docs.groupBy(key(F.col("text")).alias("hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1")


def keep_first(docs: DataFrame) -> DataFrame:
    """doc_id of the first document of each text."""
    return docs.groupBy(X.compact_hash(F.col("text")).alias("hash")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


def new_documents(docs: DataFrame, store: DataFrame) -> DataFrame:
    """Documents that neither repeat one before them in the batch nor one in the store."""
    first = docs.join(keep_first(docs), "doc_id", "left_semi").withColumn("hash", X.compact_hash(F.col("text")))
    return first.join(store.select("hash").distinct(), "hash", "left_anti")


def normal_title(title: Column | str = "title") -> Column:
    return F.lower(F.trim(title))


def title_pairs(a: DataFrame, b: DataFrame, least: int = 90) -> DataFrame:
    """ta, tb, similarity: pairs of different normal titles (ta of a, tb of b) at ``least`` or more.

    With r for the share of edits that the ratio allows (insertions and deletions, over both lengths), a title of n
    characters is at most 2rn / (1 - r) edits from its partner, and an edit takes three 3-grams at most. So two titles
    have a common one among the first 3-grams in hash order: as many as may be lost, and one. Titles that may lose all
    meet by their lengths instead.
    """
    r = (100.5 - least) / 100

    def keyed(rows: DataFrame, side: str, lengths) -> DataFrame:
        rows = rows.select(f"t{side}", F.length(f"t{side}").alias(f"n{side}"))
        n = F.col(f"n{side}")
        grams = F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.xxhash64(F.substring(f"t{side}", i, F.lit(3))))))
        rows = rows.select("*", grams.alias("grams"), (3 * F.floor(n * (2 * r / (1 - r)))).cast("int").alias("lost"))
        by_length = F.transform(lengths(n), lambda x: F.xxhash64(F.lit("length"), x))
        keys = F.concat(F.slice("grams", 1, F.col("lost") + 1), F.when(F.size("grams") <= F.col("lost"), by_length).otherwise(F.array().cast("array<bigint>")))
        return rows.select(f"t{side}", f"n{side}", F.explode(keys).alias("key"))

    around = lambda n: F.sequence(F.floor(n * ((1 - r) / (1 + r))).cast("int"), F.ceil(n * ((1 + r) / (1 - r))).cast("int"))
    fits = F.abs(F.col("na") - F.col("nb")) <= r * (F.col("na") + F.col("nb"))
    pairs = keyed(a, "a", around).join(keyed(b, "b", lambda n: F.array(n)), "key").where(fits).select("ta", "tb").distinct()
    return pairs.withColumn("similarity", title_similarity("ta", "tb")).where(F.col("similarity") >= least)


def similar_titles(a: DataFrame, b: DataFrame, least: int = 90) -> DataFrame:
    """a_id, b_id, similarity: pairs of titles at ``least`` or more. Equal titles are compared once, then joined by their rows."""
    x, y = (rows.where("title is not null").select(F.col("doc_id").alias(f"{side}_id"), normal_title().alias(f"t{side}")) for rows, side in ((a, "a"), (b, "b")))
    pairs = title_pairs(x.select("ta").distinct(), y.select("tb").distinct(), least)
    return x.join(pairs, "ta").join(y, "tb").select("a_id", "b_id", "similarity")


def cascade(docs: DataFrame, store: DataFrame) -> DataFrame:
    """doc_id, existing_id, method: content hash, else metadata hash, else file path, else a similar title.

    Titles that are equal in any case and without blanks around are compared once.
    """
    out = docs.select("doc_id", normal_title().alias("ta"), "content_hash", "metadata_hash", "file_path")
    found = []
    for key in ("content_hash", "metadata_hash", "file_path"):
        hit = store.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("doc_id").alias(f"by_{key}"))
        out = out.join(hit, key, "left")
        found.append(key)
    known = store.where("title is not null").groupBy(normal_title().alias("tb")).agg(F.min("doc_id").alias("b_id"))
    titles = docs.where("title is not null").select(normal_title().alias("ta")).distinct()
    near = title_pairs(titles, known.select("tb")).join(known, "tb").groupBy("ta").agg(F.min("b_id").alias("by_title"))
    out = out.join(near, "ta", "left")
    keys = [*found, "title"]
    method = F.coalesce(*(F.when(F.col(f"by_{k}").isNotNull(), k) for k in keys))
    return out.select("doc_id", F.coalesce(*(F.col(f"by_{k}") for k in keys)).alias("existing_id"), method.alias("method"))


def report(docs: DataFrame) -> DataFrame:
    """total_documents, unique_documents, duplicate_sets."""
    per = docs.groupBy(X.compact_hash(F.col("text")).alias("hash")).agg(F.count("*").alias("n"))
    return per.agg(F.sum("n").alias("total_documents"), F.count("*").alias("unique_documents"), F.count_if(F.col("n") > 1).alias("duplicate_sets"))
