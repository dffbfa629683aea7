"""Mixing sources to target weights.

Tokens are summed per source, targets are shares of the total by weight, and a
document is emitted floor(rate) times plus once more with the probability of the
fraction, decided by a hash of its id and a seed.

Sources by code point, null last, weigh 1, 2, 3, repeating. A target stops at
``most`` times its source's size; the excess is shared again by weight until none
is above. The final shares are one level for all sources below their stop, found
by a running sum over the sources in the order in which they reach theirs.

Rows: null text has size 0 and is never taken words of; null source is a source of
its own, null doc_id hashes as an id of its own. Repeated rows are decided alike.
An empty table gives an empty result. Other columns, whatever their names, are carried
by ``mixed`` and ignored by ``plan``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, table, with_rank, word_count

#: Sources that are joined by broadcast (each is a name and four numbers); beyond, the sources are repeated for salts.
SENT_SOURCES = 1000
SALTS = 32


def targets(sizes: DataFrame, weights: int = 3, most: int = 3) -> DataFrame:
    """source, source_size, target, rate from (source, size) rows."""
    per = materialize(sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size")))
    ranks = with_rank(per, "source", "_rank")
    n = per.where("source is not null").count()
    per = per.join(ranks, "source", "left").withColumn("w", (F.coalesce("_rank", F.lit(n)) % weights + 1).cast("long"))
    per = materialize(per.withColumn("cap", F.col("source_size") * most).select("source", "source_size", "w", "cap"))
    total = per.agg(F.sum("source_size"), F.sum("w")).first()
    level, words, weight = None, total[0] or 0, total[1] or 0
    stopped = -1
    while weight:  # every round stops at least one more source
        level = words / weight
        out = per.where(F.col("cap") < F.col("w") * F.lit(level)).agg(F.count("*"), F.sum("cap"), F.sum("w")).first()
        if out[0] == stopped:
            break
        stopped, words, weight = out[0], total[0] - (out[1] or 0), total[1] - (out[2] or 0)
    target = F.when(F.col("cap") < F.col("w") * F.lit(level), F.col("cap").cast("double")).otherwise(F.col("w") * F.lit(level)) if level is not None else F.col("cap").cast("double")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return per.withColumn("target", target.cast("double")).withColumn("rate", F.least(rate, F.lit(float(most)))).select("source", "source_size", "target", "rate")


def chance(id_col: str = "doc_id", seed: int = 0):
    """A number in [0, 1) from the id and the seed: 52 bits of MD5, the same in any engine."""
    text = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def _with_targets(sized: DataFrame, found: DataFrame) -> DataFrame:
    """``sized`` (doc_id, source, ...) with source_size, target and rate."""
    found = materialize(found)
    same = F.col("_s").eqNullSafe(F.col("source"))
    found = found.withColumnRenamed("source", "_s")
    if found.count() <= SENT_SOURCES:
        return sized.join(F.broadcast(found), same, "left").drop("_s")
    found = found.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    sized = sized.withColumn("_row", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    return sized.join(found, same & (F.col("_row") == F.col("_salt")), "left").drop("_s", "_salt", "_row")


def copies(seed: int = 0):
    whole = F.floor("rate")
    return (whole + (chance("doc_id", seed) < F.col("rate") - whole).cast("long")).cast("long")


def plan(docs: DataFrame, weights: int = 3, most: int = 3, seed: int = 0) -> DataFrame:
    """doc_id, size, source_size, target, taken (size times copies) of every row."""
    # words are counted once; the sizes are a few bytes a row
    sized = materialize(docs.select("doc_id", "source", word_count("text").alias("size")))
    out = _with_targets(sized, targets(sized, weights, most))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * copies(seed)).alias("taken"))


def mixed(docs: DataFrame, weights: int = 3, most: int = 3, seed: int = 0) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of ``docs``."""
    sized = docs.select("source", word_count("text").alias("size"))
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "doc_id", "source")
    out = _with_targets(row, targets(sized, weights, most))
    return out.select("row", F.explode(F.array_repeat(F.lit(1), copies(seed).cast("int")))).select("row.*")


def op9_mixing_sources(spark, sf_dir) -> DataFrame:
    return plan(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY 1),
weighed AS (SELECT source, source_size, 3 * source_size AS cap, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS w FROM per),
total AS (SELECT sum(source_size)::BIGINT AS t, sum(w)::BIGINT AS w FROM weighed),
ordered AS (SELECT *, coalesce(sum(cap) OVER before, 0)::BIGINT AS stopped_cap, coalesce(sum(w) OVER before, 0)::BIGINT AS stopped_w FROM weighed
  WINDOW before AS (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (SELECT o.*, (total.t - stopped_cap)::DOUBLE / (total.w - stopped_w)::DOUBLE AS level, total.t FROM ordered o, total),
level AS (SELECT coalesce(min_by(level, cap::DOUBLE / w), 0) AS level FROM levels WHERE cap >= w * level),
target AS (SELECT source, source_size, CASE WHEN cap < w * level.level THEN cap::DOUBLE ELSE w * level.level END AS target FROM weighed, level),
rated AS (SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 3.0::DOUBLE) ELSE 0.0::DOUBLE END AS rate FROM target)
SELECT s.doc_id, s.size, r.source_size, r.target,
  (s.size * (floor(r.rate)::BIGINT + CASE WHEN ('0x' || substr(md5(coalesce(s.doc_id::VARCHAR, 'null') || ':0'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE < r.rate - floor(r.rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sized s JOIN rated r ON s.source IS NOT DISTINCT FROM r.source
"""
