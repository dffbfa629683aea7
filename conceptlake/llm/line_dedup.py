"""Line dedup by a segment-partition edit join, in DataFrame expressions only.

Lines (split at \\n, trimmed of blanks) that aren't blank are compared. Equal lines are
one (128 bits of hash). Two lines match within one edit for every EACH code points of
the shorter, at most ``threshold``; those shorter than EACH match only if equal. A line
is cut into threshold + 1 even segments; of two lines within ``threshold`` edits, one
segment of the shorter is in the longer, near its place. The index holds every line's
segments by length, number and hash; a line probes it with the substrings that the
multi-match-aware rule leaves for each length. Lines that share a key are verified by a
banded bit-parallel edit distance: a bit for each diagonal of the band and number of
edits, all of them in one long that is folded over the line's code points.

Before that, bags of code points and of pairs of neighbours (as parity bits) must be as
close as the edits allow: near copies with other words in other places fail there.
First each line is compared with the smallest of its keys (a star), then all pairs
of a key whose lines are still in different classes, each pair once. A class is all lines reachable
by links; its first line (smallest doc_id, then line number) stays, the others go.

Null text has no line; a null id's lines are neither compared nor removed. Rows that
share an id but not the text have lines of their own, in the order of the texts' hashes;
repeated rows count as one in the order and lose the same lines: the first occurrence
stays in each. An empty table gives an empty result. Other columns, whatever their
names, are carried by ``deduplicated`` and ignored otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import components, drop, materialize, table

THRESHOLD = 2
#: Code points of the shorter line for every edit.
EACH = 24
#: Parity of how often each pair of neighbours occurs among code points u, by 64 residues.
DUO = "aggregate(u, struct(0L as duo, 0 as b), (s, c) -> struct(s.duo ^ shiftleft(1L, (s.b * 31 + c) % 64) as duo, c % 65536 as b), s -> s.duo)"
#: Hashes or document ids (8 bytes each) that are sent to every task.
SENT = 1_000_000


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, t (the text's hash), line_no (from 0), line (trimmed), h, c (hashes of the line): the lines that are compared."""
    rows = docs.where("text is not null and doc_id is not null").select("doc_id", F.xxhash64("text").alias("t"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    rows = rows.select("doc_id", "t", "line_no", F.trim("line").alias("line")).where(F.length("line") >= 1)
    return rows.withColumns({"h": F.xxhash64("line", F.length("line")), "c": F.xxhash64(F.lit(1), "line")})


def _segment(length: Column, i: int, parts: int) -> tuple[Column, Column]:
    """0-based start and size of segment i (from 0) of a text of ``length``."""
    base, more = F.floor(length / parts).cast("int"), (length % parts).cast("int")
    plain = parts - more
    return base * i + F.greatest(F.lit(i) - plain, F.lit(0)), base + (F.lit(i) >= plain).cast("int")


def keys(line: Column, length: Column, threshold: int = THRESHOLD) -> Column:
    """The keys that the line probes, hashes of (index length, segment, substring); the first threshold + 1 are its index keys."""
    parts = threshold + 1
    index, probe = [], []
    for delta in range(threshold + 1):
        short = (length - delta).cast("int")
        for i in range(parts):
            start, size = _segment(short, i, parts)
            low, high = max(-i, delta - (threshold - i)), min(i, delta + (threshold - i))
            for shift in range(low, high + 1):
                (probe if delta or shift else index).append(F.xxhash64(short, F.lit(i), F.substring(line, start + shift + 1, size)))
    return F.array(*index, *probe)


def distinct_lines(rows: DataFrame) -> DataFrame:
    """h, c, n, first (doc_id, t, line_no), line and length (code points) of each distinct line."""
    keyed = rows.select("h", "c", F.struct("doc_id", "t", "line_no").alias("at"), "line")
    return keyed.groupBy("h").agg(F.min("c").alias("c"), F.count("*").alias("n"), F.min("at").alias("first"), F.first("line").alias("line")).withColumn("length", F.length("line"))


def _texts(distinct: DataFrame, wanted: DataFrame) -> DataFrame:
    """h, u (code points), n (their number) and bag (parity of how often each occurs, by 64 residues) of the wanted hashes."""
    wanted = materialize(wanted.distinct())
    texts = distinct.select("h", "line").join(F.broadcast(wanted) if wanted.count() <= SENT else wanted, "h", "left_semi")
    texts = texts.select("h", F.expr("transform(split(line, ''), c -> ascii(c))").alias("u"))
    found = materialize(texts.select("h", "u", F.size("u").alias("n"), F.expr("aggregate(u, 0L, (bag, c) -> bag ^ shiftleft(1L, c % 64))").alias("bag")))
    drop(wanted)
    return found


def _edits(threshold: int) -> str:
    """Edits within which lines x and y match."""
    return f"cast(least({threshold}, floor(least(nx, ny) / {EACH})) as int)"


def possible(threshold: int) -> Column:
    """What lines (nx, bagx, ny, bagy) must meet to match: an edit changes the length by one and the bag by two bits at most."""
    return F.expr(f"abs(nx - ny) <= {_edits(threshold)} and bit_count(bagx ^ bagy) <= 2 * {_edits(threshold)}")


def alike(threshold: int) -> Column:
    """What they must meet too: an edit takes two pairs of neighbours at most and brings two, so it changes four bits of duox at most."""
    return F.expr(f"bit_count(duox ^ duoy) <= 4 * {_edits(threshold)}")


def within(threshold: int = THRESHOLD) -> Column:
    """Whether two lines (code points x and y, their numbers nx and ny) match, by a banded bit-parallel edit distance.

    After i code points of y, bit d + threshold of field e is set if the first i + d of x
    are at most e edits from them. A match keeps the diagonal, a substitution too with one
    edit more, an insertion goes one diagonal down, a deletion one up.
    """
    if not 0 <= threshold <= 2:
        raise ValueError("the band holds at most two edits")
    t, size = threshold, 2 * threshold + 2  # bits of a field, one of them a guard
    fields = [e * size for e in range(t + 1)]
    band = sum(((1 << 2 * t + 1) - 1) << f for f in fields)
    start = sum(1 << f + d + t for e, f in enumerate(fields) for d in range(e + 1))
    same = " | ".join(f"if(get(x, i + {d}) = c, {1 << d + t}L, 0L)" for d in range(-t, t + 1))
    matches = f"transform(y, (c, i) -> ({same}) * {sum(1 << f for f in fields)}L)"
    step = f"(((p & q) | shiftleft(p, {size}) | shiftright(shiftleft(p, {size}), 1)) & {band}L)"
    deleted = " | ".join([step, *(f"shiftleft({step}, {k * (size + 1)})" for k in range(1, t + 1))])
    end = f"aggregate({matches}, {start}L, (p, q) -> ({deleted}) & {band}L)"
    return F.expr(f"if(abs(nx - ny) > {_edits(t)}, false, shiftright({end}, {_edits(t)} * {size} + nx - ny + {t}) & 1L = 1L)")


def _sided(texts: DataFrame, h: str, side: str) -> DataFrame:
    return texts.select(F.col("h").alias(h), F.col("u").alias(side), F.col("n").alias(f"n{side}"), F.col("bag").alias(f"bag{side}"))


def _verified(texts: DataFrame, pairs: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) of line hashes within the threshold, as (u, v)."""
    both = pairs.join(_sided(texts, "a", "x"), "a").join(_sided(texts, "b", "y"), "b")
    return materialize(both.where(possible(threshold)).where(within(threshold)).select(F.col("a").alias("u"), F.col("b").alias("v")))


def line_links(distinct: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Links (u, v) between distinct lines that connect all lines within the threshold, directly or by others."""
    long = distinct.where(F.col("length") >= EACH)
    sides = long.select("h", F.posexplode(keys(F.col("line"), F.col("length"), threshold)).alias("i", "k")).select("h", "k", (F.col("i") <= threshold).alias("indexed"))
    by = Window.partitionBy("k")
    shared = sides.withColumns({"lo": F.min("h").over(by), "hi": F.max("h").over(by)}).where("lo <> hi")
    shared = materialize(shared.select("k", "h", "indexed", "lo"))
    star = materialize(shared.where("h <> lo").select(F.col("lo").alias("a"), F.col("h").alias("b")).distinct())
    texts = _texts(distinct, shared.select("h"))
    first = _verified(texts, star, threshold)
    rooted = shared.join(components(first).select(F.col("id").alias("h"), "root"), "h", "left").withColumn("root", F.coalesce("root", "h"))
    split = rooted.groupBy("k").agg(F.min("root").alias("p"), F.max("root").alias("q")).where("p <> q").select("k")
    rooted = materialize(rooted.join(split, "k").select("k", "h", "indexed", "root"))
    # lengths and bags come along, so that the join makes rows for possible pairs only
    apart = texts.join(rooted.select("h").distinct(), "h", "left_semi").select("h", "n", "bag", F.expr(DUO).alias("duo"))
    bags = rooted.join(materialize(apart), "h")
    left, right = (rows.select("k", F.col("h").alias(h), F.col("root").alias(f"r{h}"), *(F.col(c).alias(c + x) for c in ("n", "bag", "duo"))) for rows, h, x in ((bags.where("indexed"), "a", "x"), (bags, "b", "y")))
    # lines of one length probe each other: one direction is enough
    pairs = left.join(right, "k").where(F.col("ra") != F.col("rb")).where("nx < ny or a < b").where(possible(threshold)).where(alike(threshold))
    pairs = materialize(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(star, ["a", "b"], "left_anti"))
    found = materialize(first.union(_verified(texts, pairs, threshold)))
    drop(shared, star, first, rooted, texts, pairs)
    return found


def line_classes(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, t (the text's hash), line_no of every line that goes, its class's first line (class: doc_id, t, line_no), and the class's distinct lines."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    rows = lines(docs)
    distinct = materialize(distinct_lines(rows))
    links = line_links(distinct, threshold)
    roots = components(links).select(F.col("id").alias("h"), "root")
    classes = distinct.select("h", "c", "n", "first").join(roots, "h", "left").withColumn("root", F.coalesce("root", "h"))
    per = classes.groupBy("root").agg(F.min("first").alias("class"), F.sum("n").alias("total"), F.count("*").alias("n_texts")).where("total > 1")
    repeated = materialize(classes.join(per, "root").select("h", "c", "class", "n_texts"))
    drop(distinct, links)
    found = rows.select("doc_id", "t", "line_no", "h", "c").join(F.broadcast(repeated) if repeated.count() <= SENT // 8 else repeated, ["h", "c"])
    return found.where(F.struct("doc_id", "t", "line_no") != F.col("class")).select("doc_id", "t", "line_no", "class", "n_texts").distinct()


def removals(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, t (the text's hash) and the ascending numbers of the text's lines that go."""
    return line_classes(docs, threshold).groupBy("doc_id", "t").agg(F.sort_array(F.collect_list("line_no")).alias("gone"))


def deduplicated(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """``docs`` with the lines that go removed from the text; a text of which nothing remains goes with its row."""
    gone = materialize(removals(docs, threshold))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"))
    rest = F.expr("array_join(filter(split(row.text, '\\n'), (x, i) -> not array_contains(gone, i)), '\\n')")
    out = rows.join(gone, ["doc_id", "t"], "left").select("row", "gone", F.when(F.col("gone").isNotNull(), rest).alias("rest"))
    out = out.where("gone is null or trim(rest) <> ''")
    changed = {"text": F.coalesce("rest", "row.text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("gone").isNull(), F.col("row.n_chars")).otherwise(F.length("rest").cast("long"))
    return out.select(*(changed[c].alias(c) if c in changed else F.col(f"row.`{c}`") for c in docs.columns))


def op3_line_dedup(spark, sf_dir) -> DataFrame:
    """One row per document: its lines, those removed and their numbers, and in how many classes they are."""
    docs = table(spark, sf_dir, "documents")
    found = line_classes(docs).groupBy("doc_id", "t").agg(F.sort_array(F.collect_list("line_no")).alias("gone"), F.count_distinct("class").alias("classes"))
    sized = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("t"), F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long").alias("n_lines"))
    out = sized.join(found, ["doc_id", "t"], "left")
    return out.select("doc_id", "n_lines", F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce("classes", F.lit(0)).cast("long").alias("n_classes"), F.coalesce(F.array_join(F.col("gone").cast("array<string>"), ","), F.lit("")).alias("removed"))


OP3_SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL),
numbered AS (SELECT doc_id, unnest(range(len(s))) AS line_no, unnest(list_transform(s, lambda x: trim(x, ' '))) AS line FROM split),
filled AS (SELECT * FROM numbered WHERE length(line) >= 1),
texts AS (SELECT line, row_number() OVER (ORDER BY line) AS h, min((doc_id, line_no)) AS place, length(line) AS n FROM filled GROUP BY line),
parts AS (SELECT h, line, n, n // 3 AS b, n % 3 AS m FROM texts WHERE n >= 24),
segments AS (
  SELECT h, line, n, 0 AS i, substr(line, 1, b) AS seg FROM parts
  UNION ALL SELECT h, line, n, 1, substr(line, b + 1, b + (m >= 2)::INT) FROM parts
  UNION ALL SELECT h, line, n, 2, substr(line, n - b - (m >= 1)::INT + 1) FROM parts),
probes AS (
  SELECT p.h, p.line, p.n, q.len AS short, i.i,
    CASE i.i WHEN 0 THEN substr(p.line, 1 + z.shift, q.len // 3) WHEN 1 THEN substr(p.line, q.len // 3 + 1 + z.shift, q.len // 3 + (q.len % 3 >= 2)::INT)
      ELSE substr(p.line, q.len - q.len // 3 - (q.len % 3 >= 1)::INT + 1 + z.shift, q.len // 3 + (q.len % 3 >= 1)::INT) END AS seg
  FROM parts p, (SELECT unnest([0, 1, 2]) AS d) d, (SELECT unnest([0, 1, 2]) AS i) i, (SELECT unnest([-2, -1, 0, 1, 2]) AS shift) z, LATERAL (SELECT p.n - d.d AS len) q),
links AS (
  SELECT DISTINCT a.h AS u, b.h AS v FROM segments a JOIN probes b ON a.n = b.short AND a.i = b.i AND a.seg = b.seg
  WHERE a.h <> b.h AND levenshtein(a.line, b.line) <= least(2, least(a.n, b.n) // 24)),
sym AS (SELECT u, v FROM links UNION SELECT v, u FROM links),
reach(u, r) AS (SELECT h, h FROM texts UNION SELECT s.v, reach.r FROM reach JOIN sym s ON s.u = reach.u),
roots AS (SELECT u AS h, min(r) AS root FROM reach GROUP BY 1),
kept AS (SELECT root, min(place) AS first FROM texts JOIN roots USING (h) GROUP BY 1),
gone AS (
  SELECT DISTINCT l.doc_id, l.line_no, k.first FROM filled l JOIN texts t USING (line) JOIN roots r USING (h) JOIN kept k USING (root) WHERE (l.doc_id, l.line_no) <> k.first),
per AS (SELECT doc_id, count(*) AS n, count(DISTINCT first) AS c, string_agg(line_no::VARCHAR, ',' ORDER BY line_no) AS g FROM gone GROUP BY 1)
SELECT d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0)::BIGINT AS n_lines, coalesce(n, 0)::BIGINT AS n_removed, coalesce(c, 0)::BIGINT AS n_classes, coalesce(g, '') AS removed
FROM documents d LEFT JOIN per USING (doc_id)
"""
