"""MinHash near-duplicates with tensored tables.

Two collections of ``TABLES`` short keys are taken of a text's set of word n-grams; a key
joins ``ROWS_OF_KEY`` minhashes. A table's key is a pair, one key of either collection, so that
``2 * TABLES * ROWS_OF_KEY`` minhashes serve ``TABLES ** 2`` tables of twice as many rows.
At a similarity s two sets meet with probability ``(1 - (1 - s ** 3) ** 14) ** 2``:
0.99991 at 0.8, 0.000000 at 0.05. Whoever meets is verified on the full sets.

Sets are dealt out by their first keys alone; within one, the pairs with the second
collection's keys are grouped where they are. A first key of more than MANY sets is
instead dealt out pair by pair with sums before the shuffle, so that a group of copies
isn't one task's.

Texts with equal sets are one class. First each class is verified against one other, the
one that most of its keys in the tables of the diagonal name as their smallest; this links
groups of near copies. A key within one component has nothing more to link. Of the
others, all pairs that aren't in one component yet would be verified; those are the square
of a group's size if a share of its classes is still outside. So while there are many,
rounds come before: each class outside the component that has most classes at its key is
verified against up to CENTRES classes of that component. Each round's links join
components and so leave fewer pairs. A round moves roots by class and joins with their keys
only the rows outside; of the main components it takes a count and one class a key. When
there are few pairs, or a round no longer helps, all that are left are verified, unless
their sizes or parity bitmaps show that they can't be similar enough. A pair is taken at the first table where it meets, as the keys before it
tell, and not again at the others (up to 196). So every pair that meets in a table is
verified or already connected, whatever a key's size. Classes that meet and aren't similar
enough still cost the square of their number, as far as the bounds don't part them.

Classes are joined by 64 bits of hash; a row joins its class only if 64 other bits
agree too, else it stays on its own.

Rows: null, empty or blank text has an empty set and is linked with nothing. A text of
fewer words than n is one n-gram. Rows with a null id are returned with a null
``component_id`` and are kept. Repeated ids are rows of their own; a component's id is
its smallest doc_id. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import kernel
from .ngram_join import SENT_HOT, NgramJoin, ordered_sets, parity, set_check, set_key
from .shared import components, drop, materialize, table

TABLES, ROWS_OF_KEY = 14, 3
#: Sets of a first key from which on it is dealt out pair by pair. Only the work depends on it.
MANY = 1024
#: Classes that a class outside its keys' main components is compared with in a round. Only the work depends on it, never the result.
CENTRES = 8
#: Rounds go on while there are more pairs to look at than ENOUGH times the classes of all split keys, each round saves as many and leaves at most SLOWEST of them. Only the work depends on them.
ENOUGH, SLOWEST = 4, 0.75


def multipliers(n: int) -> np.ndarray:
    """Odd 64-bit factors, one for each minhash."""
    return kernel.mix(np.arange(1, n + 1, dtype=np.uint64) * kernel.BASE) | np.uint64(1)


def keys(sets: list[np.ndarray], tables: int = TABLES, rows: int = ROWS_OF_KEY) -> np.ndarray:
    """(sets, 2, tables) int32: both collections' keys of non-empty sets."""
    out = np.zeros((len(sets), 2 * tables), np.int32)
    if not sets:
        return out.reshape(0, 2, tables)
    values = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    factors = multipliers(2 * tables * rows)
    for t in range(2 * tables):
        key = np.full(len(sets), np.uint64(t))
        for f in factors[t * rows : (t + 1) * rows]:
            key = kernel.mix(key + np.minimum.reduceat(values * f, starts))
        out[:, t] = (key >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return out.reshape(len(sets), 2, tables)


def several(counts: DataFrame, *key: str) -> DataFrame:
    """The keys that several components have, with the root of the one with most classes (most), a class of it (named), the key's classes (g) and those outside (out). counts: key, root, c, named."""
    each = counts.groupBy(*key).agg(F.count("*").alias("parts"), F.max(F.struct("c", "root", "named")).alias("m"), F.sum("c").alias("g"))
    return each.where("parts > 1").select(*key, F.col("m.root").alias("most"), F.col("m.named").alias("named"), "g", F.expr("g - m.c").alias("out"))


def sent(small: DataFrame) -> DataFrame:
    """A table in the shared folder, broadcast if it has at most SENT_HOT rows."""
    return F.broadcast(small) if small.count() <= SENT_HOT else small


def firsts(split: DataFrame) -> DataFrame:
    """The first keys (a) of split; distinct unless they are few."""
    return F.broadcast(split.select("a")) if split.count() <= SENT_HOT else split.select("a").distinct()


def hubs(edges: DataFrame) -> DataFrame:
    """(id, root): vertices of edges (u, v) with a neighbour of more edges (ties: larger id), and that neighbour.

    One step instead of the whole search: vertices of one root are connected, not all that are connected have one root.
    """
    both = edges.union(edges.select("v", "u")).where("u <> v")
    degree = both.groupBy(F.col("u").alias("v")).agg(F.count("*").alias("d"))
    best = both.join(degree, "v").groupBy("u").agg(F.count("*").alias("d"), F.max(F.struct("d", "v")).alias("m"))
    return best.where("m.d > d or m.d = d and m.v > u").select(F.col("u").alias("id"), F.col("m.v").alias("root"))


def moved(rooted: DataFrame, over: DataFrame) -> DataFrame:
    """rooted, a row a class, with the roots in over (id, root) replaced."""
    found = rooted.withColumnRenamed("root", "id").join(sent(over), "id", "left")
    return found.withColumn("root", F.coalesce("root", "id")).drop("id")


class MinHashJoin(NgramJoin):
    """The join of ``docs`` with itself at ``num / den``; ``classes()`` has the result."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text: str = "text", n: int = 5, num: int = 80, den: int = 100):
        self.docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("t"))
        self.n, self.num, self.den = n, num, den
        self.sent = docs.sparkSession.sparkContext.broadcast(np.zeros(0, np.uint64))  # sets are ordered by hash alone

    def keyed(self) -> DataFrame:
        """doc_id, t, n_shingles, class key k (null without words), check, parity bitmap and both collections of every row."""
        n = self.n

        def run(batches):
            for batch, raw, offsets in kernel.slices(batches, "text"):
                sets = ordered_sets(raw, offsets, n, np.zeros(0, np.uint64))
                some = [i for i, s in enumerate(sets) if len(s)]
                both = iter(keys([sets[i] for i in some]))
                pairs = [next(both) if len(s) else None for s in sets]
                longs = [[len(s) for s in sets], [set_key(s) if len(s) else None for s in sets], [set_check(s) if len(s) else None for s in sets]]
                small = [pa.array([None if p is None else p[side] for p in pairs], pa.list_(pa.int32())) for side in (0, 1)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(2), *(pa.array(c, pa.int64()) for c in longs), pa.array([parity(s) for s in sets], pa.list_(pa.int64())), *small],
                    ["doc_id", "t", "n_shingles", "k", "check", "w", "first", "second"],
                )

        return self.docs.mapInArrow(run, "doc_id long, t long, n_shingles long, k long, check long, w array<long>, first array<int>, second array<int>")

    def groups(self, keyed: DataFrame) -> DataFrame:
        """A row for each class: its key and check, smallest doc_id, rows, size, bitmap and keys."""
        rows = keyed.where("k is not null and doc_id is not null")
        return rows.groupBy("k").agg(F.min("check").alias("check"), F.min("doc_id").alias("class_id"), F.count("*").alias("rows"), F.min("n_shingles").alias("n"), F.min("w").alias("w"), F.min("first").alias("first"), F.min("second").alias("second"))

    def stars(self, groups: DataFrame) -> DataFrame:
        """(k, least): the class that most of a class's keys of the diagonal tables name as their smallest."""
        diagonal = groups.select("k", F.explode(F.expr("transform(first, (a, i) -> xxhash64(i, a, get(second, i)))")).alias("x"))
        shared = diagonal.groupBy("x").agg(F.count("*").alias("g"), F.min("k").alias("least")).where("g > 1").drop("g")
        votes = diagonal.join(shared, "x").where("k <> least").repartition("k").groupBy("k", "least").agg(F.count("*").alias("c"))
        return votes.groupBy("k").agg(F.max(F.struct("c", "least")).alias("v")).select("k", F.col("v.least").alias("least"))

    def split(self, rooted: DataFrame, turn: int = 0) -> DataFrame:
        """(a, x, most, named, g, out), the table keys x that classes of different components have (``several``), with their first keys a. rooted: k, root, first, second.

        A first key within one component is left out before it is paired with second keys. With another ``turn``, another class is named.
        """
        each = rooted.select("k", "root", F.posexplode("first").alias("i", "a"), "second").select("k", "root", F.xxhash64("i", "a").alias("a"), "second")
        alive = materialize(each.groupBy("a").agg(F.count("*").alias("g"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("a", "g"))
        send = F.broadcast if alive.count() <= SENT_HOT else lambda df: df
        named = F.min_by("k", F.xxhash64("k", F.lit(turn))).alias("named")
        paired = lambda df: df.select("k", "root", "a", F.posexplode("second").alias("j", "b")).select("k", "root", "a", F.xxhash64("a", "j", "b").alias("x")).groupBy("a", "x", "root").agg(F.count("*").alias("c"), named)
        few = several(paired(each.join(send(alive.where(F.col("g") <= MANY).select("a")), "a", "left_semi").repartition("a")), "a", "x")
        hot = several(paired(each.join(send(alive.where(F.col("g") > MANY).select("a")), "a", "left_semi")), "a", "x")
        found = materialize(few.union(hot) if alive.where(F.col("g") > MANY).count() else few)
        drop(alive)
        return found

    def placed(self, rooted: DataFrame, split: DataFrame) -> DataFrame:
        """(k, root, x, before): the classes at each table key with a first key of ``split``. ``before`` holds the keys before the table's own: i of the first collection, j of the second."""
        whole = rooted.select("k", "root", F.posexplode("first").alias("i", "a"), "first", "second").select("k", "root", "i", F.xxhash64("i", "a").alias("a"), "first", "second")
        rows = whole.join(firsts(split), "a", "left_semi").select("*", F.posexplode("second").alias("j", "b"))
        return rows.select("k", "root", F.xxhash64("a", "j", "b").alias("x"), F.expr("concat(slice(first, 1, i), slice(second, 1, j))").alias("before"))

    def met(self, rooted: DataFrame, split: DataFrame | None = None) -> DataFrame:
        """(x, k, root, before, main, g): the classes of each key in ``split``. main: the row's component has most classes at the key; g: the key's classes."""
        keys = self.split(rooted) if split is None else split
        found = materialize(self.placed(rooted, keys).join(sent(keys.select("x", "most", "g")), "x").select("x", "k", "root", "before", F.expr("root = most").alias("main"), "g"))
        drop(keys)
        return found

    def nearest(self, rooted: DataFrame, split: DataFrame, info: DataFrame, close: str, tried: DataFrame) -> DataFrame:
        """Pairs (a, b) that aren't tried: each class outside its keys' main components with the CENTRES of them that most of its keys name.

        A key names one class of its main component; the main components' rows aren't joined.
        """
        rows, keys = self.placed(rooted, split).alias("r"), sent(split.select("x", "most", "named")).alias("s")
        votes = rows.join(keys, F.expr("r.x = s.x and r.root <> s.most")).groupBy("k", F.col("named").alias("c")).agg(F.count("*").alias("votes")).alias("s")
        both = votes.join(info.alias("a"), F.expr("s.k = a.k")).join(info.alias("b"), F.expr("s.c = b.k")).where(close)
        both = both.select(F.least("a.k", "b.k").alias("a"), F.greatest("a.k", "b.k").alias("b"), F.col("s.k").alias("k"), "votes").join(tried, ["a", "b"], "left_anti")
        rank = F.row_number().over(Window.partitionBy("k").orderBy(F.desc("votes"), "a", "b"))
        return both.withColumn("rank", rank).where(F.col("rank") <= CENTRES).select("a", "b").distinct()

    def pairs(self, met: DataFrame, info: DataFrame, close: str) -> DataFrame:
        """The pairs (a, b) of classes of different components that meet and may be close, each once. info: k, n, w.

        One of a pair is outside the key's main component, so that only these rows are looked at with all others.
        """
        rows = met.join(info, "k")
        again = " or ".join(f"coalesce(get(a.before, {i}) = get(b.before, {i}), false)" for i in range(2 * TABLES - 2))
        both = rows.where("not main").alias("a").join(rows.alias("b"), F.expr(f"a.x = b.x and a.root <> b.root and (b.main or a.k < b.k) and not ({again}) and {close}"))
        return both.select(F.least("a.k", "b.k").alias("a"), F.greatest("a.k", "b.k").alias("b"))

    def links(self, groups: DataFrame) -> DataFrame:
        """Links (u, v) between classes that connect every pair that meets and reaches the threshold, directly or by others."""
        num, den = self.num, self.den
        info = groups.select("k", "n", "w")
        overlap = f"ceil({num} * (a.n + b.n) / {num + den})"
        close = f"{den} * least(a.n, b.n) >= {num} * greatest(a.n, b.n) and aggregate(zip_with(a.w, b.w, (x, y) -> bit_count(x ^ y)), 0, (sum, x) -> sum + x) <= a.n + b.n - 2 * {overlap}"
        star = self.stars(groups).alias("s").join(info.alias("a"), F.expr("s.k = a.k")).join(info.alias("b"), F.expr("s.least = b.k")).where(close)
        star = star.select(F.least("a.k", "b.k").alias("a"), F.greatest("a.k", "b.k").alias("b"))
        tried = materialize(star)  # a row a class, b
        linked = self.verify(groups, tried)
        roots = components(linked).select(F.col("id").alias("k"), "root")
        rooted = materialize(groups.select("k", "first", "second").join(roots, "k", "left").select("k", F.coalesce("root", "k").alias("root"), "first", "second"))
        links, pairs, last, split = [linked], [tried], None, self.split(rooted, 1)
        some = rooted.select("k", F.posexplode("first").alias("i", "a")).select("k", F.xxhash64("i", "a").alias("a")).join(firsts(split), "a", "left_semi")
        old, rooted = rooted, materialize(rooted.join(some, "k", "left_semi"))
        drop(old)
        while True:
            rows, work = split.agg(F.coalesce(F.sum("g"), F.lit(0)), F.coalesce(F.sum(F.col("g") * F.col("out")), F.lit(0))).first()
            if work <= ENOUGH * rows or last is not None and last - work < max(ENOUGH * rows, (1 - SLOWEST) * last):
                break
            pairs.append(materialize(self.nearest(rooted, split, info, close, tried)))
            links.append(self.verify(groups, pairs[-1]))
            tried, linked, last = tried.union(pairs[-1]), linked.union(links[-1]), work
            roots = rooted.select(F.col("k").alias("u"), F.col("root").alias("ru")), rooted.select(F.col("k").alias("v"), F.col("root").alias("rv"))
            over = materialize(hubs(links[-1].join(roots[0], "u").join(roots[1], "v").select(F.col("ru").alias("u"), F.col("rv").alias("v"))))
            old, rooted = rooted, materialize(moved(rooted, over))
            drop(over, old, split)
            split = self.split(rooted, len(pairs))
        met = self.met(rooted, split)
        pairs.append(materialize(self.pairs(met, info, close).join(tried, ["a", "b"], "left_anti")))
        links.append(self.verify(groups, pairs[-1]))
        found = materialize(linked.union(links[-1]))
        drop(rooted, met, *pairs, *links)
        return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id (smallest doc_id with the same set), n_links (of the class, as verified), kept."""
    found = MinHashJoin(docs, id_col, text, n, num, den).classes()
    return found.drop("t", "root").withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op12_minhash_near_dedup(spark, sf_dir) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), n=2).select("doc_id", "n_shingles", "component_id", "kept")


OP12_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 2 THEN [w[1]]
    ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM words),
sets AS (SELECT doc_id, list(g ORDER BY g) AS s, len(s) AS n FROM grams GROUP BY 1),
classes AS (SELECT md5(array_to_string(s, chr(10))) AS k, min(doc_id) AS c, any_value(n) AS n FROM sets GROUP BY 1),
member AS (SELECT doc_id, c FROM sets JOIN classes ON md5(array_to_string(s, chr(10))) = k),
pairs AS (
  SELECT p.c AS u, q.c AS v, p.n AS pn, q.n AS qn FROM classes p JOIN classes q ON p.c < q.c AND 100 * least(p.n, q.n) >= 80 * greatest(p.n, q.n)),
links AS (
  SELECT u, v FROM (SELECT u, v, pn, qn, len(list_intersect(a.s, b.s)) AS i FROM pairs JOIN sets a ON a.doc_id = u JOIN sets b ON b.doc_id = v)
  WHERE 100 * i >= 80 * (pn + qn - i)),
sym AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach(u, r) AS (SELECT c, c FROM classes UNION SELECT s.v, reach.r FROM reach JOIN sym s ON s.u = reach.u AND reach.r < s.v),
root AS (SELECT u, min(r) AS r FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, coalesce(r, d.doc_id) AS component_id, coalesce(r, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sets s USING (doc_id) LEFT JOIN member USING (doc_id) LEFT JOIN root ON u = c
"""
