"""N-gram Jaccard join over a prefix tree.

Every text becomes a set of word n-grams in one global order: frequent n-grams
last, by hash within. Texts with equal sets are one class. Two classes can only
reach the threshold if they share an n-gram among their first
``n - ceil(t * n) + 1`` (their prefixes). The candidates of a class are held as a
prefix tree of their ordered sets, which is walked once against the class's own
set: sets with a common beginning share the overlap counted so far, and a subtree
ends where the n-grams that remain cannot reach the needed overlap.

Before a tree is built, candidates are counted: up to the smaller of the two last
prefix n-grams both prefixes are complete, so the n-grams that two prefixes share,
and all that follow in one of the sets, bound the overlap. Pairs that cannot reach
the needed overlap by this bound are no candidates. Nor are pairs whose parity
bitmaps (a bit for each of ``BITS`` hash values: is it that of an odd number of the
set's n-grams?) differ in more bits than the sets may differ in n-grams.

No pair is lost: an n-gram of few classes gives all their pairs; in one of many,
each class is first compared with a few of them (stars), then all pairs that the
links leave in different components. Classes of texts that differ are thus linked
whenever their similarity is high enough, or were already reachable from each other.
At an n-gram of many a pair is taken only where it may be the first that the two
share: neither of the RECENT ones of many before it is in both, and what remains of
the shorter rest can still give the needed overlap. So near copies that share all of
their frequent n-grams meet once and not at each of them.

Classes are joined by 64 bits of hash; a row joins its class only if 64 other bits
agree too, else it stays on its own.

Rows: null, empty or blank text has an empty set and is linked with nothing.
Rows with a null id are returned with a null ``component_id``. Repeated ids are
rows of their own; a component's id is its smallest doc_id. Other columns are carried
by ``keep_first`` and ignored otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import kernel
from .shared import components, drop, materialize

#: An n-gram counts as frequent from this many texts of the sample on; the sample is one text of SAMPLE.
FREQUENT, SAMPLE = 3, 16
#: Most n-grams that are told apart as frequent (8 bytes each are sent to every task). Only the order depends on it, never the result.
FREQUENT_MOST = 1 << 19
#: Up to so many classes of an n-gram, all pairs are counted.
FEW = 64
#: Classes of an n-gram of more that all its classes are compared with first. Only the work depends on it, never the result.
CENTRES = 8
#: N-grams of many classes before one that two classes must not share there. Only the work depends on it, never the result.
RECENT = 4
#: Bits of a set's parity bitmap.
BITS = 1024
#: Candidates that one walk takes, and texts whose ids are sent to every task.
BLOCK, SENT_IDS = 256, 1_000_000
#: N-grams of many classes (or classes of many rows) that are sent to every task, and rows of a class that one task joins.
SENT_HOT, ROWS = 50_000, 4096
#: Rows (id and hash of the text) that go, if so few are sent to every task.
SENT_ROWS = 200_000

HOT = np.uint64(1 << 63)


def ordered_sets(raw, offsets, n: int, frequent: np.ndarray) -> list[np.ndarray]:
    """Each row's distinct n-grams, ascending in the global order: 63 bits of hash below the bit that marks frequent ones."""
    hashes, _, _, rows = kernel.words(raw, offsets)
    grams, first = kernel.shingles(hashes, rows, n)
    grams >>= np.uint64(1)
    if len(frequent):
        grams[kernel.member(grams, frequent)] |= HOT
    return [np.unique(grams[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]


def set_key(s: np.ndarray) -> int:
    """64 bits that stand for the set, whatever its order."""
    low = s & ~HOT
    return int(kernel.mix(np.array([kernel.mix(low).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def set_check(s: np.ndarray) -> int:
    """64 other bits of the set."""
    low = kernel.mix((s & ~HOT) ^ np.uint64(0x5851F42D4C957F2D))
    return int(np.array([low.sum(dtype=np.uint64)], np.uint64).view(np.int64)[0])


def parity(s: np.ndarray) -> np.ndarray:
    """The set's bitmap: bit h is whether an odd number of its n-grams hash to h."""
    at = (kernel.mix(s & ~HOT) >> np.uint64(64 - (BITS - 1).bit_length())).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=BITS) & 1).astype(np.uint8)).view(np.int64)


def prefix_length(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


def _frequent(docs: DataFrame, id_col: str, text: str, n: int) -> np.ndarray:
    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, raw, offsets in kernel.slices(batches, text):
            sets = [s for s in ordered_sets(raw, offsets, n, np.zeros(0, np.uint64)) if len(s)]
            if sets:
                values, counts = np.unique(np.concatenate(sets), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts)], ["x", "c"])

    rows = docs.where(F.pmod(F.xxhash64(id_col), F.lit(SAMPLE)) == 0).select(text).mapInArrow(grams, "x long, c long")
    top = rows.groupBy("x").agg(F.sum("c").alias("c")).where(F.col("c") >= FREQUENT).orderBy(F.desc("c"), "x").limit(FREQUENT_MOST).select("x").toPandas()["x"]
    return np.sort(top.to_numpy(np.int64).view(np.uint64))


def _shared_prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows ordered by (x, k): those whose x has two or more distinct k.

    Only the last row and the first of the current x are kept between batches.
    """
    last_x = last_k = first = None
    waiting = False  # the first row of the current x has not gone out
    for batch in batches:
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        x, k = columns[:2]
        if not len(x):
            continue
        px, pk = np.empty_like(x), np.empty_like(k)
        px[1:], pk[1:] = x[:-1], k[:-1]
        px[0], pk[0] = (x[0], k[0]) if last_x is None else (last_x, last_k)
        new = x != px
        new[0] |= last_x is None
        keep = new | (k != pk)
        last_x, last_k = x[-1], k[-1]
        columns, new = [c[keep] for c in columns], new[keep]
        if not len(new):
            continue
        emit = ~new
        emit[:-1] |= new[:-1] & ~new[1:]
        if waiting and not new[0]:
            columns, emit = [np.concatenate([[v], c]).astype(c.dtype) for v, c in zip(first, columns, strict=True)], np.concatenate([[True], emit])
            new = np.concatenate([[False], new])
        if new.any():
            j = int(np.flatnonzero(new)[-1])
            first = [c[j] for c in columns]
            waiting = j == len(new) - 1
        else:
            waiting = False
        yield pa.RecordBatch.from_arrays([pa.array(c[emit]) for c in columns], ["x", "k", "n", "p"])


class PrefixTree:
    """Ordered sets in lexicographic order; a node is a common beginning of neighbours."""

    def __init__(self, sets: list[np.ndarray]):
        wide = [s.astype(">u8").tobytes() for s in sets]
        self.order = sorted(range(len(sets)), key=wide.__getitem__)
        self.sets = sets

    def join(self, base: np.ndarray, num: int, den: int, step: int = 64) -> list[tuple[int, int]]:
        """(index, overlap) of the sets with den * overlap >= num * union with ``base``."""
        found, path, counted, reached = [], np.zeros(0, np.uint64), np.zeros(1, np.int64), 0
        for i in self.order:
            s = self.sets[i]
            need = -(-num * (len(s) + len(base)) // (num + den))
            m = min(len(path), len(s))
            differ = np.flatnonzero(path[:m] != s[:m])
            depth = min(int(differ[0]) if len(differ) else m, reached)
            overlap, at = [counted[: depth + 1]], depth
            now = int(counted[depth])
            while at < len(s):
                left = len(base) - int(np.searchsorted(base, s[at]))
                if now + min(len(s) - at, left) < need:
                    break
                part = s[at : at + step]
                where = np.searchsorted(base, part)
                where[where == len(base)] = 0
                overlap.append(now + np.cumsum(base[where] == part))
                now, at = int(overlap[-1][-1]), at + len(part)
            path, counted, reached = s, np.concatenate(overlap), at
            if at == len(s) and now >= need:
                found.append((i, now))
        return found


def _verified(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base_key, base, keys, sets, out = None, None, [], [], []

        def flush():
            if sets and base is not None:
                out.extend((base_key[0], keys[i]) for i, _ in PrefixTree(sets).join(base, num, den))
            keys.clear(), sets.clear()

        for batch in batches:
            for a, salt, probe, b, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (a, salt) != base_key:
                    flush()
                    base_key, base = (a, salt), None
                if not probe:
                    base = np.frombuffer(s, np.uint64)
                    continue
                keys.append(b), sets.append(np.frombuffer(s, np.uint64))
                if len(sets) >= BLOCK:
                    flush()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], ["u", "v"])
                out.clear()
        flush()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], ["u", "v"])

    return run


class NgramJoin:
    """The join of ``docs`` with itself at ``num / den``; ``classes()`` has the result."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text: str = "text", n: int = 5, num: int = 80, den: int = 100):
        self.docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("t"))
        self.n, self.num, self.den = n, num, den
        self.sent = docs.sparkSession.sparkContext.broadcast(_frequent(self.docs, "doc_id", "text", n))

    def keyed(self) -> DataFrame:
        """doc_id, n_shingles, the class key k (null without words), its check, the last prefix n-gram and the parity bitmap of every row."""
        n, num, den, frequent = self.n, self.num, self.den, self.sent

        def run(batches):
            for batch, raw, offsets in kernel.slices(batches, "text"):
                sets = ordered_sets(raw, offsets, n, frequent.value)
                last = [int(s[prefix_length(len(s), num, den) - 1]) - (1 << 63) if len(s) else None for s in sets]
                columns = [batch.column(0), batch.column(2), *(pa.array(c, pa.int64()) for c in ([len(s) for s in sets], [set_key(s) if len(s) else None for s in sets], [set_check(s) for s in sets], last))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([parity(s) for s in sets], pa.list_(pa.int64()))], ["doc_id", "t", "n_shingles", "k", "check", "last", "w"])

        return self.docs.mapInArrow(run, "doc_id long, t long, n_shingles long, k long, check long, last long, w array<long>")

    def groups(self, keyed: DataFrame) -> DataFrame:
        """A row for each class: its key and check, its smallest doc_id, its rows, and what its set's bounds need."""
        rows = keyed.where("k is not null and doc_id is not null")
        return rows.groupBy("k").agg(F.min("check").alias("check"), F.min("doc_id").alias("class_id"), F.count("*").alias("rows"), F.min("n_shingles").alias("n"), F.min("last").alias("last"), F.min("w").alias("w"))

    def prefixes(self) -> DataFrame:
        """(x, k, n, p): prefix n-grams that two or more classes share, with the set's size and the n-gram's place in it."""
        n, num, den, frequent = self.n, self.num, self.den, self.sent

        def run(batches):
            seen: set[int] = set()
            for _, raw, offsets in kernel.slices(batches, "text"):
                xs, ks, ns = [], [], []
                for s in ordered_sets(raw, offsets, n, frequent.value):
                    if len(s) and (k := set_key(s)) not in seen:  # a task sends equal sets once
                        seen.add(k)
                        xs.append(s[: prefix_length(len(s), num, den)])
                        ks.append(k), ns.append(len(s))
                if xs:
                    each = [len(v) for v in xs]
                    columns = (np.concatenate(xs).view(np.int64), np.repeat(np.array(ks, np.int64), each), np.repeat(np.array(ns, np.int32), each), np.concatenate([np.arange(m, dtype=np.int32) for m in each]))
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["x", "k", "n", "p"])

        rows = self.docs.where("doc_id is not null").mapInArrow(run, "x long, k long, n int, p int")
        return rows.repartition("x").sortWithinPartitions("x", "k").mapInArrow(_shared_prefixes, "x long, k long, n int, p int")

    def sets(self, groups: DataFrame, wanted: DataFrame) -> DataFrame:
        """(k, s): the ordered set of each wanted class, from one document of the class."""
        n, frequent = self.n, self.sent
        ids = materialize(groups.join(wanted, "k", "left_semi").select(F.col("class_id").alias("doc_id")))
        docs = self.docs.join(F.broadcast(ids) if ids.count() <= SENT_IDS else ids, "doc_id", "left_semi")

        def run(batches):
            for _, raw, offsets in kernel.slices(batches, "text"):
                sets = [s for s in ordered_sets(raw, offsets, n, frequent.value) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([set_key(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["k", "s"])

        found = materialize(docs.mapInArrow(run, "k long, s binary").dropDuplicates(["k"]))
        drop(ids)
        return found

    def verify(self, groups: DataFrame, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose sets reach the threshold, as (u, v)."""
        sets = self.sets(groups, pairs.select(F.col("a").alias("k")).union(pairs.select("b")).distinct())
        salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("salts"))
        bases = salts.join(sets.withColumnRenamed("k", "a"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("probe"), F.lit(None).cast("long").alias("b"), "s")
        probes = pairs.join(salts, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int")).join(sets.withColumnRenamed("k", "b"), "b").select("a", "salt", F.lit(1).alias("probe"), "b", "s")
        rows = bases.union(probes).repartition("a", "salt").sortWithinPartitions("a", "salt", "probe")
        found = materialize(rows.mapInArrow(_verified(self.num, self.den), "u long, v long"))
        drop(sets)
        return found

    def links(self, groups: DataFrame) -> DataFrame:
        """Links (u, v) between classes that connect every pair of classes at the threshold, directly or by others."""
        num, den = self.num, self.den
        fits = f"{den} * least(na, nb) >= {num} * greatest(na, nb)"
        shared = materialize(self.prefixes())
        centre = [F.min(F.when(F.pmod(F.xxhash64("k"), F.lit(CENTRES)) == j, F.col("k"))) for j in range(CENTRES)]
        hot = materialize(shared.groupBy("x").agg(F.count("*").alias("g"), F.array(*centre).alias("centres")).where(F.col("g") > FEW).select("x", "centres"))
        marked = materialize(shared.join(F.broadcast(hot) if hot.count() <= SENT_HOT else hot, "x", "left"))
        drop(shared)
        few, many = marked.where("centres is null"), marked.where("centres is not null")
        before = Window.partitionBy("k").orderBy("x").rowsBetween(-RECENT, -1)
        many = materialize(many.select("x", "k", "n", "p", F.coalesce(F.array_contains("centres", F.col("k")), F.lit(False)).alias("centre"), F.collect_list("x").over(before).alias("recent")))
        held = marked.groupBy("k").agg(F.count("*").alias("s"), F.count("centres").alias("m"))
        info = materialize(groups.select("k", "n", "last", "w").join(held, "k"))

        rest_of = lambda x: f"ceil({num} * {x} / {den}) - 1"
        overlap = f"ceil({num} * (na + nb) / {num + den})"
        needed = f"{overlap} - if(lasta <= lastb, {rest_of('na')}, {rest_of('nb')})"
        close = f"aggregate(zip_with(wa, wb, (x, y) -> bit_count(x ^ y)), 0, (sum, x) -> sum + x) <= na + nb - 2 * {overlap}"
        first_shared = f"least(na - pa, nb - pb) >= {overlap} and not arrays_overlap(recenta, recentb)"

        def about(side: str, *but: str) -> DataFrame:
            return info.select(F.col("k").alias(side), *(F.col(c).alias(c + side) for c in ("n", "s", "m", "last", "w") if c not in but))

        left, right = few.select("x", F.col("k").alias("a"), F.col("n").alias("na")), few.select("x", F.col("k").alias("b"), F.col("n").alias("nb"))
        counted = left.join(right, "x").where("a < b").where(fits).groupBy("a", "b").agg(F.count("*").alias("c"))
        counted = counted.join(about("a"), "a").join(about("b"), "b").where(f"{fits} and c + least(ma, mb) >= {needed} and {close}").select("a", "b")

        def together(left: DataFrame, right: DataFrame, but: str) -> DataFrame:
            """Pairs (a, b) of classes with a common x that can reach the needed overlap. The bounds are part of the join: it makes rows for possible pairs only."""
            left, right = (t.withColumnsRenamed({"k": e, **{c: c + e for c in ("n", "p", "recent", "root") if c in t.columns}}).join(about(e, "n"), e) for t, e in ((left, "a"), (right, "b")))
            return left.join(right, "x").where(f"a < b and {but} and {fits} and least(sa, sb) >= {needed} and {first_shared} and {close}").select("a", "b").distinct()

        star = together(many.where("centre"), many, "true").union(together(many, many.where("centre"), "true"))
        tried = materialize(counted.union(star).distinct())
        first = self.verify(groups, tried)
        roots = components(first).select(F.col("id").alias("k"), F.col("root"))
        rooted = many.drop("centre").join(roots, "k", "left").withColumn("root", F.coalesce("root", "k"))
        split = rooted.groupBy("x").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("x")
        rooted = materialize(rooted.join(split, "x", "left_semi"))
        rest = materialize(together(rooted, rooted, "roota <> rootb").join(tried, ["a", "b"], "left_anti"))
        found = materialize(first.union(self.verify(groups, rest)))
        drop(marked, hot, many, info, tried, first, rooted, rest)
        return found

    def classes(self) -> DataFrame:
        """doc_id, t (the text's hash), n_shingles, component_id, class_id, n_links, root (the component's key) of every row."""
        keyed = materialize(self.keyed())
        groups = materialize(self.groups(keyed))
        links = self.links(groups)
        self.sent.destroy()
        roots = components(links).select(F.col("id").alias("k"), "root")
        degree = links.select(F.col("u").alias("k")).union(links.select("v")).groupBy("k").agg(F.count("*").alias("n_links"))
        classes = groups.select("k", "check", "class_id", "rows").join(roots, "k", "left").withColumn("root", F.coalesce("root", "k"))
        least = classes.groupBy("root").agg(F.min("class_id").alias("component_id"))
        classes = classes.join(least, "root").join(degree, "k", "left").select("k", "check", "class_id", "component_id", "root", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.ceil(F.col("rows") / ROWS).cast("int").alias("salts"))
        # a class may hold a third of all rows: its key is salted, each class is repeated for the salts it needs
        classes = materialize(classes)
        big = materialize(classes.where("salts > 1").select("k", "salts"))
        rows = keyed.select("doc_id", "t", "n_shingles", "k", "check").join(F.broadcast(big) if big.count() <= SENT_HOT else big, "k", "left")
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
        salted = classes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
        out = rows.join(salted, ["k", "salt", "check"], "left")
        alone = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
        return out.select("doc_id", "t", "n_shingles", "root", alone.alias("component_id"), F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text", n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id (smallest doc_id with the same set), n_links (of the class, as verified)."""
    return NgramJoin(docs, id_col, text, n, num, den).classes().drop("t", "root")


def keep_first(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row of each component stays, the one with its smallest id; rows with no id or no words stay.

    Rows that share an id but not the text are rows of their own. Of repeated rows, one stays.
    """
    found = materialize(NgramJoin(docs, n=n, num=num, den=den).classes().where("doc_id is not null and root is not null"))
    first = found.where("component_id = doc_id").groupBy("root").agg(F.min(F.struct("doc_id", "t")).alias("f")).select("f.doc_id", "f.t")
    gone = found.select("doc_id", "t").distinct().join(first, ["doc_id", "t"], "left_anti")
    again = found.groupBy("doc_id", "t").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "t").join(first, ["doc_id", "t"], "left_semi")
    gone, again = materialize(gone), materialize(again)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"))
    if not again.count():
        return rows.join(_sent(gone), ["doc_id", "t"], "left_anti").select("row.*")
    once = rows.join(_sent(again), ["doc_id", "t"], "left_semi").dropDuplicates(["doc_id", "t"])
    return rows.join(_sent(gone.union(again)), ["doc_id", "t"], "left_anti").unionByName(once).select("row.*")


def _sent(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= SENT_ROWS else rows


def op8_ngram_jaccard_join(spark, sf_dir) -> DataFrame:
    from .shared import table

    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


OP8_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS g FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY 1),
rare AS (SELECT g FROM grams GROUP BY 1 HAVING count(*) > 1),
shared AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS i
  FROM (SELECT * FROM grams SEMI JOIN rare USING (g)) a JOIN (SELECT * FROM grams SEMI JOIN rare USING (g)) b USING (g)
  WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT u, v FROM shared JOIN sizes p ON p.doc_id = u JOIN sizes q ON q.doc_id = v WHERE 100 * i >= 80 * (p.n + q.n - i)),
sym AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach(u, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT s.v, reach.r FROM reach JOIN sym s ON s.u = reach.u AND reach.r < s.v)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, (SELECT min(r) FROM reach WHERE reach.u = d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes s USING (doc_id)
"""
