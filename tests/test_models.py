"""Small exact models of what SQL doesn't cover."""

import random
import re

from pyspark.sql import functions as F

from conceptlake.functions import chunks as C
from conceptlake.functions import text as X
from conceptlake.operators import cells as N
from conceptlake.operators import concepts as K
from conceptlake.operators import dedup as D
from conceptlake.operators import entities as E
from conceptlake.operators import graph as G
from conceptlake.operators import lexicon as L
from conceptlake.operators import vector as V
from conceptlake.sources import sinks

from . import chunk_model as M


def test_hash_ignores_case_and_space(spark):
    rows = spark.createDataFrame([("A  b",), ("a b",), ("ab",)], ["t"])
    got = rows.select(X.content_hash(F.col("t")).alias("c"), X.compact_hash(F.col("t")).alias("k")).collect()
    assert got[0].c == got[1].c != got[2].c and len({r.k for r in got}) == 1


def test_title_similarity(spark):
    """Against a table of prefixes; titles of over one and two longs."""
    rnd = random.Random(6)
    titles = [("Machine Learning", "machine learning "), ("Introduction to Machine Learning", "Introduction to Machine Learning!"), ("Introduction to Machine Learning", "Something Completely Different"), ("", ""), ("", "a"), (None, None), (None, "x"), ("\u00c9t\u00e9 \U0001f600", "\u00e9t\u00e9 \U0001f600!")]
    for n in (5, 61, 62, 63, 64, 124, 125, 200):
        for k in (2, 5, 26):
            make = lambda m: "".join(chr(97 + rnd.randrange(k)) for _ in range(m))  # noqa: B023, E731
            titles += [(make(n), make(rnd.randint(0, n + 9))), (make(n), make(n))]
    rows = spark.createDataFrame([(i, *t) for i, t in enumerate(titles)], "i int, a string, b string")
    got = {r.i: r.s for r in rows.select("i", D.title_similarity("a", "b").alias("s")).collect()}

    def ratio(a, b):
        a, b = (a or "").strip().lower(), (b or "").strip().lower()
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return round(200 * row[-1] / (len(a) + len(b))) if a or b else 100

    assert got == {i: ratio(a, b) for i, (a, b) in enumerate(titles)}
    assert got[0] == 100 and got[1] > 80 and got[2] < 50


def test_chunkers(spark):
    """The expressions against the same rules on one text, step by step."""
    rnd = random.Random(8)
    texts = [" ".join(f"This is sentence number {i}." for i in range(60)), "x" * 1700, "ab. " * 50, "", "   ", None, "P" * 904 + "\n\n" + "P" * 904, "One. End.\n\n\nTwo  a  b", "x" * 1700 + " y. " + "z" * 30]
    texts += [" \n\n ", "A.\r\nB.\r\n\r\n" + "C" * 190 + "\n\n" + "D" * 700 + "\n\n" + "E" * 300, "caf\u00e9\u00a0\u00a0bar.\u2003Next\x1c\x1cone \U0001f600\U0001f600! " * 40]
    for _ in range(60):
        texts.append("".join(rnd.choice(["a", "bc ", ". ", "\n", "\n\n", "  ", "word ", "! ", "?\t", "\r\n", "long" * 9]) for _ in range(rnd.randint(1, 150))))
    docs = spark.createDataFrame([(str(i), t, 40 + 20 * (i % 5)) for i, t in enumerate(texts)], "doc_id string, text string, size int")
    text = F.col("text")
    forms = {
        (40, 15): (C.semantic_chunks(text, 40, 15), lambda t: M.semantic_chunks(t, 40, 15)),
        (200, 50): (C.semantic_chunks(text, 200, 50), lambda t: M.semantic_chunks(t, 200, 50)),
        (1000, 200): (C.semantic_chunks(text), M.semantic_chunks),
        "legacy": (C.semantic_chunks(text, 60, 20, legacy_suffix=True), lambda t: M.semantic_chunks(t, 60, 20, legacy_suffix=True)),
        "joined": (C.semantic_chunks(text, 60, 20, preserve_paragraphs=False), lambda t: M.semantic_chunks(t, 60, 20, preserve_paragraphs=False)),
        "breaks": (C.break_chunks(text, 40), lambda t: M.break_chunks(t, 40)),
        "sentences": (C.pack_sentences(text, 60, 25), lambda t: M.pack_sentences(t, 60, 25)),
        "no tail": (C.pack_sentences(text, 60, 0), lambda t: M.pack_sentences(t, 60, 0)),
    }
    for name, (column, model) in forms.items():
        got = {}
        for r in C.chunk_rows(docs, column).collect():
            got.setdefault(r.doc_id, {})[r.chunk_index] = r.text
        want = {str(i): dict(enumerate(model(t))) for i, t in enumerate(texts) if t and model(t)}
        assert got == want, name
    sized = {(r.doc_id, r.chunk_index): r.text for r in C.chunk_rows(docs, C.semantic_chunks(text, F.col("size"), 10)).collect()}
    assert sized == {(str(i), k): c for i, t in enumerate(texts) if t for k, c in enumerate(M.semantic_chunks(t, 40 + 20 * (i % 5), 10))}


def test_plural_and_validity(spark):
    words = ["movies", "gases", "analysis", "analyses", "classes", "boxes", "neural network", "networks", "the network", "graph data"]
    got = {r.w: (r.s, r.v) for r in spark.createDataFrame([(w,) for w in words], ["w"]).select("w", K.singular(F.col("w")).alias("s"), K.is_valid(F.col("w")).alias("v")).collect()}
    assert [got[w][0] for w in words[:6]] == ["movy", "gase", "analysi", "analyse", "class", "box"]
    assert got["graph data"][1] and not got["the network"][1] and not got["networks"][1]


def test_demo_graph(spark):
    edges = spark.createDataFrame([(1, "c1", "c2", "RELATED_TO", 0.6), (2, "c1", "c3", "RELATED_TO", 0.8)], "edge_id long, src string, dst string, type string, strength double")
    seed = spark.createDataFrame([("c2",)], ["id"])
    got = {r.target: round(r.relevance, 6) for r in G.reach(edges, seed).collect()}
    assert got == {"c1": 0.6, "c3": 1.4}


def test_merge_relations(spark):
    kind = "src string, dst string, type string, strength double, description string, method string"
    a = spark.createDataFrame([("a", "b", "IS_A", 0.9, "old", "m")], kind)
    b = spark.createDataFrame([("a", "b", "IS_A", 0.4, "new", "n"), ("a", "b", "is a", 1.0, "x", "y")], kind)
    row = sinks.merge_relations(a, b).collect()
    assert [(r.strength, r.description) for r in row] == [(0.9, "new")]


def test_upsert(spark):
    a = spark.createDataFrame([(1, "x", "p"), (2, "y", "q")], "id int, n string, m string")
    b = spark.createDataFrame([(2, "z", None), (3, "w", "r")], "id int, n string, m string")
    assert {tuple(r) for r in sinks.upsert(a, b, ["id"]).collect()} == {(1, "x", "p"), (2, "z", "q"), (3, "w", "r")}


def test_lexicon_of_any_size(spark):
    """Against a search of every keyword in every text: borders of blocks, long keywords, signs of patterns, other planes."""
    rnd = random.Random(3)
    alphabet = "ab .[\\é\U0001f600"
    keys = list({"".join(rnd.choice(alphabet) for _ in range(rnd.choice([1, 2, 3, 5, 9, 20]))) for _ in range(60)})
    long = "ab" * 60
    keys += [long, long + "é", "zz"]
    texts = ["".join(rnd.choice(alphabet) for _ in range(n)) for n in (0, 1, 5, 1023, 1024, 1025, 3000)] + ["a." * 511 + "a zz", " " * 1024 + "zz" + "." * 70, "x" + long + "é", long, None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    lexicon = spark.createDataFrame([(k, i) for i, k in enumerate(keys)] + [("", -1), (None, -2)], "keyword string, number int")
    got = {(r.doc_id, r.keyword, r.pos, r.number) for r in L.match(docs, lexicon).collect()}
    assert got == {(d, k, t.index(k) + 1, i) for d, t in enumerate(texts) if t for i, k in enumerate(keys) if k in t}
    bounded = {(r.doc_id, r.keyword, r.pos) for r in L.match(docs, lexicon, word_boundary=True).collect()}
    want = {(d, k, m.start() + 1) for d, t in enumerate(texts) if t for k in keys if (m := re.search(r"(?<![^\W_])" + re.escape(k) + r"(?![^\W_])", t))}
    assert bounded == want
    assert L.match(docs, lexicon.limit(0)).count() == 0 and L.match(docs.limit(0), lexicon).count() == 0


def test_every_relation_type(spark):
    """One sentence for each phrase; the first phrase in the order of precedence decides."""
    said = [(kind, p) for kind, ps in E.PHRASES.items() for p in ps]
    texts = [f"Alpha{p}beta" for _, p in said] + ["alpha has beta. alpha is a beta", "alpha uses the beta", "alphabeta", "alpha has attribute beta"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    names = docs.select("doc_id", F.explode(F.array(F.lit("alpha"), F.lit("Beta"), F.lit("a"))).alias("name"))
    got = {}
    for r in E.pattern_relations(docs, names).collect():
        got.setdefault((r.src, r.dst), {})[r.doc_id] = r.type

    def kind(t, a, b):
        return next((k for k, p in said if a.lower() + p + b.lower() in t.lower()), None)

    for a in ("alpha", "Beta", "a"):
        for b in ("alpha", "Beta", "a"):
            if a != b:
                assert got.get((a, b), {}) == {i: k for i, t in enumerate(texts) if (k := kind(t, a, b))}
    assert set(got["alpha", "Beta"].values()) == set(E.PHRASES)


def test_adjacency_equals_the_edges(spark):
    """Buckets, hubs over several of them, look-up and join give the paths of the plain edges."""
    rnd = random.Random(2)
    pairs = {tuple(sorted(rnd.sample(range(40), 2))) for _ in range(120)} | {(0, i) for i in range(1, 40)}
    edges = spark.createDataFrame([(i, a, b, "RELATED_TO", None if i % 9 == 0 else i / 100) for i, (a, b) in enumerate(sorted(pairs))], "edge_id long, src long, dst long, type string, strength double")
    table = G.Adjacency(edges, hub=7)
    assert table.few_hubs > 0
    seeds = spark.createDataFrame([(0,), (5,), (99,)], "id long")
    rows = lambda df: sorted(map(str, df.collect()))
    for most in (2000, 0):
        G.LOOKED_UP = most
        for hops in (2, 3) if most else (2,):
            assert rows(G.reach(table, seeds, hops).withColumn("relevance", F.round("relevance", 9))) == rows(G.reach(edges, seeds, hops).withColumn("relevance", F.round("relevance", 9)))
        assert rows(G.neighbours(table, 0)) == rows(G.neighbours(edges, 0)) and G.neighbours(table, 99).count() == 0
        assert G.paths(table, seeds).count() == G.paths(edges, seeds).count()
    G.LOOKED_UP = 2000
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # only then does the plan say so
    plan = spark.table(table.name).where(F.col("place") == 1)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert "SelectedBucketsCount: 1 out of" in plan
    table.drop()
    assert G.Adjacency(edges.limit(0)).step(seeds, "id").count() == 0


def test_containment_at_any_depth(spark):
    chain = spark.range(300).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    every = G.closure(chain)
    assert every.count() == 300 * 301 // 2
    assert G.closure(chain, spark.createDataFrame([(100,)], "id long")).count() == 200
    ring = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (None, 5)], "src long, dst long")
    assert {tuple(r) for r in G.closure(ring).collect()} == {(a, b) for a in (1, 2, 3) for b in (1, 2, 3, 4)}
    assert {r.id for r in G.contained(spark.range(30).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")), 0).collect()} == set(range(1, 31))


def test_cells_find_the_nearest(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").withColumnRenamed("vec_id", "id")
    odd = spark.createDataFrame([(-1, None, 0), (-2, [0.0] * 64, 0), (-3, [1.0], 0)], vectors.schema)
    index = N.CellIndex(vectors.union(odd), cells=20)
    queries = [r.embedding for r in vectors.where("id % 25 = 0").orderBy("id").collect()]
    found = asked = 0
    for q in queries:
        want = [r.id for r in V.knn(vectors, q, 10).collect()]
        found += len(set(want) & {r.id for r in index.knn(q, 10, probes=12).collect()})
        asked += 10
    assert found / asked >= 0.9
    exact = [tuple(r) for r in V.knn(vectors, queries[0], 30).collect()]
    assert [tuple(r) for r in index.knn(queries[0], 30, probes=20).collect()] == exact
    assert {r.id for r in index.knn(queries[0], 999, probes=20).where("distance is null").collect()} >= {-1, -2}
    assert index.near(queries[0], 3).select("cell").distinct().count() <= 4
    assert N.CellIndex(vectors.limit(0)).knn(queries[0]).count() == 0
