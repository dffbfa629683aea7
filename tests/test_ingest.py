"""Readers, sinks, ingest, jobs, plug-ins and façade on small fixtures with known answers."""

import pytest
from pyspark.sql import functions as F

from conceptlake import plugins
from conceptlake.api import Lake
from conceptlake.functions import chunks as C
from conceptlake.functions import text as X
from conceptlake.operators import concepts as K
from conceptlake.operators import dedup as D
from conceptlake.operators import entities as E
from conceptlake.operators import graph as G
from conceptlake.operators import ingest, jobs
from conceptlake.operators import vector as V
from conceptlake.sources import readers, sinks

from . import chunk_model as M

NODES = "id string, label string, name string, normalized_name string, type string, description string, source string"


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "a (Ann Lee) (Z-Library).txt").write_text("Python and Docker.")
    (tmp_path / "in/b.txt").write_bytes("caf\xe9".encode("latin-1"))
    (tmp_path / "c.md").write_text("---\ntitle: Notes\nauthor: Bo\n---\n# Head\n\nA *rest* &amp; more")
    (tmp_path / "d.json").write_text('{"title": "T", "text": "json text"}')
    (tmp_path / "e.json").write_text('{"title": "U", "text": ""}')
    (tmp_path / "f.html").write_text("<p>one</p><p>two</p>")
    (tmp_path / "g.pdf").write_bytes(b"%PDF pages")
    return str(tmp_path)


def test_readers(spark, folder):
    got = {r.title: (r.source, r.text) for r in readers.folder(spark, folder, (".txt", ".md", ".html", ".json", ".pdf"), parse_pdf=lambda b: (b.decode()[5:], {"title": "P"})).collect()}
    assert got["b"] == ("Text File", "café") and got["T"] == ("JSON File", "json text") and got["P"] == ("PDF File", "pages")
    assert got["c"][1] == "Head A rest & more" and got["f"][1] == "one two" and "U" not in got and len(got) == 6
    assert readers.markdown_files(spark, folder).first().metadata == {"title": "Notes", "author": "Bo"}
    assert readers.text_files(spark, folder, recursive=False).count() == 1
    assert [r.file_path[-5:] for r in readers.paths(spark, folder, (".txt", ".md", ".txt")).collect()] == [").txt", "/c.md", "b.txt"]
    with pytest.raises(ValueError):
        readers.folder(spark, folder, (".doc",))


def test_markdown_keeps_its_text(spark, tmp_path):
    cases = {
        "snake_case_name and a__init__b, __strong__.": "snake_case_name and a__init__b, strong.",
        "2*3*4 = 24, a * b * c": "2*3*4 = 24, a * b * c",
        "```python\n# comment\nx = a_b * c\nif a < b > c & d:\n```\nend": "# comment x = a_b * c if a < b > c & d: end",
        "see [the *link*](http://x.y \"t\") and ![pic](p.png)": "see the link and pic",
        "**bold `a_b*c` text** and _it_ and ***both***": "bold a_b*c text and it and both",
        "# Head\n\n#hash ## no\n### Three": "Head #hash ## no Three",
        "<b>tag</b> &amp; `<i>` and a lone ` tick": "tag & <i> and a lone ` tick",
    }
    for i, text in enumerate(cases):
        (tmp_path / f"{i}.md").write_text(text)
    got = {r.title: r.text for r in readers.markdown_files(spark, str(tmp_path)).collect()}
    assert [got[str(i)] for i in range(len(cases))] == list(cases.values())
    (tmp_path / "crlf").mkdir()
    (tmp_path / "crlf/a.md").write_bytes(b"---\r\ntitle: A: B\r\ndate: 1\r\n---\r\nBody")
    row = readers.markdown_files(spark, str(tmp_path / "crlf")).first()
    assert row.metadata == {"title": "A: B", "date": "1"} and row.text == "Body"


def test_open_metadata(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"text": "t", "title": "T", "year": 1999, "tags": ["x", "y"], "deep": {"k": null}, "none": null}')
    (tmp_path / "b.json").write_text("no json"), (tmp_path / "c.json").write_text('["text"]'), (tmp_path / "d.json").write_text('{"title": "no text"}')
    rows = readers.json_files(spark, str(tmp_path)).collect()
    assert [(r.text, r.metadata) for r in rows] == [("t", {"title": "T", "year": "1999", "tags": '["x","y"]', "deep": '{"k":null}'})]


def test_null_keys_and_repeated_rows(spark):
    a = spark.createDataFrame([(None, "x"), (1, "y")], "id int, n string")
    b = spark.createDataFrame([(None, "z"), (2, "w")], "id int, n string")
    assert sorted(map(str, (tuple(r) for r in sinks.upsert(a, b, ["id"]).collect()))) == ["(1, 'y')", "(2, 'w')", "(None, 'z')"]
    many = spark.createDataFrame([(1, "q"), (1, "p"), (3, None)], "id int, n string").repartition(3)
    assert {tuple(r) for r in sinks.first_rows(many, ["id"]).collect()} == {(1, "p"), (3, None)}


def test_names(spark):
    name = "A Book (Ann Lee) (2nd) (Z-Library).pdf"
    row = spark.createDataFrame([(name, "/x/deep_learning-texts/f.pdf", "few-shot LEARNING's")], ["n", "p", "k"])
    got = row.select(X.file_author(F.col("n")), X.file_title(F.col("n")), X.last_author(F.col("n")), X.folder_category(F.col("p")), X.title_case(F.col("k"))).first()
    assert tuple(got) == ("Ann Lee", "A Book", "Z-Library", "Deep learning texts", "few-shot learning's".title())


def test_vectors_and_nodes(spark, tmp_path):
    docs = spark.createDataFrame([("1", "x", "T", ["a", "b"]), (None, "y", None, None)], "id string, document string, title string, tags array<string>")
    rows = sinks.vector_rows(docs).orderBy("document").collect()
    assert rows[0].id == "1" and rows[1].id.startswith("doc_") and rows[0].tags == "a,b" and rows[0].title_lower == "t"
    nodes = sinks.document_nodes(docs.withColumnRenamed("id", "doc_id").withColumn("author", F.lit("me")))
    assert [r.name for r in nodes.orderBy("name").collect()] == ["T", "Untitled"]
    path = f"file://{tmp_path}/t"
    sinks.write_table(docs, path), sinks.write_table(docs, path)
    assert spark.read.parquet(path).count() == 4
    assert sinks.clear(spark, path) and not sinks.clear(spark, path)


def graph(spark):
    nodes = spark.createDataFrame([("d1", "Document", "One", None, None, None, None), ("concept-a", "Concept", "Alpha", "alpha", "Concept", "old", "x")], NODES)
    return nodes, spark.createDataFrame([], ingest.EDGE)


def test_entities_and_links(spark):
    nodes, edges = graph(spark)
    found = spark.createDataFrame([("d1", "concept-a", "ALPHA", "kw", "Bad label!"), ("d9", "concept-b", "Beta", "kw", "Tool")], "doc_id string, concept_id string, name string, source string, label string")
    nodes, edges = ingest.link_entities(nodes, edges, found, ["doc_id"])
    got = {r.id: (r.label, r.name, r.description) for r in nodes.collect()}
    assert got["concept-a"] == ("Concept", "ALPHA", "old") and got["concept-b"][0] == "Tool"
    assert [(r.src, r.dst, r.type) for r in edges.collect()] == [("d1", "concept-a", "MENTIONS")]  # d9 is no node
    again = ingest.link_entities(nodes, edges, found, ["doc_id"])[1]
    assert again.count() == 1


def test_concept_links(spark):
    nodes, edges = graph(spark)
    links = spark.createDataFrame([("concept-a", "ALPHA", None), ("concept-a", "concept-z", 0.9), ("Gamma", "Alpha", 0.7), ("gamma", "alpha", 0.1)], "source string, target string, strength double")
    nodes, edges = ingest.link_concepts(nodes, edges, links)
    names = {r.id: r.name for r in nodes.collect()}
    got = {(names[r.src], names[r.dst]): r.strength for r in edges.collect()}
    assert got == {("Alpha", "Alpha"): 0.5, ("Gamma", "Alpha"): 0.7, ("gamma", "alpha"): 0.1}


def test_add_documents(spark):
    nodes, edges = graph(spark)
    store = spark.createDataFrame([("known text",)], ["text"])
    docs = spark.createDataFrame([("d1", "One", "Python uses Docker. The API is a REST thing."), ("d2", "Two", "KNOWN  text"), ("d3", "Three", "python uses docker. the api is a rest thing.")], "doc_id string, title string, text string")
    lake = Lake(spark, documents=store, nodes=nodes, edges=edges)
    out = lake.add_documents(docs, "Programming")
    assert [r.doc_id for r in out["documents"].collect()] == ["d1"]
    assert {r.keyword for r in out["mentions"].collect()} == {"python", "docker", "api", "rest"}
    edges = {(r.src, r.dst): (r.type, r.strength) for r in out["edges"].collect()}
    ids = {r.keyword: r.concept_id for r in out["mentions"].collect()}
    assert edges[ids["python"], ids["docker"]] == ("IMPLEMENTS_METHOD", 0.8) and edges["d1", ids["api"]][0] == "MENTIONS" and edges["d1", "d1-chunk-0"][0] == "HAS_CHUNK"
    assert out["nodes"].where("label = 'Chunk'").first().description.startswith("Python uses")
    legacy = ingest.legacy_vectors(docs, out["mentions"]).where("id = 'd1'").first()
    assert legacy.concept_id == ids["python"] and legacy.concept_ids.count(",") == 3


def test_cascade(spark):
    kind = "doc_id string, title string, content_hash string, metadata_hash string, file_path string"
    store = spark.createDataFrame([("s1", "Introduction to Machine Learning", "h1", "m1", "/p1"), ("s2", "Other", "h2", None, "/p2"), ("s3", "ab", "h3", "m3", "/p3")], kind)
    docs = spark.createDataFrame([("1", "x", "h1", "m9", "/p2"), ("2", "x", "h9", "m1", None), ("3", "x", None, None, "/p2"), ("4", "introduction to machine learning!", None, None, None), ("5", "nothing", None, None, None), ("6", "AB", None, None, None)], kind)
    got = {r.doc_id: (r.existing_id, r.method) for r in D.cascade(docs, store).collect()}
    assert got == {"1": ("s1", "content_hash"), "2": ("s1", "metadata_hash"), "3": ("s2", "file_path"), "4": ("s1", "title"), "5": (None, None), "6": ("s3", "title")}


def test_similar_titles_brute_force(spark):
    words = "graph data machine learning a the of systems deep introduction to neural nets".split()
    titles = [" ".join(words[(i * k) % len(words)] for k in range(1, 2 + i % 7)) for i in range(40)]
    titles += [t.replace("a", "e", 1) for t in titles] + [t + "s" for t in titles] + ["", "a", "aaaaaaaaaaaa", "aaaaaaaaaaa"]
    rows = spark.createDataFrame(list(enumerate(titles)), "doc_id long, title string")
    for least in (80, 90):
        got = {(r.a_id, r.b_id) for r in D.similar_titles(rows, rows, least).collect()}
        assert got == {(i, j) for i, x in enumerate(titles) for j, y in enumerate(titles) if M.title_ratio(x, y) >= least}


def test_graph(spark):
    edges = spark.createDataFrame([(1, "a", "b", "R", 0.2), (2, "b", "c", "R", None), (3, "c", "a", "R", 0.9), (4, "a", "b", "R", 0.5)], "edge_id long, src string, dst string, type string, strength double")
    nodes = spark.createDataFrame([(x, "Concept", x.upper() * 3) for x in "abc"], "id string, label string, name string")
    assert {(r.id, r.strength) for r in G.neighbours(edges, "b").collect()} == {("a", 0.5), ("c", None)}
    seeds = spark.createDataFrame([("a",)], ["id"])
    for hops in (1, 2, 3):
        best = {}
        for r in G.paths(edges, seeds, hops).collect():
            weight = {1: 0.2, 2: 0.5, 3: 0.9, 4: 0.5}
            best[r.at] = max(best.get(r.at, 0), sum(weight[e] for e in r.used))
        assert {r.target: round(r.relevance, 6) for r in G.reach(edges, seeds, hops).collect()} == {k: round(v, 6) for k, v in best.items()}
    assert [(r.distance, r.n, r.targets) for r in G.by_distance(G.reach(edges, seeds)).orderBy("distance").collect()] == [(0, 2, ["b", "c"]), (1, 1, ["a"])]
    assert [(r.related_id, r.strength) for r in G.concept(nodes, edges, "bb").collect()] == [("c", None), ("a", 0.5)]
    assert {r.id for r in G.contained(edges, "a").collect()} == {"a", "b", "c"}
    assert G.counts(nodes, edges).first() == (3, 4, 3, 0)
    mentions = spark.createDataFrame([("d", "a"), ("d", "b")], ["src", "dst"])
    assert {(r.concept, r.other) for r in G.triangle(edges, mentions, "d").collect()} == {("a", "b"), ("b", "a")}
    assert G.endpoints(edges, nodes).count() == 4
    assert G.of_type(nodes.withColumn("document_type", F.lit("book")), "book").count() == 3
    texts = spark.createDataFrame([("x" * 120, 0.4), ("y", 0.9), (None, None)], "text string, weight double")
    assert G.at_least(texts, length=100).count() == 1 and G.at_least(texts, weight=0.5).count() == 1


def test_chunk_lookups(spark):
    chunks = spark.createDataFrame([("k1", "c1", "c1,c2", "b1", None, None, "x" * 300), ("k2", None, "c2,c1", None, "h1", None, "y")], "id string, concept_id string, concept_ids string, book_id string, chapter_id string, section_id string, text string")
    assert [r.id for r in G.chunks_about(chunks, "c1").collect()] == ["k1", "k2"] and G.chunks_about(chunks, "c1", distinct=False).count() == 3
    assert len(G.passages_about(chunks, "c2").where("id = 'k1'").first().snippet) == 203
    nodes = spark.createDataFrame([("b1", "Book", None, "Title"), ("h1", "Chapter", None, None), ("c1", "Concept", "N", None)], "id string, label string, name string, title string")
    assert {(r.id, r.label, r.name) for r in G.linked_nodes(chunks, nodes).collect()} == {("k1", "Book", "Title"), ("k1", "Concept", "N"), ("k2", "Chapter", "Unnamed")}
    assert G.node_chunks(chunks, "book", "b1").count() == 1
    exported = G.export_tables(nodes, spark.createDataFrame([("b1", "c1", "MENTIONS")], "src string, dst string, type string"))
    assert [exported[k].count() for k in ("books", "concepts", "book_concept_relationships", "concept_relationships")] == [1, 1, 1, 0]


def test_vectors(spark):
    rows = spark.createDataFrame([(i, [float(i), 1.0], f"word{i} here") for i in range(5)] + [(9, [0.0, 0.0], "")], "id long, embedding array<float>, text string")
    assert V.health(rows, 2).first() == (6, 0, 1)
    queries = spark.createDataFrame([(0, [0.0, 1.0]), (1, [5.0, 1.0])], "query_id long, query array<float>")
    assert [(r.query_id, r.id) for r in V.knn_many(rows, queries, 1).orderBy("query_id").collect()] == [(0, 0), (1, 4)]
    got = V.search_many(rows.where("id < 9"), queries, V.overlap_score("word3 here", F.col("text")), 2, 2).collect()
    assert got[0].id == 3 and got[0].distance == 0
    made = V.embed(rows.select("id", "text")).orderBy("id").collect()
    assert len(made[0].embedding) == 64 and abs(sum(x * x for x in made[0].embedding) - 1) < 1e-6 and not any(made[-1].embedding)
    assert V.embed(spark.createDataFrame([(None,)], "text string")).first().embedding == [0.0] * 64


def test_jobs(spark, tmp_path):
    runner = jobs.Runner(spark, f"file://{tmp_path}/jobs")
    done = runner.create("count", lambda s: s.range(10).count(), "ann", 10)
    bad = runner.create("fail", lambda s: 1 / 0, "bo")
    assert runner.wait(done) == "completed" and runner.wait(bad) == "failed"
    rows = {r.job_id: r for r in jobs.progress(jobs.latest(runner.log())).collect()}
    assert rows[done].result == "10" and rows[done].progress == 100 and "division" in rows[bad].error
    lake = Lake(spark, runner)
    assert {r.message for r in lake.list_jobs(created_by="bo").collect()} == {"division by zero"}
    import threading

    go = threading.Event()
    slow = [runner.create("wait", lambda s: go.wait(60), "ann") for _ in range(5)]
    assert not runner.cancel(slow[4], "bo") and runner.cancel(slow[4], "ann") and not runner.cancel(slow[4])
    go.set()
    assert [runner.wait(j) for j in slow] == ["completed"] * 4 + ["cancelled"]
    old = jobs.latest(runner.log())
    assert jobs.without_old(old, "2100-01-01 00:00:00").count() == 0 and jobs.without_old(old, "2000-01-01 00:00:00").count() == 7


class Fake(plugins.Offline):
    def generate(self, prompt):
        if prompt.startswith("List the concepts"):
            return 'Sure: [{"name": "Alpha", "type": "T", "description": "d", "related": ["B"]}, {"name": "alpha"}, 3]' if "alpha" in prompt else "none"
        if prompt.startswith("List the relations"):
            return '{"source": "Alpha", "target": "B", "type": "is a", "strength": 0.4}'
        return "error" if "bad" in prompt else "Mostly positive. SELECT count(*) AS n FROM docs;"


def test_plugins(spark):
    docs = spark.createDataFrame([("1", "about alpha"), ("2", None)], "doc_id string, text string")
    found = plugins.extracted_concepts(docs, Fake)
    assert [(r.doc_id, r.name, r.description, r.related_concepts) for r in found.collect()] == [("1", "Alpha", "d", ["B"])]
    assert [tuple(r) for r in plugins.extracted_relations(docs, found, Fake).collect()] == [("1", "Alpha", "B", "IS_A", 0.4)]
    assert {(r.doc_id, r.sentiment) for r in plugins.sentiments(docs, Fake).collect()} == {("1", "POSITIVE"), ("2", "UNKNOWN")}
    assert plugins.summaries(docs, Fake).count() == 2
    assert len(plugins.embedded(docs, Fake).first().embedding) == 32
    both = plugins.Fallback(Fake(), plugins.Offline())
    assert both.generate_batch(["x", "bad", "y"])[1:] == plugins.Offline().generate_batch(["bad", "y"])
    assert Lake(spark, docs=docs).ask(Fake(), "how many?").first().n == 2


def test_chunk_rows(spark):
    docs = spark.createDataFrame([("1", "T", "A. " * 700, ["x", "y"]), ("2", "U", None, None), ("3", "U", "", None)], "doc_id string, title string, text string, tags array<string>")
    rows = C.document_chunks(docs).orderBy("chunk_index").collect()
    assert {r.doc_id for r in rows} == {"1"} and rows[0].total_chunks == len(rows) and rows[0].tags == "x,y" and rows[0].title_lower == "t" and rows[0].metadata_hash and rows[0].content_hash
    again = C.rechunk(C.chunk_rows(docs, C.semantic_chunks(F.col("text"), 300, 0)), lambda t: C.semantic_chunks(t, 1000, 0)).collect()
    assert sum(r.text.count("A.") for r in again) == 700
    assert C.extraction_chunks(docs).count() == 2


def test_merges(spark):
    rows = spark.createDataFrame([("d", 0, "Alpha", "T", "one", ["b"]), ("d", 1, "alpha", "U", "one more", ["c"]), ("d", 2, "ALPHA", None, "one", None)], "doc_id string, chunk int, name string, type string, description string, related array<string>")
    r = K.merge_chunks(rows.where("related is not null")).first()
    assert (r.name, r.type, r.description, r.related_concepts, r.chunks) == ("Alpha", "T", "one; one more", ["b", "c"], [0, 1])
    out = K.merge_longest(rows, spark.createDataFrame([("d", "Alpha", "B", "IS_A", 0.5)], "doc_id string, source string, target string, type string, strength double")).first()
    assert out.description == "one more" and out.relationships[0].target == "B"
    kind = "doc_id string, src string, dst string, type string, strength double, method string, seq int"
    strong = spark.createDataFrame([("d", "a", "b", "IS_A", 0.8, "pattern_based", 1), ("d", "a", "b", "IS_A", 0.5, "llm_based", 2), ("d", "a", "c", "IS_A", 0.8, "x", 5), ("d", "a", "c", "IS_A", 0.8, "y", 4)], kind)
    fallback = spark.createDataFrame([("d", "a", "c", "RELATED_TO", 0.3, "basic", 0), ("e", "a", "c", "RELATED_TO", 0.3, "basic", 0)], kind)
    got = {(r.doc_id, r.dst, r.type): r.method for r in E.fuse_relations(strong, fallback).collect()}
    assert got == {("d", "b", "IS_A"): "llm_based", ("d", "c", "IS_A"): "y", ("e", "c", "RELATED_TO"): "basic"}


def test_scalars(spark):
    got = spark.createDataFrame([(0.3, "is a"), (0.99, "has  part")], ["s", "t"]).select(X.strength_category(F.col("s")).alias("c"), X.relation_type(F.col("t")).alias("t"), X.relation_description(F.lit("a"), F.upper("t"), F.lit("b")).alias("d"), X.relevance(F.col("s")).alias("r")).collect()
    assert [(r.c, r.t) for r in got] == [("weak", "IS_A"), ("strong", "HAS__PART")] and got[0].d == "a is is a b"
    base = readers.by_ids(spark.range(10), [1, 2, 99])
    assert base.count() == 2 and readers.sample(spark.range(100), 5).collect() == readers.sample(spark.range(100), 5).collect()
    noisy = spark.createDataFrame([('x [{"k": "1"}, {"k": null}] y',), ('so {"k": "2"} it',), ("none",)], ["t"]).select(X.json_in_text(F.col("t"), "struct<k:string>").alias("j")).collect()
    assert [[x.k for x in r.j] for r in noisy] == [["1", None], ["2"], []]


def test_a_merge_leaves_other_buckets(spark, tmp_path):
    base = spark.range(500).select("id", F.concat(F.lit("n"), "id").alias("n"), F.lit(None).cast("string").alias("m"))
    table = sinks.KeyedTable(spark, f"file://{tmp_path}/t", ["id"], 16).create(base)
    files = lambda: {p.name: p.parent.name for p in (tmp_path / "t").rglob("*.parquet")}
    before = files()
    delta = spark.createDataFrame([(3, "x", "y"), (1000, "new", None)], "id long, n string, m string")
    buckets = table.merge(delta)
    after = files()
    assert len(buckets) <= 2 and {f for f, b in before.items() if b not in {f"_bucket={k}" for k in buckets}} <= set(after)
    assert not {f for f, b in before.items() if b in {f"_bucket={k}" for k in buckets}} & set(after)
    assert sorted(map(tuple, table.read().collect())) == sorted(map(tuple, sinks.upsert(base, delta, ["id"]).collect()))
    kept = table.merge(delta.where("id = 3"), lambda old, new: old.join(new, "id", "left_anti"))
    assert kept and table.read().where("id = 3").count() == 0 and table.read().count() == 500
    assert table.merge(delta.limit(0)) == []
