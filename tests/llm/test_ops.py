"""Brute force, held-out accuracy and edge cases of the subpackage's operators."""

import hashlib
import itertools
import math
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash

from conceptlake.llm import decontamination, fingerprints, html_text, kernel, language, licences, line_dedup, lm_scoring, mixing, ngram_join, registry, toxicity

D = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, x string, k long, h long"
ODD = [(1, None, None, None, None, None, 1, 2), (2, "", "en", "a", 0, "q", 1, 2), (None, "a b c d e f", "en", None, 1, "q", 1, 2), (3, "  \n\t ", "en", "a", 0, "q", None, 2), (4, "the cat sat on the mat " * 40, "en", "b", 5, "q", 1, 2), (4, "the cat sat on the mat " * 40, "en", "b", 5, "q", 1, 2), (5, "word" * 3000, None, "a", 3, "q", 1, 2)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{D}/documents.parquet")


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_oracle(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    got, want = registry.QUERIES[name](spark, D).toPandas(), c.execute(registry.SQL[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    rows = lambda df: sorted(map(tuple, df[cols].astype(str).values.tolist()))
    assert rows(got) == rows(want)


def test_kernel_words():
    texts = ["The cat", "", None, "  a\tb\x0bC ", "é!x", "x"]
    raw, offsets = kernel.utf8(pa.array(texts))
    h, s, e, rows = kernel.words(raw, offsets)
    split = [(t or "").lower().split() for t in texts]
    assert np.diff(rows).tolist() == [len(w) for w in split]
    assert [raw[a:b].tobytes().decode().lower() for a, b in zip(s, e, strict=True)] == sum(split, [])
    assert len(set(h.tolist())) == len(set(sum(split, [])))


def test_odd_rows(spark, odd):
    n = len(ODD)
    found = ngram_join.jaccard_components(odd).collect()
    assert len(found) == n and {r.component_id for r in found if r.doc_id == 4} == {4}
    assert fingerprints.fingerprint_edits(odd).count() == n
    assert mixing.plan(odd).count() == n and mixing.mixed(odd).columns == odd.columns
    assert language.identify(odd).where("doc_id in (1, 2, 3)").where("lang_pred <> 'und'").count() == 0
    assert lm_scoring.score(odd).count() == n
    assert line_dedup.deduplicated(odd).count() >= n - 3
    labels = spark.createDataFrame([(4, 1), (5, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    assert toxicity.Model(odd, labels).scores(odd).count() == n
    assert licences.scan(odd).count() == 0
    bench = spark.createDataFrame([(1, "the cat sat on the mat the cat sat on the mat"), (2, None)], "item_id long, text string")
    assert {r.doc_id for r in decontamination.find_leaks(odd, bench).collect()} == {4}


def test_empty(spark, odd):
    none = odd.limit(0)
    for f in (ngram_join.jaccard_components, fingerprints.fingerprint_edits, mixing.plan, language.identify, lm_scoring.score, line_dedup.deduplicated, licences.scan):
        assert f(none).count() == 0
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_language_held_out(spark, docs):
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.95 and got.score.between(0, 1).all()


def test_segmentations_are_summed():
    vocabulary = sorted({bytes([b]) for b in range(256)} | {b"ab", b" a"})
    p = np.full((len(vocabulary), 1), 0.1)
    got = language.forward(language.Lattice(vocabulary), p, np.array([[32, 97, 98]], np.uint8), np.array([3]))
    assert np.isclose(np.exp(got[0, 0]), 0.1**3 + 2 * 0.1**2)


def test_leaks_against_brute_force(spark, docs):
    items = spark.read.parquet(f"{D}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in decontamination.find_leaks(docs, items).collect()}
    want = {(d.doc_id, i.item_id) for d in docs.collect() for i in items.collect() if i.text in d.text}
    assert want <= got
    swapped = spark.createDataFrame([(9, "x y " + " ".join("zz" if k == 7 else f"w{k}" for k in range(20)) + " q")], "doc_id long, text string")
    item = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(20)))], "item_id long, text string")
    assert [(r.start_word, r.n_words, r.matched) for r in decontamination.find_leaks(swapped, item).collect()] == [(2, 20, 19)]


@pytest.mark.parametrize("n", range(5, 20))
def test_leaks_at_all_placings(n):
    """Every placing of substitutions that leaves four fifths or 13 of the item's tokens (up to a fifth substituted), and texts that end within it."""
    item = [f"w{k}" for k in range(n)]
    index = decontamination.Index([(1, " ".join(item))], 13)
    placings = [set(x) for r in range(n // 5 + 1) for x in itertools.combinations(range(n), r)]
    texts = ["x " + " ".join("zz" if k in p else w for k, w in enumerate(item)) + " q" for p in placings]
    texts += ["x " + " ".join(item[: n - r]) for r in range(1, n // 5 + 1)] + [" ".join(item[r:]) + " q" for r in range(1, n // 5 + 1)]
    raw, offsets = kernel.utf8(pa.array(texts))
    h, _, _, rows = kernel.words(raw, offsets, kernel.WORD_BYTE)
    found = index.leaks(h, rows)
    assert [r for r, *_ in found] == list(range(len(texts)))
    assert all(m >= min(13, -(-4 * n // 5)) for *_, m in found)
    few = [" ".join("zz" if k <= max(n // 5, n - 13) else w for k, w in enumerate(item))]
    raw, offsets = kernel.utf8(pa.array(few))
    h, _, _, rows = kernel.words(raw, offsets, kernel.WORD_BYTE)
    assert index.leaks(h, rows) == []


def test_html(spark):
    page = "<html><head><title>t</title><script>x='</p>'</script></head><body><nav><a>menu</a></nav><article><h1>A &amp; B</h1><p>one <b>two</b>\n three<div class='comments'><p>reader</p></div><aside>s</aside></article><footer>f</footer></body></html>"
    bare = "<body><p>Site menu line</p><p>{}</p><p>Contact us</p></body>"
    rows = [(1, "http://a/x", page), (2, "http://b/1", bare.format("first story is long enough to be more than half")), (3, "http://b/2", bare.format("another story that is also long enough for this")), (4, None, None)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "A & B one two three", 2: "first story is long enough to be more than half", 3: "another story that is also long enough for this", 4: ""}


def texts_of(spark, rows):
    return {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_html_keeps_marked_articles(spark):
    """Headings, summaries and passages that articles share stay; class names that only sound like a menu's keep their text."""
    page = "<body><nav>menu</nav><article><h1>Title</h1><p>Summary.</p><p>{}</p><p>a passage that articles quote</p></article></body>"
    story = [f"story {k} " + " ".join(f"w{k}x{j}" for j in range(20)) for k in range(4)]
    got = texts_of(spark, [(k, f"http://a/{k}", page.format(story[k])) for k in range(4)])
    assert got == {k: f"Title Summary. {story[k]} a passage that articles quote" for k in range(4)}
    own = "<article><p class='ad-hoc'>one</p><p class='social-history'>two</p><table><tr><td class='table-header'>three</td></tr></table><p><math><mi>x</mi><mo>=</mo><mn>1</mn></math></p><div class='usercomments'>reader</div></article>"
    assert texts_of(spark, [(1, "http://a/1", own)]) == {1: "one two three x=1"}


def test_html_articles_of_the_tables(spark):
    """All pages against an independent reader: in the tables an article holds nothing but its text."""
    from html.parser import HTMLParser

    class Article(HTMLParser):
        def __init__(self):
            super().__init__()
            self.inside, self.texts = 0, []

        def handle_starttag(self, tag, attrs):
            self.inside += tag == "article"
            self.texts += [" "] * (tag not in html_text.INLINE)

        def handle_endtag(self, tag):
            self.inside -= tag == "article"
            self.texts += [" "] * (tag not in html_text.INLINE)

        def handle_data(self, data):
            self.texts += [data] * (self.inside > 0)

    pages = "/root/testdata/sf0.1/pages.parquet"
    got = {r.page_id: r.text for r in html_text.extract(spark.read.parquet(pages)).collect()}
    rows = spark.read.parquet(pages).select("page_id", "html").collect()
    for r in rows:
        reader = Article()
        reader.feed(r.html), reader.close()
        assert got[r.page_id] == " ".join("".join(reader.texts).split())
    assert len(rows) == len(got) == 2500


def test_alignment_halves_long_pages(monkeypatch):
    rng = np.random.default_rng(4)
    for _ in range(40):
        a, b = rng.integers(0, 6, rng.integers(0, 40)).tolist(), rng.integers(0, 6, rng.integers(0, 40)).tolist()
        monkeypatch.setattr(html_text, "ALIGNED", 1 << 22)
        want = len(html_text.common(a, b))
        monkeypatch.setattr(html_text, "ALIGNED", 20)
        got = html_text.common(a, b)
        assert len(got) == want and all(a[i] == b[j] for i, j in got) and all(p[0] < q[0] and p[1] < q[1] for p, q in itertools.pairwise(got))


def test_html_steps_over_copies(spark):
    page = "<body><p>Site menu line with many entries of the site</p><p>{}</p></body>"
    copy = page.format("one story that stands at four neighbouring URLs")
    rows = [(k, f"http://a/{k}", copy) for k in range(4)] + [(4, "http://a/4", page.format("short"))]
    assert texts_of(spark, rows) == {**{k: "one story that stands at four neighbouring URLs" for k in range(4)}, 4: "short"}


def test_html_partners_beyond_any_run_of_copies(spark, monkeypatch):
    """Small buckets, runs of near copies longer than several of them, hosts of one page and of copies alone: as with the whole host at hand."""
    rng = np.random.default_rng(8)
    body = [f"line {k} of a story that many pages of the site repeat word for word" for k in range(12)]
    rows = []
    for host, runs in (("a", (1, 40, 2)), ("b", (30, 1)), ("c", (25,)), ("d", (1,)), ("e", (3, 1, 33, 1, 1))):
        for n, size in enumerate(runs):
            for _ in range(size):
                own = [f"{x} {host}{n}" for x in body]
                own[int(rng.integers(12))] = f"only {len(rows)}"
                lines = [f"Menu of {host}", *own[:6], f"Notice of {host}" * (n % 2), *own[6:], f"Contact {host}"]
                rows.append((len(rows), f"http://{host}/{len(rows):04d}", "".join(f"<p>{x}</p>" for x in lines if x)))
    want = texts_of(spark, rows)
    whole = {}
    for i, url, page in rows:
        whole.setdefault(url[7], []).append((url[7], False, [(x, len(x)) for x in html_text.blocks(page)[0]]))
    at = [(host, k) for host in whole for k in range(len(whole[host]))]
    for (i, _, _), (host, k) in zip(rows, at, strict=True):
        gone = html_text._gone(whole[host], k)
        assert want[i] == " ".join(x for j, (x, _) in enumerate(whole[host][k][2]) if j not in gone)
    assert "Menu" not in want[20] and "Menu" in want[80] and sum("Menu" in x for x in want.values()) == 26
    monkeypatch.setattr(html_text, "BUCKET", 4)
    monkeypatch.setattr(html_text, "REACH", 1)
    assert texts_of(spark, rows) == want


def test_lines_brute_force(spark):
    base = "this line is long enough to be compared with other lines of the corpus"
    rows = spark.createDataFrame([(1, base), (2, base.replace("long", "lung") + "\nshort"), (3, base[3:]), (4, base + "!!")], "doc_id long, text string")
    assert [(r.doc_id, r.gone) for r in line_dedup.removals(rows).orderBy("doc_id").collect()] == [(2, [0]), (4, [0])]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def dedup_by_hand(docs):
    """The texts (by doc_id) without lines that repeat an earlier one, over all pairs of lines."""
    at = [(i, k, x.strip(" ")) for i, t in sorted(docs.items()) for k, x in enumerate(t.split("\n")) if x.strip(" ")]
    texts = sorted({x for *_, x in at})
    root = {x: x for x in texts}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a, b in itertools.combinations(texts, 2):
        most = min(2, min(len(a), len(b)) // 24)
        if abs(len(a) - len(b)) <= most and find(a) != find(b) and edits(a, b) <= most:
            root[find(a)] = find(b)
    seen, gone = set(), set()
    for i, k, x in at:
        (gone.add((i, k)) if find(x) in seen else seen.add(find(x)))
    kept = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in docs.items()}
    return {i: t for i, t in kept.items() if t.strip(" ") or not any(g == i for g, _ in gone)}


def test_short_lines_brute_force(spark):
    base, mid = "this line is long enough to be compared with other lines of the corpus", "a line of thirty characters, so"
    docs = {1: f"{base}\nshort\n{mid}\n\nYes.", 2: f"short\n{base.replace('long', 'lung')}\n\nnew here", 3: "short", 4: f"{mid}x\nshirt\n  Yes. ", 5: f"{mid}xyz\n{base[:46]}\n{base[:44]}", 6: "ab\nab\nac"}
    got = {r.doc_id: r.text for r in line_dedup.deduplicated(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    assert got == dedup_by_hand(docs) and 3 not in got and got[6] == "ab\nac"


def test_near_copies_of_a_line_are_told_apart_before_pairs(spark, monkeypatch):
    """Lines of one length and the same letters with other words in other places aren't paired; those within the edits are all found."""
    rng = np.random.default_rng(3)
    base = " ".join("".join(rng.choice(list("aeinorst"), rng.integers(2, 9))) for _ in range(40))
    lines = []
    for _ in range(60):
        at, word = int(rng.integers(60, len(base))), "".join(rng.permutation(list("bcdfgh")))
        lines.append(base[:at] + word + base[at:])
    for k in range(0, 60, 10):
        at = int(rng.integers(10, 50))
        lines += [lines[k][:at] + "z" + lines[k][at + 1 :], lines[k][:at] + lines[k][at + 2 :]]
    pairs, verified = [], line_dedup._verified
    monkeypatch.setattr(line_dedup, "_verified", lambda texts, found, most: [pairs.append(found.count()), verified(texts, found, most)][1])
    got = line_dedup.deduplicated(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"))
    assert {r.doc_id: r.text for r in got.collect()} == dedup_by_hand(dict(enumerate(lines)))
    assert pairs[1] < 300  # 1500 and more pairs share a key, a bag and a length


def test_pairs_of_neighbours_never_part_a_match(spark):
    rng = np.random.default_rng(6)
    rows = []
    for _ in range(400):
        x = list(rng.choice(list("abé😀z "), rng.integers(24, 80)))
        y = list(x)
        for _ in range(min(2, len(x) // 24)):
            k, kind = int(rng.integers(0, len(y))), rng.integers(0, 3)
            y[k : k + (kind != 1)] = [] if kind == 0 else [str(rng.choice(list("qab😀")))]
        rows.append(("".join(x), "".join(y)))
    codes = lambda c: f"transform(split({c}, ''), c -> ascii(c))"
    both = spark.createDataFrame(rows, "p string, q string").selectExpr("*", f"{codes('p')} as x", f"{codes('q')} as y").selectExpr("*", "size(x) as nx", "size(y) as ny")
    both = both.selectExpr("*", f"{line_dedup.DUO.replace('(u', '(x')} as duox", f"{line_dedup.DUO.replace('(u', '(y')} as duoy")
    got = both.select("p", "q", line_dedup.within().alias("w"), line_dedup.alike(2).alias("alike")).collect()
    assert all(r.alike for r in got if r.w) and sum(r.w for r in got) > 300


def lm_vocabulary():
    """Counts of words that are tokens, and of others by ending."""
    rng = np.random.default_rng(1)
    known = rng.permutation(1 << 20)[:50].astype(np.uint64)
    return lm_scoring.Vocabulary(known, np.arange(60, 10, -1), np.arange(lm_scoring.ENDINGS) % 7)


def test_token_probabilities_sum_to_one_and_learn():
    vocabulary = lm_vocabulary()
    net = lm_scoring.Network(lm_scoring.Network.start(vocabulary.counts))
    every = np.arange(lm_scoring.TOKENS)
    context = np.repeat(np.array([[3], [lm_scoring.TOKENS], [9], [300]]), len(every), 1)
    for _ in range(20):
        assert np.isclose(np.exp(net.log_probability(context, every).astype(float)).sum(), 1, atol=1e-3)
        net.train(context[:, :8], np.array([5, 5, 5, 5, 5, 5, 5, 6]))
    p = np.exp(net.log_probability(context, every))
    assert p[5] > p[6] > p[7:].max()
    with np.errstate(divide="ignore"):
        assert np.isclose(np.exp(lm_scoring.Network(lm_scoring.Network.start(vocabulary.counts)).log_probability(context, every))[: 50], vocabulary.counts[:50] / vocabulary.counts.sum(), rtol=1e-3).all()


def test_gradients_by_differences():
    """A step moves every parameter against the slope of the summed log-probability."""
    vocabulary = lm_vocabulary()
    rng = np.random.default_rng(2)
    token, context = rng.integers(0, 40, 30), rng.integers(0, 40, (4, 30))
    start = lm_scoring.Network.start(vocabulary.counts)
    start += rng.normal(0, 0.05, len(start)).astype(np.float32) * (start > -100)
    net = lm_scoring.Network(start.copy())
    net.train(context, token)
    moved, checked = net.vector - start, 0
    for i in np.argsort(-np.abs(moved))[:40].tolist():
        losses = []
        for step in (1e-2, -1e-2):
            v = start.copy()
            v[i] += step
            losses.append(lm_scoring.Network(v).log_probability(context, token).astype(float).sum())
        slope = (losses[0] - losses[1]) / 2e-2
        if abs(slope) > 1e-2:
            assert slope * moved[i] > 0
            checked += 1
    assert checked > 20


def test_scores_need_no_partitioning_and_count_all(spark, docs):
    rows = docs.select("doc_id", "text")
    one, many = ({r.doc_id: (r.score, r.n_tokens) for r in lm_scoring.score(rows.repartition(n)).collect()} for n in (1, 7))
    assert one.keys() == many.keys() and max(abs(one[k][0] - many[k][0]) for k in one) < 1e-2 * 5
    tokens = {r.doc_id: len(re.findall(r"[A-Za-z0-9\x80-\U0010ffff]+", r.text or "")) for r in rows.collect()}
    assert {k: n for k, (_, n) in one.items()} == tokens


def test_every_text_is_trained_on_once(spark, docs, monkeypatch):
    """All texts are in the shards of one of the two rounds."""
    counts = lm_scoring.count_words(docs)
    model, size = lm_scoring.vocabulary(counts)
    assert size == sum(r.n for r in counts.collect())
    rows = lm_scoring.tokenised(docs, spark.sparkContext.broadcast(model), 6).toPandas()
    assert sorted(rows["shard"].unique()) == list(range(6)) and rows["tokens"].map(len).sum() == 2 * size
    rare = rows["rare"].map(len).sum()
    assert rare == size - sum(sorted((r.n for r in counts.collect()), reverse=True)[: lm_scoring.TOKENS - lm_scoring.ENDINGS])


def test_word_probabilities_sum_to_one(spark):
    """With one word a text there is no context: the words' probabilities are what the network and the counts give, and sum to 1."""
    words = [f"word{chr(97 + k % 26)}{k}x" for k in range(400)]
    docs = spark.createDataFrame([(k, w) for k, w in enumerate(words)], "doc_id long, text string")
    got = lm_scoring.score(docs).toPandas()
    assert abs(np.exp(got["score"]).sum() - 1) < 1e-3


NOTICES = {
    "mit": ["This project is licensed under the MIT license.", "foo.py is released under the MIT License by Jane Doe.", 'Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the "Software"), to deal\nin the Software without restriction, including the rights to use and sell'],
    "apache": ["(c) 2020 Acme Corp. Licensed under the Apache License, Version 2.0.", "Released under the Apache License 2.0, see below."],
    "gpl": ["Licensed under the GPLv3.", "This work is licensed under the GNU General Public License, version 3."],
    "eupl": ["Licensed under the EUPL."], "bsl": ["Distributed under the Boost Software License, Version 1.0."], "mit-0": ["Released under the MIT-0 License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0."], "proprietary": ["All rights reserved."], "epl": ["Licensed under the Eclipse Public License v2.0"], "zlib": ["Released under the zlib License."],
}
PROSE = ["Our MIT license review is released under embargo.", "He holds a driving license from the state of Ohio.", "The license of the public was general.", "Copyright law is reserved for all rights holders.", "All human rights are reserved for people.", "This is part of a GPL project.", "The software is released in spring.", "A public domain of the function.", "", "Version 2.0"]


def test_licence_precision_and_recall(spark):
    rows = [(c, t) for c, ts in NOTICES.items() for t in ts] + [("", t) for t in PROSE]
    docs = spark.createDataFrame([(k, f"Some text here.\n{t}\nMore text.") for k, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {(r.doc_id, r.family) for r in licences.scan(docs).collect()}
    want = {(k, c) for k, (c, _) in enumerate(rows) if c}
    assert len(got & want) >= 0.9 * len(want) and len(got - want) <= 1
    both = docs.where("doc_id < 3").union(docs.where("doc_id < 3"))
    assert licences.scan(both).count() == 3


# Lines that are in no frame of the module (they were seen while its frames were written), and prose about the same words.
# A line with two licences has one of them.
SHORT = [("mit", "This project is MIT licensed."), ("apache", "Licensed under Apache 2"), ("bsd", "License: BSD-2-Clause"), ("cc-by", "CC-BY-4.0"), ("gpl", "Distributed under the terms of the GPL-2.0-only license."), ("mit apache", "Dual-licensed under MIT or Apache-2.0."), ("mit", "See the LICENSE file for the MIT license text."), ("mit", "MIT"), ("gpl", "GNU General Public License v3.0 or later (GPLv3+)"), ("cc-by", "Cette œuvre est mise à disposition sous licence Creative Commons Attribution 4.0 International.")]
HELD = [
    ("mit", "License :: OSI Approved :: MIT License"), ("mit", '"license": "MIT",'), ("mit", "license: mit"), ("apache", 'license = "Apache-2.0"'), ("gpl", "foo is copyright 2011 Jane Doe and may be copied under GPL version 3."), ("bsd", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."), ("mit", "(c) 2021 Foo Bar, MIT License"), ("mpl", "This file is covered by the MPL 2.0."), ("lgpl", "The library is LGPL-2.1 licensed, see COPYING."), ("agpl", "Server code: AGPLv3."),
    ("cc-by-sa", "Content on this site is CC BY-SA 4.0 unless noted."), ("cc-by-nc", "Images: CC BY-NC 4.0"), ("cc0", "The dataset is released into the public domain under CC0."), ("isc", "ISC License"), ("unlicense", "This project is released under the Unlicense."), ("epl", "Made available under the Eclipse Public License v2.0."), ("eupl", "Veröffentlicht unter der EUPL 1.2"), ("bsl", "Boost Software License - Version 1.0"), ("proprietary", "Copyright 2019 Foo Inc. All rights reserved."), ("gpl", "This package is distributed under the GNU GPL v2."),
    ("apache", "Code licensed under the Apache 2.0 License."), ("mit", "Open source, MIT."), ("gpl", "GPL-3.0+"), ("bsd", "3-Clause BSD License"), ("mit", "Available under an MIT-style licence."), ("cc-by", "Dieses Werk ist lizenziert unter einer Creative Commons Namensnennung 4.0 (CC BY 4.0)."), ("cc-by-sa", "Text under Creative Commons Attribution-ShareAlike."), ("gpl", "You can redistribute it under the terms of the GNU General Public License."), ("lgpl", "Licensed under LGPL v3"), ("mit", "Licence MIT"),
    ("gpl", "Licencia GPL v3"), ("mit", "The MIT License (MIT)"), ("mit", "foo-lib -- MIT licence, no warranty"), ("gpl", "Author: K. Lee. License GPLv2 or newer."), ("apache", "Sources are offered to you under Apache License Version 2.0"), ("bsd", "The parser comes with a two-clause BSD license."), ("cc-by-sa", "Wiki pages: Creative Commons Attribution-ShareAlike 3.0"), ("lgpl", "This font is under the GNU Lesser General Public License."), ("mpl", "Project licence is MPL-2.0"), ("agpl", "Everything in server/ is AGPL-3.0."),
    ("cc0", "Data released as CC0."), ("cc-by", "Photo by Ann Smith, licensed CC BY 2.0"), ("cc-by-nc", "Audio is shared under CC BY-NC-SA."), ("isc", "License: ISC"), ("zlib", "This library uses the zlib license"), ("epl", "Eclipse Public License - v 2.0"), ("eupl", "EUPL-1.2-or-later"), ("bsl", "Boost Software License Version 1.0, August 2003"), ("proprietary", "(c) 2023 Acme GmbH - all rights reserved."), ("mit", "Released as open source under the MIT license in 2015."),
    ("apache", "### License\tApache 2.0"), ("gpl", "Kernel modules must be GPL licensed."), ("gpl", "This manual is distributed under GNU GPL version 3 or any later version."), ("mit", "Copyright (c) 2019 Max Power. MIT licensed."), ("bsd", "License: BSD (3 clause)"), ("mit", "X11/MIT license applies to all examples."), ("lgpl", "lgpl-3.0"), ("cc-by", "Except where noted, content is licensed under a Creative Commons Attribution 4.0 license."), ("cc-by-nc", "cc-by-nc-4.0"), ("mpl", "Firefox code is available under the Mozilla Public License."),
]
NONE = ["All rights reserved by the cousins of the king.", "He holds a driving license from the state of Ohio.", "MIT researchers found a new method.", "The Apache tribe lived in the valley.", "The BSD family of systems goes back to 1977.", "Apache Spark is a fast engine.", "Creative work is common in the public sector.", "She got her license under the new law.", "The Eclipse IDE has a public API.", "Use the zlib module for compression.", "The court reserved its rights in the copyright case.", "We ship the product under a new version.", "GNU is not Unix.", "The GPL was written by Stallman in 1989.", "What is the difference between MIT and BSD?", "Mozilla makes a browser.", "The license expired in May.", "I went to MIT for my degree.", "The general public license fee is paid yearly.", "The European Union published a report.", "My cc list is long.", "Attribution is hard in marketing.", "He was licensed to drive trucks.", "Permission is granted to leave the room.", "The universal rule holds in the public domain.", "The ISC meeting was in June.", "The software comes without warranty says the vendor.", "Source code is text.", "The binary form of ten is 1010.", "The license plate of the car is green.", "An open source conference was held in Boston.", "The BSD license was discussed at length in the meeting.", "The ship under the British flag left port.", "The license fee rose by two percent.", "GPL Inc. reported a loss.", "An Apache web server handled the traffic.", "BSD and Linux are operating systems.", "The commons were enclosed.", "Open source software runs the world.", "The product may be redistributed to shops.", "The patent license was granted to the university.", "Software patents are contested.", "We modified the recipe.", "The zlib header has two bytes.", "Mozilla Foundation hired ten people.", "We use MIT lectures in class.", "Mit.", "Mit der Lizenz", "The public voted for the law.", "Her rights were reserved by contract."]


def test_short_mentions_and_prose(spark):
    rows = [*SHORT, *HELD, *(("", t) for t in NONE)]
    docs = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "doc_id long, text string")
    found = {r.doc_id: r for r in licences.scan(docs).collect()}
    right = [k in found and found[k].family in c.split() for k, (c, _) in enumerate(rows)]
    assert all(right[: len(SHORT)])
    assert sum(right[len(SHORT) : len(SHORT) + len(HELD)]) >= 0.9 * len(HELD)
    assert sum(k >= len(SHORT) + len(HELD) for k in found) <= len(NONE) // 50
    # the scan says what the classifier and the templates say
    model, kept = licences.Classifier(), licences.templates()
    for k, (_, t) in enumerate(rows):
        family, p = model.predict(t)
        have = set(licences.grams(t, licences.KNOWN))
        share = max((len(g & have) / len(g) for c, _, g in kept if c == family), default=0)
        if family == "unknown" or p < licences.LEAST or share < licences.CONFIRM:
            assert k not in found
        else:
            assert (found[k].family, found[k].probability, found[k].confirmed_share) == (family, pytest.approx(p), pytest.approx(share))


def test_licence_lines(spark):
    rows = spark.createDataFrame([(1, "Text.\nReleased under the MIT License."), (2, "Licensed under the Apache License, Version 2.0."), (3, "He lost the license of his car.")], "doc_id long, text string")
    assert {(r.doc_id, r.paragraph, r.family) for r in licences.scan(rows).collect()} == {(1, 1, "mit"), (2, 0, "apache")}


def test_toxic_sentence(spark):
    texts = [f"fine words {k}. you idiot there. more {k}" if k % 3 == 0 else f"fine words {k}. nothing there. more {k}" for k in range(120)]
    w, b = toxicity.learn(texts, np.array([k % 3 == 0 for k in range(120)]))
    raw, offsets = kernel.utf8(pa.array(["you idiot there", "nothing there"]))
    f, s, rows, _, _ = toxicity.bags(raw, offsets)
    assert (1 / (1 + np.exp(-(toxicity.sums(w[f], s) + b))) > 0.5).tolist() == [True, False]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(120)], "doc_id long, toxic int")
    model = toxicity.Model(docs, labels)
    found = {(r.doc_id, r.sentence): r.score for r in model.sentences(docs, 0.0).collect()}
    for r in model.scores(docs).collect():  # noisy-or by hand
        assert math.isclose(r.score, 1 - math.prod(1 - p for (k, _), p in found.items() if k == r.doc_id), abs_tol=1e-9)
    assert {s for (k, s), p in found.items() if p > 0.5} == {"you idiot there"}
    wrong = [r for r in model.scores(docs).collect() if (r.score >= 0.7) != (r.doc_id % 3 == 0)]
    assert not wrong
    none = toxicity.Model(docs, labels.limit(0)).scores(docs).collect()
    assert len(none) == 120 and max(r.score for r in none) < 1e-9


def test_expectation_maximisation_by_enumeration():
    """One round of the learner against all segmentations, one by one."""
    vocabulary = sorted({bytes([b]) for b in range(256)} | {b"ab", b" a", b"bb", b" ab", b"abb"})
    words = {"ab": 3, "abb": 2, "bab": 1}
    text = " ".join(w for w, n in words.items() for _ in range(n))

    def cuts(w):
        return [[]] if not w else [[w[:k], *rest] for k in range(1, len(w) + 1) if w[:k] in vocabulary for rest in cuts(w[k:])]

    p = {v: 1 / len(vocabulary) for v in vocabulary}
    for _ in range(2):
        expected = dict.fromkeys(vocabulary, 0.0)
        for w, n in words.items():
            ways = cuts(b" " + w.encode())
            weights = [math.prod(p[x] for x in way) for way in ways]
            for way, weight in zip(ways, weights, strict=True):
                for x in way:
                    expected[x] += n * weight / sum(weights)
        total = sum(expected.values()) + 0.05 * len(vocabulary)
        p = {v: (e + 0.05) / total for v, e in expected.items()}
    names, got, prior = language.learn([text], ["x"], vocabulary, rounds=2)
    assert names == ["x"] and np.allclose(got[:, 0], [p[v] for v in vocabulary]) and prior.tolist() == [0.0]


def spark_hash(*values):
    h = 42
    for v in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else int(v).to_bytes(v.size if hasattr(v, "size") else 8, "little", signed=True), h)
    return h - (1 << 64) if h >> 63 else h


class Int(int):
    size = 4


def order_minhash(text):
    """The fingerprint's bins (number, tuple) by the definition, without the operator's expressions."""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    seen, items = {}, []
    for i in range(len(words)):
        k = (spark_hash(words[i], words[i + 1] if i + 1 < len(words) else None) << 24 & (1 << 64) - 1) >> 24
        k = k - (1 << 40) if k >> 39 else k
        items.append((spark_hash(k, Int(seen.get(k, 0))) & (1 << 63) - 1 & ~((1 << 24) - 1), i))
        seen[k] = seen.get(k, 0) + 1
    items = sorted((h | i, h, i) for h, i in items)
    out = []
    for b in sorted({h >> 57 for _, h, _ in items}):
        at = next(n for n, x in enumerate(items) if x[1] >> 57 == b)
        one, two = items[at], items[(at + 1) % len(items)]
        if items[at + 1 : at + 2] and items[at + 1][1] >> 57 != b or at + 1 == len(items):
            two = next((x for x in items if x[1] >> 57 > b), items[0])
        first, second = (one, two) if one[2] < two[2] else (two, one)
        tuple_ = spark_hash(one[1] >> 24) if len(items) == 1 else spark_hash(first[1] >> 24, second[1] >> 24)
        out.append(f"{b << 24 | tuple_ & 0xFFFFFF:08x}")
    return "".join(out)


def test_fingerprints_brute_force(spark, docs):
    rows = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    ids = sorted(rows)
    bins = lambda f: {f[i : i + 2]: f[i : i + 8] for i in range(0, len(f), 8)}

    def likeness(a, b):
        a, b = bins(a), bins(b)
        return 1.0 if not a and not b else len(set(a.values()) & set(b.values())) / len(a.keys() | b.keys())

    for r in fingerprints.fingerprint_edits(docs).collect():
        text, after = rows[r.doc_id], rows[ids[(ids.index(r.doc_id) + 1) % len(ids)]]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == order_minhash(text) and r.edited_fingerprint == order_minhash(edited)
        assert math.isclose(r.near_edited, likeness(r.fingerprint, r.edited_fingerprint)) and math.isclose(r.near_next, likeness(r.fingerprint, order_minhash(after)))


def test_fingerprints_see_order(spark):
    words = [f"w{k}" for k in range(80)]
    for n in (20, 40, 80):
        rows = spark.createDataFrame([(" ".join(words[:n]), " ".join(words[n // 2 : n] + words[: n // 2]))], "a string, b string")
        rows = fingerprints._steps(fingerprints._steps(rows, "a", "x"), "b", "y")
        assert rows.select(fingerprints.likeness("x", "y").alias("v")).first().v < 0.65


def counted_leaks(text, item):
    """Most equal tokens on a diagonal, over all diagonals."""
    best = 0
    for shift in range(1 - len(item), len(text)):
        best = max(best, sum(0 <= shift + k < len(text) and text[shift + k] == w for k, w in enumerate(item)))
    return best


def test_leaks_brute_force_both_ways(spark, docs):
    words = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    items = {r.item_id: words(r.text) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()}
    rows = {r.doc_id: words(r.text) for r in docs.where("length(text) < 3000").collect()}
    found = {(r.doc_id, r.item_id): r.matched for r in decontamination.find_leaks(docs.where("length(text) < 3000"), spark.read.parquet(f"{D}/benchmark.parquet")).collect()}
    least = lambda i: min(13, -(-4 * len(i) // 5))
    want = set()
    for d, text in rows.items():
        for k, item in items.items():
            # a diagonal with so many equal tokens needs as many common words
            if sum(w in set(text) for w in item) >= least(item) and counted_leaks(text, item) >= least(item):
                want.add((d, k))
    assert found.keys() == want and len(want) > 2


@pytest.mark.parametrize(("every", "least"), [(5, 1.0), (6, 1.0), (7, 1.0), (10, 1.0)])
def test_leaks_with_every_nth_token_replaced(spark, every, least):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    index = decontamination.Index(items, 13)
    texts = ["q " + " ".join("zz" if k % every == every - 1 else w for k, w in enumerate(t.split())) + " q" for _, t in items]
    raw, offsets = kernel.utf8(pa.array(texts))
    h, _, _, rows = kernel.words(raw, offsets, kernel.WORD_BYTE)
    hits = {(r, items[i][0]) for r, i, *_ in index.leaks(h, rows)}
    assert sum((r, items[r][0]) in hits for r in range(len(items))) >= least * len(items)


def test_short_items(spark):
    rows = spark.createDataFrame([(1, "the answer is forty two indeed"), (2, "the answer is forty three"), (3, "yes")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "forty two"), (2, "Yes!"), (3, "..."), (4, None)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.find_leaks(rows, items).collect()} == {(1, 1), (3, 2)}
    assert [r.doc_id for r in decontamination.keep_clean(rows, items).collect()] == [2]


@pytest.mark.parametrize(("page", "text"), [
    ('<body><div class="content no-sidebar"><p>hello world</p></div></body>', "hello world"),
    ('<body><div class="ad">Buy<h1>Title</h1><p>Long text of the page.</p>', "Buy Title Long text of the page."),
    ("<body><form id=f><h1>T</h1><p>page in a form</p><input><p>x</p></form></body>", "T page in a form x"),
    ('<body><div class="entry-header"><h1>Title</h1></div><p>body text</p></body>', "Title body text"),
    ('<body><p>intro</p><div class="side-by-side"><p>left</p></div></body>', "intro left"),
    ("<body><nav><ul><li>a<li>b</ul></nav><article><h1>A</h1><p>one<p>two<div class='comments'><p>c</div></article><footer>f</footer>", "A one two"),
    ("<body><div><div class=ad>Buy now</div><p>Real text here and more of it</p><form>Name<input></form></div>", "Real text here and more of it"),
    ("<p>a&nbsp;b &lt;c&gt;</p><script>if (a<b) x</script>d", "a b <c> d"),
    ("plain text", "plain text"), ("", ""), ("<nav>menu<main><p>text</p></main>", "text"),
])
def test_html_blocks(page, text):
    assert " ".join(html_text.blocks(page)[0]) == text


def longest(a, b):
    """A longest common subsequence's length, the plain way."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], (last + 1 if x == y else max(row[j + 1], row[j]))
    return row[-1]


def test_alignment_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(300):
        a, b = (rng.integers(0, 5, rng.integers(0, 12)).tolist() for _ in range(2))
        pairs = html_text.common(a, b)
        assert len(pairs) == longest(a, b) and all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in itertools.pairwise(pairs))


def test_edit_distance_brute_force(spark):
    rng = np.random.default_rng(4)
    lines = ["".join(rng.choice(list("abé😀"), rng.integers(24, 60))) for _ in range(60)]
    for base in lines[:40]:
        line = list(base)
        for _ in range(rng.integers(1, 4)):
            k = int(rng.integers(0, len(line)))
            kind = rng.integers(0, 3)
            line[k : k + (kind != 1)] = [] if kind == 0 else ["z"]
        lines.append("".join(line))
    pairs = [(x, y) for x in lines for y in lines if abs(len(x) - len(y)) <= 4]
    rows = spark.createDataFrame(pairs, "p string, q string")
    codes = lambda c: f"transform(split({c}, ''), c -> ascii(c))"
    rows = rows.selectExpr("p", "q", f"{codes('p')} as x", f"{codes('q')} as y").selectExpr("*", "size(x) as nx", "size(y) as ny", "aggregate(x, 0L, (g, c) -> g ^ shiftleft(1L, c % 64)) as bagx", "aggregate(y, 0L, (g, c) -> g ^ shiftleft(1L, c % 64)) as bagy")
    got = rows.select("p", "q", line_dedup.within().alias("w"), line_dedup.possible(2).alias("possible")).collect()
    for r in got:
        want = edits(r.p, r.q) <= min(2, min(len(r.p), len(r.q)) // 24)
        assert r.w == want and (r.possible or not want)
    assert sum(r.w for r in got) > 100


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, _gone array<int>, _s string, target double, rate double, source_size long, row string, t long, k long, root long, gone string, rest string, size long, _conceptlake_id long"


def clashing(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), [1], "s", 5.0, 6.0, 7, "r", 8, 9, 10, "g", "x", 11, 12) for i, t in rows], CLASHING)


def test_stages_keep_rows_and_columns(spark):
    """Nulls, repeated rows, ids with several texts and columns of any name through every stage."""
    text = "the cat sat on the mat and saw nine other animals of the house " * 3
    other = "a quite different text stands here with words of its own kind in it"
    rows = clashing(spark, [(1, text), (1, other), (1, other), (2, None), (3, ""), (None, "words without an id at all here"), (4, text + "x")])
    sort = lambda df: sorted((tuple(map(str, r)) for r in df.collect()))
    mixed = mixing.mixed(rows)
    assert mixed.columns == rows.columns and set(sort(mixed)) <= set(sort(rows)) and {r.target for r in mixed.collect()} == {5.0}
    lines = line_dedup.deduplicated(rows)
    assert lines.columns == rows.columns and {(r.doc_id, r.text) for r in lines.collect()} == {(1, text), (1, other), (2, None), (3, ""), (None, "words without an id at all here")}
    kept = ngram_join.keep_first(rows)
    assert kept.columns == rows.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted([(1, text), (1, other), (2, ""), (3, ""), (0, "words without an id at all here")])
    clean = decontamination.keep_clean(rows, spark.createDataFrame([(1, other)], "item_id long, text string"))
    assert clean.columns == rows.columns and sorted((r.doc_id or 0, r.text or "") for r in clean.collect()) == sorted((i or 0, t or "") for i, t in [(1, text), (2, None), (3, ""), (None, "words without an id at all here"), (4, text + "x")])
    known = language.keep_known(rows)
    assert known.columns == rows.columns and all(r.text for r in known.collect())
    for stage in (mixing.mixed, line_dedup.deduplicated, ngram_join.keep_first, language.keep_known):
        assert stage(rows.limit(0)).count() == 0
    assert decontamination.keep_clean(rows.limit(0), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_very_long_texts(spark):
    long = " ".join(f"w{k % 5000}" for k in range(30_000))
    rows = spark.createDataFrame([(1, long, "en"), (2, long + "s", "en"), (3, "x" * 300_000, "en"), (4, "short text", "en")], "doc_id long, text string, lang string")
    assert {r.doc_id: r.component_id for r in ngram_join.jaccard_components(rows).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    assert [r.text for r in line_dedup.deduplicated(rows).where("doc_id = 2").collect()] == []
    assert fingerprints.fingerprint_edits(rows).where("doc_id = 1").first().near_edited > 0.3
    assert language.identify(rows).count() == lm_scoring.score(rows).count() == 4
    assert decontamination.find_leaks(rows, spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(4000, 4040)))], "item_id long, text string")).count() == 2
