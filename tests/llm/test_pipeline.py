"""Every stage of the pipeline against brute force, on what the stage before it kept of the smallest documents."""

import itertools
import re
from collections import Counter

import corpus_pipeline
from conceptlake.llm import language
from tests.llm.test_ops import counted_leaks, edits

D = "/root/testdata/sf0.001"


def union(pairs, items):
    root = {x: x for x in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in items}


def without_lines(texts):
    at = [(i, k, x.strip(" ")) for i, t in sorted(texts.items()) for k, x in enumerate(t.split("\n")) if x.strip(" ")]
    lines = sorted({x for *_, x in at})
    bags = {x: Counter(x) for x in lines}

    def near(a, b):
        most = min(2, min(len(a), len(b)) // 24)
        return abs(len(a) - len(b)) <= most and most and sum(((bags[a] - bags[b]) + (bags[b] - bags[a])).values()) <= 2 * most and edits(a, b) <= most

    by_length = sorted(lines, key=len)
    pairs = [(a, b) for k, a in enumerate(by_length) for b in itertools.takewhile(lambda b, a=a: len(b) <= len(a) + 2, by_length[k + 1 :]) if near(a, b)]
    root, seen, gone = union(pairs, lines), set(), set()
    for i, k, x in at:
        (gone.add((i, k)) if root[x] in seen else seen.add(root[x]))
    kept = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in texts.items()}
    touched = {i for i, _ in gone}
    return {i: t for i, t in kept.items() if i not in touched or t.strip(" ")}


def first_of_groups(texts):
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    pairs = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b] and min(len(sets[a]), len(sets[b])) * 100 >= 80 * max(len(sets[a]), len(sets[b])) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = union(pairs, sets)
    return {i: t for i, t in texts.items() if root[i] == i}


def clean(texts, items):
    words = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    items = [words(t) for t in items]

    def leaks(text):
        have = set(text)
        return any(sum(w in have for w in item) >= min(13, -(-4 * len(item) // 5)) and counted_leaks(text, item) >= min(13, -(-4 * len(item) // 5)) for item in items)

    return {i: t for i, t in texts.items() if not leaks(words(t))}


def test_stages(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    texts = lambda df: {r.doc_id: r.text for r in df.collect()}
    known = language.identify(docs).where("lang_pred <> 'und' and score >= 0.5")
    want = {r.doc_id for r in known.collect()}
    items = [r.text for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    models = [lambda t: {i: x for i, x in t.items() if i in want}, without_lines, first_of_groups, lambda t: clean(t, items)]
    now = docs
    for (name, stage), model in zip(corpus_pipeline.STAGES, models, strict=False):
        before, now = texts(now), stage(spark, now, D).cache()
        assert now.columns == docs.columns and texts(now) == model(before), name
        assert now.count() == len(texts(now)), name
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    mixed = corpus_pipeline.STAGES[4][1](spark, now, D)
    rows, by = mixed.collect(), {}
    kept = now.collect()
    for r in kept:
        by[r.source] = by.get(r.source, 0) + size(r.text)
    weight = {s: k % 3 + 1 for k, s in enumerate(sorted(by))}
    target, left = dict.fromkeys(by, 0.0), set(by)
    while True:  # shares by weight; who has its stop leaves the sharing
        rest = sum(by.values()) - sum(3 * by[s] for s in by if s not in left)
        over = {s for s in left if weight[s] * rest / sum(weight[x] for x in left) > 3 * by[s]}
        target = {s: weight[s] * rest / sum(weight[x] for x in left) if s in left else 3 * by[s] for s in by}
        if not over:
            break
        left -= over
    copies = Counter(r.doc_id for r in rows)
    for r in kept:
        rate = target[r.source] / by[r.source]
        assert int(rate) <= copies[r.doc_id] <= int(rate) + (rate % 1 > 1e-9)
    assert mixed.columns == docs.columns and {(r.doc_id, r.text) for r in rows} <= {(r.doc_id, r.text) for r in kept}


def test_run(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    got = corpus_pipeline.run(spark, D)
    assert got.columns == docs.columns and len(corpus_pipeline.STAGES) == 5
    assert corpus_pipeline.run(spark, D).count() == got.count()
