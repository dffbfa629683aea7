"""Vector codes, MinHash near-duplicates and periodic runs against brute force, and their odd rows."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from conceptlake.llm import minhash, ngram_join, registry, vector_codes
from conceptlake.llm import periodic_runs as runs

D = "/root/testdata/sf0.001"


def brute_runs(x, least, times):
    found = set()
    for q in range(1, len(x) // times + 1):
        i = 0
        while i < len(x) - q:
            j = i
            while j < len(x) - q and x[j] == x[j + q]:
                j += 1
            part = x[i : j + q]
            if len(part) >= max(least, times * q) and all(any(part[t] != part[t + p] for t in range(len(part) - p)) for p in range(1, q)):
                found.add((i, len(part), q))
            i = max(j, i + 1)
    return found


words = st.lists(st.integers(0, 2), max_size=12)


@settings(max_examples=300, deadline=None)
@given(words, words, st.integers(1, 12), words)
def test_runs_brute_force(head, period, times, tail):
    x = head + period * times + tail
    for least in (3, 24):
        assert runs.runs_of(x, least, 3) == brute_runs(x, least, 3)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=40))
def test_lyndon_arrays(x):
    n = len(x)
    nss = [next((j for j in range(i + 1, n) if x[j:] < x[i:]), n) for i in range(n)]
    shared = [next(m for m in range(n + 1) if j + m >= n or x[i + m] != x[j + m]) for i, j in enumerate(nss)]
    assert runs.next_smaller(x) == (nss, shared)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(words, words, st.integers(1, 12)), max_size=5), st.randoms())
def test_stretches_lose_no_run(rows, rnd):
    texts = [head + period * times + [rnd.randrange(50) for _ in range(20)] for head, period, times in rows]
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(int)
    got = runs.runs_of_rows(np.array(list(itertools.chain(*texts)), int), first, 24, 3)
    assert [set(r) for r in got] == [brute_runs(t, 24, 3) for t in texts]


def test_symbols_are_matched_once():
    class Symbol(int):
        asked = 0

        def __eq__(self, other):
            Symbol.asked += 1
            return int(self) == int(other)

        __hash__ = int.__hash__

    fib = [[0], [0, 1]]
    while len(fib[-1]) < 4000:
        fib.append(fib[-1] + fib[-2])
    nested = [0]
    for k in range(1, 8):
        nested = nested * 3 + [k]
    for x in ([0] * 4000, [0, 1] * 2000, fib[-1], nested):
        Symbol.asked = 0
        runs.next_smaller([Symbol(v) for v in x])
        assert Symbol.asked <= 4 * len(x)


def test_op13_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text").collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    planted = 0
    for r in registry.QUERIES["op13_periodic_runs"](spark, D).collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", docs[r.doc_id] or "")
        h = zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and w:
            a, g = h // 10 % len(w), h // 10
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
        number = {v: i for i, v in enumerate(sorted(set(w)))}
        # periods are sought where the array meets itself shifted
        x, found = np.array([number[v] for v in w], int), []
        for q in range(1, len(w) // 3 + 1):
            edges = np.flatnonzero(np.diff(np.concatenate([[0], (x[:-q] == x[q:]).astype(int), [0]])))
            found += [(int(s), int(e - s + q), q) for s, e in zip(edges[::2], edges[1::2], strict=True) if e - s + q >= max(24, 3 * q)]
        found = sorted((t for t in found if not any(o[2] < t[2] and o[0] <= t[0] and o[0] + o[1] >= t[0] + t[1] for o in found)), key=lambda t: (t[0], t[2]))
        gone = {i for s, n, q in found for i in range(s + q, s + n)}
        assert r.n_runs == len(found) and r.runs_sha256 == sha("".join(f"{s},{n},{q}\n" for s, n, q in found))
        assert r.collapsed_sha256 == sha(" ".join(v for i, v in enumerate(w) if i not in gone))
        if found:
            s, n, q = min(found, key=lambda t: (-t[1] / t[2], t[0], t[2]))
            assert (r.start, r.length, r.period, r.exponent_milli) == (s, n, q, 1000 * n // q)
            planted += h % 10 == 0
        else:
            assert (r.start, r.length, r.period, r.exponent_milli) == (None,) * 4
    assert planted > 5


ODD = [(1, None, 1), (2, "", 1), (None, "a b " * 30, None), (3, " \n\t ", 1), (4, "x y z " * 20, 1), (4, "x y z " * 20, 1), (5, "é " * 30 + "end", 1), (6, "one", None)]


def test_odd_texts(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string, runs int")
    got = runs.find_runs(docs).collect()
    assert len(got) == len(ODD) and [len(r.runs) for r in got] == [0, 0, 1, 0, 1, 1, 1, 0]
    assert [r.collapsed for r in got] == ["", "", "a b", "", "x y z", "x y z", "é end", "one"]
    assert runs.find_runs(docs.limit(0)).count() == 0
    near = minhash.near_duplicates(docs, n=2)
    rows = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in near.collect()}
    assert near.count() == len(ODD) and rows[1, 0] == (1, True) and rows[None, 2] == (None, True) and rows[4, 3] == (4, True)
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_very_long_text(spark):
    n = 400_000
    text = " ".join(f"w{i}" for i in range(n)) + " " + "lo ng pe ri od " * 5000
    docs = spark.createDataFrame([(1, text), (2, text + "more"), (3, "short one here")], "doc_id long, text string")
    got = {r.doc_id: r for r in runs.find_runs(docs).collect()}
    assert [tuple(r) for r in got[1].runs] == [(n, 25_000, 5)] and got[1].collapsed.endswith("lo ng pe ri od") and len(got[1].collapsed.split()) == n + 5
    near = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, n=2).collect()}
    assert near == {1: 1, 2: 1, 3: 3}


def test_near_duplicates_brute_force(spark):
    """Copies with every degree of change around the threshold: links are those of the full sets."""
    rng = np.random.default_rng(5)
    texts = []
    for base in range(25):
        w = [f"b{base}w{v}" for v in rng.integers(0, 400, 150)]
        for copy in range(6):
            v = list(w)
            for i in rng.choice(150, copy * 3, replace=False):
                v[i] = f"n{rng.integers(1 << 30)}"
            texts.append(" ".join(v))
    sets = [set(zip(t.split(), t.split()[1:])) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs, n=2).collect()}
    assert got == {i: (len(s), find(i), find(i) == i) for i, s in enumerate(sets)}


def test_a_group_of_copies_is_dealt_out(spark, monkeypatch):
    """More sets at a first key than MANY go another way to the same result."""
    w = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(i, " ".join([*w, f"only{i}"])) for i in range(80)] + [(100, "some thing else")], "doc_id long, text string")
    want = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, n=2).collect()}
    monkeypatch.setattr(minhash, "MANY", 5)
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, n=2).collect()} == want == {i: 0 for i in range(80)} | {100: 100}


def test_a_pair_is_taken_at_one_table(spark, monkeypatch):
    """Pairs meet in up to 196 tables: each is taken once, and none that meets is left out."""
    rng = np.random.default_rng(9)
    w = [f"w{i}" for i in range(80)]
    texts = [" ".join(v if rng.random() > 0.04 else f"n{rng.integers(1 << 30)}" for v in w) for _ in range(40)] + [" ".join(w[:40] + [f"u{i}v{j}" for j in range(40)]) for i in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    join = minhash.MinHashJoin(docs, n=2)
    groups = join.groups(join.keyed()).cache()
    rooted = groups.selectExpr("k", "k as root", "first", "second")
    got = [(r.a, r.b) for r in join.pairs(join.met(rooted), groups.select("k", "n", "w"), "true").collect()]
    rows = [(r.k, set(enumerate(r["first"])), set(enumerate(r["second"]))) for r in groups.collect()]
    want = {tuple(sorted((p[0], q[0]))) for p, q in itertools.combinations(rows, 2) if p[1] & q[1] and p[2] & q[2]}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 500


def test_a_group_of_near_copies_takes_few_pairs(spark, monkeypatch):
    """Half of a group's pairs reach the threshold: what the first stars leave outside isn't verified against the whole group."""
    rng = np.random.default_rng(3)
    w = [f"w{i}" for i in range(120)]
    texts = [" ".join(v if rng.random() > 0.03 else f"n{rng.integers(1 << 30)}" for v in w) for _ in range(400)]
    sets = [set(zip(t.split(), t.split()[1:])) for t in texts]
    near = lambda a, b: 100 * len(a & b) >= 80 * len(a | b)
    root, todo = {}, []
    for i in range(len(sets)):
        if i not in root:
            root[i], todo = i, [i]
            while todo:
                u = todo.pop()
                new = [v for v in range(len(sets)) if v not in root and near(sets[u], sets[v])]
                root |= dict.fromkeys(new, i)
                todo += new
    taken, verify = [], minhash.MinHashJoin.verify
    monkeypatch.setattr(minhash.MinHashJoin, "verify", lambda self, groups, pairs: taken.append(pairs.count()) or verify(self, groups, pairs))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, n=2).collect()} == root
    assert sum(taken) < 8 * len(texts)


def test_rounds_move_classes(spark, monkeypatch):
    """A round gives a new root to each class once, not at each of its up to 196 keys; the result is that of no rounds."""
    rng = np.random.default_rng(5)
    w = [f"w{i}" for i in range(100)]
    texts = [" ".join(v if rng.random() > 0.03 else f"n{rng.integers(1 << 30)}" for v in w) for _ in range(150)] + [f"other text {i} of few words" for i in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen, moved = [], minhash.moved
    monkeypatch.setattr(minhash, "moved", lambda rows, over: seen.append(rows.count()) or moved(rows, over))
    monkeypatch.setattr(minhash, "ENOUGH", 1 << 40)
    want = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, n=2).collect()}
    assert not seen
    monkeypatch.setattr(minhash, "ENOUGH", 0)
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, n=2).collect()} == want
    assert seen and max(seen) <= len(texts)


def test_rounds_lose_no_link(spark, monkeypatch):
    """The brute force test's copies, with rounds as long as they help."""
    monkeypatch.setattr(minhash, "ENOUGH", 0)
    monkeypatch.setattr(minhash, "CENTRES", 1)
    test_near_duplicates_brute_force(spark)


def test_minhash_keys_estimate_similarity():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    a, b = np.sort(values[:2000]), np.sort(values[400:2400])  # 1600 of 2400
    one, two = minhash.keys([a, b], tables=400, rows=1)
    assert abs((one == two).mean() - 2 / 3) < 0.06
    assert (minhash.keys([a]) == minhash.keys([a, b])[:1]).all()


@pytest.mark.parametrize("spread", [1, 3, 60, 1_000_000])
def test_elkan_equals_full_search(spread):
    rng = np.random.default_rng(spread)
    for _ in range(25):
        n, parts, width, k = rng.integers(1, 150), rng.choice([1, 4]), rng.integers(1, 4), rng.integers(1, 10)
        x = rng.integers(-spread, spread + 1, (n, parts, width))
        books, state = vector_codes.Codebooks(np.ascontiguousarray(x[rng.permutation(n)[:k]].transpose(1, 0, 2))), ()
        for _ in range(4):
            code, d2, upper, lower, _ = vector_codes.assign(x, books, *state)
            full = vector_codes.squares(x[:, :, None], books.entries[None])
            assert (code == full.argmin(2)).all() and (d2 == full.min(2)).all()  # argmin: ties to the lower
            assert (upper >= np.sqrt(d2)).all() and (lower * books.step[:, None] <= np.sqrt(full)).all()
            k_ = books.entries.shape[1]
            sums, counts = np.zeros((parts, k_, width), int), np.zeros((parts, k_), int)
            for p in range(parts):
                np.add.at(sums[p], code[:, p], x[:, p])
                counts[p] = np.bincount(code[:, p], minlength=k_)
            old, books = books, books.updated(sums, counts)
            assert (books.entries[counts == 0] == old.entries[counts == 0]).all()
            state = (code.astype(np.int16), np.nextafter(upper.astype(np.float32), np.float32(np.inf)), lower)


def test_elkan_prunes():
    rng = np.random.default_rng(2)
    x = rng.normal(0, 30, (2000, 16, 4)).astype(np.int64)
    books = vector_codes.Codebooks(np.ascontiguousarray(x[:64].transpose(1, 0, 2)))
    code, _, upper, lower, first = vector_codes.assign(x, books)
    again = vector_codes.assign(x, books, code.astype(np.int16), upper.astype(np.float32) * 1.001, lower)[4]
    assert again < 0.1 * x.shape[0] * 16 * 64 < first


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    v = [0.01 * i for i in range(16)]
    rows = [(1, v, 0, "a"), (2, None, 0, "a"), (3, [nan] * 16, 0, "a"), (4, [None] + v[1:], 1, "a"), (5, [inf] + v[1:], 1, "a"), (6, [-x for x in v], None, "b"), (6, [-x for x in v], None, "b"), (None, v, 1, "c"), (7, v[:4], 1, "c")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, codes string").drop("codes").withColumnRenamed("label", "n")
    out = vector_codes.with_group_error(vector_codes.Compressor(df).compress(), "n")
    got = out.collect()
    assert sorted((r.vec_id or 0) for r in got) == [0, 1, 6, 6] and all(len(r.codes) == 16 for r in got)
    assert len({tuple(r.codes) for r in got if r.vec_id == 6}) == 1 and {r.n_error for r in got} == {0}
    assert vector_codes.Compressor(df.limit(0)).compress().count() == 0
    # a length that sixteen doesn't divide is filled up; ties go to the lower entry
    short = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [0.5, 0.0])], "vec_id long, embedding array<double>")
    made = vector_codes.Compressor(short, parts=2, entries=2)
    assert {r.vec_id: list(r.codes) for r in made.compress(rounds=0).collect()} == {1: [0, 0], 2: [1, 0], 3: [0, 0]}
    with pytest.raises(Exception, match="passes"):
        vector_codes.Compressor(spark.createDataFrame([(1, [1e30])], "vec_id long, embedding array<double>")).compress()


def test_split_words():
    texts = pa.array(["a b", None, "", " \x0bx\x0c\ty\r\n", "é z"])
    flat, first = runs.split_words(texts.slice(1))
    assert flat.to_pylist() == ["x", "y", "é z"] and first.tolist() == [0, 0, 0, 2, 3]
    assert ngram_join.prefix_length(10, 80, 100) == 3
