"""Main text of web pages by nearest-URL page differencing.

A page is read into blocks (runs of text between block tags). What tags state comes
first: scripts, styles, navigation, footers, sidebars, dialogs and a header outside the
article are no blocks of the text, and of a page with a marked article only the
article's blocks are. Class, id and role names that stand for adverts, notices, menus,
comments and the like, and forms, are evidence: what such an element holds goes, unless
the element holds a heading of first rank, an article or WRAPPER of the text, since it
then wraps the page. An element ends with its tag or with that of any element around it.

Differencing then decides what belongs to pages whose markup names no article; a marked
article keeps all its blocks, since nothing tells a notice that articles share from a
heading or a passage that they share. Pages of a host lie in the order of their URL
paths; pages of equal blocks count as one, at the first one's place. Each is paired with
the nearest page on either side that is no copy of it (the next nearest of the other
side where a side has none), their blocks are aligned by longest common subsequence, and
blocks that a pair shares are deleted.

Pages are copies if their shared blocks are more than four fifths of the longer one's
text. They are stepped over however many they are: first within a bucket of BUCKET pages
and REACH pages beyond its ends; pages whose search leaves these go on from bucket to
bucket until a partner or the host's end is found.

Rows: null or empty html gives an empty text; a null or unreadable url is a host of
its own kind and is paired by page_id only. Repeated rows are paired like others (as
copies); rows that share a page_id are told apart by url and html. A page alone on its host keeps all blocks. Other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, table, with_rank

#: Fixed lists of HTML's own names.
INLINE = frozenset("math mi mn mo mrow msup msub mfrac msqrt mtext a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg object select".split())
OUTSIDE = frozenset("nav footer aside dialog menu button head".split())
MAIN = frozenset("article main".split())
#: Names whose element ends where the next of these begins.
IMPLIED = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th", "tr"), "th": ("td", "th", "tr"), "tr": ("tr",)}
#: Parts of a class, id or role name that stand for what is no article text, at the name's beginning or end; those that may go on; those that revoke it.
MARKS = frozenset("ad ads banner cookie cookies consent gdpr notice notices alert sidebar widget comment comments respond replies menu nav footer header masthead share sharing social related newsletter subscribe popup modal login pagination pager search contentinfo complementary disqus".split())
STEMS = ("advert", "sponsor", "promo", "navig", "navbar", "breadcrumb")
REVOKED = frozenset("no not without has with hoc history table".split())
#: Headers of the article itself.
OWN_HEADER = frozenset("entry post article content page section title".split())
ATTRIBUTE = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][\w:-]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][\w:-]*)([^>]*)>""", re.S)
#: Of the longer page's text: what only copies share.
SAME_PAGE = 0.8
#: Entries of the table that an alignment keeps; longer pages are halved first.
ALIGNED = 1 << 22
BUCKET, REACH = 256, 16
#: Share of the text from which on a marked element wraps the page.
WRAPPER = 0.8


def is_marked(attributes: str) -> bool:
    """Whether a class, id or role name stands for what is no article text."""
    for value in ATTRIBUTE.findall(attributes):
        for name in value.strip("\"'").lower().split():
            parts = [x for x in re.split(r"[-_]+", name) if x]
            if not parts or REVOKED & set(parts):
                continue
            for part in (parts[0], parts[-1]):
                if (part in MARKS or part.startswith(STEMS) or part.endswith("comments")) and not (part == "header" and OWN_HEADER & set(parts)):
                    return True
    return False


class _Reader:
    """The open elements of a page, and its blocks with the marked elements that they are in."""

    def __init__(self):
        self.open: list[tuple[str, int, bool, bool]] = []  # name, number of its mark (-1: none), left out, article
        self.count: dict[str, int] = {}
        self.out = self.inside = 0
        self.marks: list[int] = []
        self.wraps: set[int] = set()
        self.n_marks = 0
        self.now: list[str] = []
        self.found: list[tuple[str, bool, tuple[int, ...]]] = []

    def end(self) -> None:
        if self.now:
            text = " ".join(html.unescape("".join(self.now)).split())
            if text:
                self.found.append((text, self.inside > 0, tuple(self.marks)))
            self.now.clear()

    def push(self, name: str, mark: bool, out: bool) -> None:
        main = name in MAIN
        if main or name == "h1":
            self.wraps.update(self.marks)
        number = -1
        if mark:
            number, self.n_marks = self.n_marks, self.n_marks + 1
            self.marks.append(number)
        self.open.append((name, number, out, main))
        self.count[name] = self.count.get(name, 0) + 1
        self.out += out
        self.inside += main

    def pop(self, name: str) -> None:
        """Ends the innermost element of the name, and all in it; nothing if there is none."""
        while self.count.get(name):
            last, number, out, main = self.open.pop()
            self.count[last] -= 1
            self.out -= out
            self.inside -= main
            if number >= 0:
                self.marks.remove(number)
            if last == name:
                return


def blocks(page: str) -> tuple[list[str], bool]:
    """The text blocks of a page without what the markup excludes; whether they are those of a marked article."""
    r, at = _Reader(), 0
    for m in TOKEN.finditer(page):
        if m.start() < at:
            continue
        if not r.out:
            r.now.append(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name or name in INLINE:
            continue
        r.end()
        if m[1] or m[4]:
            r.pop(name)
            continue
        attributes = m[3] or m[6] or ""
        if name in RAW:
            over = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            at = over.end() if over else len(page)
            continue
        if name in VOID or attributes.rstrip().endswith("/"):
            continue
        if r.open and r.open[-1][0] == "p":
            r.pop("p")
        if r.open and r.open[-1][0] in IMPLIED.get(name, ()):
            r.pop(r.open[-1][0])
        if name == "body" or name in MAIN and not r.inside:
            for unclosed in ("head", "nav", "menu", "button"):
                r.pop(unclosed)
        whole = name in ("html", "body") or name in MAIN and not r.inside
        mark = not whole and (name == "form" or bool(attributes) and is_marked(attributes))
        r.push(name, mark, name in OUTSIDE or name == "header" and not r.inside)
    if not r.out and at < len(page):
        r.now.append(page[at:])
    r.end()
    main = any(inside for _, inside, _ in r.found)
    found = [x for x in r.found if x[1] == main]
    sizes, total = [0] * r.n_marks, 0
    for text, _, marks in found:
        total += len(text)
        for k in marks:
            sizes[k] += len(text)
    kept = {k for k in range(r.n_marks) if k in r.wraps or sizes[k] >= WRAPPER * total}
    return [text for text, _, marks in found if kept.issuperset(marks)], main


def common(a: list, b: list) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence, found between the equal ends."""
    n, m, head = len(a), len(b), 0
    while head < min(n, m) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(n, m) - head and a[n - 1 - tail] == b[m - 1 - tail]:
        tail += 1
    x, y = a[head : n - tail], b[head : m - tail]
    pairs = [(i, i) for i in range(head)] + [(n - 1 - i, m - 1 - i) for i in range(tail)]
    both = set(x) & set(y)
    xi, yi = [i for i, v in enumerate(x) if v in both], [j for j, v in enumerate(y) if v in both]
    number = {v: k for k, v in enumerate(both)}
    found = _aligned(np.array([number[x[i]] for i in xi], int), np.array([number[y[j]] for j in yi], int))
    return sorted(pairs + [(head + xi[i], head + yi[j]) for i, j in found])


def _next_row(row: np.ndarray, value: int, y: np.ndarray) -> np.ndarray:
    best = row.copy()
    best[1:] = np.where(y == value, row[:-1] + 1, best[1:])
    return np.maximum.accumulate(best)


def _aligned(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence. Above ALIGNED entries the first sequence is halved, and the second where both halves give most, so memory stays bounded."""
    if not len(x) or not len(y):
        return []
    if len(x) > 1 and (len(x) + 1) * (len(y) + 1) > ALIGNED:
        half = len(x) // 2
        front, back = np.zeros(len(y) + 1, np.int32), np.zeros(len(y) + 1, np.int32)
        for v in x[:half]:
            front = _next_row(front, v, y)
        for v in x[half:][::-1]:
            back = _next_row(back, v, y[::-1])
        cut = int((front + back[::-1]).argmax())
        return _aligned(x[:half], y[:cut]) + [(half + i, cut + j) for i, j in _aligned(x[half:], y[cut:])]
    rows = [np.zeros(len(y) + 1, np.int32)]
    for v in x:
        rows.append(_next_row(rows[-1], v, y))
    i, j, pairs = len(x), len(y), []
    while i and j:
        if rows[i][j] == rows[i - 1][j]:
            i -= 1
        elif rows[i][j] == rows[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((i, j))
    return pairs[::-1]


def shared_lines(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]] | None:
    """Index pairs of the blocks (hash, length) that two pages share; None if they are copies."""
    pairs = common([h for h, _ in a], [h for h, _ in b])
    same, sizes = sum(a[i][1] for i, _ in pairs), (sum(n for _, n in a), sum(n for _, n in b))
    return None if same > SAME_PAGE * max(sizes) else pairs


def _key(url: str) -> str:
    """Sort key of a URL: host, then path; scheme, query and fragment don't count."""
    m = re.match(r"(?:[a-z][\w+.-]*:)?//([^/?#]*)([^?#]*)", url or "", re.I)
    return f"{m[1].lower()}\n{m[2].rstrip('/').removesuffix('.html')}" if m else f"\n{url or ''}"


def open_lines(pages: DataFrame) -> DataFrame:
    """t (hash of the row), host, key, hashes and lengths of the blocks, whether they are a marked article's, and a hash of them all."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for pid, url, page, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key, (lines, marked) = _key(url), blocks(page or "")
                if lines:
                    hashes = [xxhash.xxh3_64_intdigest(x) - (1 << 63) for x in lines]
                    whole = xxhash.xxh3_64_intdigest(np.array([*hashes, marked], np.int64).tobytes()) - (1 << 63)
                    rows.append((t, key.split("\n")[0], f"{key}\n{pid if pid is not None else -1:020d}", hashes, [len(x) for x in lines], marked, whole))
            kinds = (pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.bool_(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["t", "host", "key", "hashes", "lengths", "marked", "whole"])

    return pages.select("page_id", "url", "html", "t").mapInArrow(run, "t long, host string, key string, hashes array<long>, lengths array<long>, marked boolean, whole long")


def _gone(pages: list[tuple], k: int, first: bool = True, last: bool = True) -> list[int] | None:
    """Indexes of the blocks of page k that differencing deletes; pages are (host, marked, blocks) in order.

    None if that depends on pages beyond the list, which begins (ends) where the table does if ``first`` (``last``).
    """
    host, marked, own = pages[k]
    if marked:
        return []
    left = False

    def nearest(step: int) -> Iterator[list[tuple[int, int]]]:
        nonlocal left
        j = k + step
        while 0 <= j < len(pages) and pages[j][0] == host:
            if (pairs := shared_lines(own, pages[j][2])) is not None:
                yield pairs
            j += step
        left |= j < 0 and not first or j >= len(pages) and not last

    before, after = nearest(-1), nearest(1)
    a, b = next(before, None), next(after, None)
    a, b = (next(after, None) if a is None else a), (next(before, None) if b is None else b)
    return None if left else sorted({i for pairs in (a, b) for i, _ in pairs or ()})


def _differenced(last: int):
    """Rows ordered by bucket and rank (up to ``last``): the blocks to delete of every page, from its neighbours on the same host; null if the bucket doesn't decide."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pages, names = None, [], []

        def found() -> pa.RecordBatch:
            ends = names[0][0] == 0, names[-1][0] == last
            out = [(*name, gone) for k, (_, real, *name) in enumerate(names) if real and (gone := _gone(pages, k, *ends)) != []]
            kinds = (pa.string(), pa.int64(), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], ["host", "whole", "gone"])

        for batch in batches:
            for bucket, rank, real, host, whole, marked, hashes, lengths in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != now:
                    if pages:
                        yield found()
                    now, pages, names = bucket, [], []
                pages.append((host, marked, list(zip(hashes, lengths, strict=True))))
                names.append((rank, real, host, whole))
        if pages:
            yield found()

    return run


#: A page's search for a partner: the page, the direction, and the rank to look at next.
SEARCH = "rank long, host string, hashes array<long>, lengths array<long>, step int, at long"


def _looked_up(size: int):
    """Rows ordered by bucket (of ``size`` pages), its pages before its searches: the searches as far as the bucket takes them.

    ``found`` holds the blocks shared with the page at ``at``; it is null while the search goes on, and where it is over without a partner ``at`` is null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pages = None, {}
        kinds = (pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), pa.int64(), pa.list_(pa.int64()))
        for batch in batches:
            out = []
            for bucket, search, rank, host, hashes, lengths, step, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != now:
                    now, pages = bucket, {}
                own = list(zip(hashes, lengths, strict=True))
                if not search:
                    pages[rank] = host, own
                    continue
                pairs = None
                while at in pages and pages[at][0] == host and (pairs := shared_lines(own, pages[at][1])) is None:
                    at += step
                if pairs is None and at // size == bucket:
                    at = None
                out.append((rank, host, hashes, lengths, step, at, None if pairs is None else [i for i, _ in pairs]))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], ["rank", "host", "hashes", "lengths", "step", "at", "found"])

    return run


def _partners(pages: DataFrame, searches: DataFrame) -> DataFrame:
    """The searches with their partners; a round takes each through one bucket."""
    place = pages.select(F.floor(F.col("rank") / BUCKET).alias("bucket"), F.lit(False).alias("search"), "rank", "host", "hashes", "lengths", F.lit(0).alias("step"), F.lit(0).cast("long").alias("at"))
    over, going = None, searches
    while True:
        rows = going.select(F.floor(F.col("at") / BUCKET).alias("bucket"), F.lit(True).alias("search"), "rank", "host", "hashes", "lengths", "step", "at")
        rows = place.join(rows.select("bucket").distinct(), "bucket", "left_semi").union(rows)
        now = materialize(rows.repartition("bucket").sortWithinPartitions("bucket", "search").mapInArrow(_looked_up(BUCKET), SEARCH + ", found array<long>"))
        ended = now.where("found is not null or at is null").select("rank", "step", "at", "found")
        over = ended if over is None else over.union(ended)
        going = now.where("found is null and at is not null").drop("found")
        if going.isEmpty():
            return over


def _far(pages: DataFrame, open_pages: DataFrame) -> DataFrame:
    """host, whole, gone of the pages whose partners their buckets don't hold: the nearest on either side, or the next of one side where the other has none."""
    own = materialize(open_pages.select("rank", "host", "whole", "hashes", "lengths"))
    each = own.withColumn("step", F.explode(F.array(F.lit(-1), F.lit(1)))).withColumn("at", F.col("rank") + F.col("step"))
    near = materialize(_partners(pages, each.drop("whole")))
    single = near.groupBy("rank").agg(F.count("at").alias("n"), F.max(F.when(F.col("at").isNotNull(), F.struct("step", "at"))).alias("one")).where("n = 1")
    again = own.drop("whole").join(single.select("rank", "one.step", (F.col("one.at") + F.col("one.step")).alias("at")), "rank")
    found = near.union(_partners(pages, materialize(again))).select("rank", F.explode("found").alias("i")).groupBy("rank").agg(F.sort_array(F.collect_set("i")).alias("gone"))
    return materialize(own.join(found, "rank").select("host", "whole", "gone"))


def deletions(pages: DataFrame) -> DataFrame:
    """t (hash of the row) and the indexes of the blocks that differencing deletes."""
    lines = materialize(open_lines(pages))
    first = materialize(lines.groupBy("host", "whole").agg(F.min("key").alias("key"), *(F.first(c).alias(c) for c in ("marked", "hashes", "lengths"))))
    first = first.withColumn("key", F.concat_ws("\n", "key", "whole"))  # rows may share url and page_id
    pages = materialize(first.join(with_rank(first, "key", "rank"), "key").drop("key"))
    ranked = pages.withColumn("bucket", F.floor(F.col("rank") / BUCKET))
    place = F.col("rank") % BUCKET
    edge = F.when(place < REACH, F.array(F.lit(0), F.lit(-1))).when(place >= BUCKET - REACH, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = ranked.withColumn("by", F.explode(edge)).withColumn("bucket", F.col("bucket") + F.col("by"))
    rows = rows.select("bucket", "rank", (F.col("by") == 0).alias("real"), "host", "whole", "marked", "hashes", "lengths")
    gone = materialize(rows.repartition("bucket").sortWithinPartitions("bucket", "rank").mapInArrow(_differenced(pages.count() - 1), "host string, whole long, gone array<long>"))
    if not (left := gone.where("gone is null")).isEmpty():
        gone = materialize(gone.where("gone is not null").union(_far(pages, pages.join(left.select("host", "whole"), ["host", "whole"]))))
    return lines.select("t", "host", "whole").join(F.broadcast(gone) if gone.count() <= 50_000 else gone, ["host", "whole"]).select("t", "gone")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    pages = pages.select(F.col("page_id").cast("long"), "url", "html", F.xxhash64("page_id", "url", "html").alias("t"))
    gone = materialize(deletions(pages).dropDuplicates(["t"]))
    joined = pages.join(F.broadcast(gone) if gone.count() <= 50_000 else gone, "t", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for page, drop in zip(batch.column("html").to_pylist(), batch.column("gone").to_pylist(), strict=True):
                lines, drop = blocks(page or "")[0], set(drop or ())
                texts.append(" ".join(x for i, x in enumerate(lines) if i not in drop))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return joined.select("page_id", "url", "html", "gone").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op7_html_extraction(spark, sf_dir) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
