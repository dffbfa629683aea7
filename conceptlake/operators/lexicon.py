"""Matching of a lexicon of any size against texts; no text is shuffled or joined.

Keywords of letters and digits alone (plain ones) lie within a word of a text. Whole words meet the keywords in an
equi-join. For parts of words the texts' words are counted first: of the frequent ones it is found out once what
keywords they hold, and a text's words look that up; of a rare word all parts meet the keywords where it stands.

Other keywords are found by their beginnings. Texts are cut into overlapping blocks; each place
of a block at which some keyword may begin gives a window as long as the longest
keyword, and windows meet the keywords by their first 1, 2, 4 or 8 characters (the
longest of these that a keyword has), where they are compared. So the work grows with the texts and
not with the lexicon, but for keywords of over
WINDOW characters: of these the beginnings are matched, and the texts that have one are
joined by their ids and searched.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from conceptlake.tables import stored

#: Characters of a block, and most of a window.
BLOCK, WINDOW = 1024, 64
LEVELS = (1, 2, 4, 8)
#: Beginnings of keywords that one pattern preselects places by.
HEADS = 2000
#: Keywords that are sent to every task; more are shuffled, as the windows are.
SENT = 200_000
#: Frequent words whose keywords are sent to every task.
FREQUENT = 100_000
WORD = r"[\p{L}\p{N}]"


def beginnings(heads: list[str]) -> str:
    """A pattern for what begins with one of the strings: a tree of their characters."""
    after: dict[str, list[str]] = {}
    for h in heads:
        after.setdefault(h[0], []).append(h[1:])
    return "(?:" + "|".join(re.escape(c) + ("" if "" in rest else beginnings(rest)) for c, rest in sorted(after.items())) + ")"


def bounded(text: str, part: str, before: str, after: str = "") -> Column:
    """The first place (from 1) of a part that follows no letter or digit; 0 without one. What comes before is counted in characters."""
    pieces = F.split(F.col(text), F.concat(F.lit(rf"{before}(?<!{WORD})\Q"), part, F.lit(rf"\E{after}")), F.lit(2))
    return F.when(F.size(pieces) > 1, F.length(pieces[0]) + 1).otherwise(0)


def match(docs: DataFrame, lexicon: DataFrame, word_boundary: bool = False, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, keyword, pos (of its first place, from 1), and the lexicon's other columns, for each keyword in the lower-case text.

    ``lexicon`` has a row for each keyword (in lower case; empty and null ones are left out, of repeated ones all rows are
    returned). With ``word_boundary`` neither a letter nor a digit stands beside the keyword. Null texts have none; rows
    of one id count as one text's.
    """
    all_keys = lexicon.select("keyword").where("length(keyword) > 0").distinct()
    plain = F.col("keyword").rlike(rf"\A{WORD}+\z") & (F.length("keyword") <= WINDOW)
    about = all_keys.agg(F.count_if(plain).alias("plain"), F.count_if(~plain).alias("others"), F.max(F.when(plain, F.length("keyword"))).alias("longest")).first()
    parts = []
    if about.plain:
        # stored, or the planner would ask every word of the texts whether it is plain
        parts.append((_whole_words if word_boundary else _parts_of_words)(docs, stored(all_keys.where(plain)), about.plain, about.longest, id_col, text))
    if about.others or not about.plain:
        parts.append(_by_beginnings(docs, all_keys.where(~plain), word_boundary, id_col, text))
    first = parts[0] if len(parts) == 1 else parts[0].union(parts[1])
    rest = [c for c in lexicon.columns if c != "keyword"]
    return first.join(_sent(lexicon, about.plain + about.others), "keyword").select(id_col, "keyword", "pos", *rest) if rest else first


def _sent(rows: DataFrame, n: int) -> DataFrame:
    return F.broadcast(rows) if n <= SENT else rows


def _word_blocks(docs: DataFrame, id_col: str, text: str, before: str, more: int) -> DataFrame:
    """id, at, block: the text in lower case with a blank for all that is no letter or digit, BLOCK characters a block; its last word goes on for up to ``more``."""
    norm = F.concat(F.lit(before), F.regexp_replace(F.lower(text), rf"[^\p{{L}}\p{{N}}]", " "))
    blocks = F.regexp_extract_all(norm, F.lit(rf"(?s)(?=(.{{1,{BLOCK}}}[^ ]{{0,{more}}})).{{1,{BLOCK}}}"), F.lit(1))
    return docs.select(F.col(id_col), F.posexplode(blocks).alias("at", "block"))


def _whole_words(docs: DataFrame, keys: DataFrame, n: int, longest: int, id_col: str, text: str) -> DataFrame:
    """id, keyword, pos of plain keywords that are words of the text."""
    # a block begins with the character before its first place, so that what precedes its first blank is another block's
    rows = _word_blocks(docs, id_col, text, " ", longest + 1)
    words = F.array_distinct(F.expr("slice(split(block, ' '), 2, length(block) + 1)"))
    hits = rows.select(id_col, "at", "block", F.explode(words).alias("keyword")).join(_sent(keys, n), "keyword")
    place = F.expr("locate(concat(' ', keyword, ' '), concat(block, ' '))")
    return hits.groupBy(id_col, "keyword").agg(F.min(F.col("at") * BLOCK + place).alias("pos"))


def _parts_of_words(docs: DataFrame, keys: DataFrame, n: int, longest: int, id_col: str, text: str) -> DataFrame:
    """id, keyword, pos of plain keywords that are anywhere in the text."""
    rows = _word_blocks(docs, id_col, text, "", longest - 1)
    rows = rows.select(id_col, "at", "block", F.explode(F.array_distinct(F.split("block", " "))).alias("word")).where("word <> ''")
    counts = stored(rows.groupBy("word").agg(F.count("*").alias("n")))
    # at most a few hundred rows come to the driver
    ranks = sorted(counts.groupBy(F.floor(F.log2("n") * 8).alias("rank")).agg(F.count("*").alias("words")).collect(), reverse=True)
    least, words = 1 << 30, 0
    for r in ranks:
        words += r.words
        if words > FREQUENT:
            break
        least = r.rank
    # all parts of a word, from each of its places
    of = F.expr(f"flatten(transform(sequence(1, length(word)), i -> transform(sequence(1, least({longest}, length(word) - i + 1)), k -> struct(substring(word, i, k) as keyword, i - 1 as off))))")
    frequent = counts.where(F.floor(F.log2("n") * 8) >= least)
    found = frequent.select("word", F.explode(of).alias("p")).select("word", "p.*").join(_sent(keys, n), "keyword").groupBy("word", "keyword").agg(F.min("off").alias("off"))
    found = found.groupBy("word").agg(F.collect_list(F.struct("keyword", "off")).alias("holds"))
    found = stored(frequent.select("word").join(found, "word", "left").withColumn("holds", F.coalesce("holds", F.expr("cast(array() as array<struct<keyword:string,off:int>>)"))))
    met = rows.join(F.broadcast(found), "word", "left")
    # the place is found once a word, before its keywords are rows
    met = met.select(id_col, (F.col("at") * BLOCK + F.expr("locate(word, block)")).alias("place"), F.coalesce("holds", of).alias("holds"))
    hits = met.select(id_col, "place", F.explode("holds").alias("p")).select(id_col, "p.keyword", (F.col("place") + F.col("p.off")).alias("pos"))
    return hits.join(_sent(keys, n), "keyword").groupBy(id_col, "keyword").agg(F.min("pos").alias("pos"))


def _by_beginnings(docs: DataFrame, keys: DataFrame, word_boundary: bool, id_col: str, text: str) -> DataFrame:
    """id, keyword, pos of any keywords."""
    level = F.lit(LEVELS[-1])
    for n, more in reversed(list(zip(LEVELS, LEVELS[1:], strict=False))):
        level = F.when(F.length("keyword") < more, n).otherwise(level)
    keys = keys.withColumn("level", level)
    about = keys.agg(F.count("*").alias("n"), F.max(F.length("keyword")).alias("longest"), F.sort_array(F.collect_set("level")).alias("levels"), *(F.count_distinct(F.left("keyword", F.lit(d))).alias(f"h{d}") for d in (2, 3, 4))).first()
    depth = max((d for d in (2, 3, 4) if about[f"h{d}"] <= HEADS), default=0)
    heads = [r[0] for r in keys.select(F.left("keyword", F.lit(depth))).distinct().collect()] if depth else []  # HEADS at most
    begins = (rf"(?<!{WORD})" if word_boundary else "") + (f"(?={beginnings(heads)})" if heads else "")
    keys = keys.select("keyword", F.expr("left(keyword, level)").alias("head"), F.left("keyword", F.lit(WINDOW)).alias("begins"))

    low = docs.select(F.col(id_col), F.lower(text).alias("low"))
    wide = min(about.longest or 1, WINDOW) + word_boundary
    # a block goes on for a window; with borders it begins with the character before its first place
    whole = F.concat(F.lit(" "), "low") if word_boundary else F.col("low")
    blocks = F.regexp_extract_all(whole, F.lit(rf"(?s)(?=(.{{1,{BLOCK + wide}}})).{{1,{BLOCK}}}"), F.lit(1))
    rows = low.select(id_col, F.posexplode(blocks).alias("at", "block"))
    first_place = r"(?!^)" if word_boundary else ""
    found = F.array_distinct(F.regexp_extract_all("block", F.lit(rf"(?s){first_place}{begins}(?=(.{{1,{wide}}}))"), F.lit(1)))
    rows = rows.select(id_col, "at", "block", F.explode(found).alias("window"))
    # of equal windows of a block the first counts; what begins behind the block's own places is the next one's
    place = bounded("block", "window", r"(?!^)") if word_boundary else F.expr("locate(window, block)")
    # a shorter window ends with its block
    place = F.when(F.length("window") < wide, F.length("block") - F.length("window") + 1).otherwise(place)
    rows = rows.select(id_col, "at", "window", (place - int(word_boundary)).alias("place")).where(F.col("place") <= BLOCK)
    place = F.col("at") * BLOCK + F.col("place")
    ends = [F.left("window", F.lit(n)) for n in about.levels or [1]]
    rows = rows.select(id_col, place.alias("pos"), "window", (F.explode(F.array(*ends)) if len(ends) > 1 else ends[0]).alias("head"))
    hits = rows.join(_sent(keys, about.n), "head").where(F.startswith("window", "begins"))
    short = F.length("keyword") <= WINDOW
    inside = hits.where(short & ~F.expr("substring(window, length(keyword) + 1, 1)").rlike(WORD)) if word_boundary else hits.where(short)
    first = inside.groupBy(id_col, "keyword").agg(F.min("pos").alias("pos"))
    if (about.longest or 0) > WINDOW:
        maybe = hits.where(~short).select(id_col, "keyword").distinct().join(low, id_col)
        at = bounded("low", "keyword", "", rf"(?!{WORD})") if word_boundary else F.expr("locate(keyword, low)")
        first = first.union(maybe.select(id_col, "keyword", at.alias("pos")).where("pos > 0").groupBy(id_col, "keyword").agg(F.min("pos").alias("pos")))
    return first
