"""Scalar text functions: hashes, normal forms, metrics, names, snippets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_hash(text: Column) -> Column:
    """SHA-256 of the text in lower case with white space collapsed and trimmed."""
    return F.sha2(F.trim(F.lower(F.regexp_replace(text, r"\s+", " "))), 256)


def compact_hash(text: Column) -> Column:
    """SHA-256 of the text in lower case without white space; duplicates are found by it."""
    return F.sha2(F.lower(F.regexp_replace(text, r"\s+", "")), 256)


def metadata_hash(title: Column, author: Column, isbn: Column, file_path: Column) -> Column:
    """SHA-256 of the sorted name:value fields that are not empty; null without any."""
    named = [("title", F.lower(F.trim(title))), ("author", F.lower(F.trim(author))), ("isbn", F.regexp_replace(F.trim(isbn), "-", "")), ("file_path", F.trim(file_path))]
    parts = F.filter(F.array_sort(F.array(*(F.when(v != "", F.concat(F.lit(f"{k}:"), v)) for k, v in named))), lambda x: x.isNotNull())
    return F.when(F.size(parts) > 0, F.sha2(F.array_join(parts, "|"), 256))


def metadata_text(values: Column) -> Column:
    """A list as one comma-joined string."""
    return F.array_join(values, ",")


def lower_fields(df, names=("title", "name", "category", "author")):
    """Adds ``<name>_lower`` for the fields that exist."""
    return df.withColumns({f"{n}_lower": F.lower(n) for n in names if n in df.columns})


def flatten_struct(df, column: str):
    """A struct's fields as ``column_field``."""
    fields = df.schema[column].dataType.names
    return df.select(*(c for c in df.columns if c != column), *(F.col(f"{column}.{f}").alias(f"{column}_{f}") for f in fields))


def with_hashes(df, text: str = "text"):
    """Adds metadata_hash, and content_hash where there is a text."""
    at = [F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string") for c in ("title", "author", "isbn", "file_path")]
    return df.withColumns({"metadata_hash": metadata_hash(*at), "content_hash": F.when(F.length(text) > 0, content_hash(F.col(text)))})


def title_case(name: Column) -> Column:
    """Every run of letters with its first in upper case, the others in lower case."""
    parts = F.regexp_extract_all(name, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.lower(F.substring(p, 2, 1 << 20)))), "")


def adaptive_chunk_size(text: Column, default: int = 1000) -> Column:
    """Smaller chunks for very long texts and for tables, code and lists; 250 to 2000."""
    n = F.length(text)
    size = F.when(n > 1_000_000, 500.0).when(n > 500_000, 750.0).otherwise(float(default))
    size = size * F.when(text.rlike(r"\|\s*-+\s*\|"), 0.8).otherwise(1.0)
    size = size * F.when(text.rlike("(?s)```.*?```"), 0.9).otherwise(1.0)
    size = size * F.when(text.rlike(r"(?m)^\s*[-*+]\s|^\s*\d+\.\s"), 0.95).otherwise(1.0)
    return F.greatest(F.lit(250), F.least(F.lit(2000), size.cast("int")))


def file_author(name: Column) -> Column:
    """First parenthesised part that is no library tag."""
    groups = F.regexp_extract_all(name, F.lit(r"\(([^)]*)\)"), F.lit(1))
    return F.coalesce(F.get(F.filter(groups, lambda x: ~x.contains("Z-Library")), F.lit(0)), F.lit("Unknown"))


def file_title(name: Column) -> Column:
    return F.trim(F.split(name, r"\(")[0])


def last_author(name: Column) -> Column:
    """The last parenthesised part, if it is under 70 characters and no number."""
    last = F.element_at(F.regexp_extract_all(name, F.lit(r"\(([^)]*)\)"), F.lit(1)), -1)
    return F.when(F.try_element_at(F.regexp_extract_all(name, F.lit(r"\(([^)]*)\)"), F.lit(1)), F.lit(-1)).isNull(), "Unknown").otherwise(F.when((F.length(last) < 70) & ~last.rlike(r"^\d+$"), last).otherwise("Unknown"))


def folder_category(path: Column) -> Column:
    parent = F.regexp_replace(F.regexp_extract(path, r"([^/]+)/[^/]+$", 1), "[_-]", " ")
    return F.when(parent == "", "General").otherwise(F.concat(F.upper(F.left(parent, F.lit(1))), F.lower(F.substring(parent, 2, 1 << 20))))


def word_count(text: Column) -> Column:
    return F.when(F.trim(F.regexp_replace(text, r"\s+", " ")) == "", 0).otherwise(F.size(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")))


def snippet(text: Column, n: int = 200) -> Column:
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("..."))).otherwise(text)


def contains_name(name: Column, part: str, case_sensitive: bool = False) -> Column:
    return name.contains(part) if case_sensitive else F.lower(name).contains(part.lower())


def relevance(distance: Column) -> Column:
    return 1 - distance


def strength_bucket(strength: Column) -> Column:
    return F.when(strength <= 0.3, "Low").when(strength <= 0.6, "Medium").when(strength <= 0.9, "High").otherwise("Very High")


def strength_category(strength: Column) -> Column:
    return F.when(strength < 0.4, "weak").when(strength < 0.7, "moderate").when(strength < 1.0, "strong").otherwise("essential")


def relation_type(name: Column) -> Column:
    return F.upper(F.replace(name, F.lit(" "), F.lit("_")))


def relation_description(src: Column, kind: Column, dst: Column) -> Column:
    return F.concat_ws(" ", src, F.lit("is"), F.replace(F.lower(kind), F.lit("_"), F.lit(" ")), dst)


def json_in_text(text: Column, schema: str) -> Column:
    """Objects of the first [...] in a noisy reply, else of its {...}, else none; ``schema`` is one object's."""
    many = F.from_json(F.regexp_extract(text, r"(?s)\[.*\]", 0), f"array<{schema}>")
    one = F.from_json(F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit("")), schema)
    return F.coalesce(many, F.when(one.isNotNull(), F.array(one)), F.array().cast(f"array<{schema}>"))


def open_json(text: Column) -> Column:
    """Any JSON as a variant, whose fields need not be known; null for what isn't JSON."""
    return F.try_parse_json(text)


def open_fields(text: Column) -> Column:
    """An object's fields as a map; a value that is no string is JSON, a null is null; what isn't an object has none."""
    return F.when(F.schema_of_variant(open_json(text)).startswith("OBJECT"), F.from_json(text, "map<string,string>"))


def sentiment_label(reply: Column) -> Column:
    up, out = F.upper(reply), F.lit("UNKNOWN")
    for label in ("MIXED", "NEUTRAL", "NEGATIVE", "POSITIVE"):
        out = F.when(up.contains(label), label).otherwise(out)
    return out


def strip_html(text: Column) -> Column:
    """Tags to blanks, white space collapsed, five named references decoded."""
    out = F.trim(F.regexp_replace(F.regexp_replace(text, "<[^>]+>", " "), r"\s+", " "))
    for name, value in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"')):
        out = F.replace(out, F.lit(name), F.lit(value))
    return out
