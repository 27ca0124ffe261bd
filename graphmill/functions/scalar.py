"""Scalar functions of the engine as native column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def one_line(text: Column) -> Column:
    """The non-blank lines, trimmed and joined by single spaces."""
    lines = F.transform(F.split(text, r"\r\n|\r|\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.array_join(F.filter(lines, lambda x: x != ""), " ")


def sorted_json(mapping: Column) -> Column:
    """A map as JSON with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(mapping))))


def first_filled(*columns: str) -> Column:
    """The first value that is neither null nor empty. coalesce alone would stop at an empty one."""
    return F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in columns))


def prefixed_sha256(value: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(value, 256))


def posix(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def escape_html(text: Column) -> Column:
    pairs = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"))
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, text)


def simple_name(qualified: Column) -> Column:
    return F.substring_index(qualified, ".", -1)


def utf16_column(line: Column, byte_column: Column) -> Column:
    """The 0-based UTF-16 column at a 0-based UTF-8 byte column of a line."""
    head = F.decode(F.substring(F.encode(line, "UTF-8"), F.lit(1), byte_column), "UTF-8")
    return (F.octet_length(F.encode(head, "UTF-16LE")) / 2).cast("int")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector has no length."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a) * dot(b, b)), F.lit(0.0))


def similarity(distance: Column) -> Column:
    """1 - distance, not below 0."""
    return F.greatest(F.lit(0.0), 1.0 - distance)


def visible_types(wanted: Column, visible: tuple[str, ...]) -> Column:
    """The wanted types that are visible, each once, in the order wanted."""
    return F.filter(F.array_distinct(wanted), lambda x: x.isin(*visible))
