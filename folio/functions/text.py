"""Column expressions for texts, paths, ids and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Java patterns with Unicode classes and with line feed as the only line end.
UNICODE = "(?Ud)"


def ustrip(c: Column) -> Column:
    """Strip white space of any kind from both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def lines(c: Column) -> Column:
    return F.split(c, r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def stem(path: Column) -> Column:
    """The file name without its last suffix; both path separators count."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]+$", "")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r"(?<=.)(\.[^.]+)$", 1))


def book_id(path: Column) -> Column:
    return F.concat(F.lit("book::"), F.md5(path.cast("binary")))


def note_id(path: Column) -> Column:
    return F.concat(F.lit("note::"), F.md5(path.cast("binary")))


def capitalize(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))


def matches(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(UNICODE + pattern))


def preview(c: Column, n: int = 600, mark: str = " …[truncated]") -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(mark))).otherwise(c)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null if a vector is null, of no length or of another size."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm)


def keywords(c: Column, stop: list[str]) -> Column:
    """Distinct lower-case words of three letters or more that are no stop words, in order."""
    words = F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}]+"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(stop)))


def human_time(seconds: Column) -> Column:
    hours = seconds / 3600
    return F.when(hours < 48, F.format_string("%.1f hours", hours)).otherwise(F.format_string("%.1f days", hours / 24))
