"""Column helpers on text. All are built-in expressions that stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def lines_nl(text: Column) -> Column:
    """Split at each \\n; a trailing newline leaves an empty last line."""
    return F.split(text, "\n", -1)


def lines_univ(text: Column) -> Column:
    """Split at all line ends, without an empty line after the last one."""
    parts = F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]", -1)
    return let(parts, lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p))


def strip(text: Column) -> Column:
    """Without leading and trailing Unicode white space."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


#: White space as Python's str methods see it, for a character class.
SPACE = r"\s\x0b\x1c-\x1f\x85\p{Z}"


def lstrip(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{SPACE}]+", "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, f"[{SPACE}]+$", "")


def words_ws(text: Column) -> Column:
    """White-space separated words."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def tokens(text: Column) -> Column:
    """Words of letters, digits and underscores, and single other characters."""
    return F.regexp_extract_all(text, F.lit(r"(?U)\w+|[^\w\s]"), 0)


def code_tokens(text: Column) -> Column:
    """ASCII identifiers, numbers, and single other characters than letters, digits and white space."""
    return F.regexp_extract_all(text, F.lit(rf"[A-Za-z_][\p{{L}}\p{{N}}_]*|[0-9]+(?:\.[0-9]+)?|[^{SPACE}\p{{L}}\p{{N}}_]"), 0)


def ngrams(items: Column, n: int, sep: str = " ") -> Column:
    """Joined n-grams of an array of strings, repeats included."""
    return F.when(F.size(items) < n, F.array().cast("array<string>")).otherwise(
        F.transform(F.slice(items, 1, F.size(items) - n + 1), lambda _, i: F.array_join(F.slice(items, i + 1, n), sep)))


def char_ngrams(text: Column, n: int) -> Column:
    """Different substrings of n characters."""
    return F.when(F.length(text) < n, F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substr(text, i, F.lit(n)))))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets: 1 if both are empty, 0 if one is."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(
        F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def occurrences(text: Column, needle: str) -> Column:
    """How often a literal occurs, without overlap."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))) / len(needle)).cast("int")


def how_many_contained(text: Column, needles: Iterable[str]) -> Column:
    return reduce(lambda a, b: a + b, [text.contains(n).cast("int") for n in needles])


def contains_any(text: Column, needles: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(n) for n in needles])


def starts_with_any(text: Column, prefixes: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.startswith(p) for p in prefixes])


def count_where(items: Column, predicate: Callable[[Column], Column]) -> Column:
    return F.size(F.filter(items, predicate))


def total(items: Column) -> Column:
    """Sum of an array of numbers."""
    return F.aggregate(items, F.lit(0.0), lambda s, x: s + x)


def md5_fold(key: Column, k: int) -> Column:
    """A stable fold from 0 to k - 1, from the first eight hexadecimal digits of the MD5."""
    return (F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") % k).cast("int")
