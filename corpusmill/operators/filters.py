"""Filters on metadata and content: licence, personal data, content kinds, labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import contains_any, lines_nl, strip, text_or_empty
from corpusmill.operators.quality import AUTOGENERATED

# Licences that allow training use, and how texts declare licences.
PERMISSIVE = ("mit", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "isc", "unlicense", "cc0-1.0", "zlib", "wtfpl", "0bsd")
DECLARED = {"mit": "MIT License", "apache-2.0": "Apache License, Version 2.0", "gpl-3.0": "GNU General Public License, version 3", "cc-by-nc-4.0": "CC BY-NC 4.0", "bsd-3-clause": "BSD 3-Clause"}
# Personal data and secrets, in the order in which they are reported.
PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "aws_key": r"\bAKIA[0-9A-Z]{16}\b",
    "github_token": r"\bghp_[A-Za-z0-9]{36}\b",
    "private_key": r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----",
    "api_key": r"""(?i)\b(?:api[_-]?key|secret|token)\b\s*[:=]\s*["']?[A-Za-z0-9_-]{16,}""",
    "password": r"""(?i)\b(?:password|passwd|pwd)\b\s*[:=]\s*["'][^"']{6,}["']""",
}
PLACEHOLDERS = ("example", "your_", "<your", "xxxx", "changeme", "placeholder")
LOCK_SIGNS = ('"lockfileVersion"', "# yarn lockfile v1", "# This file is @generated by Poetry", "[[package]]")


def with_declared_license(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with license: the first licence that the text declares, or null."""
    text = text_or_empty(F.col(text_col))
    found = reduce(lambda out, x: out.when(text.contains(x[1]), F.lit(x[0])), list(DECLARED.items())[1:], F.when(text.contains(DECLARED["mit"]), F.lit("mit")))
    return docs.withColumn("license", found)


def license_reason(license_id: Column, allow_unknown: bool = False, allowed: tuple[str, ...] = PERMISSIVE) -> Column:
    """Null if the licence is allowed, whatever its letter case."""
    clean = F.lower(strip(license_id))
    unknown = clean.isNull() | (clean == "")
    return F.when(unknown, F.lit(None) if allow_unknown else F.lit("no_license")).when(~clean.isin(*allowed), F.lit("non_permissive"))


def _personal(text: Column, pattern: str) -> Column:
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    return F.exists(found, lambda x: ~contains_any(F.lower(x), PLACEHOLDERS))


def pii_reason(text: Column) -> Column:
    """The kind of the first personal data or secret that is no placeholder, or null."""
    clean = text_or_empty(text)
    kinds = list(PII)
    return reduce(lambda out, k: out.when(_personal(clean, PII[k]), k), kinds[1:], F.when(_personal(clean, PII[kinds[0]]), kinds[0]))


def pii_sql(kind: str) -> str:
    pattern = PII[kind].replace("'", "''")
    none = " AND ".join(f"NOT contains(lower(x), '{p}')" for p in PLACEHOLDERS)
    return f"len(list_filter(regexp_extract_all(coalesce(text, ''), '{pattern}'), lambda x: {none})) > 0"


def redact_pii(text: Column) -> Column:
    """Every match replaced by its kind in angle brackets."""
    return reduce(lambda x, k: F.regexp_replace(x, PII[k], f"<{k.upper()}>"), PII, text)


def content_reason(text: Column) -> Column:
    """lock_file, autogenerated, minified, data_dump or null."""
    clean = text_or_empty(text)
    data = F.length(F.regexp_replace(clean, r"[^0-9,;\t]", "")) / F.length(clean)
    return (F.when(contains_any(clean, LOCK_SIGNS), "lock_file")
            .when(contains_any(F.lower(clean), AUTOGENERATED), "autogenerated")
            .when(F.array_max(F.transform(lines_nl(clean), F.length)) > 1000, "minified")
            .when((F.length(clean) >= 200) & (data > 0.6), "data_dump"))


def length_reason(text: Column, min_lines: int = 5, max_lines: int = 10_000) -> Column:
    n = F.size(lines_nl(text_or_empty(text)))
    return F.when(n < min_lines, "too_short").when(n > max_lines, "too_long")


def four_criteria(text: Column) -> Column:
    """Share of four criteria met: length, letters, character diversity, not blank."""
    t = text_or_empty(text)
    diverse = (F.length(t) > 0) & (F.size(F.array_distinct(F.split(t, ""))) >= 0.1 * F.length(t))
    met = [F.length(t) >= 20, t.rlike("[a-zA-Z]{2,}"), diverse, strip(t) != ""]
    return sum((m.cast("int") for m in met), F.lit(0)) / 4


def against_labels(rows: DataFrame, kept: Column, good: Column) -> DataFrame:
    """Confusion counts, precision, recall, F1 and keep rate of a filter: one row."""
    c = rows.agg(F.count_if(kept & good).alias("tp"), F.count_if(kept & ~good).alias("fp"), F.count_if(~kept & good).alias("fn"), F.count_if(~kept & ~good).alias("tn"))
    rate = lambda a, b: F.round(F.try_divide(a, b), 6)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select("tp", "fp", "fn", "tn", rate(tp, tp + fp).alias("precision"), rate(tp, tp + fn).alias("recall"),
                    rate(2 * tp, 2 * tp + fp + fn).alias("f1"), rate(tp + fp, tp + fp + fn + tn).alias("keep_rate"))
