"""The quality checks of a code or text file, their composition into a filter, and scoring.

Every check is a column expression; a filter computes them in one projection and takes the first that
fails. Only the Python parser needs Python, and it runs on the rows the built-in checks leave.
"""

from __future__ import annotations

import ast
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from corpusmill.functions.text import contains_any, count_where, how_many_contained, let, lines_nl, occurrences, starts_with_any, strip, text_or_empty, total

# Fixed values that the checks look for.
AUTOGENERATED = (
    "auto-generated", "autogenerated", "automatically generated", "do not edit", "do not modify", "generated by", "generated from",
    "this file is generated", "machine generated", "code generated by", "generated by the protocol buffer compiler",
    "generated by django", "generated by swagger", "generated by openapi",
)
COMMENT_STARTS = ("#", "//", "/*", "*", "'''", '"""')
ASSERT_STARTS = ("assert", "self.assert", "expect(")
DEFINITIONS = ("def ", "class ", "function ", "const ", "let ", "export ", "async function", "interface ", "type ", "enum ")
NAME_PATTERN = r"(?:def |function |const |let |var |export (?:const |let |function )?)([a-zA-Z_]\w*)"
SHORT_NAMES = ("i", "j", "k", "n", "x", "y", "e", "fn", "cb", "db", "id", "ok")
DOC_SIGNS = ('"""', "'''", "/**", "* @", "# ", "// ")
SECRETS = (
    r"""(?i)(?:api[_-]?key|apikey)\s*[:=]\s*["'][a-zA-Z0-9]{20,}""",
    r"""(?i)(?:password|passwd|pwd)\s*[:=]\s*["'][^"']{8,}""",
    r"""(?i)(?:secret|token)\s*[:=]\s*["'][a-zA-Z0-9]{20,}""",
    r"(?i)(?:aws_access_key_id|aws_secret_access_key)\s*[:=]",
    r"-----BEGIN (?:RSA |EC )?PRIVATE KEY-----",
    r"sk-[a-zA-Z0-9]{32,}",
    r"ghp_[a-zA-Z0-9]{36}",
)
JS_VETO = ("const ", "let ", "=> ", "require(", "export ", "interface ", "type ")
PYTHON_SIGNS = ("def ", "self.", "if __name__", "elif ", "except ", "print(", "#!/usr/bin")
JS_SIGNS = ("function ", "const ", "let ", "var ", "=> ", "require(", "import ", "export ", "interface ", "type ", "async ")


@dataclass(frozen=True)
class Limits:
    """Thresholds of a mode."""

    min_lines: int = 5
    max_lines: int = 10_000
    max_avg_line: int = 200
    max_line: int = 1000
    min_diversity: float = 0.05
    max_comments: float = 0.85
    max_asserts: float = 0.9
    strict: bool = False


CONSERVATIVE = Limits()
STRICT = Limits(10, 5000, 120, 500, 0.08, 0.60, 0.70, True)
MODES = {"conservative": CONSERVATIVE, "strict": STRICT}

#: The score of a failed check (too short and too long differ, see score_of).
FAIL_SCORES = {
    "length": 0.2, "avg_line_length": 0.0, "max_line_length": 0.1, "character_diversity": 0.1, "not_autogenerated": 0.0,
    "not_data_file": 0.0, "comment_ratio": 0.2, "not_test_heavy": 0.2, "python_parseable": 0.1, "js_ts_parseable": 0.2,
    "has_functions_or_classes": 0.3, "naming_quality": 0.4, "code_to_blank_ratio": 0.3, "no_obvious_copy_paste": 0.2,
    "has_some_documentation": 0.4, "no_hardcoded_secrets": 0.0,
}


def _lines(text: Column) -> Column:
    return lines_nl(text)


def _nonblank(text: Column) -> Column:
    return F.filter(F.transform(_lines(text), strip), lambda x: x != "")


def _code(failed: Column, reason: str) -> Column:
    return F.when(failed, F.lit(reason))


#: Characters from the start that the checks look at where a span is given as for compatibility; by default they look at whole texts.
COMPATIBLE_SPANS = {"language": 2000, "names": 10_000, "secrets": 5000, "security": 8000}


def within(text: Column, span: int | None) -> Column:
    return text if span is None else F.substring(text, 1, span)


def looks_like_python(text: Column, span: int | None = None) -> Column:
    head = within(text, span)
    return (how_many_contained(head, JS_VETO) < 2) & (how_many_contained(head, PYTHON_SIGNS) >= 2)


def looks_like_js_ts(text: Column, span: int | None = None) -> Column:
    return how_many_contained(within(text, span), JS_SIGNS) >= 2


def check_length(text: Column, limits: Limits = CONSERVATIVE) -> Column:
    n = occurrences(text, "\n") + 1
    return F.when(n < limits.min_lines, F.lit("too_short")).when(n > limits.max_lines, F.lit("too_long"))


def check_avg_line_length(text: Column, limits: Limits = CONSERVATIVE) -> Column:
    breaks = occurrences(text, "\n")
    return _code((F.length(text) - breaks) / (breaks + 1) > limits.max_avg_line, "minified")


def check_max_line_length(text: Column, limits: Limits = CONSERVATIVE) -> Column:
    return _code(F.array_max(F.transform(_lines(text), F.length)) > limits.max_line, "long_line")


def check_character_diversity(text: Column, limits: Limits = CONSERVATIVE) -> Column:
    ratio = F.size(F.array_distinct(F.split(text, ""))) / F.least(F.length(text), F.lit(1000))
    return _code((F.length(text) >= 100) & (ratio < limits.min_diversity), "low_diversity")


def check_not_autogenerated(text: Column, limits: Limits = CONSERVATIVE) -> Column:
    head = F.lower(F.array_join(F.slice(_lines(text), 1, 10), "\n"))
    return _code(let(head, lambda h: contains_any(h, AUTOGENERATED)), "autogenerated")


def check_not_data_file(text: Column, limits: Limits = CONSERVATIVE) -> Column:
    def judge(sample: Column) -> Column:
        n = F.size(sample)
        braces = count_where(sample, lambda x: starts_with_any(strip(x), ("{", "[", "]", "}")))
        hexes = count_where(sample, lambda x: strip(x).rlike(r"^[0-9a-fA-F\s]{40,}$"))
        commas = F.transform(F.filter(sample, lambda x: strip(x) != ""), lambda x: occurrences(x, ","))

        def csv(c: Column) -> Column:
            mean = total(c) / F.size(c)
            variance = let(mean, lambda m: total(F.transform(c, lambda x: (x - m) * (x - m))) / F.size(c))
            return (F.size(c) > 0) & (F.array_min(c) > 3) & (variance < 2.0) & (mean > 5)

        return F.when(n <= 10, F.lit(None)).when(braces / n > 0.8, F.lit("data_file_json")).when(hexes / n > 0.5, F.lit("data_file_hex")).when(
            F.coalesce(let(commas, lambda c: F.when(F.size(c) > 0, csv(c)).otherwise(F.lit(False))), F.lit(False)), F.lit("data_file_csv"))

    return let(F.slice(_lines(text), 1, 50), judge)


def check_comment_ratio(text: Column, limits: Limits = CONSERVATIVE) -> Column:
    return _code(let(_nonblank(text), lambda x: (F.size(x) >= 10) & (
        count_where(x, lambda v: starts_with_any(v, COMMENT_STARTS)) > limits.max_comments * F.size(x))), "mostly_comments")


def check_not_test_heavy(text: Column, limits: Limits = CONSERVATIVE) -> Column:
    return _code(let(_nonblank(text), lambda x: (F.size(x) >= 20) & (
        count_where(x, lambda v: starts_with_any(v, ASSERT_STARTS)) > limits.max_asserts * F.size(x))), "assertion_dump")


@F.pandas_udf(BooleanType())
def _parses(code: pd.Series) -> pd.Series:
    def ok(x: str) -> bool:
        try:
            ast.parse(x)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return False
        return True

    return code.map(ok, na_action="ignore")


def check_python_parseable(text: Column, limits: Limits = CONSERVATIVE) -> Column:
    """Python's parser reads only texts that look like Python: the others reach it as null."""
    return _code(_parses(F.when(looks_like_python(text), text)) == F.lit(False), "python_syntax_error")


def check_js_ts_parseable(text: Column, limits: Limits = CONSERVATIVE) -> Column:
    opened, off = occurrences(text, "{"), F.abs(occurrences(text, "{") - occurrences(text, "}"))
    return _code(looks_like_js_ts(text) & (off > 5) & (off / F.greatest(opened, F.lit(1)) > 0.2), "js_brace_imbalance")


def check_has_functions_or_classes(text: Column, limits: Limits = STRICT) -> Column:
    return _code(~F.exists(_lines(text), lambda x: contains_any(x, DEFINITIONS) & ~starts_with_any(strip(x), ("#", "//", "*"))), "no_structure")


def names_of(text: Column, span: int | None = None) -> Column:
    return F.regexp_extract_all(within(text, span), F.lit(NAME_PATTERN), 1)


def check_naming_quality(text: Column, limits: Limits = STRICT) -> Column:
    telling = lambda n: F.filter(n, lambda x: ~F.lower(x).isin(*SHORT_NAMES))
    short = lambda m: (F.size(m) > 0) & (total(F.transform(m, F.length)) < 3.0 * F.size(m))
    return _code(let(names_of(text), lambda n: (F.size(n) >= 5) & let(telling(n), short)), "short_names")


def check_code_to_blank_ratio(text: Column, limits: Limits = STRICT) -> Column:
    return _code(let(_lines(text), lambda x: (F.size(x) >= 10) & (count_where(x, lambda v: strip(v) != "") < 0.5 * F.size(x))), "too_sparse")


def check_no_obvious_copy_paste(text: Column, limits: Limits = STRICT) -> Column:
    long = F.filter(_nonblank(text), lambda x: F.length(x) > 10)
    return _code(let(long, lambda x: (F.size(x) >= 20) & ((F.size(x) - F.size(F.array_distinct(x))) / F.size(x) > 0.3)), "internal_duplication")


def check_has_some_documentation(text: Column, limits: Limits = STRICT) -> Column:
    return _code((occurrences(text, "\n") + 1 > 50) & ~contains_any(text, DOC_SIGNS), "no_documentation")


def check_no_hardcoded_secrets(text: Column, limits: Limits = STRICT, span: int | None = None) -> Column:
    head = within(text, span)
    return _code(F.greatest(*[head.rlike(p).cast("int") for p in SECRETS]) == 1, "hardcoded_secret")


BASE = {
    "length": check_length, "avg_line_length": check_avg_line_length, "max_line_length": check_max_line_length,
    "character_diversity": check_character_diversity, "not_autogenerated": check_not_autogenerated, "not_data_file": check_not_data_file,
    "comment_ratio": check_comment_ratio, "not_test_heavy": check_not_test_heavy,
}
SYNTAX = {"python_parseable": check_python_parseable, "js_ts_parseable": check_js_ts_parseable}
STRICT_ONLY = {
    "has_functions_or_classes": check_has_functions_or_classes, "naming_quality": check_naming_quality, "code_to_blank_ratio": check_code_to_blank_ratio,
    "no_obvious_copy_paste": check_no_obvious_copy_paste, "has_some_documentation": check_has_some_documentation, "no_hardcoded_secrets": check_no_hardcoded_secrets,
}
CHECKS = BASE | SYNTAX | STRICT_ONLY


def checks_for(mode: str, languages: list[str] | None = None) -> dict:
    """The checks of a mode in their order; syntax checks only for the languages asked for."""
    syntax = dict(SYNTAX)
    if languages is not None:
        if "python" not in languages:
            syntax.pop("python_parseable")
        if not {"typescript", "javascript"} & set(languages):
            syntax.pop("js_ts_parseable")
    return BASE | syntax | (STRICT_ONLY if MODES[mode].strict else {})


def first_failure(text: Column, mode: str = "conservative", languages: list[str] | None = None) -> Column:
    """The reason code of the first failed check, or null."""
    clean = text_or_empty(text)
    return F.coalesce(*[check(clean, MODES[mode]) for check in checks_for(mode, languages).values()])


def with_verdict(docs: DataFrame, mode: str = "conservative", languages: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """docs with reason_code (null if kept) and keep."""
    out = docs.withColumn("reason_code", first_failure(F.col(text_col), mode, languages))
    return out.withColumn("keep", F.col("reason_code").isNull())


def filter_code(docs: DataFrame, mode: str = "conservative", languages: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """The documents that pass."""
    return docs.where(first_failure(F.col(text_col), mode, languages).isNull())


def score_of(name: str, reason: Column) -> Column:
    fail = F.when(reason == "too_long", 0.3).otherwise(0.2) if name == "length" else F.lit(FAIL_SCORES[name])
    return F.when(reason.isNull(), 1.0).otherwise(fail)


def score_code(docs: DataFrame, mode: str = "conservative", languages: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """docs with check_scores (a struct with a score of each check) and score, their plain mean."""
    checks = checks_for(mode, languages)
    clean = text_or_empty(F.col(text_col))
    out = docs.withColumn("check_scores", F.struct(*[score_of(n, c(clean, MODES[mode])).alias(n) for n, c in checks.items()]))
    mean = sum((F.col(f"check_scores.{n}") for n in checks), F.lit(0.0)) / len(checks)
    return out.withColumn("score", mean)


def score_bucket(score: Column) -> Column:
    """Five buckets of 0.2, the last one closed."""
    return F.least(F.floor(score * 5 + 1e-9), F.lit(4)).cast("int")


def filter_stats(docs: DataFrame, by: list[str], mode: str = "conservative", languages: list[str] | None = None) -> DataFrame:
    """Documents by group and reason."""
    judged = docs.select(*by, F.coalesce(first_failure(F.col("text"), mode, languages), F.lit("kept")).alias("reason_code"))
    return judged.groupBy(*by, "reason_code").agg(F.count("*").alias("n"))
