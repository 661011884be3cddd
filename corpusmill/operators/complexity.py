"""Complexity of source text: decision points, nesting, counts of definitions, and a difficulty bucket. Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import let, lines_univ, lstrip, strip, text_or_empty, total

# What counts as a decision point, a branch, a definition and a comment.
DECISIONS = {
    "python": (r"\bif\b", r"\belif\b", r"\bfor\b", r"\bwhile\b", r"\band\b", r"\bor\b", r"\bexcept\b"),
    "typescript": (r"\bif\b", r"\belse\s+if\b", r"\bfor\b", r"\bwhile\b", r"\bcase\b", r"\bcatch\b", r"&&", r"\|\|", r"\?\.", r"\?\s"),
}
BRANCHES = {"python": r"^\s*(if|elif|for|while|except|with|match)\b", "typescript": r"\b(if|else\s+if|for|while|catch|switch)\b"}
LOGIC = {"python": r"\band\b|\bor\b", "typescript": r"&&|\|\|"}
FUNCTIONS = {
    "python": r"(?m)^\s*(?:async\s+)?def\s+\w+",
    "typescript": r"(?:function\s+\w+|(?:const|let|var)\s+\w+\s*=\s*(?:async\s+)?(?:\([^)]*\)|[^=])\s*=>)",
}
CLASSES = r"(?m)^\s*(?:export\s+)?(?:abstract\s+)?class\s+\w+"
IMPORTS = {"python": r"(?m)^\s*(?:import|from)\s+", "typescript": r"(?m)^\s*import\s+"}
COMMENTS = {"python": ("#",), "typescript": ("//", "/*", "*")}
STRINGS = r"""(?s)"[^"]*(?:"|\z)|'[^']*(?:'|\z)|`[^`]*(?:`|\z)"""
# Upper bounds of the points 1, 2, ... of each measure, and of the buckets.
POINTS = {"cyclomatic": (2, 5, 10, 20), "nesting": (1, 3, 5), "lines": (10, 30, 100), "definitions": (1, 3)}
BUCKETS = (5, 8, 11, 14)
INDENT = 4


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(f"(?d){pattern}"))


def _indent(line: Column) -> Column:
    return F.floor((F.length(line) - F.length(lstrip(line))) / INDENT).cast("int")


def _most(items: Column) -> Column:
    return F.coalesce(F.array_max(items), F.lit(0))


def cyclomatic(text: Column, language: str) -> Column:
    return sum((_count(text, p) for p in DECISIONS[language]), F.lit(1))


def nesting(text: Column, lines: Column, language: str) -> Column:
    """Python: the deepest indentation of a line of code; else the deepest brace outside strings."""
    if language == "python":
        return _most(F.transform(F.filter(lines, lambda x: (lstrip(x) != "") & ~lstrip(x).startswith("#")), _indent))
    braces = F.split(F.regexp_replace(F.regexp_replace(text, STRINGS, ""), r"[^{}]+", ""), "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(s: Column, c: Column) -> Column:
        now = F.when(c == "{", s["now"] + 1).when(c == "}", F.greatest(s["now"] - 1, F.lit(0))).otherwise(s["now"])
        return let(now, lambda d: F.struct(d.alias("now"), F.greatest(s["most"], d).alias("most")))

    return F.aggregate(braces, start, step, lambda s: s["most"])


def cognitive(lines: Column, language: str) -> Column:
    """Branches cost one and their nesting; logical operators cost one."""
    if language == "python":
        return total(F.transform(lines, lambda x: F.when(x.rlike(BRANCHES[language]), _indent(x) + 1).otherwise(0) + _count(lstrip(x), LOGIC[language]))).cast("int")
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("score"))
    braces = lambda x: F.length(F.regexp_replace(x, r"[^{]+", "")) - F.length(F.regexp_replace(x, r"[^}]+", ""))
    step = lambda s, x: F.struct(F.greatest(s["depth"] + braces(x), F.lit(0)).alias("depth"),
                                 (s["score"] + _count(x, BRANCHES[language]) * (s["depth"] + 1) + _count(x, LOGIC[language])).alias("score"))
    return F.aggregate(lines, start, step, lambda s: s["score"])


def python_functions(lines: Column) -> Column:
    """array<struct<start, length, nesting>>: from each def line to the last line with text before the next one."""
    begins = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(r"^\s*(?:async\s+)?def\s+\w+"), i)), lambda i: i.isNotNull())

    def of(starts: Column) -> Column:
        def one(start: Column, k: Column) -> Column:
            end = F.coalesce(F.get(starts, k + 1), F.size(lines))
            body = F.filter(F.transform(F.slice(lines, start + 1, end - start), lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: strip(s["x"]) != "")
            width = lambda x: F.length(x) - F.length(lstrip(x))
            deep = F.transform(F.filter(body, lambda s: s["i"] > 0), lambda s: F.greatest(F.floor((width(s["x"]) - width(lines[start])) / INDENT), F.lit(0)).cast("int"))
            return F.struct(start.alias("start"), (_most(F.transform(body, lambda s: s["i"])) + 1).alias("length"), _most(deep).alias("nesting"))

        return F.transform(starts, one)

    return let(begins, of)


def bucket(cyclomatic: Column, nesting: Column, lines: Column, definitions: Column) -> Column:
    """1 (trivial) to 5 (very complex)."""
    def points(value: Column, bounds: tuple[int, ...]) -> Column:
        return sum(((value > b).cast("int") for b in bounds), F.lit(1))

    score = points(cyclomatic, POINTS["cyclomatic"]) + points(nesting, POINTS["nesting"]) + points(lines, POINTS["lines"]) + points(definitions, POINTS["definitions"])
    return points(score, BUCKETS)


def with_complexity(docs: DataFrame, text_col: str = "text", language: str = "typescript") -> DataFrame:
    """docs with cyclomatic, cognitive, nesting, lines, functions, classes, imports, comment_ratio, avg_line, bucket, and for Python avg_function, max_function."""
    language = "typescript" if language == "javascript" else language
    text = text_or_empty(F.col(text_col))
    out = docs.withColumn("_lines", lines_univ(text))
    lines = F.col("_lines")
    full = F.filter(lines, lambda x: strip(x) != "")
    comment = lambda x: F.coalesce(*[F.when(strip(x).startswith(c), True) for c in COMMENTS[language]], F.lit(False))
    some = lambda c, none: F.when(F.size(lines) > 0, c).otherwise(none)
    out = out.withColumns({
        "cyclomatic": some(cyclomatic(text, language), 1), "cognitive": cognitive(lines, language), "nesting": nesting(text, lines, language), "lines": F.size(lines),
        "functions": _count(text, FUNCTIONS[language]), "classes": _count(text, CLASSES), "imports": _count(text, IMPORTS[language]),
        "comment_ratio": some(F.size(F.filter(lines, comment)) / F.size(lines), 0.0),
        "avg_line": let(full, lambda x: F.when(F.size(x) > 0, total(F.transform(x, F.length)) / F.size(x)).otherwise(0.0)),
    })
    if language == "python":
        own = let(python_functions(lines), lambda f: F.struct(
            F.when(F.size(f) > 0, total(F.transform(f, lambda x: x["length"])) / F.size(f)).otherwise(0.0).alias("avg"), _most(F.transform(f, lambda x: x["length"])).alias("most")))
        out = out.withColumn("_f", own).withColumns({"avg_function": F.col("_f.avg"), "max_function": F.col("_f.most")}).drop("_f")
    return out.withColumn("bucket", bucket(F.col("cyclomatic"), F.col("nesting"), F.col("lines"), F.col("functions") + F.col("classes"))).drop("_lines")
