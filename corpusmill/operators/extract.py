"""Rows out of syntax trees and comments: functions, what they call, their documentation, pairs for training.

A text is parsed once, by a table function that emits a row for each function; everything after that is relational. Texts without
the first words of a definition never reach Python. Defined cases: a null or empty text gives no rows; a text that Python's parser
refuses gives no functions, and documentation only where a pattern finds it; functions nested in others give rows of their own; repeated
texts and ids give repeated rows; columns of docs are carried through under their own names, those of the result must be free.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import let, lines_nl, strip
from corpusmill.session import written

FUNCTION = (
    "name string, params array<string>, positional array<string>, annotations map<string,string>, returns string, decorators array<string>, is_async boolean, is_method boolean, "
    "start_line int, end_line int, complexity int, calls array<string>, refs array<string>, docstring string, doc string, source string, parsed boolean"
)
COMMENTED = "name string, doc string, params array<string>, returns string, line int"

# Nodes that add a path through a function (a boolean operator adds one for each operand after the first).
BRANCHES = (ast.If, ast.While, ast.For, ast.AsyncFor, ast.ExceptHandler, ast.With, ast.AsyncWith, ast.Assert, ast.comprehension)

# Documentation comments and the three forms of a function that may follow one.
COMMENT = re.compile(r"/\*\*(.*?)\*/", re.DOTALL)
CALLABLES = (
    re.compile(r"(?:export\s+)?(?:async\s+)?function\s+(\w+)\s*\(([^)]*)\)"),
    re.compile(r"(?:export\s+)?(?:const|let|var)\s+(\w+)\s*(?::[^=]+)?=\s*(?:async\s+)?\(([^)]*)\)\s*(?::[^=>{]+)?\s*=>"),
    re.compile(r"(?:(?:public|private|protected|static|async|override)\s+)*(\w+)\s*\(([^)]*)\)\s*(?::\s*[^{]+)?\s*\{"),
)

# Parameters and results named in documentation, and documented definitions in texts that don't parse.
ARGS_SECTION = r"(?isU)(?:Args|Arguments|Parameters)\s*:\s*\n(.*?)(?:\n\s*(?:Returns|Raises|Notes|Examples|$))"
ARG_LINE = r"(?mU)^\s+(\w+)\s*(?:\(.*?\))?\s*:"
PARAM_FIELD = r"(?U):param\s+(?:\w+\s+)?(\w+)\s*:"
RTYPE_FIELD = r"(?U):rtype:[^\S\n]*(\S.*)"
RETURNS_SECTION = r"(?iU)Returns\s*:\s*\n\s+(\w[\w\[\], ]*?)(?:\s*:|\n)"
DOCUMENTED = r'(?sU)def\s+(\w+)\s*\(([^)]*)\)\s*(?:->\s*([^:]+))?\s*:\s*\n\s*"""(.*?)"""'


def _plain(node: ast.AST | None) -> str | None:
    try:
        return node and ast.unparse(node)
    except RecursionError:
        return None


def _function(node: ast.FunctionDef | ast.AsyncFunctionDef, lines: list[str]) -> dict:
    spec, inner = node.args, list(ast.walk(node))
    named = [*spec.posonlyargs, *spec.args, *spec.kwonlyargs]
    rest = [mark + a.arg for mark, a in (("*", spec.vararg), ("**", spec.kwarg)) if a]
    bound = {p.lstrip("*") for p in rest} | {a.arg for a in named}
    for n in inner:
        targets = n.targets if isinstance(n, ast.Assign) else [n.target] if isinstance(n, (ast.AugAssign, ast.AnnAssign)) else []
        bound.update(t.id for t in targets if isinstance(t, ast.Name))
    called = [n.func for n in inner if isinstance(n, ast.Call)]
    return {
        "name": node.name, "params": [a.arg for a in named] + rest, "positional": [a.arg for a in spec.args],
        "annotations": {a.arg: _plain(a.annotation) for a in named if a.annotation}, "returns": _plain(node.returns),
        "decorators": [_plain(d) or "" for d in node.decorator_list], "is_async": isinstance(node, ast.AsyncFunctionDef),
        "is_method": any(a.arg in ("self", "cls") for a in named), "start_line": node.lineno, "end_line": node.end_lineno,
        "complexity": 1 + sum(len(n.values) - 1 if isinstance(n, ast.BoolOp) else isinstance(n, BRANCHES) for n in inner),
        "calls": [f.id if isinstance(f, ast.Name) else f.attr for f in called if isinstance(f, (ast.Name, ast.Attribute))],
        "refs": sorted({n.id for n in inner if isinstance(n, ast.Name)} - bound),
        "docstring": ast.get_docstring(node, clean=False), "doc": ast.get_docstring(node), "source": "\n".join(lines[node.lineno - 1 : node.end_lineno]), "parsed": True,
    }


_COLUMNS = [c.split()[0] for c in FUNCTION.split(", ")]
_REFUSED = tuple(False if c == "parsed" else None for c in _COLUMNS)


@F.udtf(returnType=FUNCTION)
class _Functions:
    """A row for each function of one text; a text that doesn't parse gives one row without any."""

    def eval(self, text: str) -> Iterator[tuple]:
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            yield _REFUSED
            return
        lines = re.split(r"\r\n|[\n\r]", text)
        for node in ast.walk(tree):
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                row = _function(node, lines)
                yield tuple(row[c] for c in _COLUMNS)


@F.udtf(returnType=COMMENTED)
class _Comments:
    """A row for each documentation comment that describes the callable after it, which begins within `reach` characters."""

    def eval(self, text: str, reach: int) -> Iterator[tuple]:
        line, seen = 1, 0
        for found in COMMENT.finditer(text):
            line, seen = line + text.count("\n", seen, found.start()), found.start()
            body = [x.strip().lstrip("*").strip() for x in found[1].splitlines()]
            tag = next((k for k, x in enumerate(body) if x.startswith("@")), len(body))
            described = "\n".join(body[:tag]).strip()
            if not described:
                continue
            after = text[found.end() : found.end() + reach].lstrip("\n\r ")
            callee = next(filter(None, (p.match(after) for p in CALLABLES)), None)
            if callee:
                own = [p.split(":")[0].strip().lstrip(".") for p in callee[2].split(",")]
                tags = "\n".join(body)
                result = re.search(r"@returns?\s+\{([^}]+)\}", tags)
                yield callee[1], described, [p for p in own if p] or re.findall(r"@param\s+(?:\{[^}]*\}\s+)?\[?(\w+)", tags), result and result[1].strip(), line


def _parsed(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.where(F.col(text_col).rlike(r"\bdef\s+\w")).lateralJoin(_Functions(F.col(text_col).outer()))


def functions(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without their text, a row for each Python function in it: signature, lines, complexity, calls, free names, documentation, source."""
    return _parsed(docs, text_col).where("parsed").drop(text_col, "parsed")


def call_edges(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, caller, callee: which functions of a text call which others of it, each pair once.

    Names and calls are written once, as both sides of the join read them: else each text would be parsed twice.
    """
    found = written(found.select(id_col, "name", "calls"))
    calls = found.select(id_col, F.col("name").alias("caller"), F.explode(F.array_distinct("calls")).alias("callee")).distinct()
    known = found.select(F.col(id_col).alias("_id"), F.col("name").alias("_name"))
    return calls.join(known, F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("callee") == F.col("_name")), "left_semi")


def dedented(lines: Column) -> Column:
    """Lines without the white space that all lines with content begin with; other lines become empty."""
    heads = F.transform(F.filter(lines, lambda x: x.rlike(r"[^ \t]")), lambda x: F.regexp_extract(x, r"^[ \t]*", 0))
    ends = F.struct(F.array_min(heads).alias("a"), F.array_max(heads).alias("b"))
    shared = let(ends, lambda e: F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.length(e["a"]), F.lit(1))), lambda k: (k <= F.length(e["a"])) & (F.left(e["a"], k) == F.left(e["b"], k)))))
    return let(F.when(F.size(heads) > 0, shared).otherwise(0), lambda n: F.transform(lines, lambda x: F.when(x.rlike(r"[^ \t]"), F.substr(x, n + 1)).otherwise("")))


def function_pairs(found: DataFrame, signature: bool = True) -> DataFrame:
    """found, with prompt (its lines up to the first that ends in a colon, or a request by name) and completion (the rest, dedented)."""
    lines = lines_nl(F.col("source"))
    first = F.coalesce(F.nullif(F.array_position(F.transform(lines, lambda x: x.rlike(r":\s*$")), True), F.lit(0)), F.lit(1)).cast("int")
    parts = let(lines, lambda x: let(first, lambda k: F.struct(F.array_join(F.slice(x, 1, k), "\n").alias("prompt"), F.array_join(dedented(F.slice(x, k + 1, F.size(x))), "\n").alias("completion"))))
    asked = F.col("_pair.prompt") if signature else F.concat(F.lit("# Implement function '"), F.col("name"), F.lit("'"))
    return found.withColumn("_pair", parts).withColumns({"prompt": asked, "completion": F.col("_pair.completion")}).drop("_pair")


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(strip(F.regexp_extract(text, pattern, group)), F.lit(""))


def _own(params: Column) -> Column:
    return F.filter(params, lambda p: ~p.isin("", "self", "cls"))


def documented(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without their text, a row for each documented Python function: name, doc, params, returns, line (null where the text doesn't parse).

    Parameters and results come from the signature, else from the documentation (sections or fields).
    """
    rows = _parsed(docs, text_col)
    carried = [c for c in docs.columns if c != text_col]
    section = F.regexp_extract_all(F.regexp_extract("doc", ARGS_SECTION, 1), F.lit(ARG_LINE), 1)
    told = F.when(F.size(section) > 0, section).otherwise(F.regexp_extract_all("doc", F.lit(PARAM_FIELD), 1))
    own = let(_own(F.col("positional")), lambda p: F.when(F.size(p) > 0, p).otherwise(told))
    read = F.struct("name", "doc", own.alias("params"), F.coalesce("returns", _found(F.col("doc"), RTYPE_FIELD), _found(F.col("doc"), RETURNS_SECTION)).alias("returns"), F.col("start_line").alias("line"))
    split = lambda m: _own(F.transform(F.split(F.regexp_extract(m, DOCUMENTED, 2), ","), lambda p: strip(F.regexp_extract(p, r"^[^:]*", 0))))
    guessed = F.transform(F.regexp_extract_all(text_col, F.lit(DOCUMENTED), 0), lambda m: F.struct(
        F.regexp_extract(m, DOCUMENTED, 1).alias("name"), strip(F.regexp_extract(m, DOCUMENTED, 4)).alias("doc"), split(m).alias("params"), _found(m, DOCUMENTED, 3).alias("returns"), F.lit(None).cast("int").alias("line")))
    out = rows.select(*carried, F.explode(F.when(F.col("parsed"), F.array(read)).otherwise(guessed)).alias("_d")).select(*carried, "_d.*")
    return out.where("doc <> ''")


def commented(docs: DataFrame, text_col: str = "text", reach: int = 300) -> DataFrame:
    """docs without their text, a row for each documented callable of JavaScript or TypeScript: name, doc, params, returns, line of the comment."""
    held = docs.where(F.contains(text_col, F.lit("/**")))
    return held.lateralJoin(_Comments(F.col(text_col).outer(), F.lit(reach))).drop(text_col)


def signature(language: str = "python") -> Column:
    """The head of a documented function, from its name, params and returns."""
    head, arrow, end = ("def ", " -> ", ":") if language == "python" else ("function ", ": ", "")
    result = F.coalesce(F.concat(F.lit(arrow), F.col("returns")), F.lit(""))
    return F.concat(F.lit(head), F.col("name"), F.lit("("), F.array_join("params", ", "), F.lit(")"), result, F.lit(end))
