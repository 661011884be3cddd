"""How often syntax-tree patterns occur in Python texts, and how two corpora differ in them.

Each text is parsed once, by a table function that counts within the text; sums, examples and comparisons are relational. Defined cases:
null and empty texts, and texts that the parser refuses, give no rows; repeated texts count each time; an empty table gives no rows.
"""

from __future__ import annotations

import ast
from collections import defaultdict
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.session import written

PATTERN = "kind string, signature string, n long, examples array<struct<line:int,code:string>>"

# Expressions that are idioms, and their names.
IDIOMS = {
    ast.ListComp: "list_comprehension", ast.DictComp: "dict_comprehension", ast.SetComp: "set_comprehension", ast.GeneratorExp: "generator_expression",
    ast.IfExp: "conditional_expression", ast.NamedExpr: "walrus_operator", ast.Lambda: "lambda", ast.Yield: "yield", ast.YieldFrom: "yield_from",
    ast.Await: "await", ast.Starred: "starred_unpack", ast.JoinedStr: "fstring",
}
MUTABLE = (ast.List, ast.Dict, ast.Set)


def subtree(node: ast.AST, levels: int) -> str:
    """The node's type and those of its children, joined by '>'; deeper levels stand in brackets."""
    below = [subtree(c, levels - 1) for c in ast.iter_child_nodes(node)] if levels > 0 else []
    return ">".join([type(node).__name__, *(f"({x})" if ">" in x else x for x in below)])


def _named(node: ast.AST) -> Iterator[tuple[str, str]]:
    """Kind and signature of what a node is, besides a subtree."""
    if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
        spec = node.args
        n = len(spec.posonlyargs) + len(spec.args) + len(spec.kwonlyargs) + bool(spec.vararg) + bool(spec.kwarg)
        marks = ("async" * isinstance(node, ast.AsyncFunctionDef), f"def({n}_args)", "->annot" if node.returns else "", f"@{len(node.decorator_list)}decs" if node.decorator_list else "")
        yield "construct", ":".join(filter(None, marks))
        if any(isinstance(d, MUTABLE) for d in (*spec.defaults, *spec.kw_defaults)):
            yield "anti_pattern", "mutable_default_arg"
    elif isinstance(node, ast.ClassDef):
        yield "construct", f"class({len(node.bases)}_bases)"
    elif isinstance(node, ast.ExceptHandler) and node.type is None:
        yield "anti_pattern", "bare_except"
    elif isinstance(node, ast.Assert) and isinstance(node.test, ast.Tuple):
        yield "anti_pattern", "assert_tuple"
    elif type(node) in IDIOMS:
        yield "idiom", IDIOMS[type(node)]


@F.udtf(returnType=PATTERN)
class _Patterns:
    """A row for each different pattern of one text, with its number and its first lines; kind 'total' counts the text and its nodes."""

    def eval(self, text: str, levels: int, most: int) -> Iterator[tuple]:
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return
        lines, nodes = text.replace("\r\n", "\n").replace("\r", "\n").split("\n"), 0
        count, where = defaultdict(int), defaultdict(list)
        for node in ast.walk(tree):
            nodes += 1
            count["subtree", subtree(node, levels)] += 1
            for key in _named(node):
                count[key] += 1
                where[key].append(node.lineno)
        yield "total", "texts", 1, []
        yield "total", "nodes", nodes, []
        for key, n in count.items():
            yield *key, n, [(at, lines[at - 1].strip()) for at in sorted(where[key])[:most]]


def mined(docs: DataFrame, text_col: str = "text", levels: int = 1, examples: int = 3) -> DataFrame:
    """docs without their text, a row for each different pattern of it: kind, signature, n, examples."""
    full = docs.where(F.col(text_col).rlike(r"\S"))
    return full.lateralJoin(_Patterns(F.col(text_col).outer(), F.lit(levels), F.lit(examples))).drop(text_col)


def frequencies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", levels: int = 1, examples: int = 3) -> DataFrame:
    """kind, signature, n, texts (that hold it), examples (the first lines by id and place) of all patterns.

    What the texts give is written once, as two reductions read it. Both keep a bounded state for a pattern, so that one in all texts
    is reduced before its rows meet.
    """
    key = ["kind", "signature"]
    rows = written(mined(docs.select(id_col, text_col), text_col, levels, examples))
    totals = rows.groupBy(key).agg(F.sum("n").alias("n"), F.count("*").alias("texts"))
    spread = rows.select(F.col(id_col).alias("_id"), *key, F.explode("examples").alias("_e")).select("_id", *key, "_e.line", "_e.code")
    first = spread.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy("_id", "line", "code"))).where(F.col("_k") <= examples)
    shown = first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "code"))), lambda x: x["code"]).alias("examples"))
    return totals.join(shown, key, "left").withColumn("examples", F.coalesce("examples", F.array().cast("array<string>")))


def comparison(a: DataFrame, b: DataFrame, text_col: str = "text", levels: int = 1, smoothing: float = 1.0) -> DataFrame:
    """kind, signature, a, b, delta, log_ratio: numbers in two corpora; the logarithm to base 2 of b's share of its kind over a's.

    `smoothing` is added to each number, so that a pattern of one corpus alone has a ratio. Without it the ratio is null there.
    """
    sides = [mined(d.select(text_col), text_col, levels, 0).select("kind", "signature", F.when(F.lit(side == 0), F.col("n")).otherwise(0).alias("a"), F.when(F.lit(side == 1), F.col("n")).otherwise(0).alias("b")) for side, d in enumerate((a, b))]
    both = written(sides[0].unionByName(sides[1]).where("kind <> 'total'").groupBy("kind", "signature").agg(F.sum("a").alias("a"), F.sum("b").alias("b")))
    kinds = both.groupBy("kind").agg(F.sum("a").alias("_a"), F.sum("b").alias("_b"), F.count("*").alias("_v"))  # four kinds at most
    share = lambda c: F.try_divide(F.col(c) + F.lit(smoothing), F.col(f"_{c}") + F.lit(smoothing) * F.col("_v"))
    return both.join(F.broadcast(kinds), "kind").select("kind", "signature", "a", "b", (F.col("b") - F.col("a")).alias("delta"), F.log2(F.try_divide(share("b"), share("a"))).alias("log_ratio"))
