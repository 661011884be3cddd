"""Functions, calls and documentation out of small sources, with rows written by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import extract

CODE = [
    "def add(a, b: int = 2) -> int:\n    return a + b\n",
    'async def load(url, *, tries=3):\n    """Loads it."""\n    for k in range(tries):\n        if url and k:\n            return await fetch(url)\n',
    'class Box:\n    @property\n    def size(self) -> "int":\n        """\n        How big.\n\n        :param unit: cm\n        :rtype: float\n        """\n        return len(self.rows)\n',
    "def outer(x):\n    def inner(y):\n        return helper(y)\n    return inner(x)\n\ndef helper(z):\n    return outer(z)\n",
    "def broken(:\n    pass\n",
    "no code at all, but a def word",
    "",
    None,
    'def bad(a, self, b=1) -> Dict[str, int]:\n    """Says so."""\n  return\n',
    "def tabs():\r\n\tx = 1\r\n\treturn x\r\n",
]


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.createDataFrame([(k, t, k % 2) for k, t in enumerate(CODE)], "doc_id long, text string, extra int")
    return extract.functions(docs)


def test_functions_by_hand(found):
    rows = {(r.doc_id, r.name): r for r in found.collect()}
    assert set(rows) == {(0, "add"), (1, "load"), (2, "size"), (3, "outer"), (3, "inner"), (3, "helper"), (9, "tabs")}
    assert {r.extra == r.doc_id % 2 for r in rows.values()} == {True}
    add, load, size = rows[0, "add"], rows[1, "load"], rows[2, "size"]
    assert (add.params, add.annotations, add.returns, add.complexity, add.calls, add.docstring) == (["a", "b"], {"b": "int"}, "int", 1, [], None)
    assert (load.is_async, load.is_method, load.params, load.complexity, sorted(load.calls), load.doc) == (True, False, ["url", "tries"], 4, ["fetch", "range"], "Loads it.")
    assert (size.is_method, size.decorators, size.start_line, size.end_line, size.calls) == (True, ["property"], 3, 10, ["len"])
    assert size.doc == "How big.\n\n:param unit: cm\n:rtype: float" and size.docstring.startswith("\n        How big.")
    assert rows[3, "inner"].source == "    def inner(y):\n        return helper(y)" and sorted(rows[3, "outer"].calls) == ["helper", "inner"]
    assert rows[1, "load"].refs == ["fetch", "k", "range"] and rows[9, "tabs"].source == "def tabs():\n\tx = 1\n\treturn x"


def test_call_edges(found):
    assert {(r.doc_id, r.caller, r.callee) for r in extract.call_edges(found).collect()} == {
        (3, "outer", "inner"), (3, "outer", "helper"), (3, "inner", "helper"), (3, "helper", "outer")}


def test_function_pairs(found):
    rows = {(r.doc_id, r.name): (r.prompt, r.completion) for r in extract.function_pairs(found).collect()}
    assert rows[0, "add"] == ("def add(a, b: int = 2) -> int:", "return a + b")
    assert rows[3, "inner"] == ("    def inner(y):", "return helper(y)")
    assert rows[9, "tabs"] == ("def tabs():", "x = 1\nreturn x")
    assert {r.prompt for r in extract.function_pairs(found.where("doc_id = 0"), signature=False).collect()} == {"# Implement function 'add'"}


def test_documented(spark):
    docs = spark.createDataFrame(list(enumerate(CODE)), "doc_id long, text string")
    rows = {(r.doc_id, r.name, r.doc, tuple(r.params), r.returns, r.line, r.head) for r in extract.documented(docs).withColumn("head", extract.signature()).collect()}
    assert rows == {
        (1, "load", "Loads it.", ("url",), None, 1, "def load(url):"),
        (2, "size", "How big.\n\n:param unit: cm\n:rtype: float", ("unit",), "'int'", 3, "def size(unit) -> 'int':"),
        (8, "bad", "Says so.", ("a", "b=1"), "Dict[str, int]", None, "def bad(a, b=1) -> Dict[str, int]:"),
    }


def test_commented(spark):
    code = "/** Adds.\n * @param {number} a one\n * @returns {number} sum */\nexport const add = (a: number, b) => a + b\n/** @internal */\nfunction no() {}\n/** Runs */ async run() {\n}\n/** Far */" + " " * 40 + "x; function far() {}\n/** open"
    docs = spark.createDataFrame([(1, code), (2, ""), (3, None), (4, "/** alone */")], "doc_id long, text string")
    rows = {(r.doc_id, r.name, r.doc, tuple(r.params), r.returns, r.line) for r in extract.commented(docs).collect()}
    assert rows == {(1, "add", "Adds.", ("a", "b"), "number", 1), (1, "run", "Runs", (), None, 7)}


def test_long_and_empty(spark):
    many = "\n".join(f"def f{k}(x):\n    return f{k + 1}(x)" for k in range(3000))
    deep = "def f():\n    return " + "(" * 5000 + ")" * 5000
    docs = spark.createDataFrame([(1, many), (2, deep), (2, many)], "doc_id long, text string")
    assert {(r.doc_id, r["count"]) for r in extract.functions(docs).groupBy("doc_id").count().collect()} == {(1, 3000), (2, 3000)}
    assert extract.call_edges(extract.functions(docs)).count() == 2 * 2999
    empty = docs.limit(0)
    assert not extract.functions(empty).count() and not extract.documented(empty).count() and not extract.commented(empty).count()


def test_dedent(spark):
    rows = spark.createDataFrame([(["    a", "", "      b", "   "],), (["\ta", " b"],), ([" "],), ([],)], "x array<string>")
    assert [r.y for r in rows.select(extract.dedented(F.col("x")).alias("y")).collect()] == [["a", "", "  b", ""], ["\ta", " b"], [""], []]
