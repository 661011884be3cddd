"""Syntax-tree patterns of small sources, counted by hand."""

from __future__ import annotations

import ast
import math

from corpusmill.operators import patterns

CODE = [
    "def f(a, b, *c):\n    return [x for x in a]\n",
    "x = [y for y in z]; w = [y for y in z]\n",
    "def broken(:\n", "", None,
    "async def g(q={}) -> int:\n    try:\n        await q\n    except:\n        pass\n",
]


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_frequencies_by_hand(spark):
    rows = {(r.kind, r.signature): (r.n, r.texts, r.examples) for r in patterns.frequencies(docs(spark, CODE)).where("kind <> 'subtree'").collect()}
    assert rows == {
        ("total", "texts"): (3, 3, []), ("total", "nodes"): (sum(len(list(ast.walk(ast.parse(CODE[k])))) for k in (0, 1, 5)), 3, []),
        ("construct", "def(3_args)"): (1, 1, ["def f(a, b, *c):"]), ("construct", "async:def(1_args):->annot"): (1, 1, ["async def g(q={}) -> int:"]),
        ("idiom", "list_comprehension"): (3, 2, ["return [x for x in a]", "x = [y for y in z]; w = [y for y in z]", "x = [y for y in z]; w = [y for y in z]"]),
        ("idiom", "await"): (1, 1, ["await q"]), ("anti_pattern", "mutable_default_arg"): (1, 1, ["async def g(q={}) -> int:"]), ("anti_pattern", "bare_except"): (1, 1, ["except:"]),
    }


def test_subtrees(spark):
    tree = ast.parse("f(1)")
    assert patterns.subtree(tree, 0) == "Module" and patterns.subtree(tree, 1) == "Module>Expr" and patterns.subtree(tree, 3) == "Module>(Expr>(Call>Name>Constant))"
    rows = {r.signature: r.n for r in patterns.mined(docs(spark, ["f(1)"]), levels=2).where("kind = 'subtree'").collect()}
    assert rows["Expr>(Call>Name>Constant)"] == 1 and rows["Call>(Name>Load)>Constant"] == 1 and rows["Load"] == 1
    assert not patterns.frequencies(docs(spark, CODE).limit(0)).count()


def test_comparison(spark):
    a, b = docs(spark, ["lambda: 1", "lambda: 2"]), docs(spark, ["lambda: [x for x in y]", "[x for x in y]"])
    rows = {r.signature: (r.a, r.b, r.delta, r.log_ratio) for r in patterns.comparison(a, b).where("kind = 'idiom'").collect()}
    assert rows.keys() == {"lambda", "list_comprehension"} and rows["lambda"][:3] == (2, 1, -1) and rows["list_comprehension"][:3] == (0, 2, 2)
    assert math.isclose(rows["lambda"][3], math.log2((2 / 5) / (3 / 4))) and math.isclose(rows["list_comprehension"][3], math.log2((3 / 5) / (1 / 4)))
    plain = {r.signature: r.log_ratio for r in patterns.comparison(a, b, smoothing=0.0).where("kind = 'idiom'").collect()}
    assert plain["list_comprehension"] is None and math.isclose(plain["lambda"], math.log2(1 / 3))


def test_a_pattern_in_many_texts(spark):
    many = docs(spark, [f"a{k} = lambda: {k}" for k in range(2000)])
    row = patterns.frequencies(many).where("signature = 'lambda'").first()
    assert (row.n, row.texts, row.examples) == (2000, 2000, ["a0 = lambda: 0", "a1 = lambda: 1", "a2 = lambda: 2"])
