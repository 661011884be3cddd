"""Rewritten code parses, means the same where it must, and differs in one place where it must not."""

from __future__ import annotations

import ast

import pytest

from corpusmill.catalogue import editing
from corpusmill.operators import rewrite

SOURCE = '''#!/usr/bin/env python
"""total in a docstring"""
from __future__ import annotations
import sys
import os

# whole line: total
LIMIT = 10  # trailing


def add(values, start=0):
    """total stays here."""
    total = start  # total é
    shown = "total"
    for value in values:
        if value > 3 and value != LIMIT:
            total = total + value
    print(f"{total} é {shown}")
    inner = [value * total for value in values]
    return total


@sys.intern
def keeps(a, b):
    global LIMIT
    LIMIT = a
    try:
        é = a; c = é + 2
    except ValueError as error:
        raise error
    def nested():
        return c
    flag = True
    return nested() or flag
'''


def rows(text=SOURCE, key="1:42"):
    return {r["strategy"]: r for r in rewrite.variants(text, key)}


def test_renaming_back_gives_the_text():
    r = rows()["variable_rename"]
    assert r["changed"]
    code = r["code"]
    renames = dict(x.split(">") for x in r["note"].split(","))
    # total is read by a comprehension, value belongs to one, c to a nested function, error to a handler, LIMIT is global
    assert set(renames) == {"shown", "inner", "é", "flag"} and all(new not in SOURCE for new in renames.values())
    for old, new in renames.items():
        code = code.replace(new, old)
    assert code == SOURCE


def test_variants_mean_the_same():
    plain = ast.dump(ast.parse(SOURCE))
    found = rows()
    assert set(found) == set(rewrite.STRATEGIES) and all(r["changed"] for r in found.values())
    for name in ("comment_remove", "comment_add", "whitespace_vary"):
        assert ast.dump(ast.parse(found[name]["code"])) == plain and found[name]["code"] != SOURCE
    bare = found["comment_remove"]["code"]
    assert bare.startswith("#!") and "trailing" not in bare and "whole line" not in bare and "total é\n" not in bare and '"total"' in bare
    assert found["import_reorder"]["code"].index("import os") < found["import_reorder"]["code"].index("import sys")
    dead = ast.parse(found["dead_code_insert"]["code"])
    assert sum(isinstance(x, ast.If) for x in ast.walk(dead)) == 1 + sum(isinstance(x, ast.If) for x in ast.walk(ast.parse(SOURCE)))


def test_every_key_gives_code_that_parses():
    texts = set()
    for k in range(200):
        for r in rewrite.variants(SOURCE, f"{k}:1") + rewrite.bugs(SOURCE, f"{k}:1"):
            ast.parse(r["code"])
            texts.add(r["code"])
    assert len(texts) > 150 and rewrite.variants(SOURCE, "3:1") == rewrite.variants(SOURCE, "3:1")


def test_bugs_change_one_line():
    for k in range(100):
        found = rewrite.bugs(SOURCE, f"{k}:7")
        assert [r["bug"] for r in found] == list(rewrite.BUGS)
        for r in found:
            old, new = SOURCE.split("\n"), r["code"].split("\n")
            assert [i + 1 for i, (x, y) in enumerate(zip(old, new, strict=True)) if x != y] == [r["line"]]
            assert (old[r["line"] - 1], new[r["line"] - 1]) == (r["original"], r["modified"])
            assert "total é" not in r["note"] and ast.dump(ast.parse(r["code"])) != ast.dump(ast.parse(SOURCE))


@pytest.mark.parametrize("text", [None, "", "def f(", "\x00", "x = " + "(" * 500])
def test_what_does_not_parse_gives_nothing(text):
    assert rewrite.variants(text, "1:1") == [] and rewrite.bugs(text, "1:1") == []


def test_captures_are_refused():
    text = "def f(p):\n    x = p\n    y = locals()\n    return x, y\n\ndef g(p):\n    x = p\n    x_ = (lambda: x)()\n    match p:\n        case [z, *w]:\n            q = z\n    del q\n    return x_\n"
    note = rows(text)["variable_rename"]["note"]
    assert {x.split(">")[0] for x in note.split(",")} == {"q", "x_"}
    assert {x.split(">")[0] for x in rows("def f():\n    x = y = 1\n    return f'{x = }{y}'\n")["variable_rename"]["note"].split(",")} == {"y"}
    assert rows("import b\r\nimport a\r\nx = 1\r\n")["import_reorder"]["code"] == "import a\r\nimport b\r\nx = 1\r\n"
    assert not rows("import b as q\nimport q\n")["import_reorder"]["changed"]
    assert all(not r["changed"] for r in rewrite.variants("x", "1:1"))


def test_rows(spark):
    docs = spark.createDataFrame([(1, SOURCE, "a"), (1, SOURCE, "a"), (None, "x = 1", "b"), (2, "def f(", "c"), (3, None, "d"), (4, "", "e")], "doc_id int, text string, bug_of string")
    got = rewrite.augmented(docs, seed=7).collect()
    assert len(got) == 18 and {r["bug_of"] for r in got} == {"a", "b"}
    assert {r["code"] for r in got if r["doc_id"] == 1} == {r["code"] for r in rewrite.variants(SOURCE, "1:7")}
    found = rewrite.with_bugs(docs, seed=7).collect()
    assert sorted(r["bug"] for r in found if r["bug_of"] == "b") == ["off_by_one", "type_error"]
    assert rewrite.with_bugs(docs.limit(0)).count() == 0


def test_plain_texts_are_parsed_once(monkeypatch):
    text = "import sys\nimport os\n# two\ndef f(amount):\n    total = amount + 3  # three\n    if total < 10:\n        return total\n    return amount\n"
    want = rewrite.variants(text, "1:42"), rewrite.bugs(text, "1:42")
    assert all(v["changed"] for v in want[0]) and len(want[1]) == len(rewrite.BUGS)
    assert all(rewrite.parses(r["code"]) for rows in want for r in rows)
    monkeypatch.setattr(rewrite, "parses", lambda code: pytest.fail("parsed again"))
    assert (rewrite.variants(text, "1:42"), rewrite.bugs(text, "1:42")) == want


@pytest.mark.parametrize("text", [
    "x = 1 + \\\n    2\n# c\ny = x\n", "if True:\n    x = 1 \\\n# c\n    y = 2\n", "x = 0x1for 2\ny = 8or x\n", "def f(x):\n    match x:\n        case -1:\n            return 1\n        case 2 + 3j:\n            return 2\n",
    "def f(x):\n    y = x\n    return f'{y!r:>{3}} {y=}'\n", "def f(x):\n    y = 1if x else(2)\n    return y and(x)\n", "def f(ñ):\n    é = ñ+1  # ü\n    return é\n", "x = 1\n\x0c\n# c\ny = 2\r\nz = 3\r\n",
])
def test_what_is_returned_parses(text):
    for key in range(20):
        rows = [*rewrite.variants(text, f"{key}:42"), *rewrite.bugs(text, f"{key}:42")]
        assert rows or not rewrite.parses(text)
        assert all(rewrite.parses(r["code"]) for r in rows)


def test_keys_are_dealt_before_the_code_is_filled_in(spark):
    plan = editing._functions(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert [k for k, line in enumerate(plan) if "def order_" in line][-1] < next(k for k, line in enumerate(plan) if "Repartition" in line)
