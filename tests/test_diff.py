"""Line diffs against slow versions and the standard library; contrastive pairs by hand."""

from __future__ import annotations

import difflib
import random
from functools import lru_cache

from pyspark.sql import functions as F

from corpusmill.functions.order import following
from corpusmill.operators import contrast, diff


def longest(a, b) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for k, y in enumerate(b):
            new.append(row[k] + 1 if x == y else max(new[k], row[k + 1]))
        row = new
    return row[-1]


def test_scripts_are_shortest():
    rnd = random.Random(5)
    for size, letters in ((0, 1), (1, 2), (7, 2), (40, 3), (150, 30), (300, 5)):
        for _ in range(12):
            a, b = ([rnd.randrange(letters) for _ in range(rnd.randrange(size + 1))] for _ in range(2))
            script = diff.runs(a, b)
            at, to, out = 0, 0, []
            for op, i, n, k, m in script:
                assert (i, k) == (at, to) and (op == "equal") == (a[i : i + n] == b[k : k + m])
                assert {"equal": n == m > 0, "replace": n > 0 < m, "delete": n > 0 == m, "insert": m > 0 == n}[op]
                out += a[i : i + n] if op == "equal" else b[k : k + m]
                at, to = i + n, k + m
            assert (at, to) == (len(a), len(b)) and out == b
            assert sum(n for op, _, n, _, _ in script if op == "equal") == longest(a, b)
            assert all(x[0] != y[0] and "equal" in (x[0], y[0]) for x, y in zip(script, script[1:], strict=False))


def test_long_texts_in_memory_linear_in_their_lines():
    rnd = random.Random(1)
    a = [rnd.randrange(10**9) for _ in range(20_000)]
    b = a[5_000:] + a[:5_000]
    assert sum(n for op, _, n, _, _ in diff.runs(a, b) if op == "equal") == 15_000


def _apply(a: list[str], hunks) -> list[str]:
    out, at = [], 0
    for h in hunks:
        lines = h["text"].split("\n")[1:]
        out += a[at : h["a"]]
        assert [x[1:] for x in lines if x[0] in " -"] == a[h["a"] : h["a"] + h["n"]]
        out += [x[1:] for x in lines if x[0] in " +"]
        at = h["a"] + h["n"]
    return out + a[at:]


def test_hunks_and_unified(spark):
    rnd = random.Random(9)
    rows = [(0, None, None), (1, "", "x"), (2, "x\ny", ""), (3, "same\n", "same\n"), (4, "a\r\nb", "a\nb\n"), (5, "x", "y")]
    for k in range(6, 60):
        a = [f"line {i}" for i in range(rnd.randrange(40))]
        b = []
        for x in a:
            p = rnd.random()
            b += [] if p < 0.1 else [x + "!"] if p < 0.2 else [x, f"new {p}"] if p < 0.25 else [x]
        rows.append((k, "\n".join(a), "\n".join(b)))
    pairs = spark.createDataFrame(rows, "id int, a string, b string")
    for context in (0, 1, 3):
        unified = {r["id"]: r["diff"] for r in diff.with_unified(pairs, "a", "b", context).collect()}
        hunks = {}
        for r in diff.hunks(pairs, "a", "b", context).orderBy("id", "hunk").collect():
            hunks.setdefault(r["id"], []).append(r)
        for k, a, b in rows:
            x, y = (a or "").splitlines(), (b or "").splitlines()
            # all lines of a text differ here, so there is one shortest script and the standard library finds it too
            assert unified[k] == "\n".join(difflib.unified_diff(x, y, "original", "modified", n=context, lineterm="")), (k, context)
            assert _apply(x, hunks.get(k, [])) == y
    side = diff.aligned(pairs, "a", "b").collect()
    for k, a, b in rows:
        own = sorted((r for r in side if r["id"] == k), key=lambda r: r["place"])
        assert [r["a_text"] for r in own if r["a_line"]] == (a or "").splitlines() and [r["b_text"] for r in own if r["b_line"]] == (b or "").splitlines()


def test_stats_and_edits(spark):
    rows = [(1, "a\nb\nc\nd", "a\nB\nC\nX\nd\ne"), (2, None, ""), (3, "a\nb", "b"), (1, "a\nb\nc\nd", "a\nB\nC\nX\nd\ne")]
    got = sorted(tuple(r) for r in diff.stats(spark.createDataFrame(rows, "id int, a string, b string"), "a", "b").collect())
    assert got == [(1, 1, 0, 3, 2, 4 / 6)] * 2 + [(2, 0, 0, 0, 0, 0.0), (3, 0, 1, 0, 1, 0.5)]
    assert diff.stats(spark.createDataFrame([], "id int, a string, b string"), "a", "b").count() == 0
    one = spark.createDataFrame([("a\nb\nc", "x\ny")], "t string, r string")
    edit = lambda f, n: one.select(diff.edited(F.col("t"), F.lit(f), F.lit(n), F.col("r"))).first()[0]
    assert edit(2, 2) == "a\nx\ny\nc" and edit(1, 3) == "x\ny" and edit(3, 9) == "a\nb\nx\ny"


def test_contrastive_pairs(spark):
    rows = [(1, "a = b", 0), (2, "a = b", 0), (3, "é  x", 0), (4, "p =  q\n  r", 0), (5, "plain", 0), (6, None, 0), (7, "", 0), (None, "a = b", 0), (1, "a = b", 0)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, h int")
    got = contrast.contrastive_pairs(docs).collect()
    same = {r["a_id"]: r["b"] for r in got if r["same"]}
    assert same == {1: "x = y", 3: "é  u", 4: "p=q\n  r", 5: "plain\n", 7: "\n"} and all(r["a_id"] == r["b_id"] for r in got if r["same"])
    ring = {r["a_id"]: r["b_id"] for r in got if not r["same"]}
    seen, at = [], 1
    for _ in ring:
        seen.append(at)
        at = ring[at]
    assert at == 1 and sorted(seen) == [1, 3, 4, 5, 7] and all(r["a"] != r["b"] for r in got)
    assert [r["same"] for r in contrast.contrastive_pairs(docs.where("doc_id <= 2")).collect()] == [True]
    assert contrast.contrastive_pairs(docs.where("doc_id = 6")).count() == 0


def test_following_meets_at_the_ends_of_ranges(spark):
    rows = spark.range(1000).repartition(7)
    got = {r["id"]: r["next"] for r in following(rows, F.col("id") % 10, [F.col("id")], F.col("id"), "next").collect()}
    order = sorted(range(1000), key=lambda k: (k % 10, k))
    assert got == dict(zip(order, [*order[1:], order[0]], strict=True))


def test_near_copy_diff_is_shortest(spark):
    from corpusmill.catalogue import editing
    from corpusmill.session import table

    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"].splitlines() for r in table(spark, sf, "documents").where("text IS NOT NULL").collect()}

    @lru_cache
    def kept(a, b):
        return longest(texts[a], texts[b])

    found = editing.q_near_copy_diff(spark, sf).collect()
    assert found and all(r["unchanged"] == kept(r["first_id"], r["doc_id"]) for r in found)
