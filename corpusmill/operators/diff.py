"""Line diffs: a shortest edit script for each pair of texts, its figures, hunks, unified text and lines side by side.

Lines are split and hashed by Spark; Python sees two arrays of 64-bit hashes for a pair and returns the script as runs of lines, from which
everything else is cut out of the lines again by expressions. The script keeps a longest common subsequence of lines, found by halving one side (memory
linear in the lines) over rows of bits (time: lines of one side times 64-bit words of the other), after common ends and lines
that only one side has are set aside.

Defined cases: a null text counts as empty, an empty text has no lines, two equal texts give one run or none; of several shortest scripts
the halving fixes one; texts may have any length; repeated rows give repeated results; other columns are carried through.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from corpusmill.functions.text import let, lines_univ, text_or_empty

SCRIPT = "array<struct<op:string,a:int,n:int,b:int,m:int>>"
#: Masks of lines that stand in at least one of so many places are kept, so that all kept ones together are linear in the lines.
COMMON = 256


def _gains(a: Sequence[int], b: Sequence[int]) -> np.ndarray:
    """For each prefix of a, from the empty one, the length of its longest common subsequence with b."""
    width = len(a)
    places: dict[int, list[int]] = {}
    for k, x in enumerate(a):
        places.setdefault(x, []).append(k)
    kept: dict[int, int] = {}

    def mask(x: int) -> int:
        found = kept.get(x)
        if found is None:
            bits = bytearray(width // 8 + 1)
            for k in places[x]:
                bits[k >> 3] |= 1 << (k & 7)
            found = int.from_bytes(bits, "little")
            if len(places[x]) * COMMON >= width:
                kept[x] = found
        return found

    full = (1 << width) - 1
    row = full
    for x in b:
        if x in places:
            hit = row & mask(x)
            row = ((row + hit) | (row - hit)) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes(width // 8 + 1, "little"), np.uint8), count=width, bitorder="little")
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def matches(a: Sequence[int], b: Sequence[int]) -> list[tuple[int, int]]:
    """The places of a longest common subsequence, ascending."""
    out = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        if i == j or k == m:
            continue
        if m - k == 1:
            out.extend((p, k) for p in [next((p for p in range(i, j) if a[p] == b[k]), None)] if p is not None)
            continue
        half = (k + m) // 2
        both = _gains(a[i:j], b[k:half]) + _gains(a[i:j][::-1], b[half:m][::-1])[::-1]
        cut = i + int(np.argmax(both))
        todo += [(i, cut, k, half), (cut, j, half, m)]
    return sorted(out)


def runs(a: Sequence[int], b: Sequence[int]) -> list[tuple[str, int, int, int, int]]:
    """The script: what happens to n lines from a (from 0), and the m lines from b that stand there afterwards."""
    ours, theirs = set(a), set(b)
    left, right = [k for k, x in enumerate(a) if x in theirs], [k for k, x in enumerate(b) if x in ours]
    pairs = [(left[i], right[k]) for i, k in matches([a[k] for k in left], [b[k] for k in right])]
    out: list[tuple[str, int, int, int, int]] = []
    i = k = same = 0
    for p, q in [*pairs, (len(a), len(b))]:
        if p > i or q > k:
            if same:
                out.append(("equal", i - same, same, k - same, same))
            out.append(("replace" if p > i and q > k else "delete" if p > i else "insert", i, p - i, k, q - k))
            same = 0
        i, k, same = p + 1, q + 1, same + 1
    if same > 1:
        out.append(("equal", len(a) - same + 1, same - 1, len(b) - same + 1, same - 1))
    return out


def _script(a: pd.Series, b: pd.Series) -> pd.Series:
    of = lambda run: dict(zip(("op", "a", "n", "b", "m"), run, strict=True))
    return pd.Series([[of(r) for r in runs(x.tolist(), y.tolist())] for x, y in zip(a, b, strict=True)], dtype=object)


def text_lines(text: Column) -> Column:
    """A text's lines, none for an empty one."""
    return let(text_or_empty(text), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(lines_univ(t)))


def with_script(pairs: DataFrame, a: str, b: str, name: str = "script") -> DataFrame:
    """pairs with the runs of lines that turn text a into text b: op (equal, delete, insert, replace), a, n, b, m."""
    hashes = lambda c: F.transform(text_lines(F.col(c)), lambda x: F.xxhash64(x))
    return pairs.withColumn(name, pandas_udf(_script, SCRIPT)(hashes(a), hashes(b)))


def _sum(script: Column, op: str, amount) -> Column:
    return F.aggregate(script, F.lit(0), lambda s, r: s + F.when(r["op"] == op, amount(r)).otherwise(0))


def stats(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """pairs without the texts, with additions, deletions, modifications (the longer side of a replaced run), unchanged, change_ratio (of all four)."""
    s = F.col("_script")
    counts = {"additions": _sum(s, "insert", lambda r: r["m"]), "deletions": _sum(s, "delete", lambda r: r["n"]),
              "modifications": _sum(s, "replace", lambda r: F.greatest(r["n"], r["m"])), "unchanged": _sum(s, "equal", lambda r: r["n"])}
    changed = F.col("additions") + F.col("deletions") + F.col("modifications")
    out = with_script(pairs, a, b, "_script").drop(a, b).withColumns(counts).drop("_script")
    return out.withColumn("change_ratio", F.coalesce(F.try_divide(changed, changed + F.col("unchanged")), F.lit(0.0)))


def _pieces(script: Column, context: int) -> Column:
    """Runs as hunks show them: equal ones cut to the context at their ends; `opens` marks where a hunk begins."""

    def piece(opens, r: Column, skip, n, m) -> Column:
        return F.struct(F.lit(opens).alias("opens"), r["op"].alias("op"), (r["a"] + skip).alias("a"), n.alias("n"), (r["b"] + skip).alias("b"), m.alias("m"))

    def of(r: Column, k: Column) -> Column:
        first, last = k == 0, k == F.size(script) - 1
        head, tail = F.least(r["n"], F.lit(context)), F.least(r["n"], F.lit(context))
        cut = r["n"] - tail
        equal = (F.when(first & last, F.array().cast("array<struct<opens:boolean,op:string,a:int,n:int,b:int,m:int>>"))
                 .when(first, F.array(piece(True, r, cut, tail, tail))).when(last, F.array(piece(False, r, F.lit(0), head, head)))
                 .when(r["n"] > 2 * context, F.array(piece(False, r, F.lit(0), head, head), piece(True, r, cut, tail, tail)))
                 .otherwise(F.array(piece(False, r, F.lit(0), r["n"], r["m"]))))
        changed = F.array(piece(False, r, F.lit(0), r["n"], r["m"]))
        return F.when(r["op"] == "equal", equal).otherwise(changed)

    return F.flatten(F.transform(script, of))


def _span(start: Column, n: Column) -> Column:
    """A range of lines as unified diffs write it: from 1, without a length of one; an empty one names the line before."""
    return F.when(n == 1, (start + 1).cast("string")).when(n == 0, F.concat(start.cast("string"), F.lit(",0"))).otherwise(F.concat((start + 1).cast("string"), F.lit(","), n.cast("string")))


def _hunks(script: Column, ours: Column, theirs: Column, context: int) -> Column:
    marked = lambda mark, lines, start, n: F.transform(F.slice(lines, start + 1, n), lambda x: F.concat(F.lit(mark), x))

    def hunk(parts: Column) -> Column:
        lines = F.flatten(F.transform(parts, lambda p: F.when(p["op"] == "equal", marked(" ", ours, p["a"], p["n"])).otherwise(
            F.concat(marked("-", ours, p["a"], p["n"]), marked("+", theirs, p["b"], p["m"])))))
        total = lambda f: F.aggregate(parts, F.lit(0), lambda s, p: s + p[f])
        start = lambda f: parts[0][f]
        return let(F.struct(total("n").alias("n"), total("m").alias("m")), lambda z: F.struct(
            start("a").alias("a"), z["n"].alias("n"), start("b").alias("b"), z["m"].alias("m"),
            F.concat(F.lit("@@ -"), _span(start("a"), z["n"]), F.lit(" +"), _span(start("b"), z["m"]), F.lit(" @@\n"), F.array_join(lines, "\n")).alias("text")))

    def cut(parts: Column) -> Column:
        starts = F.filter(F.transform(parts, lambda p, k: F.when((k == 0) | p["opens"], k + 1)), lambda k: k.isNotNull())
        ends = lambda s: F.transform(s, lambda x, k: F.struct(x.alias("first"), F.coalesce(F.get(s, k + 1), F.size(parts) + 1).alias("end")))
        return F.transform(let(starts, ends), lambda e: hunk(F.slice(parts, e["first"], e["end"] - e["first"])))

    return let(_pieces(script, context), cut)


def _with_lines(pairs: DataFrame, a: str, b: str, body) -> Column:
    return let(F.struct(text_lines(F.col(a)).alias("a"), text_lines(F.col(b)).alias("b")), lambda t: body(F.col("_script"), t["a"], t["b"]))


def hunks(pairs: DataFrame, a: str, b: str, context: int = 3) -> DataFrame:
    """pairs without the texts, a row for each hunk: hunk (from 0), a, n, b, m (its lines on both sides), text with its header; no row for equal texts."""
    out = with_script(pairs, a, b, "_script").withColumn("_hunks", _with_lines(pairs, a, b, lambda s, x, y: _hunks(s, x, y, context)))
    kept = [c for c in pairs.columns if c not in (a, b)]
    # outer, as a plain one would have Spark make each script once more for a filter on empty arrays
    return out.select(*kept, F.posexplode_outer("_hunks").alias("hunk", "_h")).where("hunk IS NOT NULL").select(*kept, "hunk", "_h.*")


def with_unified(pairs: DataFrame, a: str, b: str, context: int = 3, labels: tuple[str, str] = ("original", "modified"), name: str = "diff") -> DataFrame:
    """pairs with their unified diff, empty for equal texts."""
    out = with_script(pairs, a, b, "_script").withColumn("_hunks", _with_lines(pairs, a, b, lambda s, x, y: F.transform(_hunks(s, x, y, context), lambda h: h["text"])))
    head = F.lit(f"--- {labels[0]}\n+++ {labels[1]}\n")
    return out.withColumn(name, F.when(F.size("_hunks") == 0, "").otherwise(F.concat(head, F.array_join("_hunks", "\n")))).drop("_script", "_hunks")


def aligned(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """pairs without the texts, a row for each line of the texts side by side: place, mark (equal, delete, insert, replace), a_line, a_text, b_line, b_text."""

    def rows(s: Column, x: Column, y: Column) -> Column:
        def line(r: Column, k: Column) -> Column:
            has_a, has_b = k < r["n"], k < r["m"]
            mark = F.when(has_a & has_b, r["op"]).when(has_a, "delete").otherwise("insert")
            at = lambda has, start: F.when(has, start + k + 1)
            return F.struct(mark.alias("mark"), at(has_a, r["a"]).alias("a_line"), F.when(has_a, F.get(x, r["a"] + k)).alias("a_text"),
                            at(has_b, r["b"]).alias("b_line"), F.when(has_b, F.get(y, r["b"] + k)).alias("b_text"))

        return F.flatten(F.transform(s, lambda r: F.transform(F.sequence(F.lit(0), F.greatest(r["n"], r["m"]) - 1), lambda k: line(r, k))))

    kept = [c for c in pairs.columns if c not in (a, b)]
    out = with_script(pairs, a, b, "_script").withColumn("_rows", _with_lines(pairs, a, b, rows))
    return out.select(*kept, F.posexplode_outer("_rows").alias("place", "_r")).where("place IS NOT NULL").select(*kept, "place", "_r.*")


def edited(text: Column, first: Column, last: Column, replacement: Column) -> Column:
    """text with its lines first to last (from 1, both included) replaced."""
    return let(text_lines(text), lambda x: F.array_join(F.concat(F.slice(x, F.lit(1), first - 1), text_lines(replacement), F.slice(x, last + 1, F.greatest(F.size(x) - last, F.lit(0)))), "\n"))
