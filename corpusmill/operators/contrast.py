"""Pairs of texts for contrastive training: a text with a rewritten form of itself, and with another text.

The other text is the next one in a fixed shuffled order of all different texts, so that each stands in two pairs as the other does.
Copies count once, before anything is ordered; only hashes are ordered, and texts move by their hash. Neighbours at
the ends of ranges meet without a partition that holds all rows (functions.order.following).

Defined cases: null texts give no pairs, an empty text is a text like any other; of equal texts the smallest id names all (null if all are
null); a single text has no other one and gives no negative pair; ids may repeat; other columns of docs are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.order import following, hash32
from corpusmill.functions.text import let, lines_nl
from corpusmill.session import written

# Names and what they become. All are replaced at once, so no name passes through two of them.
NAMES = {
    "a": "x", "b": "y", "c": "z", "x": "u", "y": "v", "z": "w", "i": "idx", "j": "jdx", "k": "kdx",
    "n": "num", "m": "cnt", "result": "out", "val": "value", "tmp": "temp", "ret": "retval",
}
WORD = r"[\p{L}\p{N}_]+"


def renamed(text: Column, names: dict[str, str] = NAMES) -> Column:
    """text with whole words replaced by the table."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    words = F.regexp_extract_all(text, F.lit(rf"{WORD}|[^\p{{L}}\p{{N}}_]+"), 0)
    return F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(table, w), w)), "")


def reformatted(text: Column) -> Column:
    """text with lines as they were indented, one space where there were more, and none around the operators + - * / = , and the colon."""

    def line(x: Column) -> Column:
        indent = F.regexp_extract(x, r"^[ \t]*", 0)
        tight = lambda rest: F.regexp_replace(F.regexp_replace(rest, r" {2,}", " "), r"[ \t]*([+\-*/=,:])[ \t]*", "$1")
        return let(indent, lambda i: F.concat(i, tight(F.substr(x, F.length(i) + 1))))

    return F.array_join(F.transform(lines_nl(text), line), "\n")


def positive(text: Column) -> Column:
    """text with other names; if it has none of them, in another format; if that leaves it as it is, with one line end at its end."""
    plain = lambda t: F.concat(F.regexp_replace(t, r"\n+\z", ""), F.lit("\n"))
    return let(text, lambda t: let(renamed(t), lambda r: F.when(r != t, r).otherwise(let(reformatted(t), lambda f: F.when(f != t, f).otherwise(plain(t))))))


def contrastive_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42) -> DataFrame:
    """same (true for a text and its rewritten form), a_id, b_id, a, b: one pair of each kind for each different text."""
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.sha2(text_col, 256).alias("h"))
    classes = rows.groupBy("h").agg(F.min("id").alias("id"))
    chosen = classes.withColumnRenamed("h", "_h").withColumnRenamed("id", "_id")
    # ids may repeat with their text; each text is written once
    texts = written(rows.join(chosen, (F.col("h") == F.col("_h")) & F.col("id").eqNullSafe(F.col("_id")), "left_semi").dropDuplicates(["h"]))
    order = following(texts.select("h"), hash32(F.col("h"), F.lit(seed)), [F.col("h")], F.col("h"), "other").where("h <> other")
    same = texts.select(F.lit(True).alias("same"), F.col("id").alias("a_id"), F.col("id").alias("b_id"), F.col("text").alias("a"), positive(F.col("text")).alias("b"))
    second = texts.select(F.col("h").alias("other"), F.col("id").alias("b_id"), F.col("text").alias("b"))
    first = texts.select("h", F.col("id").alias("a_id"), F.col("text").alias("a"))
    return same.unionByName(first.join(order, "h").join(second, "other").select(F.lit(False).alias("same"), "a_id", "b_id", "a", "b"))
