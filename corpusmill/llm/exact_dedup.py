"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash.

One pass over the texts leaves a narrow table of fingerprints; every grouping and join afterwards
moves only those few bytes a row. Whole texts are hashed only where length and prefix hash are shared. A group of
copies of any size is pre-aggregated before its shuffle. The surviving lengths and prefixes are broadcast when a count shows
them to be few; else adaptive execution can split the join. Decisions hold for a doc_id and its text, never for a doc_id alone.

Defined cases: a null text counts as empty; an empty table gives an empty result; texts that
differ in any code point differ, however long; of rows that repeat a doc_id with different texts each is judged by its own
text; rows that repeat both share their fate in exact_dedup, and drop_copies leaves one of them; a null doc_id is never preferred to
another. Other columns are ignored, and drop_copies returns them as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import plain_names, small_side, written

#: Code points of the text that the second level hashes.
PREFIX_CHARS = 64


BY = ["_len", "_pre", "_sha"]


def _short_keys(id_col: str, text_col: str, prefix_chars: int) -> list[Column]:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return [F.col(id_col).alias("doc_id"), F.octet_length(text).alias("_len"), F.xxhash64(F.substring(text, 1, prefix_chars)).alias("_pre")]


def _sha(text_col: str) -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))


def _survivors(rows: DataFrame) -> DataFrame:
    """_len, _pre that several rows share; a row of a length of its own isn't counted by prefix."""
    lengths = written(rows.groupBy("_len").agg(F.count("*").alias("n")).where("n > 1").select("_len"))
    first = rows.join(small_side(lengths), "_len", "left_semi")
    return small_side(written(first.groupBy("_len", "_pre").agg(F.count("*").alias("n")).where("n > 1").select("_len", "_pre")))


def _groups(hashed: DataFrame) -> DataFrame:
    """BY, keep_id, n, c (how many rows have keep_id) of texts that several rows have."""
    by_id = hashed.groupBy(*BY, "doc_id").agg(F.count("*").alias("c"))
    found = by_id.groupBy(*BY).agg(F.max(F.struct("doc_id", "c")).alias("x"), F.sum("c").alias("n")).where("n > 1")
    return small_side(written(found.select(*BY, F.col("x.doc_id").alias("keep_id"), "n", "x.c")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS, digests: bool = False) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept (and text_sha256 if digests).

    With digests the caller wants every text's hash anyway, so the only pass over the texts also
    takes it; without, a second pass reads and hashes the texts of surviving groups alone.
    """
    keys = _short_keys(id_col, text_col, prefix_chars)
    rows = written(docs.select(*keys, *([_sha(text_col).alias("_sha")] if digests else [])))
    shared = _survivors(rows)
    if digests:
        found = rows.join(_groups(rows.join(shared, ["_len", "_pre"], "left_semi")), BY, "left")
    else:
        hashed = written(docs.select(*keys, F.col(text_col).alias("_text")).join(shared, ["_len", "_pre"], "left_semi").withColumn("_sha", _sha("_text")).drop("_text"))
        alone = rows.join(shared, ["_len", "_pre"], "left_anti").select("doc_id")
        found = hashed.join(_groups(hashed), BY, "left").select("doc_id", "keep_id", "n").unionByName(alone, allowMissingColumns=True)
    return found.select(
        "doc_id",
        F.coalesce("keep_id", "doc_id").alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("keep_id") == F.col("doc_id"), F.col("n").isNull() | F.col("keep_id").isNull()).alias("kept"),
        *([F.lower(F.hex("_sha")).alias("text_sha256")] if digests else []),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """The documents that stay, with all their columns: of equal texts one row with the largest doc_id."""
    plain, name = plain_names(docs)
    keys = _short_keys(name[id_col], name[text_col], prefix_chars)
    shared = _survivors(written(plain.select(*keys)))
    marked = plain.select(*plain.columns, *keys).join(shared.withColumn("_both", F.lit(True)), ["_len", "_pre"], "left")
    marked = marked.withColumn("_sha", F.when(F.col("_both"), _sha(name[text_col]))).drop("_both")
    groups = _groups(marked.where("_sha IS NOT NULL").select(*BY, "doc_id"))
    left = marked.join(groups, BY, "left").where(F.col("n").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id")))
    if not groups.where("c > 1").isEmpty():
        left = left.where("c IS NULL OR c = 1").unionByName(left.where("c > 1").dropDuplicates(BY))
    return left.select(*plain.columns).toDF(*docs.columns)
