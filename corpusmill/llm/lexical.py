"""Ranked lexical search: three-phase uniform thresholds (TPUT) over term-partitioned postings.

One pass over the documents counts terms and keeps the postings of terms that some item has. Each posting carries the
value it adds to a score, so an item's score of a document is a sum over its lists. Lists are dealt to tasks by term, a long
list in parts by document, and sorted by falling value.

1. The head of each list gives partial sums; the best documents by these are looked up, and the k-th highest of
   their whole scores is a lower bound of what a result must reach.
2. Every list of an item sends all entries of at least that bound divided by the number of the item's lists. A document that
   no list sends adds up to less than the bound. Partial sums, and for each list that did not send a document the
   most it can still add, bound each document's score from above.
3. Documents whose upper bound reaches the k-th highest lower bound are looked up in all lists of the item, and ranked.

All sums are 64-bit integers and nothing is cut off but what can't be a result. The driver sees three numbers.

Terms are maximal runs of ASCII letters and digits and all characters from U+0080, with A to Z lower-cased.

Defined cases: a null or empty text has no terms; a text is read whole by one task, however long; rows of one item_id are one item
with all their terms, and a null item_id is an item like any other; each row of the documents is a document, so repeated rows are
ranked each; equal scores rank by ascending doc_id, null first; an item without terms, or empty tables, give no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import in_small_batches, small_side, written

TOP = 10
#: Entries of a list's head; documents looked up for each item's lower bound; entries of a part of a long list; items in a row of those that ask a list.
HEAD, LOOKED_UP, PART, ASKED = 64, 40, 1 << 20, 4_096
#: Parts of the score: of a term's weight and of a document's length (in hundredths).
WEIGHT, SCALE, NEAR, FAR = 1_000, 1_000_000_000, 8, 90
#: A to Z lower-cased; ASCII characters that no term has as spaces.
FOLD = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def terms(text: str | None) -> list[bytes]:
    """All terms of a text, in order, as UTF-8."""
    return text.encode("utf-8", "replace").translate(FOLD).split() if text else []


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """uid (a row's own number), doc_id, n (all its terms), term and tf of each different one.

    A row with the empty term ends each task's output: its tf is the number of documents with terms there, its n all their terms.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = first = TaskContext.get().partitionId() << 40
        n_docs = n_terms = 0
        names = ["uid", "doc_id", "n", "counts"]

        def batch(ids: pa.Array, uids: list[int], sizes: list[int], found: list[Counter]) -> pa.RecordBatch:
            ends = np.concatenate([[0], np.cumsum([len(c) for c in found])]).astype(np.int32)
            flat = pa.array([t for c in found for t in c], pa.binary()).cast(pa.string())
            tf = pa.array([k for c in found for k in c.values()], pa.int64())
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([flat, tf], ["term", "tf"]))
            return pa.RecordBatch.from_arrays([pa.array(uids, pa.int64()), ids, pa.array(sizes, pa.int64()), lists], names)

        for b in batches:
            found = [Counter(terms(t)) for t in b.column(1).to_pylist()]
            sizes = [c.total() for c in found]
            n_docs, n_terms = n_docs + sum(map(bool, sizes)), n_terms + sum(sizes)
            yield batch(b.column(0), list(range(uid, uid + b.num_rows)), sizes, found)
            uid += b.num_rows
        if uid > first:
            yield batch(pa.array([None], pa.int64()), [uid], [n_terms], [Counter({b"": n_docs})])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    each = in_small_batches(rows).mapInArrow(run, "uid long, doc_id long, n long, counts array<struct<term: string, tf: long>>")
    return each.select("uid", "doc_id", "n", F.inline("counts"))


def item_terms(items: DataFrame, item_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The items (item, a number; id, which may be null), and their terms (item, term, each once), both written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [list(set(terms(t))) for t in b.column(1).to_pylist()]
            at = np.repeat(np.arange(len(found)), [len(x) for x in found])
            flat = pa.array([t for x in found for t in x], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), flat], ["own", "term"])

    rows = items.select(F.col(item_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    numbered = written(rows.select("id").distinct().select(F.monotonically_increasing_id().alias("item"), "id"))
    found = rows.mapInArrow(run, f"own {kind}, term string").distinct()
    return numbered, written(found.join(small_side(numbered), F.col("own").eqNullSafe(F.col("id"))).select("item", "term"))


def lists(docs: DataFrame, wanted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """term, uid, doc_id, v (above 0): the postings of the wanted terms, by term and falling value, written."""
    spark = docs.sparkSession
    words = wanted.select("term").distinct().union(spark.createDataFrame([("",)], "term string"))
    raw = written(counted(docs, id_col, text_col).join(small_side(written(words)), "term"))
    totals = raw.where("term = ''").agg(F.sum("tf").alias("docs"), F.sum("n").alias("terms")).head()
    n_docs, n_terms = totals["docs"] or 0, totals["terms"] or 0
    weights = raw.where("term <> ''").groupBy("term").agg(F.count("*").alias("df"))
    w = F.floor(WEIGHT * F.log((2.0 * F.lit(n_docs) + 2) / (2.0 * F.col("df") + 1)))
    weights = written(weights.select("term", w.alias("w"), F.expr(f"df div {PART} + 1").alias("parts")))
    own = raw.where("term <> ''").join(small_side(weights), "term").withColumn("m", 100 - FAR + F.expr(f"({FAR} * n * {n_docs}) div {max(1, n_terms)}"))
    valued = own.select("term", "uid", "doc_id", (F.col("w") * F.expr(f"({SCALE} * tf) div (1000 * tf + {NEAR} * m)")).alias("v"), F.pmod(F.xxhash64("uid"), F.col("parts")).alias("part"))
    return written(valued.where("v > 0").repartition("term", "part").sortWithinPartitions("term", F.desc("v")).drop("part"))


def _kth(sums: DataFrame, k: int, name: str) -> DataFrame:
    """item, name: the k-th highest s of each item that has so many."""
    placed = sums.select("item", "s", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("s"))).alias("place")).where(F.col("place") <= k)
    return placed.where(F.col("place") == k).select("item", F.col("s").alias(name))


def met(postings: DataFrame, limits: DataFrame, entry: Column) -> DataFrame:
    """postings with asked, the entries (by threshold) of the items that ask their list, at most about ASKED in a row, and passed, how many of them the value reaches."""
    asked = limits.groupBy("term", "part").agg(F.array_sort(F.collect_list(entry)).alias("asked"))
    asked = written(asked)
    most = asked.agg(F.max(F.size("asked"))).head()[0] or 1
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(most.bit_length()))])
    reaches = lambda p: (p <= F.size("asked")) & (F.try_element_at("asked", p)["least"] <= F.col("v"))
    passed = F.aggregate(steps, F.lit(0), lambda p, s: F.when(reaches(p + s), p + s).otherwise(p))
    return postings.join(small_side(asked), "term").withColumn("passed", passed)


def unsent(postings: DataFrame, limits: DataFrame) -> DataFrame:
    """limits (item, term, least, ...) with part, and unsent: the list's highest value below `least`, or 0. Rows grow with the postings, not with postings times items."""
    parts = limits.groupBy("term").agg(F.expr(f"count(*) div {ASKED} + 1").alias("parts"))
    limits = written(limits.join(small_side(parts), "term").withColumn("part", F.pmod(F.xxhash64("item"), F.col("parts"))).drop("parts"))
    between = met(postings.select("term", "v"), limits, F.struct("least", "item")).groupBy("term", "part", (F.col("passed") + 1).alias("place")).agg(F.max("v").alias("v"))
    inside = Window.partitionBy("term", "part").orderBy("least", "item")
    placed = limits.withColumn("place", F.row_number().over(inside)).join(small_side(written(between)), ["term", "part", "place"], "left")
    return written(placed.withColumn("unsent", F.coalesce(F.max("v").over(inside.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))).drop("v", "place"))


def _whole(candidates: DataFrame, wanted: DataFrame, postings: DataFrame) -> DataFrame:
    """item, uid, doc_id, s: the whole scores of (item, uid)."""
    uids = small_side(written(candidates.select("uid").distinct()))
    entries = postings.join(uids, "uid", "left_semi").join(small_side(candidates), "uid").join(small_side(wanted), ["item", "term"])
    return entries.groupBy("item", "uid").agg(F.min("doc_id").alias("doc_id"), F.sum("v").alias("s"))


def search(docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the k highest-scoring documents of each item with a score above 0."""
    named, wanted = item_terms(items, item_col, item_text_col)
    postings = lists(docs, wanted, id_col, text_col)
    # 1: heads, and whole scores of the best documents by them
    by_value = Window.partitionBy("term").orderBy(F.desc("v"), "uid")
    heads = written(postings.select("term", "uid", "v").withColumn("place", F.row_number().over(by_value)).where(F.col("place") <= max(HEAD, k)))
    wanted = written(wanted.join(small_side(heads.where("place = 1").select("term", F.col("v").alias("most"))), "term"))  # lists that have entries
    sums = wanted.join(small_side(heads), "term").groupBy("item", "uid").agg(F.sum("v").alias("s"))
    best = sums.withColumn("place", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("s"), "uid"))).where(F.col("place") <= max(LOOKED_UP, k))
    floor = _kth(_whole(written(best.select("item", "uid")), wanted, postings), k, "floor")
    # 2: a uniform threshold for the lists of an item. What a list has not sent of a document is at most its highest value
    # below the threshold, and nothing if the whole list is sent.
    n_lists = wanted.groupBy("item").agg(F.count("*").alias("n_lists"))
    limits = wanted.join(small_side(n_lists), "item").join(small_side(floor), "item", "left").withColumn("floor", F.coalesce("floor", F.lit(0)))
    limits = unsent(postings, written(limits.select("item", "term", "floor", F.expr("(floor + n_lists - 1) div n_lists").alias("least"))))
    reached = met(postings.select("term", "uid", "v"), limits, F.struct("least", "item", "unsent")).where("passed > 0")
    sent = reached.select("uid", "v", F.inline(F.slice("asked", F.lit(1), F.col("passed"))))
    partial = written(sent.groupBy("item", "uid").agg(F.sum("v").alias("s"), F.sum("unsent").alias("known")))
    rest = limits.groupBy("item").agg(F.max("floor").alias("floor"), F.sum("unsent").alias("rest"))
    bounds = written(rest.join(_kth(partial, k, "second"), "item", "left").select("item", F.greatest("floor", F.coalesce("second", F.lit(0))).alias("bound"), "rest"))
    # 3: what can still be a result, looked up in all its lists
    upper = F.col("s") + F.col("rest") - F.col("known")
    candidates = written(partial.join(small_side(bounds), "item").where(upper >= F.col("bound")).select("item", "uid"))
    ranks = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("s"), F.asc_nulls_first("doc_id"), "uid"))
    placed = _whole(candidates, wanted, postings).withColumn("rank", ranks).where(F.col("rank") <= k)
    return placed.join(small_side(named), "item").select(F.col("id").alias("item_id"), F.col("rank").cast("int").alias("rank"), "doc_id", F.col("s").alias("score"))


def score_of(tf: Column, n: Column, df: Column, n_docs: Column, n_terms: Column) -> Column:
    """What one term adds to a document's score: for checks against a plain join."""
    m = 100 - FAR + F.floor(FAR * n * n_docs / n_terms)
    return F.floor(WEIGHT * F.log((2 * n_docs + 2) / (2 * df + 1))) * F.floor(SCALE * tf / (1000 * tf + NEAR * m))


#: The same results by plain joins, for DuckDB.
SEARCH_SQL = rf"""
WITH words AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
counts AS (SELECT doc_id, len(w) AS n, w FROM words WHERE len(w) > 0),
total AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM counts),
items AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
wanted AS (SELECT DISTINCT term FROM items),
tokens AS (SELECT doc_id, n, unnest(w) AS term FROM counts),
postings AS (SELECT doc_id, n, term, count(*) AS tf FROM tokens SEMI JOIN wanted USING (term) GROUP BY ALL),
weights AS (SELECT term, CAST(floor({WEIGHT} * ln((2.0::DOUBLE * any_value(big_n) + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w FROM postings, total GROUP BY term),
valued AS (SELECT term, doc_id, w * (({SCALE} * tf) // (1000 * tf + {NEAR} * ({100 - FAR} + ({FAR} * n * big_n) // big_l))) AS v FROM postings JOIN weights USING (term), total),
scores AS (SELECT item_id, doc_id, CAST(sum(v) AS BIGINT) AS score FROM items JOIN valued USING (term) GROUP BY ALL HAVING sum(v) > 0),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scores)
SELECT * FROM ranked WHERE rank <= {TOP}
"""
