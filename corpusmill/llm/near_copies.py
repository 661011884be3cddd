"""Near copies for the pipeline: SimHash with covering masks for candidates, and a check of each by Jaccard.

A text is the set of its five-word shingles, as 64-bit hashes; texts of equal sets are one node. Two nodes are linked if their sets are
similar to THRESHOLD or more. A node's fingerprint has 128 bits, of its different words (a changed word is one of them, but in five of the shingles).
All pairs within RADIUS bits meet in a table of the covering masks (llm.simhash): none of them can be missed. Pairs beyond RADIUS,
which SimHash leaves, meet in MinHash bands: of each set ROWS * BANDS minima are taken, and sets of similarity s
share a band's bucket with probability 1 - (1 - s^5)^20: 0.9996 at 0.8, more above. Each pair is then compared by its
whole sets, so no link is below the threshold.

A bucket of up to PAIRS nodes is compared pair by pair. The nodes of larger buckets go through an exact set-similarity join over
rare-first prefixes of their sets (operators.setjoin): what many dissimilar texts share, such as a passage, brings none
of them together, near copies are compared with a few of their list first, and what is then still unconnected is compared in full.
So components are exactly those of all links between such nodes, whatever a bucket's size.

Links, components and decisions are tables; none reaches the driver.

Defined cases: a null text counts as empty, and texts without words are copies of each other; a shorter text is one
shingle; decisions hold for an id and its text, so repeated and null ids do no harm (rows equal in both share
their fate, and a null id stays only where there is no other); a very long text is one set that a task holds whole; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from corpusmill.llm import simhash
from corpusmill.llm.common import in_small_batches, make_room, plain_names, small_side, written
from corpusmill.operators import setjoin
from corpusmill.operators.graph import components

SHINGLE, THRESHOLD, ROWS, BANDS, SEED = 5, 0.8, 5, 20, 42
#: Longs of a fingerprint, the parts of its masks and the differing bits that they cover.
WORDS, PARTS, RADIUS = 2, 3, 11
FP = [f"fp{k}" for k in range(WORDS)]
MASKS = simhash.covering_masks(WORDS, PARTS, RADIUS)
#: Nodes in a bucket that are compared pair by pair.
PAIRS = 32
#: An odd multiplier that spreads bits.
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Hashes whose images are made at once.
BLOCK = 256


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and addends, one of each for every minimum."""
    a, b = np.random.default_rng(SEED).integers(0, 1 << 63, (2, ROWS * BANDS), np.uint64)
    return a * np.uint64(2) + np.uint64(1), b


PERMUTATIONS = _permutations()


def hashed_words(text: str) -> tuple[np.ndarray, dict[bytes, bytes]]:
    """The hashes of all words, in order, and the different words with their digests; each of these is hashed once."""
    words = text.encode().lower().split()
    own = {w: xxhash.xxh64_digest(w, SEED) for w in set(words)}
    return np.frombuffer(b"".join(map(own.__getitem__, words)), ">u8").astype(np.uint64), own


def shingles(h: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """The different hashes of shingles, in order. A shingle's hash mixes those of its words (h), in their order."""
    width = min(shingle, len(h))
    out = np.zeros(len(h) - width + 1, np.uint64)
    for k in range(width):
        out = (out ^ (out >> np.uint64(31))) * MIX + h[k : k + len(out)]
    return np.unique((out ^ (out >> np.uint64(29))) * MIX)


def node_of(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED)


def bucket_keys(hashes: np.ndarray) -> np.ndarray:
    """One key for each band; keys of different bands differ."""
    a, b = PERMUTATIONS
    least = np.full(ROWS * BANDS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), BLOCK):  # a matrix that stays in the processor's cache, however long the text
        block = hashes[at : at + BLOCK, None] * a
        block += b
        np.minimum(least, block.min(axis=0), out=least)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        key = (key ^ (row >> np.uint64(29))) * MIX + row
    return key


def all_keys(fps: np.ndarray, bands: np.ndarray) -> np.ndarray:
    """The keys of a node in one row: of the masks with the lowest bit set, of the bands without."""
    one = np.uint64(1)
    return np.concatenate([simhash.covering_keys(fps, MASKS) | one, bands & ~one], axis=1)


def _text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def signed(docs: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, th (hash of the text), node, n (size of its set), fp0 and fp1 (its fingerprint), keys: a row for each of docs, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        for b in batches:
            if not b.num_rows:
                continue
            nodes, sizes, fps, bands = [], [], [], []
            for t in b.column(2).to_pylist():
                h, own = hashed_words(t or "")
                hashes = shingles(h, shingle)
                nodes.append(node_of(hashes))
                sizes.append(len(hashes))
                fps.append(simhash.wide_fingerprint(own, WORDS))
                bands.append(bucket_keys(hashes))
            fp = np.array(fps, np.uint64)
            keys = all_keys(fp, np.array(bands, np.uint64))
            ends = pa.array(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32))
            columns = [pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), *[pa.array(fp[:, k].copy().view(np.int64)) for k in range(WORDS)]]
            columns = [b.column(0), b.column(1), *columns, pa.ListArray.from_arrays(ends, pa.array(keys.view(np.int64).ravel()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "th", "node", "n", *FP, "keys"])

    rows = docs.select(F.col(id_col).alias("doc_id"), _text_hash(F.col(text_col)).alias("th"), F.col(text_col).alias("text"))
    more = [*[StructField(x, LongType()) for x in ("th", "node", "n", *FP)], StructField("keys", ArrayType(LongType()))]
    return written(in_small_batches(rows).mapInArrow(run, StructType([StructField("doc_id", rows.schema["doc_id"].dataType), *more])))


def shingle_sets(docs: DataFrame, rows: DataFrame, wanted: DataFrame, text_col: str, shingle: int = SHINGLE) -> DataFrame:
    """node, set of the nodes in wanted, written: a second pass over the texts of candidates alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        for b in batches:
            sets = [shingles(hashed_words(t or "")[0], shingle) for t in b.column(0).to_pylist()]
            nodes = np.array([node_of(s) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["node", "set"])

    texts = small_side(written(rows.join(small_side(wanted), "node", "left_semi").groupBy("node").agg(F.min("th").alias("_th")).select("_th")))
    found = docs.join(texts, _text_hash(F.col(text_col)) == F.col("_th"), "left_semi").select(text_col)
    return written(in_small_batches(found).mapInArrow(run, "node long, set array<long>").dropDuplicates(["node"]))


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose sets are similar, written."""
    left, right = (sets.select(F.col("node").alias(x), F.col("set").alias(f"s{x}")) for x in "ab")
    both = F.size(F.array_intersect("sa", "sb"))
    return written(pairs.join(left, "a").join(right, "b").where(both >= threshold * (F.size("sa") + F.size("sb") - both)).select("a", "b"))


def candidates(rows: DataFrame, threshold: float = THRESHOLD, pairs: int = PAIRS) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of nodes to be compared, and the nodes of crowded buckets (node), both written; rows: of signed().

    Pairs within RADIUS come from the masks alone, pairs beyond it from the bands alone.
    """
    each = rows.select("node", F.explode("keys").alias("key"))
    sizes = written(each.groupBy("key").agg(F.count("*").alias("members")).where("members > 1"))
    own = rows.select("node", "n", *FP).dropDuplicates(["node"])
    keyed = written(each.join(small_side(sizes), "key").dropDuplicates(["node", "key"]).join(small_side(own), "node"))
    small = keyed.where(F.col("members") <= pairs)
    first, other = (small.select("key", *[F.col(c).alias(f"{c}_{x}") for c in ("node", "n", *FP)]) for x in "ab")
    differ = sum((F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in FP), F.lit(0))
    of_masks = F.col("key").bitwiseAND(F.lit(1).cast("long")) == 1
    met = first.join(other, "key").where((F.col("node_a") < F.col("node_b")) & (F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b")) & ((differ <= RADIUS) == of_masks))
    return written(met.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()), written(keyed.where(F.col("members") > pairs).select("node").distinct())


def links(docs: DataFrame, rows: DataFrame, text_col: str = "text", threshold: float = THRESHOLD, shingle: int = SHINGLE, pairs: int = PAIRS) -> DataFrame:
    """Links (a, b) between different nodes that are similar, enough of them for the components; rows: of signed()."""
    met, crowded = candidates(rows, threshold, pairs)
    wanted = met.select(F.explode(F.array("a", "b")).alias("node")).union(crowded).distinct()
    sets = shingle_sets(docs, rows, written(wanted), text_col, shingle)
    found = _verified(met, sets, threshold)
    if crowded.isEmpty():
        return found
    lists = setjoin.prefix_lists(sets.join(small_side(crowded), "node"), threshold)
    return written(found.union(setjoin.connecting_links(lists, lambda met: _verified(met, sets, threshold), threshold)).distinct())


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, shingle: int = SHINGLE, pairs: int = PAIRS) -> DataFrame:
    """The documents with the smallest doc_id of their component, with all their columns."""
    plain, name = plain_names(docs)
    rows = signed(plain, name[id_col], name[text_col], shingle)
    roots = small_side(written(components(links(plain, rows, name[text_col], threshold, shingle, pairs))))
    judged = rows.select("doc_id", "th", "node").join(roots, "node", "left").select("doc_id", "th", F.coalesce("root", "node").alias("root"))
    least = judged.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("stays"), F.count("*").alias("n")).where("n > 1")
    same = F.col("doc_id").eqNullSafe(F.col("stays.doc_id")) & (F.col("th") == F.col("stays.th"))
    dropped = judged.join(small_side(written(least.drop("n"))), "root").where(~same).select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"))
    dropped = small_side(written(dropped.distinct()))
    return plain.join(dropped, F.col(name[id_col]).eqNullSafe(F.col("_id")) & (_text_hash(F.col(name[text_col])) == F.col("_th")), "left_anti").toDF(*docs.columns)
