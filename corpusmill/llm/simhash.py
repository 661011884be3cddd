"""SimHash near-duplicate detection with covering locality-sensitive hashing.

A fingerprint has 64 bits, each the majority over the XXH64 values of a text's word shingles. Equal
fingerprints are grouped first; everything afterwards works on different fingerprints. For radius r
a random map m of the 64 bit positions to the nonzero vectors of GF(2)^(r+1) gives 2^(r+1)-1 masks:
mask v has bit i if <m(i), v> = 1. For any r positions some v is orthogonal to their images, so every pair
within the radius agrees on all bits of some mask and meets in that table: no pair can be missed.

A bucket of up to PAIRS fingerprints is compared pair by pair. In a larger one (for radius 2) each
fingerprint instead sends itself to the 65 points within one bit of it: two fingerprints share
such a point exactly if they differ in at most two bits, so linking all that share a point to the
smallest of them gives the same components with rows linear in the bucket, however large it is.

Components come from repeated large-star and small-star steps over links, each written to the shared
folder; no links, fingerprints or components reach the driver.

For wider radii, whose 2^(r+1)-1 masks would be too many, the bits are cut into parts (covering_masks): texts within the radius are within a
part's share of it on some part, whose own masks cover that. The pipeline takes its candidates from them (near_copies).

Defined cases: a null text counts as empty, and without words the fingerprint is zero, linked like
any other; repeated rows share a fingerprint; a null doc_id is never a component's id unless alone;
a very long text is hashed whole, in bounded blocks of bits; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import in_small_batches, small_side, written
from corpusmill.operators.graph import components

SHINGLE, RADIUS, SEED = 3, 2, 42
#: Fingerprints in a bucket that are compared pair by pair; larger buckets take the linear way.
PAIRS = 32


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    words = text.encode().lower().split()  # of bytes: A-Z only, and the separators are 0x20 and 0x09-0x0D
    if not words:
        return 0
    if len(words) < shingle:
        words = [b" ".join(words)]
        shingles = words
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # a bounded matrix of bits, however long the text
        ones += np.unpackbits(hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def wide_fingerprint(own: Mapping[bytes, bytes], words: int = 2) -> np.ndarray:
    """64 bits for each of so many longs: of a text's different words, so that what every text repeats weighs no more than the rest.

    own: the different words with their XXH64 digests of SEED, which the first long takes; the others take those of the next seeds.
    """
    sums = []
    for k in range(words):
        digests = b"".join(own.values() if k == 0 else [xxhash.xxh64_digest(w, SEED + k) for w in own])
        ones = np.zeros(64, np.int64)
        for at in range(0, len(digests), 8 * 255):  # as many words as a byte counts
            ones += np.unpackbits(np.frombuffer(digests[at : at + 8 * 255], np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.uint8)
        sums.append(ones)
    return np.packbits(2 * np.concatenate(sums) > len(own)).view(">u8").astype(np.uint64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long), written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t or "", shingle) for t in b.column(1).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return written(in_small_batches(ids).mapInArrow(run, "doc_id long, fp long"))


def masks(radius: int = RADIUS, seed: int = SEED) -> list[int]:
    """The 2^(radius+1)-1 masks of 64 bits; each bit position is in about half of them."""
    images = np.random.default_rng(seed).integers(1, 1 << (radius + 1), 64)
    return [sum(1 << i for i in range(64) if bin(int(images[i]) & v).count("1") % 2) for v in range(1, 1 << (radius + 1))]


def covering_masks(words: int, parts: int, radius: int, seed: int = SEED) -> np.ndarray:
    """A row of longs for each mask over 64 * words bits: two fingerprints within the radius agree on all bits of some mask.

    Of parts that don't overlap, one has at most radius // parts of the differing bits; its masks are made as those of masks().
    """
    r, within = np.random.default_rng(seed), radius // parts
    order = r.permutation(64 * words)
    out = []
    for k in range(parts):
        at = order[k::parts]
        images = np.resize(r.permutation(np.arange(1, 1 << (within + 1))), len(at))  # each vector about equally often, so that masks have about as many bits
        for v in range(1, 1 << (within + 1)):
            bits = np.zeros(64 * words, np.uint8)
            bits[at] = np.bitwise_count(images & v) % 2
            out.append(np.packbits(bits).view(">u8").astype(np.uint64))
    return np.array(out)


def covering_keys(fps: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """A hash for each fingerprint (row of fps) and mask; those of different masks differ."""
    mix = np.uint64(0x9E3779B97F4A7C15)
    key = np.broadcast_to(np.arange(1, len(masks) + 1, dtype=np.uint64), (len(fps), len(masks)))
    for k in range(masks.shape[1]):
        key = (key ^ (fps[:, k, None] & masks[:, k])) * mix
        key = key ^ (key >> np.uint64(32))
    return key * mix


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(fps: DataFrame, radius: int = RADIUS, pairs: int = PAIRS) -> DataFrame:
    """Links (a, b) between different fingerprints within the radius that give the exact components.

    fps: one column fp, without repeats. Beyond radius 2 all buckets are compared pair by pair.
    """
    tables = F.array(*[F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for k, m in enumerate(masks(radius))])
    keyed = fps.select("fp", F.explode(tables).alias("k")).select("fp", "k.t", "k.key")
    sizes = written(keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1"))
    limit = pairs if radius == 2 else 1 << 62
    small = written(keyed.join(small_side(sizes.where(F.col("n") <= limit).select("t", "key")), ["t", "key"], "left_semi"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    found = (small.withColumnRenamed("fp", "a").join(small.withColumnRenamed("fp", "b"), ["t", "key"])
             .where((F.col("a") < F.col("b")) & near).select("a", "b"))
    if radius == 2:
        large = keyed.join(small_side(sizes.where(F.col("n") > limit).select("t", "key")), ["t", "key"], "left_semi").select("fp").distinct()
        points: list[Column] = [F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << k))) for k in range(64)]]
        balls = large.select("fp", F.explode(F.array(*points)).alias("z"))
        # at most 65 fingerprints share a point, so these groups are small however large the bucket
        stars = balls.groupBy("z").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
        stars = stars.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a < b")
        found = found.union(stars)
    return found.distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id that links reach, the document's own included."""
    rows = fingerprints(docs, id_col, text_col, shingle)
    fps = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    nodes = written(components(links(fps.select("fp"), radius)))
    first = fps.withColumnRenamed("fp", "node").join(nodes, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = written(first.where("root <> node").select("root", "first")
                    .union(first.where("root = node").select("root", "first")).groupBy("root").agg(F.min("first").alias("component_id")))
    of = written(first.join(least, "root").select(F.col("node").alias("fp"), "component_id"))
    return rows.join(small_side(of), "fp").select("doc_id", "fp", "component_id")
