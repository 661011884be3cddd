"""Exact and MinHash deduplication, cross-dataset removal and evaluation-set leakage."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import char_ngrams, code_tokens, jaccard, let, ngrams, text_or_empty
from corpusmill.operators import setjoin
from corpusmill.session import small_side, written

PRIME, PERMUTATIONS, BANDS, SHINGLE = (1 << 31) - 1, 128, 16, 5
#: Units whose images a task keeps, of 512 bytes each, and whose hashes it keeps.
KEPT, HASHED = 1 << 17, 1 << 20


def mark_copies(docs: DataFrame, key: Column, id_col: str = "doc_id") -> DataFrame:
    """docs with first_id: the smallest id of an equal key. Groups are pre-aggregated, so any size is fine."""
    keyed = docs.withColumn("_key", key)
    firsts = keyed.groupBy("_key").agg(F.min(id_col).alias("first_id"))
    return keyed.join(firsts, "_key").drop("_key")


def exact_dedup(docs: DataFrame, content: Column, id_col: str = "doc_id") -> DataFrame:
    """The first of all rows with equal content."""
    return mark_copies(docs, F.sha2(content.cast("string"), 256), id_col).where(F.col("first_id") == F.col(id_col)).drop("first_id")


def duplicate_pairs(docs: DataFrame, content: Column, id_col: str = "doc_id") -> DataFrame:
    """first_id, id of every later copy."""
    return mark_copies(docs, F.sha2(content, 256), id_col).where(F.col("first_id") < F.col(id_col)).select("first_id", id_col)


def cross_dedup(primary: DataFrame, secondary: DataFrame, content_col: str = "text") -> DataFrame:
    """Rows of secondary whose content is not in primary."""
    key = F.sha2(F.col(content_col), 256)
    return secondary.withColumn("_key", key).join(primary.select(key.alias("_key")).distinct(), "_key", "left_anti").drop("_key")


def priority_dedup(docs: DataFrame, content: Column, priority: Column) -> DataFrame:
    """Of equal contents across datasets, the rows of the dataset with the smallest priority."""
    keyed = docs.withColumns({"_key": F.sha2(content, 256), "_rank": priority})
    best = keyed.groupBy("_key").agg(F.min("_rank").alias("_best"))
    return keyed.join(best, "_key").where("_rank = _best").drop("_key", "_rank", "_best")


def coefficients(n: int = PERMUTATIONS, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Of the permutations (a * h + b) mod p: fixed by a linear congruence, which SQL can repeat."""
    a, b, x = [], [], seed
    for _ in range(n):
        x = (x * 48271) % PRIME
        a.append(x)
        x = (x * 48271) % PRIME
        b.append(x)
    return np.array(a, np.int64), np.array(b, np.int64)


def normal_text(text: Column) -> Column:
    """Small letters, white space as single spaces."""
    return F.btrim(F.regexp_replace(F.lower(text_or_empty(text)), r"[ \t\n\r\x0b\x0c]+", " "))


class _Minima:
    """Minima of the permutations over a text's different units, its substrings of `shingle` characters.

    A unit is a number, made from those that its characters were given; a text with too many different ones has strings as units.
    The hashes of the first HASHED units that a task meets are kept, and the images of the first KEPT, as few units make up most of all texts.
    """

    def __init__(self, shingle: int, permutations: int) -> None:
        self.shingle, self.bits = shingle, 63 // shingle
        self.a, self.b = coefficients(permutations)
        self.places: dict[int | str, int] = {}
        self.images, self.hashes = np.empty((KEPT, permutations), np.uint32), np.empty(HASHED, np.int64)
        self.numbers, self.chars = np.zeros(0x110000, np.int64), [""]

    def units(self, t: str) -> list[int] | list[str]:
        if len(t) < self.shingle:
            return [t]
        points = np.frombuffer(t.encode("utf-32-le"), np.uint32)
        new = np.unique(points[self.numbers[points] == 0]).tolist()
        if len(self.chars) + len(new) > 1 << self.bits:
            return list({t[i : i + self.shingle] for i in range(len(t) - self.shingle + 1)})
        for c in new:
            self.numbers[c] = len(self.chars)
            self.chars.append(chr(c))
        numbers, last = self.numbers[points], len(t) - self.shingle + 1
        key = np.zeros(last, np.int64)
        for k in range(self.shingle):
            key = (key << self.bits) | numbers[k : k + last]
        return np.unique(key).tolist()

    def text(self, unit: int | str) -> str:
        if isinstance(unit, str):
            return unit
        return "".join(self.chars[unit >> self.bits * k & (1 << self.bits) - 1] for k in reversed(range(self.shingle)))

    def of(self, t: str) -> np.ndarray:
        least, units = np.full(len(self.a), PRIME, np.int64), self.units(t)
        place = self.places.get
        for at in range(0, len(units), 256):  # a matrix that stays in the processor's cache, however long the text
            some = units[at : at + 256]
            places = np.array([place(u, -1) for u in some])
            kept = places[(places >= 0) & (places < KEPT)]
            if len(kept):
                np.minimum(least, self.images.take(kept, axis=0).min(axis=0), out=least)
            if len(kept) == len(some):
                continue
            new = [some[k] for k in np.flatnonzero(places < 0).tolist()]
            h = np.fromiter((int.from_bytes(hashlib.md5(self.text(u).encode()).digest()[:4], "big") % PRIME for u in new), np.int64, len(new))  # noqa: S324
            images = (np.concatenate([h, self.hashes[places[places >= KEPT]]])[:, None] * self.a + self.b) % PRIME
            np.minimum(least, images.min(axis=0), out=least)
            first = len(self.places)
            self.hashes[first : first + len(new)] = h[: HASHED - first]
            self.images[first : first + len(new)] = images[: min(len(new), max(KEPT - first, 0))]
            self.places.update(zip(new, range(first, HASHED), strict=False))
        return least


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, permutations: int = PERMUTATIONS) -> DataFrame:
    """id, signature array<long>: minima over the different character shingles of the normalised text.

    The base hash is the first eight hexadecimal digits of a shingle's MD5, mod p. Texts shorter than a
    shingle are one shingle; an empty text has no signature.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minima = _Minima(shingle, permutations)
        for batch in batches:
            out = [minima.of(t) if t else None for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64()))], [id_col, "signature"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, normal_text(F.col(text_col)).alias("t")).mapInArrow(run, f"`{id_col}` {kind}, signature array<bigint>")


def band_keys(signature: Column, bands: int = BANDS, permutations: int = PERMUTATIONS) -> Column:
    rows = permutations // bands
    return F.array(*[F.struct(F.lit(k).alias("band"), F.md5(F.array_join(F.slice(signature, k * rows + 1, rows), ",")).alias("key")) for k in range(bands)])


def agreement(a: Column, b: Column) -> Column:
    """Share of equal positions: the estimate of the Jaccard coefficient."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda z: z)) / F.size(a)


#: Members of a bucket that are compared pair by pair; those of larger ones are compared over rare-first prefixes of their signatures.
PAIRS = 32


def signature_set(signature: Column) -> Column:
    """A signature as a set: equal positions are shared tokens."""
    return F.transform(signature, lambda v, k: F.xxhash64(k, v))


def bucket_links(signed: DataFrame, threshold: float, pairs: int = PAIRS) -> DataFrame:
    """a, b, similarity: all pairs of nodes that share a band and agree in at least the threshold of their positions. signed: node, signature.

    A bucket of up to `pairs` nodes is compared pair by pair. The nodes of larger ones meet in the lists of a set-similarity join over
    their whole signatures: no pair that agrees enough is missed, and many that share a band alone meet nowhere.
    """
    banded = _banded(signed)
    sizes = written(banded.groupBy("key").agg(F.count("*").alias("members")).where("members > 1"))
    keyed = written(banded.join(small_side(sizes), "key"))
    small = keyed.where(F.col("members") <= pairs)
    met = small.select("key", F.col("node").alias("a")).join(small.select("key", F.col("node").alias("b")), "key").where("a < b").select("a", "b").distinct()
    crowded = written(keyed.where(F.col("members") > pairs).select("node").distinct())
    if not crowded.isEmpty():
        sets = signed.join(small_side(crowded), "node").select("node", signature_set(F.col("signature")).alias("set"))
        met = met.union(setjoin.candidate_pairs(setjoin.prefix_lists(sets, threshold), threshold, jaccard=False)).distinct()
    left, right = (signed.select(F.col("node").alias(x), F.col("signature").alias(f"s{x}")) for x in "ab")
    both = met.join(left, "a").join(right, "b").withColumn("similarity", agreement(F.col("sa"), F.col("sb")))
    share = F.arrays_overlap(band_keys(F.col("sa")), band_keys(F.col("sb")))
    return both.where((F.col("similarity") >= threshold) & share).select("a", "b", "similarity")


def _signed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """node (the smallest id of equal normalised texts), signature, written."""
    texts = docs.select(F.col(id_col).alias("node"), F.col(text_col).alias("text"))
    texts = texts.groupBy(F.sha2(normal_text(F.col("text")), 256).alias("_h")).agg(F.min(F.struct("node", "text")).alias("x")).select("x.node", "x.text")
    return written(signatures(texts, "node", "text").where("signature IS NOT NULL"))


def _banded(signed: DataFrame) -> DataFrame:
    return signed.select("node", F.explode(F.transform(band_keys(F.col("signature")), lambda k: F.xxhash64(k["band"], k["key"]))).alias("key"))


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, class_id: the smallest id of the same normalised text, which near_duplicates links."""
    return mark_copies(docs.select(id_col, text_col), F.sha2(normal_text(F.col(text_col)), 256), id_col).select(id_col, F.col("first_id").alias("class_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """first_id, id, similarity: links between classes of equal texts (near_classes) whose signatures share a band and agree enough."""
    return bucket_links(_signed(docs, id_col, text_col), threshold).select(F.col("a").alias("first_id"), F.col("b").alias("id"), "similarity")


def cross_near_dedup(primary: DataFrame, secondary: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """The rows of secondary that are no near copy of a row of primary, which itself stays as it is.

    Texts are compared once for each different text of either side, and only across the sides. Rows without a signature stay.
    """
    one, other = (_signed(x, id_col, text_col) for x in (primary, secondary))
    buckets = written(_banded(one).withColumn("p", F.lit(1)).unionByName(_banded(other).withColumn("p", F.lit(0))).groupBy("key")
                      .agg(F.sum("p").alias("here"), F.count("*").alias("all")).where("here > 0 AND here < all"))
    sides = [written(_banded(x).join(small_side(buckets), "key")) for x in (one, other)]
    few = F.col("here") * (F.col("all") - F.col("here")) <= PAIRS * PAIRS

    def verified(pairs: DataFrame) -> DataFrame:
        both = pairs.join(one.select(F.col("node").alias("a"), F.col("signature").alias("sa")), "a").join(other.select(F.col("node").alias("b"), F.col("signature").alias("sb")), "b")
        return both.where((agreement(F.col("sa"), F.col("sb")) >= threshold) & F.arrays_overlap(band_keys(F.col("sa")), band_keys(F.col("sb")))).select("a", "b")

    met = sides[0].where(few).select("key", F.col("node").alias("a")).join(sides[1].where(few).select("key", F.col("node").alias("b")), "key").select("a", "b").distinct()
    near = written(verified(met).select(F.col("b").alias("node")).distinct())
    crowded = [written(x.where(~few).select("node").distinct()) for x in sides]
    if not crowded[1].isEmpty():
        # one order of tokens for both sides, whose nodes may have the same ids
        tagged = [x.join(small_side(c), "node").select(F.struct(F.lit(k).alias("side"), "node").alias("node"), signature_set(F.col("signature")).alias("set")) for k, (x, c) in enumerate(zip((one, other), crowded, strict=True))]
        lists = setjoin.prefix_lists(tagged[0].union(tagged[1]), threshold)
        own = [lists.where(F.col("node.side") == k).select("token", F.col("node.node").alias("node"), *setjoin.ENTRY[1:]) for k in (0, 1)]
        near = near.union(setjoin.reached(own[0], own[1].join(small_side(near), "node", "left_anti"), verified, threshold, jaccard=False))
    classes = small_side(written(near.select(F.col("node").alias("class_id")).distinct()))
    return secondary.join(near_classes(secondary, id_col, text_col).join(classes, "class_id", "left_semi").select(id_col).distinct(), id_col, "left_anti")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """Documents in the order of their ids, without each that is a copy of an earlier one or a near copy of an earlier one that stays."""
    links = near_duplicates(docs, id_col, text_col, threshold).select(F.col("first_id").alias("a"), F.col("id").alias("b"))
    dropped = setjoin.earlier_kept(links).select(F.col("node").alias(id_col))
    one = exact_dedup(docs, normal_text(F.col(text_col)), id_col)
    return one.join(dropped, id_col, "left_anti")


def nearest_items(rows: DataFrame, items: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", chars: int = 3, words: int = 3) -> DataFrame:
    """id, most, mean, nearest: half the Jaccard coefficient of character n-grams, half that of token n-grams, over all items; the smallest id of equally near ones.

    Similarities are summed from shared n-grams alone: what shares none has similarity 0. An empty set counts as one that holds
    a mark of its own, so two empty ones are equal. Ids of rows and of items are unique.
    """
    marked = lambda kind, grams: F.when(F.size(grams) == 0, F.array(F.xxhash64(F.lit(kind)))).otherwise(F.transform(grams, lambda g: F.xxhash64(F.lit(kind), g)))
    grams = {"c": lambda c: let(text_or_empty(F.col(c)), lambda t: marked("c", char_ngrams(t, chars))),
             "t": lambda c: let(code_tokens(text_or_empty(F.col(c))), lambda t: marked("t", F.array_distinct(ngrams(t, words))))}
    halves = []
    for of in grams.values():
        ours = rows.select(F.col(id_col).alias("node"), of(text_col).alias("set"))
        shared = setjoin.overlaps(ours, items.select(F.col(item_col).alias("item"), of(text_col).alias("set")))
        halves.append(shared.select("node", "item", (0.5 * F.col("shared") / (F.col("n") + F.col("m") - F.col("shared"))).alias("_s")))
    scored = halves[0].union(halves[1]).groupBy("node", "item").agg(F.round(F.sum("_s"), 9).alias("_s"))
    best = scored.groupBy(F.col("node").alias(id_col)).agg(F.max("_s").alias("most"), F.sum("_s").alias("sum"), F.min_by("item", F.struct(-F.col("_s"), F.col("item"))).alias("nearest"))
    all_items = items.agg(F.count("*").alias("n"), F.min(item_col).alias("least")).where("n > 0")
    out = rows.select(id_col).join(best, id_col, "left").crossJoin(F.broadcast(all_items))  # one row
    near = F.when(F.col("most") > 0, F.col("nearest")).otherwise(F.col("least"))
    return out.select(id_col, F.coalesce("most", F.lit(0.0)).alias("most"), (F.coalesce("sum", F.lit(0.0)) / F.col("n")).alias("mean"), near.alias("nearest"))


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / the longer text's length, in characters; 1 for two empty texts."""
    return F.coalesce(1 - F.try_divide(F.levenshtein(a, b), F.greatest(F.length(a), F.length(b))), F.lit(1.0))


def word_grams(text: Column, n: int) -> Column:
    """Different hashed word n-grams of the normalised text; the whole text if it has fewer words. Words are hashed once."""
    grams = lambda h: F.transform(F.sequence(F.lit(0), F.greatest(F.size(h) - n, F.lit(0))), lambda i: F.xxhash64(F.slice(h, i + 1, n)))
    of = lambda t: F.when(t == "", F.array().cast("array<bigint>")).otherwise(F.array_distinct(let(F.transform(F.split(t, " "), lambda w: F.xxhash64(w)), grams)))
    return let(normal_text(text), of)


def containment(docs: DataFrame, items: DataFrame, n: int = 8, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, doc_id, containment: the share of an item's word n-grams that stand in a document.

    The join is on n-grams that the items have; a document sends only those.
    """
    wanted = items.select(item_col, F.size(word_grams(F.col(text_col), n)).alias("total"), F.explode(word_grams(F.col(text_col), n)).alias("gram"))
    wanted = written(wanted)
    found = docs.select(id_col, F.explode(word_grams(F.col(text_col), n)).alias("gram")).join(small_side(wanted), "gram")
    return found.groupBy(item_col, id_col, "total").agg(F.count("*").alias("shared")).select(item_col, id_col, (F.col("shared") / F.col("total")).alias("containment"))


def leakage(docs: DataFrame, items: DataFrame, threshold: float = 0.5, n: int = 8, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The document that contains most of each item, where that is at least the threshold, with a preview."""
    found = containment(docs, items, n, id_col, item_col, text_col).where(F.col("containment") >= threshold)
    best = found.groupBy(item_col).agg(F.min_by(id_col, F.struct(-F.col("containment"), F.col(id_col))).alias(id_col), F.max("containment").alias("containment"), F.count("*").alias("n_docs"))
    return best.join(items.select(item_col, F.substring(text_col, 1, 100).alias("preview")), item_col)


def leakage_rate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """One row: n_items, n_leaked, rate."""
    leaked = leakage(docs, items, **options).agg(F.count("*").alias("n_leaked"))
    return items.agg(F.count("*").alias("n_items")).crossJoin(leaked).withColumn("rate", F.try_divide("n_leaked", "n_items"))


def pair_similarity(pairs: DataFrame, a: str, b: str, n: int = 3) -> DataFrame:
    """pairs with char_jaccard (n characters) and token_jaccard (words) of two text columns."""
    tokens = lambda c: F.filter(F.array_distinct(F.split(normal_text(F.col(c)), " ")), lambda w: w != "")
    grams = lambda c: let(normal_text(F.col(c)), lambda t: char_ngrams(t, n))
    return pairs.withColumns({"char_jaccard": jaccard(grams(a), grams(b)), "token_jaccard": jaccard(tokens(a), tokens(b))})
