"""Set-similarity joins over an inverted index of rare-first prefixes.

Sets are rows (node, set array<long>, without repeats). Two sets whose similarity reaches `share` have a token in common among
their first n - ceil(share * n) + 1 tokens, in any order that is the same for all sets; with rare tokens first, what many
dissimilar sets share stands behind the prefixes, so it brings nobody together. Sizes and places in the order bound the overlap
of two sets that meet, parities of their hashed tokens bound from below how many tokens they differ in, and what can't reach the threshold is left
out where it meets, before sets are compared. All bounds are safe: none leaves out a similar pair.

jaccard: overlap / union is measured; otherwise overlap / size, for sets that all have one size.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.operators.graph import components
from corpusmill.session import small_side, written

#: Steps in which one member of a list is compared with the rest, before all that is left is compared.
ROUNDS = 3
#: By how much the members that are tried grow from step to step.
MORE_HEADS = 6
#: Longs of parities of a set, and what stands in a list.
WORDS = 4
ENTRY = ("node", "n", "place", *[f"bits{w}" for w in range(WORDS)])


def _parities(tokens: Column) -> list[Column]:
    """WORDS longs whose bits are parities of the tokens that fall on them: two sets differ in at least as many tokens as these in bits."""
    bits = F.transform(tokens, lambda t: F.xxhash64(t))
    of = lambda w: F.aggregate(bits, F.lit(0).cast("long"), lambda x, h: F.when(F.pmod(F.shiftrightunsigned(h, 6), F.lit(WORDS)) == w, x.bitwiseXOR(_bit(h))).otherwise(x))
    return [of(w).alias(f"bits{w}") for w in range(WORDS)]


def _bit(h: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63).cast("long")).cast("int"))


def prefix_lists(sets: DataFrame, share: float) -> DataFrame:
    """token, node, n (size of its set), place (of the token in its order, from 1), bits: prefixes, as far as another set has the token; written."""
    # in a step of its own: beside explode it would be computed for each token
    known = sets.select("node", F.size("set").alias("n"), *_parities(F.col("set")), "set")
    each = known.select("node", *ENTRY[1:2], *ENTRY[3:], F.explode("set").alias("token"))
    held = written(each.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"))
    order = Window.partitionBy("node").orderBy(F.coalesce("df", F.lit(1)), "token")
    placed = each.join(small_side(held), "token", "left").withColumn("place", F.row_number().over(order))
    return written(placed.where((F.col("place") <= F.col("n") - F.ceil(share * F.col("n") - 1e-9) + 1) & F.col("df").isNotNull()).select("token", *ENTRY))


def _side(lists: DataFrame, name: str, *more: str) -> DataFrame:
    return lists.select("token", *[F.col(c).alias(f"{c}_{name}") for c in (*ENTRY, *more)])


def possible(share: float, jaccard: bool = True) -> Column:
    """Whether two entries of a list, in the columns of sides a and b, may be the first common tokens of similar sets."""
    need = share / (1 + share) * (F.col("n_a") + F.col("n_b")) if jaccard else share * F.col("n_a")
    differ = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"bits{w}_a").bitwiseXOR(F.col(f"bits{w}_b"))) for w in range(WORDS)])
    in_time = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b")) + 1 >= need - 1e-9
    return in_time & (differ <= F.col("n_a") + F.col("n_b") - 2 * need + 1e-9)


def _pairs(met: DataFrame) -> DataFrame:
    return met.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def candidate_pairs(lists: DataFrame, share: float, jaccard: bool = True) -> DataFrame:
    """All pairs (a, b), a < b, that can be similar."""
    return _pairs(_side(lists, "a").join(_side(lists, "b"), "token").where((F.col("node_a") < F.col("node_b")) & possible(share, jaccard)))


def connecting_links(lists: DataFrame, verified: Callable[[DataFrame], DataFrame], share: float, jaccard: bool = True, rounds: int = ROUNDS) -> DataFrame:
    """Links (a, b) with exactly the components of all links; verified(pairs a, b) gives the similar ones.

    First one member of each list is compared with all members that are not yet connected with it, again and again, so that
    a list of near copies costs rows in proportion to its length. Then all pairs of a list that
    are still in different components are compared, so nothing is missed.
    """
    found: list[DataFrame] = []
    members = written(lists.withColumn("root", F.col("node")))
    for k in range(rounds + 1):
        mixed = written(members.groupBy("token").agg(F.min("root").alias("lowest"), F.max("root").alias("_highest")).where("lowest < _highest").drop("_highest"))
        if mixed.isEmpty():
            break
        here = written(members.join(small_side(mixed), "token"))
        if k < rounds:
            # more heads in each step, from different components; by node alone, so that alike lists mostly name the same ones
            slot = F.pmod(F.xxhash64("root", F.lit(k)), F.lit(MORE_HEADS**k))
            heads = here.groupBy("token", slot.alias("slot")).agg(F.min_by(F.struct(*ENTRY, "root"), F.struct(F.xxhash64("node", F.lit(k)), F.col("node"))).alias("h")).select("token", "h.*")
            met = _side(heads, "a", "root").join(_side(here, "b", "root"), "token").where(F.col("root_a") != F.col("root_b"))
        else:
            met = _side(here, "a", "root").join(_side(here, "b", "root"), "token").where("root_a < root_b")
        met = _pairs(met.where(possible(share, jaccard)))
        found.append(written(verified(met)))
        if k < rounds:
            roots = written(components(reduce(DataFrame.union, found)))
            members = written(lists.join(small_side(roots), "node", "left").select("token", *ENTRY, F.coalesce("root", "node").alias("root")))
    return reduce(DataFrame.union, found).distinct() if found else lists.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)


def reached(lists: DataFrame, others: DataFrame, verified: Callable[[DataFrame], DataFrame], share: float, jaccard: bool = True, rounds: int = ROUNDS) -> DataFrame:
    """node: those of `others` that are similar to some node of `lists`; verified(pairs: a of lists, b of others) gives the similar ones.

    As in connecting_links, some members of a list are tried first; who is still unmatched meets all of them.
    """
    found: list[DataFrame] = []
    left = written(others)
    for k in range(rounds + 1):
        heads = lists if k == rounds else lists.groupBy("token").agg(F.min_by(F.struct(*ENTRY), F.struct(F.xxhash64("node", F.lit(k)), F.col("node"))).alias("h")).select("token", "h.*")
        met = _side(heads, "a").join(_side(left, "b"), "token").where(possible(share, jaccard)).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()
        found.append(written(verified(met).select(F.col("b").alias("node")).distinct()))
        left = written(left.join(small_side(found[-1]), "node", "left_anti"))
        if left.isEmpty():
            break
    return reduce(DataFrame.union, found).distinct()


def earlier_kept(links: DataFrame) -> DataFrame:
    """node: those dropped when nodes are taken in order and one is dropped if it is linked to an earlier one that was kept.

    links: (a, b) with a < b. A node is decided once all earlier neighbours are, so rounds are as many as the longest chain of undecided ones.
    """
    open_links = written(links.select("a", "b").where("a < b").distinct())
    dropped: list[DataFrame] = []
    while not open_links.isEmpty():
        kept = open_links.select(F.col("a").alias("node")).join(open_links.select(F.col("b").alias("node")), "node", "left_anti").distinct()
        kept = written(kept)  # all earlier neighbours of these are dropped or none were
        gone = written(open_links.join(small_side(kept), F.col("a") == F.col("node"), "left_semi").select(F.col("b").alias("node")).distinct())
        dropped.append(gone)
        decided = small_side(written(kept.union(gone)))
        # links from dropped nodes no longer count, links to decided nodes need not
        open_links = written(open_links.join(decided, F.col("a") == F.col("node"), "left_anti").join(decided, F.col("b") == F.col("node"), "left_anti"))
    return reduce(DataFrame.union, dropped).distinct() if dropped else links.select(F.col("b").alias("node")).limit(0)


def overlaps(rows: DataFrame, items: DataFrame) -> DataFrame:
    """node, item, shared, n, m: sizes of the intersection and of both sets, of all pairs that share a token, summed from shared tokens alone.

    rows (node, set) and items (item, set) have arrays without repeats of tokens of one type.
    """
    theirs = written(items.select("item", F.size("set").alias("m"), F.explode("set").alias("token")))
    ours = rows.select("node", F.size("set").alias("n"), F.explode("set").alias("token"))
    return ours.join(small_side(theirs), "token").groupBy("node", "item").agg(F.count("*").alias("shared"), F.first("n").alias("n"), F.first("m").alias("m"))
