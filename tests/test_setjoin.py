"""Set-similarity joins against brute force: all pairs, components, reach and greedy order."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import dedup, setjoin
from corpusmill.operators.graph import components

SHARE = 0.8


def families(seed, n):
    """Sets in one crowd that all share a passage, some of them near copies of each other, some drifting."""
    r = random.Random(seed)
    passage = list(range(30))
    sets = []
    for k in range(n // 5):
        own = [1_000 * (k + 1) + j for j in range(r.choice([8, 30]))]
        for v in range(5):
            kept = [t for t in passage + own if r.random() > r.choice([0.0, 0.05, 0.15])]
            sets.append(kept + [10**6 + 100 * len(sets) + j for j in range(r.randint(0, 4))])
    return {k: sorted(set(s)) for k, s in enumerate(sets)}


def similar(sets):
    return {(a, b) for a in sets for b in sets if a < b and len(x := set(sets[a])) and len(x & (y := set(sets[b]))) >= SHARE * len(x | y)}


def roots(nodes, links):
    root = {n: n for n in nodes}
    for _ in nodes:
        before = dict(root)
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
        if root == before:
            break
    return root


@pytest.mark.parametrize("seed", range(2))
def test_pairs_and_components_in_a_crowd_of_a_thousand(spark, seed):
    sets = families(seed, 1_000)
    want = similar(sets)
    frame = spark.createDataFrame(list(sets.items()), "node long, set array<long>").repartition(4)
    compared = []

    def verified(pairs):
        compared.append(pairs.count())
        left, right = (frame.select(F.col("node").alias(x), F.col("set").alias(f"s{x}")) for x in "ab")
        both = F.size(F.array_intersect("sa", "sb"))
        return pairs.join(left, "a").join(right, "b").where(both >= SHARE * (F.size("sa") + F.size("sb") - both)).select("a", "b")

    lists = setjoin.prefix_lists(frame, SHARE)
    assert {tuple(x) for x in verified(setjoin.candidate_pairs(lists, SHARE)).collect()} == want
    compared.clear()
    links = setjoin.connecting_links(lists, verified, SHARE)
    found = {tuple(x) for x in links.collect()}
    assert found <= want and sum(compared) < len(sets) * len(sets) / 8
    truth = roots(sets, want)
    nodes = {x.node: x.root for x in components(links).collect()}
    assert {k: nodes.get(k, k) for k in sets} == truth


def test_nothing_similar_stays_linear(spark):
    """Texts that share a passage of 70 % meet in no list."""
    sets = {k: [*range(70), *range(1_000 * (k + 1), 1_000 * (k + 1) + 30)] for k in range(500)}
    frame = spark.createDataFrame(list(sets.items()), "node long, set array<long>")
    assert setjoin.prefix_lists(frame, SHARE).count() == 0


def test_reached_and_greedy(spark):
    sets = families(5, 300)
    want = similar(sets)
    frame = spark.createDataFrame(list(sets.items()), "node long, set array<long>")
    lists = setjoin.prefix_lists(frame, SHARE)
    hold = spark.createDataFrame([*want, (-1, -1)], "a long, b long")
    verified = lambda pairs: pairs.join(hold.union(hold.select("b", "a")).distinct(), ["a", "b"], "left_semi")
    found = {x.node for x in setjoin.reached(lists.where("node % 3 = 0"), lists.where("node % 3 <> 0"), verified, SHARE).collect()}
    assert found == {y for x, z in want for y, o in ((x, z), (z, x)) if y % 3 and o % 3 == 0}
    kept = []
    for k in sets:
        if not any((o, k) in want for o in kept):
            kept.append(k)
    dropped = {x.node for x in setjoin.earlier_kept(spark.createDataFrame([*want], "a long, b long")).collect()}
    assert dropped == set(sets) - set(kept)
    assert setjoin.earlier_kept(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("pairs", [2, 1_000])
def test_bucket_links_are_whole(spark, pairs):
    """One crowd in a band: every pair that shares a band and agrees enough is found, whatever the bucket's size."""
    r = random.Random(3)
    base = [r.randrange(1 << 30) for _ in range(128)]
    signed = {}
    for k in range(150):
        own = signed[r.randrange(len(signed))] if k and r.random() < 0.6 else base
        signed[k] = [v if j < 8 or r.random() > 0.12 else r.randrange(1 << 30) for j, v in enumerate(own)]
    want = {(a, b) for a in signed for b in signed if a < b and sum(x == y for x, y in zip(signed[a], signed[b], strict=True)) >= SHARE * 128}
    frame = spark.createDataFrame(list(signed.items()), "node long, signature array<long>")
    assert len(want) > 50 and {(x.a, x.b) for x in dedup.bucket_links(frame, SHARE, pairs).collect()} == want


def test_a_chain_keeps_what_is_far_from_the_first(spark):
    """Of three texts in a chain the middle one goes: the last is near a dropped text alone."""
    words = [f"word{k}" for k in range(160)]
    texts = [" ".join(words), " ".join([*words[:-8], *[f"b{k}" for k in range(8)]]), " ".join([*[f"c{k}" for k in range(12)], *words[12:-8], *[f"b{k}" for k in range(8)]])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    links = {(x.first_id, x.id) for x in dedup.near_duplicates(docs).collect()}
    left = sorted(x.doc_id for x in dedup.drop_near_copies(docs).collect())
    assert left == ([0, 2] if links == {(0, 1), (1, 2)} else [0]) and links >= {(0, 1)}


def test_nearest_items_of_empty_texts(spark):
    rows = spark.createDataFrame([(0, ""), (1, None), (2, "abcdef"), (3, "zzz")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "abcdef"), (5, ""), (9, "")], "item_id long, text string")
    found = {x.doc_id: (x.most, round(x["mean"], 9), x.nearest) for x in dedup.nearest_items(rows, items).collect()}
    assert found == {0: (1.0, round((0.5 + 1 + 1) / 3, 9), 5), 1: (1.0, round((0.5 + 1 + 1) / 3, 9), 5), 2: (1.0, round(2 / 3, 9), 7), 3: (0.5, 0.5, 5)}
    assert dedup.nearest_items(rows, items.limit(0)).count() == 0


def test_parities_are_computed_once_for_a_set(spark, monkeypatch):
    """Not once for each of its tokens, which takes a set's length squared."""
    plans, write = [], setjoin.written
    monkeypatch.setattr(setjoin, "written", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString().splitlines()) or write(df))
    sets = spark.createDataFrame([(1, [1, 2, 3]), (2, [2, 3, 4])], "node long, set array<long>")
    setjoin.prefix_lists(sets, SHARE)
    for plan in plans:
        exploded = [k for k, line in enumerate(plan) if "Generate explode" in line]
        assert exploded and all(k > exploded[-1] for k, line in enumerate(plan) if "aggregate(transform(" in line)
    assert any("aggregate(transform(" in line for plan in plans for line in plan)
