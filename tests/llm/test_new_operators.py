"""Operators 11 to 13 against brute force on small fixtures, and their defined cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from corpusmill.llm import best_fit, lexical, prefix_trie
from corpusmill.llm.queries import tokenizer_path

TURNS = "conv_id long, turn long, role string, text string, key string, base long"


def slow_trie(rows):
    convs = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = convs.get(c - int(math.fmod(c, 100)), [])[:h] + own[h:]
    members = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    out = []
    for node, own in members.items():
        below = [x for x in members if x[: len(node)] == node]
        leaves = [x for x in below if not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in members)]
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x)
        ends = ",".join(str(c) for c in own if len(built[c]) == len(node))
        children = sum(len(y) == len(node) + 1 and y[: len(node)] == node for y in members)
        out.append((own[0], len(node), members[node[:-1]][0] if node else None, len(own), children, len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def trie_of(spark, rows, **options):
    found = prefix_trie.trie(spark.createDataFrame(rows, TURNS), **options).drop("key")
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in found.collect()), key=repr)


@pytest.mark.parametrize("family", [20_000, 30, 0])
def test_trie_against_brute_force(spark, family):
    r = random.Random(family)
    rows = []
    for c in [*range(0, 40), *range(100, 130), 205, 207, 300, 399, -1, -150, -100]:
        for turn in range(r.randint(1, 8)):
            rows.append((c, r.choice([turn, turn, None]), r.choice(["user", "user", None]), r.choice(["", "a", "bb", "día", None]) if turn > 1 else "hi", "k", 1))
    rows += [(100, 1, "user", "x" * 50_000, None, None), (100, 1, "user", "x" * 50_000, None, None), (None, 0, "user", "lost", None, None), (205, None, None, None, None, None)]
    assert trie_of(spark, rows, family=family) == slow_trie(rows)


def test_trie_of_one_long_and_many_equal_conversations(spark):
    rows = [(7, k, "user", str(k % 3), None, None) for k in range(60)] + [(c, k, "user", "same", None, None) for c in range(200, 420) for k in range(3)]
    assert trie_of(spark, rows, family=50) == slow_trie(rows)
    assert trie_of(spark, [], family=50) == []


# -- best fit


def slow_best_fit(lengths, size):
    """Best fit, longest first, piece by piece: the number of sequences."""
    rooms: list[int] = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, room in enumerate(rooms) if room >= n]
        if fits:
            rooms[min(fits, key=lambda k: rooms[k])] -= n
        else:
            rooms.append(size - n)
    return len(rooms)


@pytest.mark.parametrize("seed", range(12))
def test_plan_is_best_fit(seed):
    r = random.Random(seed)
    size = r.choice([1, 7, 64, 1024])
    lengths = [min(size, 1 + int(r.expovariate(3 / size))) for _ in range(r.choice([0, 1, 50, 900]))]
    counts = Counter(lengths)
    ranges, n = best_fit.plan(counts, size)
    assert n == slow_best_fit(lengths, size)
    taken = defaultdict(list)
    for length, many in counts.items():
        starts = [x[0] for x in ranges[length]]
        assert starts == sorted(starts) and starts[0] == 0
        for rank in range(many):
            first, sequence, each, at = next(x for x in reversed(ranges[length]) if x[0] <= rank)
            k = rank - first
            taken[sequence + k // each].append((at + k % each * length, length))
    assert set(taken) == set(range(n))
    for slots in taken.values():
        end = 0
        for at, length in sorted(slots):
            assert at == end
            end += length
        assert end <= size


def test_plan_is_bounded():
    counts = {n: 10**9 + 7 * n for n in range(1, 1025)}
    ranges, n = best_fit.plan(counts, 1024)
    assert sum(map(len, ranges.values())) < 135_000
    assert n >= sum(k * v for k, v in counts.items()) / 1024


@pytest.mark.parametrize("length", [16, 1024])
def test_best_fit(spark, length):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    library.no_truncation()
    r = random.Random(length)
    texts = [None, "", "", " ".join(r.choice("one two three four".split()) for _ in range(4_000)), *(" ".join(["word"] * r.randint(0, 60)) for _ in range(150))]
    rows = [(k // 2 if k else None, t, "x", 1) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string, block long").repartition(3)
    packed = best_fit.pack(docs, tokenizer_path(), length=length, tokens=True)
    assert packed.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids"]
    found = [x.asDict() for x in packed.collect()]
    want = Counter()
    for doc_id, text, *_ in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        at, k = 0, 0
        while at < len(ids):
            n = (len(ids) % length or length) if k == 0 else length
            want[doc_id, k, at, tuple(ids[at : at + n])] += 1
            at, k = at + n, k + 1
    assert Counter((x["doc_id"], x["piece"], x["start"], tuple(x["ids"])) for x in found) == want
    for x in found:
        assert x["length"] == len(x["ids"]) and x["ids_crc32"] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in x["ids"]))
    by = defaultdict(list)
    for x in found:
        by[x["sequence_id"]].append((x["offset"], x["length"]))
    assert len(by) == slow_best_fit([x["length"] for x in found], length)
    for slots in by.values():
        assert [a for a, _ in sorted(slots)] == [sum(n for _, n in sorted(slots)[:k]) for k in range(len(slots))]
    whole = best_fit.sequences(packed).collect()
    assert len(whole) == len(by) and all(len(x["ids"]) == sum(x["lengths"]) <= length for x in whole)
    assert best_fit.pack(docs.limit(0), tokenizer_path(), length=length).collect() == []


# -- lexical search


def slow_search(docs, items, k):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(fold))
    counts = [(d, Counter(words(t))) for d, t, *_ in docs]
    big_n, big_l = sum(bool(c) for _, c in counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    wanted = defaultdict(set)
    for i, t, *_ in items:
        wanted[i] |= set(words(t))
    out = []
    for i, own in wanted.items():
        scored = []
        for d, c in counts:
            m = 100 - 90 + (90 * c.total() * big_n) // max(1, big_l)
            s = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in own if c[t])
            if s > 0:
                scored.append((-s, d is not None, d or 0, d))
        out += [(i, rank + 1, x[3], -x[0]) for rank, x in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_search_against_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(lexical, "HEAD", 3)  # bounds that aren't exact, so that all three phases have work
    monkeypatch.setattr(lexical, "LOOKED_UP", 3)
    monkeypatch.setattr(lexical, "ASKED", 4)
    monkeypatch.setattr(lexical, "PART", 20)
    r = random.Random(seed)
    vocabulary = [f"W{k}é" if k % 3 else f"w{k}" for k in range(60)]
    text = lambda n: "-".join(r.choices(vocabulary, [1 / (k + 1) for k in range(60)], k=n))
    docs = [(k, text(r.randint(0, 60)), "a", 1, None) for k in range(300)] + [(k, None if k % 2 else "", "a", 1, None) for k in (900, 901)]
    docs += [(700 + k, "w0 w3 W7é copy", "a", 1, "t") for k in range(25)] + [(None, "w3 w6 null", "a", 1, None), (700, "w0 w3 W7é copy", "a", 1, None), (800, text(3_000), "a", 1, None)]
    items = [(k, text(r.randint(1, 25)), "b") for k in range(20)] + [(20, "w0 w3 copy", "b"), (21, "nowhere", "b"), (22, None, "b"), (23, "...", "b"), (None, "w3 null", "b"), (20, "w6", "b")]
    found = lexical.search(spark.createDataFrame(docs, "doc_id long, text string, item string, n long, term string").repartition(5), spark.createDataFrame(items, "item_id long, text string, term string"))
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(x) for x in found.collect()), key=repr) == slow_search(docs, items, 10)


def test_search_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical.search(docs.limit(0), items).collect() == [] and lexical.search(docs, items.limit(0)).collect() == []
