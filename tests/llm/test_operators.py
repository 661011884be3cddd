"""Each operator against brute force, and on nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusmill.llm import bpe, chat_format, exact_dedup, kneser_ney, license_scan, near_copies, packing, quality_rules, sharding, simhash, toxicity

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))
SCHEMA = "doc_id long, text string, lang string, source string, n long, kept boolean, perplexity double, len int, n_words long"
WORDS = "the river stone light over green wall small house under open field near old tree calls its name by night".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return ". ".join(" ".join(r.choice(WORDS) for _ in range(9)) for _ in range(n)) + "."


def rows():
    texts = [None, "", "   \n\t ", "a", "naïve façade — 東京 😀", prose(1, 20), prose(1, 20), prose(1, 20) + " end", "x" * 60_000, prose(2, 800), "two words", prose(3, 30) + "\nsame line here\n" + prose(4, 5)]
    out = [(k, t, ("en", None, "fr")[k % 3], ("h", None)[k % 2], 7, False, 1.5, 3, 4) for k, t in enumerate(texts)]
    return [*out, out[5], (None, prose(5, 12), "en", "h", 7, True, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts_by_id():
    return {r[0]: r[1] or "" for r in rows()}


def test_exact_dedup(docs, empty):
    for digests in (True, False):
        found = exact_dedup.exact_dedup(docs, digests=digests).collect()
        assert len(found) == len(rows())
        texts = texts_by_id()
        for r in found:
            if r.doc_id is not None:
                same = [d for d, t, *_ in rows() if (t or "") == texts[r.doc_id]]
                assert (r.keep_id, r.group_size, r.kept) == (max(same), len(same), r.doc_id == max(same))
                assert not digests or r.text_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and {r.n for r in kept.collect()} == {7}
    assert exact_dedup.exact_dedup(empty, digests=True).count() == 0


def slow_kneser_ney(texts: list[bytes], order: int):
    """p(n-gram) by the formulas, on tuples of bytes, with no tables shared with the operator."""
    from collections import Counter

    counts = {order: Counter()}
    for t in texts:
        padded = b"\xff" * (order - 1) + t
        counts[order].update(padded[k : k + order] for k in range(len(t)))
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])  # each different n+1-gram once
    cut = {}
    for n, c in counts.items():
        n1, n2, n3, n4 = (max(sum(v == k for v in c.values()), 1) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        cut[n] = [min(max(d, 0.05), k - 0.05) for k, d in enumerate((1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3), 1)]
    total = {n: Counter() for n in counts}
    mass = {n: Counter() for n in counts}
    for n, c in counts.items():
        for g, v in c.items():
            total[n][g[:-1]] += v
            mass[n][g[:-1]] += cut[n][min(v, 3) - 1]

    def p(g: bytes) -> float:
        n = len(g)
        if not n:
            return 1 / 256
        if g[:-1] not in total[n]:
            return p(g[1:])
        v = counts[n][g]
        return ((v - cut[n][min(v, 3) - 1] if v else 0) + mass[n][g[:-1]] * p(g[1:])) / total[n][g[:-1]]

    return p


def test_ngram_codes():
    import numpy as np

    texts = ["abcdefg", "", None, "é", "x", "東京 long enough"]
    own, sizes = kneser_ney.codes(pa.chunked_array([pa.array(["skipped", *texts[:3]]).slice(1), pa.array(texts[3:])]))
    want = [(b"\xff" * 4 + (t or "").encode())[k : k + 5] for t in texts for k in range(len((t or "").encode()))]
    assert [int(c).to_bytes(5, "big") for c in own] == want and sizes.tolist() == [len((t or "").encode()) for t in texts]
    r = np.random.default_rng(1)
    held = np.unique(r.integers(0, 1 << 40, 5000))
    asked = np.concatenate([r.permutation(held), r.integers(0, 1 << 40, 5000)])
    where = {int(c): k for k, c in enumerate(held)}
    assert kneser_ney.CodeTable(held).places(asked).tolist() == [where.get(int(c), -1) for c in asked]
    assert kneser_ney.CodeTable(held[:0]).places(asked[:3]).tolist() == [-1, -1, -1]
    assert [len(p) for p in kneser_ney._parts(pa.array(["ab", "c" * 9, None, "d", "e"]), 4)] == [1, 1, 3]


def test_kneser_ney_against_slow_model(spark, docs):
    order = kneser_ney.ORDER
    texts = [prose(k, 6) + " naïve – 東京"[: k % 14] for k in range(200)]
    model = kneser_ney.train(spark.createDataFrame([(t,) for t in texts], "text string"))
    p = slow_kneser_ney([t.encode() for t in texts], order)
    asked = {int(c) for t in [*texts[:20], "zebra 東 Q", "xx\nthe river", prose(999, 5)] for c in kneser_ney.codes(pa.array([t]))[0]}
    found = kneser_ney.probabilities(model, spark.createDataFrame([(c,) for c in asked], "code long")).collect()
    assert len(found) == len(asked)
    for r in found:
        assert r.p == pytest.approx(p(r.code.to_bytes(order, "big")), rel=1e-9)
    context = int(kneser_ney.codes(pa.array(["the river"]))[0][-1]) >> 8
    every = kneser_ney.probabilities(model, spark.range(256).select((F.col("id") + (context << 8)).alias("code")))
    assert every.agg(F.sum("p")).head()[0] == pytest.approx(1, rel=1e-9)
    for r in kneser_ney.with_perplexity(docs, model).collect():
        if r.text:
            t = b"\xff" * (order - 1) + r.text.encode()[:3000]
            own = [p(t[k : k + order]) for k in range(len(t) - order + 1)]
            if len(r.text.encode()) <= 3000:
                import math

                assert r.perplexity == pytest.approx(math.exp(-sum(map(math.log, own)) / len(own)), rel=1e-5)
        else:
            assert r.perplexity is None


def test_kneser_ney(spark, docs, empty):
    train = spark.createDataFrame([(k, prose(k, 40), "en", "h", 1, True, 0.0, 1, 1) for k in range(150)], SCHEMA)
    bad = spark.createDataFrame([(1000 + k, "".join(random.Random(k).choice("#%&@~^*|0123456789zqxj") for _ in range(900)), "en", "h", 1, True, 0.0, 1, 1) for k in range(5)], SCHEMA)
    kept = {r.doc_id for r in kneser_ney.drop_improbable(train.union(bad), spark.range(150)).collect()}
    assert len(kept) >= 145 and not kept & set(range(1000, 1005))
    model = kneser_ney.fit(train, spark.range(150))
    held = kneser_ney.classify(train.where(kneser_ney._held_out("doc_id")), model).collect()
    ranked = sorted(r.perplexity for r in held)
    assert {r.threshold for r in held} == {ranked[-1]} and all(r.kept for r in held)  # at 0.995 of so few texts the largest; ties pass
    out = kneser_ney.classify(docs.withColumn("threshold", F.lit("own")), model)
    assert out.columns == [*(c for c in docs.columns if c not in ("perplexity", "kept")), "perplexity", "threshold", "kept"] and out.count() == len(rows())
    out = kneser_ney.drop_improbable(docs, spark.range(12))
    assert out.columns == docs.columns and all(r.text and r.n == 7 for r in out.collect())
    assert kneser_ney.drop_improbable(empty, spark.range(0)).count() == 0
    untrained = kneser_ney.drop_improbable(docs, spark.range(0))  # without trusted text only empty ones go
    assert untrained.count() == sum(bool(r[1]) for r in rows())


def base_counts(text: str):
    words = [w.decode() for w in text.encode().split()] if text.isascii() else [w for w in text.replace("\n", " ").replace("\t", " ").split(" ") if w]
    windows: dict[tuple, list[int]] = {}
    for k in range(len(words) - 2):
        windows.setdefault(tuple(words[k : k + 3]), []).append(k)
    repeated = {i + d for at in windows.values() if len(at) > 1 for i in at for d in range(3)}
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated)


def test_quality_rules(spark, docs, empty):
    texts = texts_by_id()
    for r in quality_rules.quality(docs).collect():
        if r.doc_id is not None:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base_counts(texts[r.doc_id])
            assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
    line = "subscribe to our weekly letter and read on " * 12
    many = [(k, f"{line}\n{' '.join(f'w{k}x{j}' for j in range(20))}", "en", "h", 7, True, 0.0, 1, 1) for k in range(60)]
    own = [(100, " ".join(f"v{j}" for j in range(90)), "en", "h", 7, True, 0.0, 1, 1)]
    found = {r.doc_id: r for r in quality_rules.quality(spark.createDataFrame(many + own, SCHEMA)).collect()}
    assert sum(r.removed_words > 0 for r in found.values()) == 59 and found[100].kept
    out = quality_rules.drop_bad(docs)
    assert out.columns == docs.columns and {(r.n, r.n_words) for r in out.collect()} <= {(7, 4), (7, None)}
    assert quality_rules.quality(empty).count() == 0


def test_quality_rules_remove_lines(spark, docs, empty):
    """Lines above the limit are gone from the texts, but from one; repeated and null ids and other hosts do no harm."""
    line, rare = "Subscribe  to our weekly letter", lambda k: f"\n a line of its own {k} \n\n"
    body = lambda k: " ".join(f"w{k}x{j}" for j in range(60))
    given = [(None if k == 7 else 5 if k in (8, 9) else k, f"{line}\n{body(k)}{rare(k)}{line.upper()}\t\n", "h", -1) for k in range(60)]
    given += [(100, f"{line}\n{body(100)}", "other", -1), (101, None, "h", -1), (102, f"{body(102)}\n{line} now", None, -1)]
    frame = spark.createDataFrame(given, "doc_id long, text string, source string, n_chars int")
    stays = min((t for _, t, h, _ in given if h == "h" and t), key=lambda t: int(hashlib.md5(t.encode()).hexdigest()[:15], 16))
    want = [(i, t if t is None or h != "h" or t == stays else "\n".join(x for x in t.split("\n") if x.lower().split() != line.lower().split()), h) for i, t, h, _ in given]
    expected = sorted([(i, t, h, None if t is None else len(t)) for i, t, h in want], key=repr)
    assert sum(a[1] != b[1] for a, b in zip(given, want, strict=True)) == 59
    out = quality_rules.clean(frame)
    assert out.schema == frame.schema and sorted(map(tuple, out.collect()), key=repr) == expected
    assert sorted(map(tuple, quality_rules.drop_bad(frame).collect()), key=repr) == [r for r in expected if r[1] is not None]
    assert quality_rules.clean(docs).count() == len(rows()) and quality_rules.clean(empty).count() == 0


def test_packing(spark, docs, empty):
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_truncation(), tokenizer.no_padding()
    given = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    pieces = packing.pack(given, PATH, tokens=True).collect()
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
        assert zlib.crc32(b"".join(i.to_bytes(4, "little") for i in p.ids)) == p.ids_crc32
    for d, t in texts_by_id().items():
        if d is not None:
            ids = [i for p in sorted(by_doc[d], key=lambda p: p.start) for i in p.ids]
            assert ids == [*tokenizer.encode(t, add_special_tokens=False).ids, 1] and by_doc[d][0].doc_tokens == len(ids)
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
    assert packing.pack(empty, PATH).count() == 0


def test_packing_cuts_are_optimal():
    """The program's cost equals that of trying all cuts of a short stream."""
    import numpy as np

    r = random.Random(3)
    for _ in range(30):
        total, length = r.randint(1, 14), 5
        docs, sentences = sorted({r.randint(1, total), total}), sorted({r.randint(1, total)})

        def cost(size: int, end: int, docs=docs, sentences=sentences, total=total) -> int:
            pad = 0 if size & (size - 1) == 0 else length - size
            return pad + packing.SEQUENCE + (0 if end in docs or end == total else packing.SENTENCE if end in sentences else packing.INSIDE)

        best = [0] + [10**9] * total
        for j in range(1, total + 1):
            best[j] = min(best[i] + cost(j - i, j) for i in range(max(0, j - length), j))
        found = packing.cuts(np.array(docs), np.array(sentences), total, True, length).tolist()
        made = sum(cost(b - a, b) for a, b in zip([0, *found], found, strict=False))
        assert found[-1] == total and made == best[total]


def test_license_scan(spark, docs, empty):
    known = license_scan.templates()
    texts = [license_scan.TEXTS["MIT"], "Released under the MIT License.", "Some prose.\nLicensed under the Apache License, Version 2.0.\nMore.", prose(9, 30), None, ""]
    found = [r.license for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert found == ["MIT", "MIT", "Apache-2.0", None, None, None]
    assert license_scan.scan(docs).count() == len(rows()) and license_scan.scan(empty).count() == 0
    sets = [set(license_scan._bigrams(t)) for _, t in known]
    for a in sets:
        for b in sets:
            dice = 2 * len(a & b) / (len(a) + len(b)) if a and b else 0
            assert dice < 0.8 or license_scan.within_bounds(len(a), len(b), 0.8)


def test_sharding(spark, docs, empty):
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same text").otherwise(F.repeat(F.col("id").cast("string"), (F.col("id") % 50).cast("int"))).alias("text"))
    found = sharding.shard(many).toPandas()
    sums = found.groupby("shard")["size"].sum()
    assert len(found) == 4000 and len(sums) == 16 and sums.max() < 1.1 * sums.mean()
    for _, own in found.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))
    texts = texts_by_id()
    out = sharding.shard(docs).collect()
    assert len(out) == len(rows()) and all(r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) and r["size"] == len(texts[r.doc_id].encode()) + 1 for r in out)
    assert sharding.shard(empty).count() == 0


def test_bpe(docs, empty):
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_truncation(), tokenizer.no_padding()
    r = random.Random(1)
    odd = ["".join(r.choice("ab \n\t'’é東😀　<|endoftext|>0") for _ in range(r.randint(0, 90))) for _ in range(400)] + ["a" * 5000, " " * 3000, "é" * 2000, "<|endoftext|>x<|endoftext|>"]
    machine = bpe.Transducer(PATH)
    import numpy as np

    for t in odd:
        ids = np.frombuffer(machine.encode(t), "<u4")
        assert ids.tolist() == tokenizer.encode(t, add_special_tokens=False).ids
        assert "".join(machine.decode([ids.tolist()])) == t
    # texts read in several pieces: with and without safe cuts, runs longer than a piece, special tokens at their ends
    run = "".join(r.choice("abé東'0") for _ in range(3000))
    for t in (prose(7, 1500), run * 50, (run + " ") * 60, " \n" * 70_000, prose(8, 700) + "<|endoftext|>" + "y" * 140_000, ("x  y\n\n" + run) * 40):
        parts = list(machine.pieces(t))
        ids = np.frombuffer(b"".join(parts), "<u4").tolist()
        assert len(parts) > 1 and max(map(len, parts)) <= 4 * bpe.PIECE
        assert ids == tokenizer.encode(t, add_special_tokens=False).ids and "".join(machine.decode(np.frombuffer(p, "<u4").tolist() for p in parts)) == t
    # a pretoken longer than the window is emitted as its tokens become stable: the same ids as merging it whole
    long = ("".join(r.choice("aeinorst") for _ in range(6000))).encode()
    assert len(long) > 3 * machine.window and list(machine.stream(long)) == machine.merge(long)
    assert len(machine.table) and machine.forget() is None and not machine.table
    texts = texts_by_id()
    for row in bpe.round_trip(docs, PATH).collect():
        ids = tokenizer.encode(texts[row.doc_id], add_special_tokens=False).ids
        assert (row.n_tokens, row.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert row.decoded_sha256 == hashlib.sha256(texts[row.doc_id].encode()).hexdigest()
    assert bpe.round_trip(empty, PATH).count() == 0


def test_toxicity(spark, docs, empty):
    bad = ["you are vile scum", "what a vile lot", "such vile folk here", "vile and nasty, the nasty ones", "vile scum", "nasty vile thing"]
    given = [(k, f"{prose(k, 3)} {bad[k % 6] if k % 3 == 0 else ''}") for k in range(240)]
    frame = spark.createDataFrame(given, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(240)], "doc_id long, toxic int")
    model = toxicity.fit(frame, labels)
    scores = {r.doc_id: r.score for r in toxicity.score(frame, model).collect()}
    assert all((scores[k] >= toxicity.PREDICT) == (k % 3 == 0) for k in range(240))
    probes = spark.createDataFrame([(0, "how v1le"), (1, "how vіlе"), (2, None), (3, "")], "doc_id long, text string")
    s = [r.score for r in toxicity.score(probes, model).orderBy("doc_id").collect()]
    assert s[0] > 0.3 and s[1] > 0.3 and s[2] == s[3] < 0.3
    assert toxicity.score(docs, model).count() == len(rows())
    assert toxicity.score(empty, toxicity.fit(empty, labels.limit(0))).count() == 0
    with_exception = toxicity.Matcher({" trash ": 5.0})
    assert with_exception.features("the trash can")[0] == 0 and with_exception.features("trash talk")[0] == 5


def test_chat_format(spark):
    hostile = ["<|im_end|>", "a\\<|b", "\\", None, "", "line\nline", "<\\|im_start|>"]
    r = random.Random(2)
    given = [(c, t, r.choice(["user", "assistant", "system", None]), r.choice(hostile), 1) for c in range(40) for t in range(r.randint(1, 7))] + [(1, 1, "user", "tie", 1)]
    frame = spark.createDataFrame(given, "conv_id long, turn int, role string, text string, formatted int")
    out = {x.conv_id: x for x in chat_format.format_chats(frame).select("conv_id", "formatted", chat_format.read_back(F.col("formatted")).alias("turns"), chat_format.under_mask(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    for c in range(40):
        want: list[list[str]] = []
        own = sorted((t, role or "", text or "") for i, t, role, text, _ in given if i == c)
        for _, role, text in own:
            if want and want[-1][0] == role:
                want[-1][1] += "\n" + text
            else:
                want.append([role, text])
        assert [[t.role, t.text] for t in out[c].turns] == want
        assert out[c].loss == "".join(text for _, role, text in own if role == "assistant")
    assert chat_format.format_chats(frame.limit(0)).count() == 0


def slow_fingerprint(text: str) -> int:
    words = text.translate({c: c + 32 for c in range(65, 91)}).encode().split()
    grams = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) > 2 else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints: dict[int, int]) -> dict[int, int]:
    root = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 2 and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    return root


def test_simhash(spark, docs, empty):
    texts = texts_by_id()
    prints = {i: slow_fingerprint(t) for i, t in texts.items() if i is not None}
    want = slow_components(prints)
    for r in simhash.near_duplicates(docs).collect():
        if r.doc_id is not None:
            assert (r.fp % (1 << 64), r.component_id) == (prints[r.doc_id], want[r.doc_id])
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("pairs", [2, 1000])
def test_simhash_links(spark, pairs):
    """Small and large buckets give the same components."""
    r = random.Random(5)
    centres = [r.getrandbits(64) for _ in range(6)]
    prints = {k: c ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 3))) for k, c in enumerate(centres * 12)}
    want = slow_components(prints)
    signed = {k: p - (1 << 64) if p >> 63 else p for k, p in prints.items()}
    fps = spark.createDataFrame([(p,) for p in set(signed.values())], "fp long")
    nodes = {x.node: x.root for x in simhash.components(simhash.links(fps, 2, pairs)).collect()}
    group = lambda k: nodes.get(signed[k], signed[k])
    assert all((group(a) == group(b)) == (want[a] == want[b]) for a in prints for b in prints)


def test_covering_masks():
    """Any two differing positions leave some mask untouched."""
    masks = simhash.masks()
    assert len(masks) == 7 and all(any(not (m >> a & 1 or m >> b & 1) for m in masks) for a in range(64) for b in range(64))


def test_kneser_ney_plans_stay_small(spark, monkeypatch):
    """No plan holds all orders: a driver describes a plan anew, whole, whenever one of its exchanges ends."""
    seen = []

    def counted(df):
        seen.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange"))
        return written(df)

    written = kneser_ney.written
    model = kneser_ney.train(spark.createDataFrame([(prose(k, 5),) for k in range(4)], "text string"))
    asked = written(spark.createDataFrame([(x,) for x in kneser_ney.codes(pa.array([prose(9, 3)]))[0].tolist()], "code long").distinct())
    monkeypatch.setattr(kneser_ney, "written", counted)
    assert kneser_ney.probabilities(model, asked).count() == asked.count() and max(seen) <= 8


def test_covering_masks_in_parts():
    """Fingerprints within the radius share a key, whichever bits differ; those that differ in half of the bits hardly ever do."""
    r, masks = random.Random(3), near_copies.MASKS
    assert masks.shape == (45, 2)
    keys = lambda x: set(simhash.covering_keys(np.array([[x >> 64, x % (1 << 64)]], np.uint64), masks)[0].tolist())
    for k in range(300):
        x = r.getrandbits(128)
        at = r.sample(range(128), 11) if k % 2 else [i for i in range(128) if any(int(m[0]) << 64 >> i & 1 or int(m[1]) >> i & 1 for m in masks[:15])][:11]
        assert len(keys(x)) == 45 and keys(x) & keys(x ^ sum(1 << b for b in at))
    assert sum(bool(keys(r.getrandbits(128)) & keys(r.getrandbits(128))) for _ in range(300)) <= 2


def slow_wide(text):
    """128 bits of the different words, counted bit by bit."""
    words = set(text.lower().split())
    hashes = [xxhash.xxh64_intdigest(w.encode(), 42) << 64 | xxhash.xxh64_intdigest(w.encode(), 43) for w in words]
    return sum(1 << b for b in range(128) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("kind", ["masks", "bands"])
def test_near_copy_candidates(spark, kind):
    """The stage takes all pairs within the radius from SimHash's masks alone; bands give only pairs beyond it."""
    r, given = random.Random(4), []
    for k in range(12):
        words = [f"w{k}x{j}" for j in range(90)]
        for n in (0, 1, 2, 4, 7, 12):
            given.append((len(given), " ".join([f"v{k}x{n}x{j}" if j in r.sample(range(90), n) else w for j, w in enumerate(words)])))
    prints = {t: slow_wide(t) for _, t in given}
    rows = near_copies.signed(spark.createDataFrame(given, "doc_id long, text string"), "doc_id", "text")
    assert {(x.fp0 % (1 << 64)) << 64 | x.fp1 % (1 << 64) for x in rows.collect()} == set(prints.values())
    text = {x.node: given[x.doc_id][1] for x in rows.collect()}
    size = {x.node: x.n for x in rows.collect()}
    kept = rows.withColumn("keys", F.filter("keys", lambda k: k.bitwiseAND(F.lit(1).cast("long")) == int(kind == "masks")))
    got = {(x.a, x.b) for x in near_copies.candidates(kept, pairs=1000)[0].collect()}
    within = {(a, b) for a in text for b in text if a < b and (prints[text[a]] ^ prints[text[b]]).bit_count() <= 11 and min(size[a], size[b]) >= 0.8 * max(size[a], size[b])}
    assert len(within) > 12 and (got == within if kind == "masks" else got and not got & within)


@pytest.mark.parametrize("pairs", [3, 1000])
def test_near_copies(spark, docs, empty, pairs):
    """The pipeline's stage links what brute force links at a five-word Jaccard of 0.8, in small and in large buckets."""
    import corpus_pipeline

    r, given = random.Random(8), []
    for k in range(14):
        words = [f"w{k}x{j}" for j in range(120)]
        given.append((len(given), " ".join(words)))
        for n in range(9 if k < 2 else 2):  # copies with one to four words replaced: from well above to below 0.8
            copy = list(words)
            for at in r.sample(range(120), 1 + n % 4):
                copy[at] = f"v{k}x{n}x{at}"
            given.append((len(given), " ".join(copy)))
    grams = {i: {tuple(t.split()[j : j + 5]) for j in range(116)} for i, t in given}
    root = {i: i for i in grams}
    near = [(a, b) for a in grams for b in grams if a < b and len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b])]
    for _ in given:
        for a, b in near:
            root[a] = root[b] = min(root[a], root[b])
    want = {i for i in root if root[i] == i}
    assert 14 <= len(want) < len(given) - 14
    frame = spark.createDataFrame(given, "doc_id long, text string")
    assert {x.doc_id for x in near_copies.drop_near_copies(frame, pairs=pairs).collect()} == want
    if pairs > 3:
        assert {x.doc_id for x in corpus_pipeline.near_copies(spark, frame, "").collect()} == want
        out = near_copies.drop_near_copies(docs)
        assert out.columns == docs.columns and {x.n for x in out.collect()} == {7} and near_copies.drop_near_copies(empty).count() == 0
        repeats = spark.createDataFrame([(5, given[0][1]), (9, given[1][1]), (5, "b " * 30), (None, given[0][1] + " end"), (None, "c d e f g h")], frame.schema)
        assert sorted((x.doc_id or 0, x.text[0]) for x in near_copies.drop_near_copies(repeats).collect()) == [(0, "c"), (5, "b"), (5, "w")]


def test_license_headers_inside_files(spark):
    """Notices and whole licences in longer files, however they are wrapped and marked as comments."""
    import textwrap

    code = "\n".join(f"value_{k} = compute(value_{k - 1}, {k})  # step number {k}" for k in range(300))
    of = dict(license_scan.TEXTS)
    whole = {i: t for i, t in license_scan.whole_licences()}
    comment = lambda t, sign, width: "\n".join(f"{sign} {x}" for x in textwrap.wrap(t, width))
    given = {
        1: ("MIT", "Copyright 2020 somebody\n\n" + "\n".join(textwrap.wrap(of["MIT"], 72)) + "\n\n" + code),
        2: ("Apache-2.0", comment(of["Apache-2.0"], "#", 70) + "\n" + code),
        3: ("BSD-3-Clause", "/*\n" + comment(of["BSD-3-Clause"], " *", 60) + "\n */\n" + code),
        4: ("BSD-2-Clause", code + "\n" + comment(of["BSD-2-Clause"], "//", 90)),
        5: ("GPL-3.0", "intro of a few words\n" + whole["GPL-3.0"] + "\n" + code),
        6: ("AGPL-3.0", whole["AGPL-3.0"]),
        7: ("Apache-2.0", whole["Apache-2.0"] + "\n" + code),
        8: (None, code), 9: (None, None), 10: (None, ""), 11: (None, "\n".join(of["MIT"].split()[:60]) + code),
        12: ("MPL-2.0", comment(of["MPL-2.0"], "--", 50) + "\n\n" + code),
        13: ("LGPL-2.1", whole["LGPL-2.1"]), 14: ("GPL-2.0", whole["GPL-2.0"] + code), 15: ("MIT", of["MIT"]), 16: ("CC0-1.0", code[:900] + "\n" + whole["CC0-1.0"]),
    }
    frame = spark.createDataFrame([(k, t, 1) for k, (_, t) in given.items()], "doc_id long, text string, dice int")
    found = {r.doc_id: r for r in license_scan.scan(frame).collect()}
    assert {k: r.license for k, r in found.items()} == {k: i for k, (i, _) in given.items()}
    assert all(found[k].dice > 0.9 for k, (i, _) in given.items() if i)


def slow_scan(text, known, threshold=0.8):
    import re

    lines = [x.strip() for x in re.sub(r"[^a-z0-9\n]+", " ", text.lower()).split("\n") if x.strip()]
    words = [w for x in lines for w in x.split(" ")]
    grams = lambda w: set(zip(w, w[1:]))
    units = [(x.split(" "), None) for x in lines] + ([(words, None)] if len(lines) > 1 else [])
    ends = [sum(len(x.split(" ")) for x in lines[: k + 1]) for k in range(len(lines))]
    scores = []
    for k, (name, t) in enumerate(known):
        tw = t.split(" ")
        tg = grams(tw)
        dice = lambda g: 2 * len(g & tg) / (len(g) + len(tg))
        scores += [(-dice(grams(w)), name, u) for u, (w, _) in enumerate(units) if len(w) > 1 and dice(grams(w)) >= threshold]
        if len(tg) >= license_scan.RUN_BIGRAMS:
            for first in range(len(lines)):
                begin = ends[first - 1] if first else 0
                fit = max(first, sum(e <= begin + len(tw) for e in ends) - 1)
                for last in {fit, min(fit + 1, len(lines) - 1)}:
                    if last > first and dice(grams(words[begin : ends[last]])) >= threshold:
                        scores.append((-dice(grams(words[begin : ends[last]])), name, -1 - k))
    best = min(scores, default=None)
    return (best[1], round(-best[0], 6), len({u for *_, u in scores})) if best else (None, None, 0)


def test_license_scan_against_slow_scan(spark):
    r = random.Random(4)
    known = [("A", " ".join(f"a{k}" for k in range(40))), ("B", " ".join(f"a{k}" if k < 30 else f"b{k}" for k in range(45))), ("C", "licensed under the c licence"), ("D", " ".join(f"d{k % 30}" for k in range(70)))]
    given = []
    for _ in range(60):
        words = []
        for _ in range(r.randint(0, 3)):
            words += [f"x{r.randint(0, 9)}" for _ in range(r.randint(0, 25))]
            words += [w for w in r.choice(known)[1].split() if r.random() > r.choice([0, 0.05, 0.2])]
        given.append("".join(w + r.choice([" ", " ", " ", ", ", "\n", "\n# "]) for w in words))
    out = license_scan.scan(spark.createDataFrame(list(enumerate(given)), "doc_id long, text string"), known).collect()
    assert {x.doc_id: (x.license, x.dice, x.n_matches) for x in out} == {k: slow_scan(t, known) for k, t in enumerate(given)}


def test_exact_dedup_judges_ids_by_their_texts(spark):
    given = [(1, "aa"), (1, "bb"), (2, "aa"), (3, "bb"), (4, "c" * 5000), (5, "c" * 4999 + "d"), (None, "aa"), (None, "e"), (6, "f"), (6, "f"), (None, "g"), (None, "g")]
    frame = spark.createDataFrame(given, "doc_id long, text string")
    for digests in (True, False):
        found = sorted(((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in exact_dedup.exact_dedup(frame, digests=digests).collect()))
        assert found == [(0, 0, 1, True), (0, 0, 2, True), (0, 0, 2, True), (0, 2, 3, False), (1, 2, 3, False), (1, 3, 2, False), (2, 2, 3, True), (3, 3, 2, True), (4, 4, 1, True), (5, 5, 1, True), (6, 6, 2, True), (6, 6, 2, True)]
    left = sorted((r.doc_id or 0, r.text[:1]) for r in exact_dedup.drop_copies(frame.withColumn("_len", F.lit(1))).collect())
    assert left == [(0, "e"), (0, "g"), (2, "a"), (3, "b"), (4, "c"), (5, "c"), (6, "f")]


def test_sharding_against_brute_force(spark):
    """Sizes near equal, equal texts together unless they fill a shard, hot groups and repeated keys split, slots gapless."""
    r = random.Random(6)
    given = [(k, prose(k, r.randint(1, 40))) for k in range(1500)] + [(10_000 + k, "one hot text " * 40) for k in range(1000)] + [(77_777, "a row that repeats " * 30)] * 900 + [(None, None), (None, ""), (90_000, "x" * 50_000)]
    frame = spark.createDataFrame(given, "doc_id long, text string").repartition(5)
    out = sharding.shard(frame, 4).collect()
    want = sorted((d or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in given)
    assert sorted((x.doc_id or 0, x.size, x.text_crc32) for x in out) == want
    total = sum(w[1] for w in want)
    by_shard: dict[int, list] = {}
    for x in out:
        by_shard.setdefault(x.shard, []).append(x)
    for own in by_shard.values():
        assert sorted(x.slot for x in own) == list(range(len(own)))
        assert abs(sum(x.size for x in own) - total / 4) < 60_000
    places: dict[int, set] = {}
    for x in out:
        places.setdefault(x.text_crc32, set()).add(x.shard)
    split = [c for c, shards in places.items() if len(shards) > 1]
    assert set(split) <= {zlib.crc32(("one hot text " * 40).encode()), zlib.crc32(("a row that repeats " * 30).encode())}


def test_toxicity_against_slow_matcher(spark):
    import math

    def slow(text, lexicon, exceptions):
        folded = toxicity.fold(text)
        best, harmless = {}, set()
        for at in range(len(folded)):
            best |= {at: max([w for e, w in lexicon.items() if folded.startswith(e, at)], default=0)}
            for e in exceptions:
                if folded.startswith(f" {e} ", at):
                    harmless |= set(range(at, at + len(e) + 1))
        kept = [w for at, w in best.items() if w and at not in harmless]
        return sum(kept), 100 * sum(kept) / max(len(folded.split()), 1), len(kept)

    r = random.Random(9)
    lexicon = {" trash ": 5.0, " scum ": 4.0, " scum": 3.0, " vile": 3.5, " vile ": 3.5, " lose": 3.1, " loser ": 4.4}
    matcher = toxicity.Matcher(lexicon)
    words = ["trash", "can", "tr4sh", "scum", "pond", "soap", "$cum", "vile", "vilest", "loser", "bracket", "l0ser", "the", "ѕсum", "losers", "talk", "1", "!!"]
    for _ in range(300):
        text = " ".join(r.choice(words) for _ in range(r.randint(0, 12)))
        a, b = matcher.features(text), slow(text, lexicon, toxicity.EXCEPTIONS)
        assert a[2] == b[2] and a[:2] == pytest.approx(b[:2])
    given = [(k, f"plain words here {k % 7} " + ("vile scum" if k % 4 == 0 else "good folk")) for k in range(400)]
    frame = spark.createDataFrame(given, "doc_id long, text string")
    labels = [(k, int(k % 4 == 0)) for k in range(400)]
    doubled = spark.createDataFrame(labels + [(k, 0) for k, y in labels if y] + labels[:50], "doc_id long, toxic int")
    lexicon_a, curve_a = toxicity.fit(frame, doubled.repartition(4))
    lexicon_b, curve_b = toxicity.fit(frame, spark.createDataFrame(labels, "doc_id long, toxic int"))  # of labels that differ the larger one holds
    used = {k: y for k, y in labels if zlib.crc32(str(k).encode()) % 4 != 2}
    t, c = sum(used.values()), len(used) - sum(used.values())
    assert lexicon_a == lexicon_b == {e: pytest.approx(math.log((t + 0.5) / (t + 1)) - math.log(0.5 / (c + 1))) for e in (" vile ", " vile", " scum ", " scum")}
    assert curve_a == pytest.approx(curve_b)


def test_long_conversation(spark):
    """A conversation of many turns with characters of several sizes, at either end of texts."""
    bits = ["\ufeffx", "😀 y", "é<|z", "", "\\", "plain words"]
    given = [(1, t, ("user", "assistant")[t % 3 == 0], bits[t % 6] * (t % 4)) for t in range(6000)]
    frame = spark.createDataFrame(given, "conv_id long, turn int, role string, text string")
    out = chat_format.format_chats(frame).select("formatted", "loss_spans", chat_format.under_mask(F.col("formatted"), F.col("loss_spans")).alias("loss")).head()
    assert out.loss == "".join(t for _, _, role, t in given if role == "assistant")
    assert len(out.loss_spans) == sum(role == "assistant" for *_, role, _ in given)
    for s, text in list(zip(out.loss_spans, [t for *_, role, t in given if role == "assistant"]))[:200]:
        assert out.formatted[s.start : s.start + s.length] == text.replace("\\", "\\\\").replace("<|", "<\\|")


def test_pipeline_defined_cases(spark, tmp_path):
    """Nulls in any column, empty and long texts, ties, repeated rows, extra columns with clashing names, and an empty table through the whole chain."""
    import corpus_pipeline
    from corpusmill.llm.common import table, written

    given = [(k, prose(k, 30), ("en", None)[k % 5 == 0], ("h", None)[k % 7 == 0], 1) for k in range(200)]
    given += [(300, None, "en", "h", None), (301, "", None, "h", 0), (302, prose(3, 3000), "en", "h", 1), given[4], given[4], (None, prose(900, 30), None, None, None), (303, given[8][1], "en", "h", 1), (304, given[9][1] + " more", "en", "h", 1)]
    names = "doc_id long, text string, lang string, source string, n_chars long"
    extra = lambda df: df.withColumns({"kept": F.lit("own"), "perplexity": F.lit(1), "_len": F.lit(2), "n_words": F.lit(3)})
    spark.createDataFrame([(k, 1, 0) for k in range(200)] + [(300, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for rows_, least in ((given, 150), ([], 0)):
        docs = extra(spark.createDataFrame(rows_, names))
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = written(stage(spark, docs, str(tmp_path)))
            assert docs.columns == columns, name
        left = docs.collect()
        assert len(left) >= least and {(r.kept, r.perplexity, r["_len"], r.n_words) for r in left} <= {("own", 1, 2, 3)}
        assert not {300, 301, 8} & {r.doc_id for r in left} and sum(r.doc_id == 4 for r in left) <= 1
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
        assert packed.select("doc_id").distinct().count() == len({r.doc_id for r in left})
