"""Toxicity by a weighted lexicon that an Aho-Corasick automaton matches in folded text.

Folding lower-cases, maps homoglyphs and digits or signs that stand for letters inside words, and
leaves words between single spaces. The lexicon's entries are whole words and word beginnings,
weighted by log-odds between labelled toxic and clean documents; both weights and the final logistic curve
are fitted on a bounded sample of labelled rows (FIT_ROWS), which also bounds the lexicon: every entry that passes is
in it. A word counts once, with its heaviest entry, and not at all inside an exception phrase. The score joins the summed weight and its share of the text's length.

Defined cases: a null or empty text scores like one without a match; very long texts are matched
whole; repeated rows score alike; null labels teach nothing, and of labels that differ for a document the
larger one holds; without labels of both kinds the score is
a constant; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import in_small_batches, small_side, written

#: Labelled rows that the fit draws at most (about), by a hash of their id.
FIT_ROWS = 20_000
#: An entry needs so many toxic documents, so large log-odds, and beginnings have so many letters.
MIN_TOXIC, MIN_ODDS, BEGINNINGS = 5, 3.0, range(4, 9)
PREDICT = 0.3
#: Phrases in which a listed word is harmless.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "class clown", "clown fish", "pond scum", "soap scum", "loser bracket")
# Letters of other scripts that look like Latin ones, and digits and signs used as letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "н": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o", "р": "p", "ԛ": "q",
    "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ѡ": "w", "х": "x", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l"}

_LETTERS = str.maketrans(HOMOGLYPHS)
_INSIDE = re.compile(r"(?<=[a-zA-Z])[013457890@$!|]+(?=[a-zA-Z])|(?<![\w@$!|])[013457890@$!|]{1,2}(?=[a-zA-Z]{2})")
_OTHER = re.compile(r"[\W\d_]+")


def fold(text: str) -> str:
    """Words between single spaces, with one before and behind."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).lower().translate(_LETTERS)
    text = _INSIDE.sub(lambda m: "".join(DIGITS[c] for c in m[0] if c in DIGITS), text.lower())
    return f" {_OTHER.sub(' ', text).strip()} "


def entries(folded: str) -> set[str]:
    """The whole words and word beginnings of a folded text that a lexicon may list."""
    out = set()
    for w in set(folded.split()):
        out.add(f" {w} ")
        out.update(f" {w[:k]}" for k in BEGINNINGS if k <= len(w))
    return out


class Matcher:
    """Finds the weight of a text under a lexicon {entry: weight}."""

    def __init__(self, lexicon: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS):
        self.machine = ahocorasick.Automaton()
        for e, w in lexicon.items():
            self.machine.add_word(e, (len(e), w))
        for e in exceptions:
            self.machine.add_word(f" {e} ", (len(e) + 2, -1.0))
        if len(self.machine):
            self.machine.make_automaton()

    def features(self, text: str) -> tuple[float, float, int]:
        """Summed weight, summed weight for each hundred words, and words matched."""
        folded = fold(text)
        best: dict[int, float] = {}
        harmless: list[tuple[int, int]] = []
        if len(self.machine):
            for end, (n, w) in self.machine.iter(folded):
                start = end - n + 1
                if w < 0:
                    harmless.append((start, end))
                else:
                    best[start] = max(best.get(start, 0.0), w)
        if harmless:
            inside = {k for a, b in harmless for k in range(a, b)}  # exceptions are short
            best = {s: w for s, w in best.items() if s not in inside}
        total = sum(best.values())
        return total, 100 * total / max(folded.count(" ") - 1, 1), len(best)


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> tuple[dict[str, float], list[float]]:
    """The lexicon and the curve's coefficients, from labelled rows that are not held out."""
    usable = labels.where(~held_out(id_col) & F.col("toxic").isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    usable = written(usable)
    n = usable.count()
    drawn = usable.where(F.pmod(F.xxhash64("id", F.lit("fit")), F.lit(1 << 20)) < F.lit((1 << 20) * min(1.0, fit_rows / max(n, 1))))
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sample = written(narrow.join(small_side(written(drawn), 2 * fit_rows), "id"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clean, toxic = Counter(), Counter()
        for b in batches:
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                (toxic if y else clean).update(entries(fold(text or "")))
            if len(clean) + len(toxic) > 1 << 20:
                yield pairs(clean, toxic)
                clean, toxic = Counter(), Counter()
        yield pairs(clean, toxic)

    def pairs(clean: Counter, toxic: Counter) -> pa.RecordBatch:
        keys = list(clean.keys() | toxic.keys())
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([clean[k] for k in keys], pa.int64()), pa.array([toxic[k] for k in keys], pa.int64())], ["entry", "clean", "toxic"])

    totals = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    t, c = totals.get(1, 0), totals.get(0, 0)
    if not t or not c:
        return {}, [math.log(0.01) if not t else math.log(99), 0.0, 0.0, 0.0]
    odds = F.log((F.col("toxic") + 0.5) / (t + 1)) - F.log((F.col("clean") + 0.5) / (c + 1))
    counted = in_small_batches(sample.select("text", "toxic")).mapInArrow(count, "entry string, clean long, toxic long").groupBy("entry").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    least = min(MIN_TOXIC, max(2, t // 20))
    listed = counted.where((F.col("toxic") >= least) & (odds >= MIN_ODDS)).select("entry", odds.alias("w"))
    lexicon = {r.entry: r.w for r in listed.collect()}
    rows = with_features(sample.select("text", "toxic"), lexicon).select("f", "toxic").collect()
    return lexicon, logistic(np.array([[1.0, *curve(*r.f)] for r in rows]), np.array([r.toxic for r in rows], float))


def curve(total: float, rate: float, hits: int) -> list[float]:
    return [math.log1p(total), math.log1p(rate), float(hits > 0)]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> list[float]:
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w.tolist()


def with_features(rows: DataFrame, lexicon: dict[str, float], text_col: str = "text") -> DataFrame:
    """rows with f = array(total weight, weight for each hundred words, hits)."""
    held = rows.sparkSession.sparkContext.broadcast(lexicon)
    at = rows.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(held.value)
        for b in batches:
            f = pa.array([[float(v) for v in matcher.features(x or "")] for x in b.column(at).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*[c for k, c in enumerate(b.columns) if k != at], f], [*[n for k, n in enumerate(b.schema.names) if k != at], "f"])

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != text_col]
    return in_small_batches(rows).mapInArrow(run, ", ".join([*kept, "f array<double>"]))


def score(docs: DataFrame, model: tuple[dict[str, float], list[float]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score from 0 to 1."""
    lexicon, w = model
    f = with_features(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), lexicon)
    z = F.lit(w[0]) + w[1] * F.log1p(F.col("f")[0]) + w[2] * F.log1p(F.col("f")[1]) + w[3] * (F.col("f")[2] > 0).cast("double")
    return f.select("doc_id", (1 / (1 + F.exp(-z))).alias("score"))
