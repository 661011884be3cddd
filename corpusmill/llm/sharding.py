"""Sharding by sampled splitters.

Records are ordered by (hash of the text, doc_id, row number), so equal texts are neighbours. A size-weighted
sample of keys gives the quantile boundaries of many fine ranges; the exact bytes and rows of each
range are then counted, ranges that came out overfull besides their largest record are subdivided at further sampled
splitters until none is left, and consecutive ranges are dealt to the shards at quantiles of the exact
sums. Only the sample and the per-range sums reach the driver, a few dozen numbers for a range of about ROWS_PER_RANGE
rows; a shard's slots are numbered range by range, so no task ever holds a whole shard.

Law `bytes`: sizes near equal. Equal texts share a range, and so a shard, unless their group is
itself overfull; then doc_id subdivides it, and the row number what repeats both.

Defined cases: a null or empty text has size 1 and hashes as empty; a very long text may make its range, and so its shard, as large as it is;
a null doc_id orders first; repeated rows get a slot each; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import written

SHARDS = 16
#: Fine ranges per shard at least, rows of a fine range at most (about), and sampled keys per fine range.
RANGES_PER_SHARD = 64
ROWS_PER_RANGE = 1_000_000
SAMPLES_PER_RANGE = 24
#: A range of more than this many times its fair share besides its largest record is subdivided.
OVERFULL = 2.0
LEAST = -(1 << 63)
SIGN = np.uint64(1 << 63)


Key = tuple[int, int, int]


def _keys(*parts: np.ndarray) -> np.ndarray:
    """Bytes of each row that order as its numbers do."""
    both = np.empty((len(parts[0]), len(parts)), ">u8")
    for k, x in enumerate(parts):
        both[:, k] = x.astype(np.int64).view(np.uint64) ^ SIGN
    return both.view(f"S{8 * len(parts)}").ravel()


def _sample(rows: DataFrame, total: int, wanted: int, salt: int) -> list[tuple[Key, float]]:
    """Keys drawn with a chance in proportion to size, by a hash of the key: about `wanted` of them, in order, with what each stands for."""
    chance = F.least(F.lit(1.0), F.col("size") * F.lit(wanted / max(total, 1)))
    u = (F.xxhash64("h", "i", "u", F.lit(salt)).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))).cast("double")
    drawn = rows.where(u < chance).select("h", "i", "u", F.greatest(F.col("size").cast("double"), F.lit(total / wanted)).alias("w"))
    return sorted(((r.h, r.i, r.u), r.w) for r in drawn.collect())


def _quantiles(drawn: list[tuple[Key, float]], parts: int, level: int) -> list[Key]:
    """At most parts - 1 boundaries; they stand where the first `level` numbers of a key begin."""
    total, at, out = sum(w for _, w in drawn), 0.0, []
    for key, w in drawn:
        if at > 0 and at * parts >= (len(out) + 1) * total:
            out += [(*key[:level], *[LEAST] * (3 - level))] * (int(at * parts / total) - len(out))
        at += w
    return sorted(set(out[: parts - 1]))


def _ranged(rows: DataFrame, splitters: list[Key]) -> DataFrame:
    cut = _keys(*np.array(splitters, np.int64).reshape(-1, 3).T)

    @F.pandas_udf("int")
    def place(h: pd.Series, i: pd.Series, u: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cut, _keys(h.to_numpy(), i.to_numpy(), u.to_numpy()), "right").astype(np.int32))

    return rows.withColumn("range", place("h", "i", "u"))


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every document."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = written(docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST)).alias("i"), F.monotonically_increasing_id().alias("u"),
        (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h"),
    ))
    whole = rows.agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).head()
    total = whole.bytes or 0
    fine = shards * max(RANGES_PER_SHARD, -(-whole.n // (shards * ROWS_PER_RANGE)))
    splitters = _quantiles(_sample(rows, total, fine * SAMPLES_PER_RANGE, 0), fine, 1)
    key, again = F.struct("h", "i", "u"), 0
    while True:
        ranged = _ranged(rows, splitters)
        stats = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.max("size").alias("top"), F.min(key).alias("least"), F.max(key).alias("most")).collect()
        sums = {r["range"]: (r.bytes, r.n) for r in stats}
        over = {r["range"]: r for r in stats if r.bytes - r.top > OVERFULL * total / fine}
        if not over:
            break
        again += 1
        drawn = _sample(ranged.where(F.col("range").isin(sorted(over))), sum(r.bytes for r in over.values()), len(over) * SAMPLES_PER_RANGE, again)
        more = set(splitters)
        for r in over.values():
            least, most = tuple(r.least), tuple(r.most)
            # at the starts of hashes as long as there are two, then of doc_ids, then anywhere: each range is split at least once
            level = next(k for k in (1, 2, 3) if least[:k] != most[:k])
            cuts = {c for c in _quantiles([x for x in drawn if least <= x[0] <= most], int(np.ceil(r.bytes * fine / total)), level) if least < c <= most}
            # and behind the first one, so that a heavy group is alone after two rounds, however few keys were drawn besides
            more |= cuts | {(*least[: level - 1], least[level - 1] + 1, *[LEAST] * (3 - level))}
        splitters = sorted(more)

    # consecutive ranges to shards at quantiles of the exact bytes; positions of ranges within their shard
    starts, at, shard_rows, of = [], 0, [0] * shards, {}
    for k in sorted(sums):
        b, n = sums[k]
        s = min(shards - 1, int((at + b / 2) * shards / max(total, 1)))
        of[k] = (s, shard_rows[s])
        shard_rows[s] += n
        at += b
    ends = sorted(of)
    shard_of, base = [of[k][0] for k in ends], [of[k][1] for k in ends]

    @F.pandas_udf("struct<shard int, base long>")
    def dealt(r: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(ends, r.to_numpy())
        return pd.DataFrame({"shard": np.array(shard_of, np.int32)[at], "base": np.array(base, np.int64)[at]})

    order = Window.partitionBy("range").orderBy("h", "i", "u")
    return (ranged.withColumn("k", F.row_number().over(order) - 1).withColumn("d", dealt("range"))
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("d.shard").alias("shard"), (F.col("d.base") + F.col("k")).cast("long").alias("slot")))
