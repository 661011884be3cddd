"""Exact sequential folds over series of any length: the best value that counts, with a least improvement.

A value counts when it is lower than the best one so far by more than `least`, which no running minimum can tell: small steps down don't
count until they add up. Series are cut into blocks of `size` rows, wherever they begin. A block's effect is a function of the best
value that enters it, given by its own running minima: the first that counts decides all that follows. These functions are composed
along each series, a row for each block, and the entering values go back to the blocks. No task holds more than a block, and a series
of many blocks is read by many tasks; only the composition of its blocks is one stream, in constant memory.

Defined cases: nulls, NaN and infinite values never count; before the first that counts, best and since are null; null keys are a series
of their own; rows equal in keys and order follow each other in a fixed but arbitrary order.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.order import global_rank, running_total
from corpusmill.operators.metrics import Series
from corpusmill.session import written

BLOCK = 65_536
EFFECT = "part long, resets boolean, minima array<double>, best array<double>, at array<long>, start long"
ENTERS = "part long, best double, at long, start long"
PROGRESS = "_g long, best double, since long, place long"


def effect(values: Iterable[float], places: Iterable[int], least: float) -> tuple[list[float], list[float], list[int]]:
    """The running minima of a block in their order; for each, the best value that leaves and its place if it is the first that counts."""
    low, best, at = [], [], []
    for v, place in reversed(list(zip(values, places, strict=True))):
        if not math.isfinite(v):
            continue
        while low and low[-1] >= v:
            low.pop(), best.pop(), at.pop()
        k = bisect_left(low, v - least) - 1
        low.append(v), best.append(best[k] if k >= 0 else v), at.append(at[k] if k >= 0 else place)
    return low[::-1], best[::-1], at[::-1]


def _walk(block: pd.DataFrame, best: float, at: int, start: int, least: float) -> Iterator[tuple]:
    for g, v, new in zip(block["_g"].tolist(), block["_v"].tolist(), block["_new"].tolist(), strict=True):
        if new:
            best, at, start = math.inf, -1, g
        if math.isfinite(v) and v < best - least:
            best, at = v, g
        yield g, (best if at >= 0 else None), (g - at if at >= 0 else None), g - start


def progress(rows: DataFrame, s: Series, least: float = 0.0, size: int = BLOCK) -> DataFrame:
    """rows with best (the last value that counted), since (rows since then) and place (from 0 in its series)."""
    if least < 0:
        raise ValueError("the least improvement can't be negative")
    numbered = written(global_rank(rows, F.struct(*s.keys), [F.col(c) for c in s.order], "_g"))
    starts = numbered.groupBy(*s.keys).agg(F.min("_g").alias("_start")).select("_start")
    value = F.coalesce(F.col(s.value).cast("double"), F.lit(math.nan)).alias("_v")
    work = written(numbered.select("_g", value).join(starts, F.col("_g") == F.col("_start"), "left").select(
        "_g", "_v", F.col("_start").isNotNull().alias("_new"), F.floor(F.col("_g") / size).alias("part")))

    def effects(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("_g")
        new = block.loc[block["_new"], "_g"]
        part, resets = int(block["part"].iloc[0]), len(new) > 0
        own = block[block["_g"] >= new.iloc[-1]] if resets else block
        low, best, at = effect(own["_v"].tolist(), own["_g"].tolist(), least)
        return pd.DataFrame([(part, resets, low, best, at, int(new.iloc[-1]) if resets else -1)], columns=["part", "resets", "minima", "best", "at", "start"])

    found = written(work.groupBy("part").applyInPandas(effects, EFFECT))
    runs = written(running_total(found, F.col("part"), [], F.col("resets").cast("int"), "run"))
    seeds = runs.where("resets").withColumn("run", F.col("run") + 1).withColumn("seed", F.lit(True))
    steps = runs.withColumn("seed", F.lit(False)).unionByName(seeds)

    def compose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, best, at, start = None, math.inf, -1, 0
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if row.run != run or row.seed:
                    run, best, at, start = row.run, math.inf, -1, row.start if row.seed else 0
                if not row.seed:
                    out.append((row.part, best, at, start))
                if row.seed or not row.resets:
                    k = next((k for k, v in enumerate(row.minima) if v < best - least), None)
                    best, at = (best, at) if k is None else (float(row.best[k]), int(row.at[k]))
            yield pd.DataFrame(out, columns=["part", "best", "at", "start"])

    enters = steps.repartition("run").sortWithinPartitions("run", "part").mapInPandas(compose, ENTERS)

    def walked(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("_g")
        first = block.iloc[0]
        out = _walk(block, float(first["best"]), int(first["at"]), int(first["start"]), least)
        return pd.DataFrame(out, columns=["_g", "best", "since", "place"]).astype({"best": "float64", "since": "Int64"})

    done = work.join(enters, "part").groupBy("part").applyInPandas(walked, PROGRESS)
    return numbered.join(done, "_g").drop("_g")


def stagnations(rows: DataFrame, s: Series, patience: int = 50, least: float = 1e-5, size: int = BLOCK) -> DataFrame:
    """series keys, fired_at, best: each place at which the best value has just become `patience` rows old; once for each such stretch."""
    return progress(rows, s, least, size).where(F.col("since") == patience).select(*s.keys, F.col("place").alias("fired_at"), "best")


def stopped(rows: DataFrame, s: Series, patience: int = 50, least: float = 1e-5, size: int = BLOCK) -> DataFrame:
    """series keys, stopped_at: where a run that waits `patience` rows for the least improvement ends, null if it never does."""
    due = F.min(F.when(F.col("since") >= patience, F.col("place")))
    return progress(rows, s, least, size).groupBy(*s.keys).agg(due.alias("stopped_at"))
