"""Metric series: smoothing, anomalies, plateaus, as-of values, comparison.

A series is one run and one metric; its rows are ordered by a step. Windows are partitioned by
series, and no series is gathered in a row.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Series:
    """Names the columns of a table of series."""

    def __init__(self, keys: list[str], order: list[str], value: str = "value"):
        self.keys, self.order, self.value = keys, order, value

    @property
    def window(self):
        return Window.partitionBy(*self.keys).orderBy(*self.order)

    @property
    def all(self):
        return Window.partitionBy(*self.keys)


def moving_average(rows: DataFrame, s: Series, n: int = 20) -> DataFrame:
    """rows with ma: the mean of the last n values, of fewer at the start."""
    return rows.withColumn("ma", F.avg(s.value).over(s.window.rowsBetween(1 - n, 0)))


def divergence(rows: DataFrame, s: Series, factor: float = 2.0) -> DataFrame:
    """rows with diverged: the value is above factor times the mean of all before."""
    mean = F.avg(s.value).over(s.window.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("diverged", F.coalesce(F.col(s.value) > factor * mean, F.lit(False)))


def rolling_z(rows: DataFrame, s: Series, n: int = 20, limit: float = 3.0) -> DataFrame:
    """rows with z, anomaly and severity, against the n finite values before (at least max(5, n/4) of them).

    The sample deviation counts as 1e-6 at least. NaN and infinite values are critical anomalies without a z
    and stand in no window; a null is none.
    """
    v = F.col(s.value)
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    before = s.window.rowsBetween(-n, -1)
    own = rows.where(finite).withColumns({"_m": F.avg(v).over(before), "_s": F.stddev_samp(v).over(before), "_n": F.count(v).over(before)})
    z = F.when(F.col("_n") >= max(5, n // 4), (v - F.col("_m")) / F.greatest(F.col("_s"), F.lit(1e-6)))
    own = own.withColumn("z", z).drop("_m", "_s", "_n").withColumn("anomaly", F.coalesce(F.abs("z") > limit, F.lit(False)))
    own = own.withColumn("severity", F.when(F.col("anomaly"), "warning"))
    odd = rows.where(~finite | v.isNull()).withColumns({"z": F.lit(None).cast("double"), "anomaly": v.isNotNull(), "severity": F.when(v.isNotNull(), "critical")})
    return own.unionByName(odd)


def jumps(rows: DataFrame, s: Series, ratio: float = 10.0) -> DataFrame:
    """Rows whose value is so many times the one before, or less than that part of it."""
    before = F.lag(s.value).over(s.window)
    r = F.try_divide(F.col(s.value), before)
    return rows.withColumn("ratio", r).where((F.col("ratio") > ratio) | (F.col("ratio") < 1 / ratio))


def rate_of_change(rows: DataFrame, s: Series, step: Column) -> DataFrame:
    """rows with rate: change of value over change of step; rows without a change of step are skipped."""
    out = rows.withColumns({"_dv": F.col(s.value) - F.lag(s.value).over(s.window), "_ds": step - F.lag(step).over(s.window)})
    return out.where("_ds <> 0").withColumn("rate", F.col("_dv") / F.col("_ds")).drop("_dv", "_ds")


def down_sample(rows: DataFrame, s: Series, points: int) -> DataFrame:
    """All rows of a series of at most so many, else those at int(i * (n - 1) / (points - 1)) for each i below points."""
    out = rows.withColumns({"_k": F.row_number().over(s.window) - 1, "_n": F.count("*").over(s.all)})
    i = F.expr(f"(_k * {points - 1} + greatest(_n - 2, 0)) div greatest(_n - 1, 1)")  # the first i whose row isn't before this one
    return out.where((F.col("_n") <= points) | (F.floor(i * (F.col("_n") - 1) / (points - 1)) == F.col("_k"))).drop("_k", "_n")


def plateaus(rows: DataFrame, s: Series, n: int = 20, least: float = 1e-4, length: int = 5) -> DataFrame:
    """series keys, start_step, end_step (from 0), n: runs of rows whose moving average improves by less than `least` on the row before, which is the run's first."""
    smooth = moving_average(rows, s, n)
    flat = F.coalesce(F.lag("ma").over(s.window) - F.col("ma") < least, F.lit(False))
    marked = smooth.withColumns({"_flat": flat, "_k": F.row_number().over(s.window) - 1})
    island = F.col("_k") - F.sum(F.col("_flat").cast("int")).over(s.window)
    runs = marked.withColumn("_island", island).where("_flat").groupBy(*s.keys, "_island")
    return runs.agg((F.min("_k") - 1).alias("start_step"), F.max("_k").alias("end_step"), (F.count("*") + 1).alias("n")).where(F.col("n") >= length).drop("_island")


def oscillation(rows: DataFrame, s: Series, share: float = 0.6) -> DataFrame:
    """series keys, sign_changes (how many changes go up after one that doesn't, or the reverse, over all changes), oscillating: that is above share, and there are four values."""
    up = F.col(s.value) - F.lag(s.value).over(s.window) > 0
    turned = rows.withColumn("_up", up).withColumn("_t", (F.col("_up") != F.lag("_up").over(s.window)).cast("int"))
    out = turned.groupBy(*s.keys).agg((F.coalesce(F.sum("_t"), F.lit(0)) / F.greatest(F.count("_up"), F.lit(1))).alias("sign_changes"), F.count("*").alias("_n"))
    return out.withColumn("oscillating", (F.col("_n") >= 4) & (F.col("sign_changes") > share)).drop("_n")


def trend(rows: DataFrame, s: Series) -> DataFrame:
    """series keys, slope of the value on its index."""
    indexed = rows.withColumn("_k", F.row_number().over(s.window))
    return indexed.groupBy(*s.keys).agg(F.regr_slope(F.col(s.value), F.col("_k")).alias("slope"), F.count("*").alias("n"))


def ema(rows: DataFrame, s: Series, alpha: float = 0.1) -> DataFrame:
    """series keys, ema: exponential smoothing that starts at the first value.

    Unrolled it is a weighted sum, so a series of any length is summed in parts and never stands in one row.
    """
    k, n = F.row_number().over(s.window), F.count("*").over(s.all)
    placed = rows.withColumns({"_k": k, "_n": n})
    share = F.pow(F.lit(1 - alpha), F.col("_n") - F.col("_k")) * F.when(F.col("_k") == 1, 1.0).otherwise(alpha)
    return placed.groupBy(*s.keys).agg(F.sum(F.col(s.value) * share).alias("ema"))


def patience(rows: DataFrame, s: Series) -> DataFrame:
    """series keys, best, stale: the least value, and the rows since a value was less than all before it."""
    before = F.min(s.value).over(s.window.rowsBetween(Window.unboundedPreceding, -1))
    placed = rows.withColumns({"_k": F.row_number().over(s.window), "_before": before})
    better = F.when(F.col("_before").isNull() | (F.col(s.value) < F.col("_before")), F.col("_k"))
    return placed.groupBy(*s.keys).agg(F.min(s.value).alias("best"), (F.max("_k") - F.max(better)).cast("long").alias("stale"))


def as_of(queries: DataFrame, rows: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """queries with value: the latest at or before `at` in the same series. One sort of the union, no join."""
    both = queries.select(*keys, at, F.lit(1).alias("_q"), F.lit(None).cast(dict(rows.dtypes)[value]).alias(value)).unionByName(rows.select(*keys, at, F.lit(0).alias("_q"), value))
    w = Window.partitionBy(*keys).orderBy(at, "_q").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last(value, ignorenulls=True).over(w)).where("_q = 1").drop("_q")


def as_of_interpolated(queries: DataFrame, rows: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """queries with value: linear between the neighbours, clamped at both ends. `at` is a number."""
    both = queries.select(*keys, at, F.lit(1).alias("_q"), F.lit(None).cast("double").alias(value)).unionByName(rows.select(*keys, at, F.lit(0).alias("_q"), F.col(value).cast("double").alias(value)))
    point = F.when(F.col("_q") == 0, F.struct(F.col(at).alias("x"), F.col(value).alias("y")))
    w = Window.partitionBy(*keys).orderBy(at, "_q")
    lo = F.last(point, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    hi = F.first(point, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    out = both.withColumns({"_lo": lo, "_hi": hi}).where("_q = 1")
    between = F.col("_lo.y") + (F.col("_hi.y") - F.col("_lo.y")) * F.try_divide(F.col(at) - F.col("_lo.x"), F.col("_hi.x") - F.col("_lo.x"))
    known = F.when(F.col("_lo").isNull(), F.col("_hi.y")).when(F.col("_hi").isNull() | (F.col("_lo.x") == F.col(at)), F.col("_lo.y")).otherwise(between)
    return out.withColumn(value, known).drop("_q", "_lo", "_hi")


def leaderboard(runs: DataFrame, metric: str, k: int, key: str, lower_is_better: bool = True) -> DataFrame:
    """The k best runs with their rank; runs without the metric come last."""
    v = F.coalesce(F.col(metric) if lower_is_better else -F.col(metric), F.lit(float("inf")))
    top = runs.withColumn("_v", v).orderBy("_v", key).limit(k)
    return top.withColumn("rank", F.rank().over(Window.orderBy("_v"))).drop("_v")


def compare(a: DataFrame, b: DataFrame, key: str, value: str, least: float = 1e-9) -> DataFrame:
    """key, a, b, delta, state: only_a, only_b, improved (lower), regressed or unchanged."""
    both = a.select(key, F.col(value).alias("a")).join(b.select(key, F.col(value).alias("b")), key, "full_outer").withColumn("delta", F.col("b") - F.col("a"))
    state = F.when(F.col("b").isNull(), "only_a").when(F.col("a").isNull(), "only_b").when(F.col("delta") < -least, "improved").when(F.col("delta") > least, "regressed").otherwise("unchanged")
    return both.withColumn("state", state)


def noise(rows: DataFrame, s: Series, n: int = 50, least: int = 10, target: float = 1.0) -> DataFrame:
    """rows with noise_scale, snr and batch_factor of the last n finite values, where there are at least so many."""
    v, w = F.col(s.value), s.window.rowsBetween(1 - n, 0)
    finite = rows.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    out = finite.withColumns({"_m": F.avg(v).over(w), "_v": F.coalesce(F.var_samp(v).over(w), F.lit(0.0)), "_n": F.count(v).over(w)}).where(F.col("_n") >= least)
    small = F.col("_m") < 1e-12
    snr = F.when(small, 0.0).otherwise(F.col("_m") * F.col("_m") / (F.col("_v") + 1e-12))
    out = out.withColumns({"noise_scale": F.when(small, float("inf")).otherwise(F.sqrt("_v") / (F.col("_m") + 1e-12)), "snr": snr})
    factor = F.when(F.col("snr") > 1e-9, F.sqrt(target / F.col("snr"))).otherwise(4.0)
    return out.withColumn("batch_factor", F.greatest(F.lit(0.1), F.least(F.lit(10.0), factor))).drop("_m", "_v", "_n")


def stability(rows: DataFrame, s: Series, driver: Column, n: int = 20) -> DataFrame:
    """series keys and, of the last n values: variance, oscillation (mean absolute change), sensitivity (mean of change over the driver's change, where that changes)."""
    last = rows.withColumn("_x", driver).withColumn("_back", F.row_number().over(Window.partitionBy(*s.keys).orderBy(*[F.desc(o) for o in s.order]))).where(F.col("_back") <= n)
    moved = last.withColumns({"_dv": F.abs(F.col(s.value) - F.lag(s.value).over(s.window)), "_dx": F.abs(F.col("_x") - F.lag("_x").over(s.window))})
    return moved.groupBy(*s.keys).agg(F.when(F.count("*") > 1, F.var_samp(s.value)).alias("variance"), F.avg("_dv").alias("oscillation"), F.avg(F.when(F.col("_dx") > 1e-15, F.col("_dv") / F.col("_dx"))).alias("sensitivity"))


def on_grid(rows: DataFrame, keys: list[str], at: str, value: str, steps: list[float]) -> DataFrame:
    """keys, at, value: every series at each of the steps, linear between its neighbours and clamped at its ends."""
    grid = rows.select(*keys).distinct().withColumn(at, F.explode(F.array(*[F.lit(x) for x in steps]).cast(f"array<{dict(rows.dtypes)[at]}>")))
    return as_of_interpolated(grid, rows, keys, at, value)


def stagnation(rows: DataFrame, s: Series, patience: int = 10, least: float = 0.0) -> DataFrame:
    """series keys, fired_at: the first row (from 0) at which the best value is `patience` rows old; each series fires once at most."""
    k = F.row_number().over(s.window) - 1
    before = F.min(s.value).over(s.window.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumns({"_k": k, "_best": before})
    improved = F.when(F.col("_best").isNull() | (F.col(s.value) < F.col("_best") - least), F.col("_k"))
    age = F.col("_k") - F.last("_i", ignorenulls=True).over(s.window.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("_i", improved).withColumn("_age", age).where(F.col("_age") >= patience).groupBy(*s.keys).agg(F.min("_k").alias("fired_at"))


def curriculum(rows: DataFrame, difficulty: Column, step: int, warm_up: int, bands: int = 5, start: float = 0.05) -> DataFrame:
    """rows with band (from 0) and eligible: the difficulty is within a ceiling that rises from start to 1 over the warm-up.

    The ceiling is computed exactly and rounded once, so that a difficulty equal to it is eligible.
    """
    low = Fraction(str(start))
    ceiling = 1.0 if warm_up <= 0 else float(low + (1 - low) * min(Fraction(step) / Fraction(warm_up), 1))
    return rows.withColumns({"band": F.least(F.floor(difficulty * bands), F.lit(bands - 1)).cast("int"), "eligible": difficulty <= ceiling})
