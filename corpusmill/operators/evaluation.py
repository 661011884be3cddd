"""Evaluation statistics: pass@k, group advantage, calibration, confusion, agreement, distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import total

# Perplexity levels, each above its bound.
LEVELS = ((1000, "barely learning"), (200, "early training"), (100, "below average"), (50, "reasonable"), (20, "good"), (10, "very good"))
BEST_LEVEL = "excellent / check for overfitting"


def pass_at_k(n: Column, c: Column, k: int) -> Column:
    """1 - prod over i < k of (n - c - i) / (n - i); 1 where n - c < k, null where n < k."""
    miss = F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.lit(1.0), lambda p, i: p * (n - c - i) / (n - i))
    return F.when(n < k, F.lit(None)).when(n - c < k, 1.0).otherwise(1.0 - miss)


def mean_pass_at_k(attempts: DataFrame, problem: str, passed: Column, ks: list[int]) -> DataFrame:
    """k, problems (with n >= k), pass_at_k: their mean, 0 without any."""
    counts = attempts.groupBy(problem).agg(F.count("*").alias("n"), F.count_if(passed).alias("c"))
    each = counts.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), pass_at_k(F.col("n"), F.col("c"), k).alias("p")) for k in ks])).alias("x")).select("x.*")
    return each.groupBy("k").agg(F.count("p").alias("problems"), F.coalesce(F.avg("p"), F.lit(0.0)).alias("pass_at_k"))


def group_advantage(rows: DataFrame, group: list[str], reward: str) -> DataFrame:
    """rows with advantage: (reward - mean) / (sample deviation + 1e-8) within the group, 0 in a group of one."""
    w = Window.partitionBy(*group)
    return rows.withColumn("advantage", F.coalesce((F.col(reward) - F.avg(reward).over(w)) / (F.stddev_samp(reward).over(w) + 1e-8), F.lit(0.0)))


def _bins(rows: DataFrame, confidence: Column, correct: Column, bins: int) -> DataFrame:
    c = F.least(F.greatest(confidence, F.lit(0.0)), F.lit(1.0))
    b = F.least(F.floor(c * bins), F.lit(bins - 1)).cast("int")
    out = rows.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(c).alias("confidence"), F.avg(correct).alias("accuracy"), F.count_if(c > correct).alias("over"), F.count_if(c < correct).alias("under"))
    return out.withColumn("gap", F.abs(F.col("confidence") - F.col("accuracy")))


def reliability(rows: DataFrame, confidence: Column, correct: Column, bins: int = 10) -> DataFrame:
    """bin, n, confidence (cut to 0 to 1), accuracy, gap."""
    return _bins(rows, confidence, correct, bins).drop("over", "under")


def calibration_error(rows: DataFrame, confidence: Column, correct: Column, bins: int = 10) -> DataFrame:
    """One row: ece, the largest gap, and the shares of rows whose confidence is above or below their correctness."""
    return _bins(rows, confidence, correct, bins).agg(
        (F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"), F.max("gap").alias("largest_gap"),
        (F.sum("over") / F.sum("n")).alias("over"), (F.sum("under") / F.sum("n")).alias("under"))


def confusion(rows: DataFrame, actual: str, predicted: str) -> DataFrame:
    """actual, predicted, n."""
    return rows.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def per_class(rows: DataFrame, actual: str, predicted: str) -> DataFrame:
    """class, support, precision, recall, f1 (six digits) of the classes that occur as actual ones."""
    c = confusion(rows, actual, predicted)
    by_a = c.groupBy(F.col("actual").alias("class")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)).alias("tp"))
    by_p = c.groupBy(F.col("predicted").alias("class")).agg(F.sum("n").alias("found"))
    out = by_a.join(by_p, "class", "left").fillna(0, ["found"])
    p, r = F.coalesce(F.try_divide("tp", "found"), F.lit(0.0)), F.coalesce(F.try_divide("tp", "support"), F.lit(0.0))
    out = out.withColumns({"precision": p, "recall": r})
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return out.select("class", "support", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round(f1, 6).alias("f1"))


def macro(rows: DataFrame, actual: str, predicted: str) -> DataFrame:
    """One row: macro and weighted F1 over the actual classes."""
    c = per_class(rows, actual, predicted)
    return c.agg(F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"), F.sum("support").alias("n"))


def agreement(rows: DataFrame, score: Column, label: Column) -> DataFrame:
    """One row: mae, rmse, pearson of a score against a label."""
    e = score - label
    return rows.agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.corr(score, label).alias("pearson"))


def perplexity_level(ppl: Column) -> Column:
    out = F.when(ppl > LEVELS[0][0], LEVELS[0][1])
    for bound, name in LEVELS[1:]:
        out = out.when(ppl > bound, name)
    return out.otherwise(BEST_LEVEL)


def perplexity_rollup(rows: DataFrame, by: str, loss: Column, step: Column) -> DataFrame:
    """by (null: all), current, least, most, mean perplexity and n."""
    p = F.exp(loss)
    return rows.rollup(by).agg(F.max_by(p, step).alias("current"), F.min(p).alias("least"), F.max(p).alias("most"), F.avg(p).alias("mean"), F.count("*").alias("n"))


def softmax(logits: Column, temperature: float = 1.0) -> Column:
    """Of an array of numbers."""
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp((x - top) / temperature))
    return F.transform(F.array(e), lambda a: F.transform(a, lambda x: x / total(a)))[0]


def divergences(p: Column, q: Column) -> dict[str, Column]:
    """kl, js, cross_entropy of two arrays of probabilities, in nats."""
    term = lambda a, b: F.when(a > 0, a * F.log(a / b)).otherwise(0.0)
    m = F.zip_with(p, q, lambda a, b: (a + b) / 2)
    kl = lambda a, b: total(F.zip_with(a, b, term))
    return {"kl": kl(p, q), "js": (kl(p, m) + kl(q, m)) / 2, "cross_entropy": total(F.zip_with(p, q, lambda a, b: -a * F.log(b)))}


def reward_mix(parts: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    """Weighted sum of type, syntax, style and completeness scores."""
    w = weights or {"type": 0.4, "syntax": 0.2, "style": 0.1, "completeness": 0.3}
    return sum((F.coalesce(parts[n], F.lit(0.0)) * x for n, x in w.items()), F.lit(0.0))


def repository_tier(passed: Column, failed: Column, skipped: Column, has_tests: Column) -> dict[str, Column]:
    """pass_rate (skipped tests don't count), tier and weight of a repository by its test results."""
    ran = F.coalesce(passed, F.lit(0)) + F.coalesce(failed, F.lit(0))
    rate = F.try_divide(passed, ran)
    tier = F.when((ran > 0) & (rate >= 0.9), "verified").when(ran > 0, "tested").when(has_tests, "detected").otherwise("none")
    return {"pass_rate": rate, "tier": tier, "weight": F.when(tier == "verified", 3.0).when(tier == "tested", 2.0).when(tier == "detected", 1.0).otherwise(0.5)}
