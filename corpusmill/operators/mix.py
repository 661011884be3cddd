"""Combining, mixing, balancing and splitting datasets. All draws are hashes, so every run agrees."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.order import global_rank, hash32, seeded_rank, uniform
from corpusmill.functions.text import md5_fold
from corpusmill.session import small_side, written


def weights_table(spark, weights: dict[str, float], sources: list[str] | None = None) -> DataFrame:
    """source, weight: normalised over the sources asked for; missing ones weigh 0, without any overlap all are equal."""
    names = sources if sources is not None else list(weights)
    raw = [max(0.0, weights.get(n, 0.0)) for n in names]
    shares = [w / sum(raw) for w in raw] if sum(raw) > 0 else [1 / max(len(names), 1)] * len(names)
    return spark.createDataFrame(list(zip(names, shares, strict=True)), "source string, weight double")


def candidates(spark, sources: list[str], n: int, seed: int = 42) -> DataFrame:
    """candidate, source, weight: mixtures to try. One source has one; two are stepped through evenly; more are drawn uniformly, each by the hash of its number and source."""
    if not sources:
        raise ValueError("candidates need at least one source")
    if len(sources) <= 2:
        steps = [(k, (k + 1) / (n + 1)) for k in range(n)] if len(sources) == 2 else [(0, 1.0)]
        rows = [(k, s, w if s == sources[0] else 1 - w) for k, w in steps for s in sources]
        return spark.createDataFrame(rows, "candidate long, source string, weight double")
    drawn = spark.range(n).select(F.col("id").alias("candidate"), F.explode(F.array(*map(F.lit, sources))).alias("source"))
    drawn = drawn.withColumn("_e", -F.log(uniform(F.col("candidate"), F.col("source"), F.lit(seed))))
    return drawn.withColumn("weight", F.col("_e") / F.sum("_e").over(Window.partitionBy("candidate"))).drop("_e")


def weights_from_losses(losses: DataFrame, method: str = "proportional", loss: str = "loss") -> DataFrame:
    """losses with weight: proportional to the loss, softmax of it, or equal."""
    one = Window.partitionBy()
    raw = {"proportional": F.col(loss), "softmax": F.exp(F.col(loss) - F.max(loss).over(one)), "equal": F.lit(1.0)}[method]
    return losses.withColumn("_w", raw).withColumn("weight", F.col("_w") / F.sum("_w").over(one)).drop("_w")


def concat(datasets: dict[str, DataFrame], max_rows: dict[str, int] | None = None, key: str = "chunk_id") -> DataFrame:
    """All rows one dataset after the other, with `dataset`; of those named in max_rows the first so many by key."""
    parts = []
    for name, df in datasets.items():
        limit = (max_rows or {}).get(name)
        part = df if limit is None else global_rank(df, F.lit(0), [F.col(key)], "_r").where(F.col("_r") < limit).drop("_r")
        parts.append(part.withColumn("dataset", F.lit(name)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def cap_per_group(rows: DataFrame, group: str, n: int, order: list[Column]) -> DataFrame:
    """The first n rows of each group."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_k") <= n).drop("_k")


def interleave(rows: DataFrame, weights: DataFrame, source: str = "source", key: str = "doc_id") -> DataFrame:
    """rows with `position`: sources take turns in proportion to their weights until all are drained."""
    ranks = _rank_in_source(rows, source, key)
    timed = ranks.join(F.broadcast(weights.withColumnRenamed("source", source)), source).where("weight > 0").withColumn("_t", (F.col("_r") + 0.5) / F.col("weight"))
    return global_rank(timed, F.col("_t"), [F.col(source), F.col(key)], "position").drop("_r", "_t", "weight")


def weighted_drain(rows: DataFrame, weights: DataFrame, source: str = "source", key: str = "doc_id", seed: int = 42) -> DataFrame:
    """rows with `race`: ordering by it draws sources at random by weight and loses no row."""
    joined = rows.join(F.broadcast(weights.withColumnRenamed("source", source)), source)
    return joined.withColumn("race", -F.log(uniform(F.col(key), F.lit(seed))) / F.col("weight")).drop("weight")


def _rank_in_source(rows: DataFrame, source: str, key: str) -> DataFrame:
    """rows with _r: the position within the source, from the position among all, so that no task holds a whole source."""
    ranked = written(global_rank(rows, F.col(source), [F.col(key)], "_g"))
    firsts = small_side(written(ranked.groupBy(source).agg(F.min("_g").alias("_base"))))
    return ranked.join(firsts, source).withColumn("_r", F.col("_g") - F.col("_base")).drop("_g", "_base")


def draw_with_replacement(rows: DataFrame, weights: DataFrame, n: int, source: str = "source", key: str = "doc_id", seed: int = 42) -> DataFrame:
    """n draws (draw, source, key): a source by weight, then one of its rows, by two hashes of the draw's number."""
    ranked = written(_rank_in_source(rows.select(source, key), source, key))
    counts = ranked.groupBy(source).agg(F.count("*").alias("n"))
    by_name = Window.orderBy(source)
    bounds = counts.join(weights.withColumnRenamed("source", source), source).where("weight > 0")
    total = F.sum("weight").over(Window.partitionBy())
    high = F.round(F.sum("weight").over(by_name.rowsBetween(Window.unboundedPreceding, 0)) / total, 9)
    bounds = bounds.withColumn("high", high).withColumn("low", F.lag("high", 1, 0.0).over(by_name)).drop("weight")
    draws = rows.sparkSession.range(n).select(F.col("id").alias("draw"), uniform(F.col("id"), F.lit(seed), F.lit("source")).alias("u"), hash32(F.col("id"), F.lit(seed), F.lit("row")).alias("h"))
    placed = draws.join(F.broadcast(bounds), (F.col("u") >= F.col("low")) & (F.col("u") < F.col("high")))
    return placed.select("draw", source, (F.col("h") % F.col("n")).alias("_r")).join(ranked, [source, "_r"]).select("draw", source, key)


def class_weights(rows: DataFrame, col: str, classes: int | None = None) -> DataFrame:
    """col, n, weight: the ideal count of a class divided by its own; the ideal is total over classes."""
    counts = rows.groupBy(col).agg(F.count("*").alias("n"))
    one = Window.partitionBy()
    k = F.lit(classes) if classes else F.count("*").over(one)
    return counts.withColumn("weight", F.sum("n").over(one) / k / F.col("n"))


def balance(rows: DataFrame, language: str, difficulty: Column, size: Column, topic: str) -> DataFrame:
    """rows with weight: .4 language, .2 difficulty, .2 size, .2 topic, within .1 and 3. Difficulty has five bins."""
    binned = rows.withColumns({"_bin": F.least(F.floor(difficulty * 5), F.lit(4)), "_size": size})
    lang = class_weights(binned, language).select(language, F.col("weight").alias("_wl"))
    hard = class_weights(binned, "_bin", 5).select("_bin", F.col("weight").alias("_wd"))
    about = class_weights(binned, topic).select(topic, F.col("weight").alias("_wt"))
    top = binned.agg(F.max("_size").alias("_max"))
    # five bins are few; languages and topics are counted before they are broadcast
    out = binned.join(F.broadcast(hard), "_bin").join(small_side(written(lang)), language).join(small_side(written(about)), topic).crossJoin(F.broadcast(top))
    blend = 0.4 * F.col("_wl") + 0.2 * F.col("_wd") + 0.2 * (1 - 0.3 * F.col("_size") / F.col("_max")) + 0.2 * F.col("_wt")
    return out.withColumn("weight", F.least(F.greatest(blend, F.lit(0.1)), F.lit(3.0))).drop("_bin", "_size", "_wl", "_wd", "_wt", "_max")


def effective_size(weight: Column) -> Column:
    """Kish's effective sample size, an aggregate."""
    return F.sum(weight) * F.sum(weight) / F.sum(weight * weight)


def imbalance(rows: DataFrame, col: str, limit: float, least: int = 100) -> DataFrame:
    """One row: the largest class, its share, whether that is above the limit, whether there are few rows."""
    counts = rows.groupBy(col).agg(F.count("*").alias("n"))
    out = counts.agg(F.max_by(col, F.struct(F.col("n"), F.col(col))).alias("top"), F.max("n").alias("top_n"), F.sum("n").alias("n"))
    return out.select("top", (F.col("top_n") / F.col("n")).alias("share"), (F.col("top_n") / F.col("n") > limit).alias("dominant"), (F.col("n") < least).alias("few"))


def hash_fold(rows: DataFrame, key: Column, k: int) -> DataFrame:
    return rows.withColumn("fold", md5_fold(key, k))


def group_folds(rows: DataFrame, group: str, k: int, seed: int = 42, by_size: bool = False) -> DataFrame:
    """rows with fold: groups, shuffled or the largest first, are dealt round-robin and never split."""
    groups = rows.groupBy(group).agg(F.count("*").alias("n"))
    h = hash32(F.col(group), F.lit(seed))
    if by_size:
        dealt = global_rank(groups, -F.col("n"), [h, F.col(group)], "_r")
    else:
        dealt = global_rank(groups, h, [F.col(group)], "_r")
    return rows.join(dealt.select(group, (F.col("_r") % k).cast("int").alias("fold")), group)


def split(rows: DataFrame, key: str, ratio: float, seed: int = 42) -> DataFrame:
    """rows with split: exactly max(1, int(n * ratio)) in val, the others in train."""
    n = rows.count()
    cut = max(1, int(n * ratio))
    return seeded_rank(rows, F.col(key), seed, "_r").withColumn("split", F.when(F.col("_r") < cut, "val").otherwise("train")).drop("_r")


def three_way(rows: DataFrame, key: str, train: float = 0.8, val: float = 0.1, seed: int = 42) -> DataFrame:
    n = rows.count()
    a, b = int(n * train), int(n * train) + int(n * val)
    return seeded_rank(rows, F.col(key), seed, "_r").withColumn("split", F.when(F.col("_r") < a, "train").when(F.col("_r") < b, "val").otherwise("test")).drop("_r")


def fold_leakage(rows: DataFrame, group: str, fold: str = "fold") -> DataFrame:
    """Groups that stand in more than one fold."""
    return rows.groupBy(group).agg(F.count_distinct(fold).alias("n_folds")).where("n_folds > 1")


def labelled_set(rows: DataFrame, label: str, confidence: str, text: str, key: str, per_class: int, least: float = 0.3) -> DataFrame:
    """Rows of at least 50 characters and enough confidence, texts cut at 2000, so many rows per class."""
    fit = rows.where((F.length(text) >= 50) & (F.col(confidence) >= least)).withColumn(text, F.substring(text, 1, 2000))
    return cap_per_group(fit, label, per_class, [F.col(key)])
