"""Embeddings: similarity, nearest neighbours, statistics, clustering, projection, sampling cuts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import total
from corpusmill.session import written

#: Queries of a block; a block's vectors are what a task holds besides its batch.
BLOCK = 4096
#: Rows that a task multiplies with a block at once.
ROWS_AT_ONCE = 512


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is zero."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def nearest(rows: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query, id, similarity, rank: the k rows most similar to each query, itself excluded, ties by id.

    Queries go out in blocks of fixed size; each task multiplies its batches with a block and sends on the k best
    of each query only.
    """
    own = written(queries.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")))
    blocks = max(1, -(-own.count() // BLOCK))
    found = None
    for block in range(blocks):
        part = own.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).collect()
        ids, matrix = np.array([r.id for r in part], np.int64), np.array([r.v for r in part], np.float64).reshape(len(part), -1)

        def best(batches: Iterator[pa.RecordBatch], ids=ids, matrix=matrix) -> Iterator[pa.RecordBatch]:
            unit = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)
            kept: list[np.ndarray] = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
            for b in batches:
                if not b.num_rows or not len(ids):
                    continue
                every = np.stack([np.asarray(x, np.float64) for x in b.column(1).to_pylist()])
                by_id = np.argsort(b.column(0).to_numpy(), kind="stable")  # so that a stable sort by similarity leaves ties by id
                for lo in range(0, len(by_id), ROWS_AT_ONCE):
                    rows_ = by_id[lo : lo + ROWS_AT_ONCE]
                    at, v = b.column(0).to_numpy()[rows_], every[rows_]
                    s = np.round((v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)) @ unit.T, 9)
                    s[at[:, None] == ids[None, :]] = -np.inf
                    best_rows = np.argsort(-s, axis=0, kind="stable")[:k]
                    q = np.tile(np.arange(len(ids)), len(best_rows))
                    new = [np.concatenate([x, y]) for x, y in zip(kept, (q, at[best_rows].ravel(), np.take_along_axis(s, best_rows, 0).ravel()), strict=True)]
                    order = np.lexsort((new[1], -new[2], new[0]))
                    new = [x[order] for x in new]
                    starts = np.searchsorted(new[0], np.arange(len(ids)))
                    near = (np.arange(len(new[0])) - starts[new[0]] < k) & np.isfinite(new[2])
                    kept = [x[near] for x in new]
            yield pa.RecordBatch.from_arrays([pa.array(ids[kept[0]]), pa.array(kept[1]), pa.array(kept[2])], ["query", "id", "similarity"])

        local = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(best, "query long, id long, similarity double")
        found = local if found is None else found.union(local)
    w = Window.partitionBy("query").orderBy(F.desc("similarity"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def norm_stats(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    n = norm(F.col(vector))
    return rows.agg(F.count("*").alias("n"), F.avg(n).alias("mean_norm"), F.stddev_pop(n).alias("std_norm"), F.min(n).alias("least_norm"), F.max(n).alias("most_norm"))


def dimension_stats(rows: DataFrame, vector: str = "embedding", dead: float = 1e-8) -> DataFrame:
    """dim, mean, variance, dead."""
    spread = rows.select(F.posexplode(vector).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    return spread.groupBy("dim").agg(F.avg("x").alias("mean"), F.var_pop("x").alias("variance")).withColumn("dead", F.col("variance") < dead)


def mean_pair_cosine(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """One row: the mean cosine over all pairs, from the sum of the unit vectors, without any pair."""
    unit = rows.withColumn("_n", norm(F.col(vector))).where("_n > 0").select(F.posexplode(F.transform(vector, lambda x: x / F.col("_n"))).alias("dim", "x"))
    sums = unit.groupBy("dim").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    return sums.agg(F.max("n").alias("n"), F.sum(F.col("s") * F.col("s")).alias("q")).select("n", F.try_divide(F.col("q") - F.col("n"), F.col("n") * (F.col("n") - 1.0)).alias("mean_cosine"))


def clusters(rows: DataFrame, k: int, vector: str = "embedding", iterations: int = 20, seed: int = 42) -> DataFrame:
    """rows with cluster."""
    data = rows.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    model = KMeans(k=k, maxIter=iterations, seed=seed, featuresCol="_v", predictionCol="cluster").fit(data)
    return model.transform(data).drop("_v")


def centres(rows: DataFrame, cluster: str = "cluster", vector: str = "embedding") -> DataFrame:
    """cluster, n, squares (the sum of its vectors' squared norms), centre: a row for each cluster, from sums by dimension."""
    spread = rows.where(F.col(cluster).isNotNull()).select(F.col(cluster).alias("cluster"), F.posexplode(F.col(vector).cast("array<double>")).alias("dim", "x"))
    sums = spread.groupBy("cluster", "dim").agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    centre = F.transform(F.array_sort(F.collect_list(F.struct("dim", (F.col("s") / F.col("n")).alias("m")))), lambda d: d["m"])
    return sums.groupBy("cluster").agg(F.max("n").alias("n"), F.sum("q").alias("squares"), centre.alias("centre"))


def _all_centres(rows: DataFrame, cluster: str, vector: str, most: int) -> DataFrame:
    """One row: all clusters with their centres, whose number is a model's parameter and is checked."""
    found = written(centres(rows, cluster, vector))
    if (n := found.count()) > most:
        raise ValueError(f"{n} clusters; the limit is {most}")
    return found.agg(F.array_sort(F.collect_list(F.struct("cluster", "n", "squares", "centre"))).alias("_all"))


def silhouette(rows: DataFrame, cluster: str = "cluster", vector: str = "embedding", most: int = 10_000) -> DataFrame:
    """rows with silhouette: how much nearer a vector is to its own cluster than to the next one, in mean squared distances.

    A mean squared distance to all vectors of a cluster follows from their number, sum and squared norms, so no pair is made. A vector
    alone in its cluster has 0, as one that equals all others; it is null without a cluster or vector, and where there is one cluster only.
    """
    v = F.col(vector).cast("array<double>")
    out = rows.crossJoin(F.broadcast(_all_centres(rows, cluster, vector, most))).withColumn("_q", dot(v, v))
    mean = lambda c: F.greatest(F.col("_q") + c["squares"] / c["n"] - 2 * dot(v, c["centre"]), F.lit(0.0))
    far = F.transform("_all", lambda c: F.struct((c["cluster"] == F.col(cluster)).alias("own"), c["n"].alias("n"), mean(c).alias("d")))
    own = F.get(F.filter("_far", lambda c: c["own"]), F.lit(0))
    other = F.array_min(F.transform(F.filter("_far", lambda c: ~c["own"]), lambda c: c["d"]))
    out = out.withColumn("_far", far).withColumns({"_own": own, "_b": other}).withColumn("_a", F.col("_own.d") * F.col("_own.n") / F.greatest(F.col("_own.n") - 1, F.lit(1)))
    value = F.when(F.col("_own.n") == 1, 0.0).otherwise(F.coalesce(F.try_divide(F.col("_b") - F.col("_a"), F.greatest("_a", "_b")), F.lit(0.0)))
    return out.withColumn("silhouette", F.when(F.col(vector).isNotNull() & F.col("_b").isNotNull() & F.col("_a").isNotNull(), value)).drop("_all", "_q", "_far", "_own", "_b", "_a")


def cluster_quality(rows: DataFrame, cluster: str = "cluster", vector: str = "embedding", most: int = 10_000) -> DataFrame:
    """One row: n_clusters, n, inside (mean variance of the distances to the centre, of clusters with two vectors or more), between (mean
    distance of two centres), estimate ((between - inside) over the larger, from -1 to 1). All are 0 where there is nothing to compare."""
    one = _all_centres(rows, cluster, vector, most)
    named = rows.where(F.col(cluster).isNotNull() & F.col(vector).isNotNull()).crossJoin(F.broadcast(one))
    centre = F.get(F.filter("_all", lambda c: c["cluster"] == F.col(cluster)), F.lit(0))["centre"]
    spread = named.select(F.col(cluster).alias("_c"), euclidean(F.col(vector), centre).alias("_d")).groupBy("_c").agg(F.count("*").alias("n"), F.var_pop("_d").alias("v"))
    inside = spread.agg(F.count("*").alias("n_clusters"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.avg(F.when(F.col("n") >= 2, F.col("v"))), F.lit(0.0)).alias("inside"))
    a = one.select(F.posexplode("_all").alias("_i", "_a"), "_all")
    between = a.select(F.explode(F.transform(F.slice("_all", F.col("_i") + 2, F.size("_all")), lambda b: euclidean(F.col("_a.centre"), b["centre"]))).alias("_d")).agg(F.coalesce(F.avg("_d"), F.lit(0.0)).alias("between"))
    estimate = (F.col("between") - F.col("inside")) / F.greatest("between", "inside", F.lit(1e-12))
    return inside.crossJoin(F.broadcast(between)).withColumn("estimate", F.greatest(F.least(estimate, F.lit(1.0)), F.lit(-1.0)))


def projected(rows: DataFrame, dims: int = 2, vector: str = "embedding") -> DataFrame:
    """rows with projection: principal components (their signs are arbitrary)."""
    data = rows.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    model = PCA(k=dims, inputCol="_v", outputCol="_p").fit(data)
    return model.transform(data).withColumn("projection", vector_to_array("_p")).drop("_v", "_p")


def top_k_cut(logits: DataFrame, id_col: str, k: int, vector: str = "embedding") -> DataFrame:
    """id, token, probability of the k largest logits, renormalised."""
    spread = logits.select(id_col, F.posexplode(vector).alias("token", "x"))
    w = Window.partitionBy(id_col)
    kept = spread.withColumn("r", F.row_number().over(w.orderBy(F.desc("x"), "token"))).where(F.col("r") <= k)
    e = F.exp(F.col("x").cast("double"))
    return kept.withColumn("probability", e / F.sum(e).over(w)).select(id_col, "token", "probability")


def top_p_cut(logits: DataFrame, id_col: str, p: float, vector: str = "embedding") -> DataFrame:
    """id, token, probability: the fewest most likely tokens that reach p together, renormalised."""
    spread = logits.select(id_col, F.posexplode(vector).alias("token", "x")).withColumn("e", F.exp(F.col("x").cast("double")))
    w = Window.partitionBy(id_col)
    shared = spread.withColumn("q", F.col("e") / F.sum("e").over(w))
    before = F.coalesce(F.sum("q").over(w.orderBy(F.desc("x"), "token").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    kept = shared.withColumn("b", F.round(before, 12)).where(F.col("b") < p)
    return kept.withColumn("probability", F.col("q") / F.sum("q").over(w)).select(id_col, "token", "probability")
