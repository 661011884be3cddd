"""Sinks: chunks, splits, manifests, results."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_split(rows: DataFrame, path: str) -> None:
    """A folder per value of split."""
    rows.write.mode("overwrite").partitionBy("split").parquet(path)


def write_with_manifest(rows: DataFrame, path: str, lineage: dict[str, str], tokenizer: bytes | None = None) -> None:
    """rows as Parquet, and path.manifest: one JSON row with its counts, schema, and lineage, by Spark's writer."""
    rows.write.mode("overwrite").parquet(path)
    spark = rows.sparkSession
    n = spark.read.parquet(path).count()
    entry = {"rows": n, "columns": rows.dtypes, "lineage": lineage}
    one = spark.createDataFrame([(json.dumps(entry, sort_keys=True), bytearray(tokenizer or b""))], "entry string, tokenizer binary")
    one.select("entry", F.sha2("tokenizer", 256).alias("tokenizer_sha256"), F.current_timestamp().cast("string").alias("created_at")).write.mode("overwrite").json(f"{path}.manifest")


def read_manifest(spark: SparkSession, path: str) -> dict:
    row = spark.read.json(f"{path}.manifest").head()
    return json.loads(row.entry) | {"tokenizer_sha256": row.tokenizer_sha256, "created_at": row.created_at}


def save_result(rows: DataFrame, store: str, name: str) -> None:
    """Replaces the result of that name; others stay."""
    out = rows.withColumn("saved_at", F.current_timestamp())
    out.write.mode("overwrite").parquet(f"{store}/name={name}")


def load_results(spark: SparkSession, store: str, name: str | None = None) -> DataFrame:
    found = spark.read.option("mergeSchema", "true").parquet(store)
    return found.where(F.col("name") == name) if name else found


def list_results(spark: SparkSession, store: str) -> DataFrame:
    """name, saved_at, newest first."""
    return load_results(spark, store).groupBy("name").agg(F.max("saved_at").alias("saved_at")).orderBy(F.desc("saved_at"), "name")


def delete_result(spark: SparkSession, store: str, name: str) -> bool:
    """Whether there was a result of that name to delete."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/name={name}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def write_report(rows: DataFrame, path: str, kind: str, order: list[str]) -> None:
    """A report of few rows, in order, as csv with a header, json lines or a markdown table; each in one file."""
    one = rows.orderBy(*order).coalesce(1)
    if kind == "csv":
        one.write.mode("overwrite").option("header", "true").csv(path)
    elif kind == "json":
        one.write.mode("overwrite").json(path)
    elif kind == "markdown":
        row = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"([|\\])|\n", r"\\$1") for c in rows.columns]), F.lit(" |"))
        head = [f"| {' | '.join(rows.columns)} |", f"| {' | '.join('---' for _ in rows.columns)} |"]
        lines = one.select(F.array(row).alias("value"))
        top = rows.sparkSession.range(1).select(F.array(*map(F.lit, head)).alias("value"))
        top.union(lines).coalesce(1).select(F.explode("value").alias("value")).write.mode("overwrite").text(path)
    else:
        raise ValueError(f"unknown report: {kind}")
