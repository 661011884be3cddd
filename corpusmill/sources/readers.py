"""Readers: parquet by language, JSON lines, text, directories, matrices, logs."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Keys that may hold the text, directories and files that are never read, log patterns.
TEXT_KEYS = ("text", "content", "code", "src")
IGNORED_DIRS = ("node_modules", "dist", "build", ".git", "venv", ".venv", "target", "__pycache__", "vendor")
SECRET_FILES = (r"\.env[^/]*", r"credentials\.json", r"id_rsa", r"[^/]*\.pem")
EXTENSIONS = ("py", "ts", "js", "txt")
LOG_FIELDS = {"step": r"step[ =:]+(\d+)", "loss": r"loss[ =:]+([0-9.eE+-]+|nan|inf)", "lr": r"lr[ =:]+([0-9.eE+-]+)", "tokens_per_sec": r"tok(?:ens)?/s(?:ec)?[ =:]+([0-9.]+)", "grad_norm": r"grad_norm[ =:]+([0-9.eE+-]+)"}


def corpus(spark: SparkSession, root: str, languages: list[str] | None = None, limit: int | None = None, min_chars: int = 50, text_col: str = "content") -> DataFrame:
    """content, lang from root/lang=x/*.parquet; languages prune partitions. A limit takes rows in a fixed order."""
    docs = spark.read.parquet(root).select(text_col, "lang").where(F.length(text_col) >= min_chars)
    docs = docs.where(F.col("lang").isin(languages)) if languages else docs
    return docs.orderBy("lang", F.xxhash64(text_col), text_col).limit(limit) if limit is not None else docs


def missing_languages(spark: SparkSession, root: str, languages: list[str]) -> list[str]:
    """Of the languages asked for, those without a partition below root; all of them where there is none at all."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [x for x in languages if not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(path, f"lang={x}"))]


def sample_per_language(docs: DataFrame, n: int, key: str = "doc_id", lang: str = "lang") -> DataFrame:
    """n rows in all, as many of each language, the first by key."""
    langs = max(1, docs.select(lang).distinct().count())
    w = Window.partitionBy(lang).orderBy(key)
    return docs.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n // langs).drop("_k")


def jsonl(spark: SparkSession, path: str, keep_malformed: bool = True) -> DataFrame:
    """text, malformed: the first text key that a line has; a malformed line is its own text, or skipped."""
    lines = spark.read.text(path).where(F.btrim("value") != "")
    parsed = lines.withColumn("_o", F.from_json("value", "map<string,string>", {"mode": "PERMISSIVE"}))
    text = F.coalesce(*[F.col("_o")[k] for k in TEXT_KEYS])
    bad = F.col("_o").isNull()
    out = parsed.select(F.when(bad, F.col("value")).otherwise(text).alias("text"), bad.alias("malformed")).where("text IS NOT NULL")
    return out if keep_malformed else out.where("NOT malformed")


def text_samples(spark: SparkSession, path: str, max_lines: int = 100, long_line: int = 200) -> DataFrame:
    """path, text: a file of fewer than max_lines lines with a long one is one sample, others one for each line."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x) != "")
    whole = (F.size(lines) < max_lines) & F.exists(lines, lambda x: F.length(x) > long_line)
    return files.select("path", F.explode(F.when(whole, F.array("text")).otherwise(lines)).alias("text"))


def directory(spark: SparkSession, root: str, extensions: tuple[str, ...] = EXTENSIONS, min_chars: int = 10) -> DataFrame:
    """path, content, source of the files below root with an extension, read whole. Tiny files are skipped."""
    files = (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(extensions) + "}").text(root, wholetext=True)
             .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content")))
    return files.where(F.length("content") >= min_chars).withColumn("source", F.lit("local"))


def wanted_path(path: Column) -> Column:
    """Whether a repository file is outside ignored directories and no secret file."""
    ignored = "(^|/)(" + "|".join(d.replace(".", r"\.") for d in IGNORED_DIRS) + r"|[^/]*\.egg-info)/"
    return ~path.rlike(ignored) & ~path.rlike("(^|/)(" + "|".join(SECRET_FILES) + ")$")


def repository_probes(files: DataFrame, repo: str = "repo", path: str = "path", content: str = "content") -> DataFrame:
    """repo, has_tests, has_ci, strict (of the compiler settings), license (by its text)."""
    p, c = F.col(path), F.col(content)
    named = p.rlike(r"(?i)(^|/)licen[cs]e[^/]*$")
    spdx = F.when(~named, None).when(c.contains("Permission is hereby granted, free of charge"), "MIT").when(c.contains("Apache License"), "Apache-2.0").when(c.contains("GNU GENERAL PUBLIC LICENSE"), "GPL-3.0").when(c.contains("Redistribution and use in source and binary forms"), "BSD-3-Clause")
    strict = p.endswith("tsconfig.json") & (F.get_json_object(c, "$.compilerOptions.strict") == "true")
    return files.groupBy(repo).agg(F.max(p.rlike(r"(^|/)(tests?|__tests__|spec)/|(^|/)test_[^/]*$|\.(test|spec)\.[a-z]+$")).alias("has_tests"), F.max(p.rlike(r"(^|/)\.github/workflows/|(^|/)\.gitlab-ci\.yml$")).alias("has_ci"),
                                   F.coalesce(F.max(strict), F.lit(False)).alias("strict"), F.max(spdx).alias("license"))


def search_predicate(stars: tuple[int | None, int | None] = (None, None), forks: tuple[int | None, int | None] = (None, None), language: str | None = None, licenses: list[str] | None = None,
                     pushed_after: str | None = None, archived: bool | None = None, fork: bool | None = None, topics: list[str] | None = None, max_size: int | None = None) -> Column:
    """A filter on repository metadata; what is None is not tested."""
    out = F.lit(True)
    for col, (lo, hi) in (("stars", stars), ("forks", forks)):
        out = out & (F.col(col) >= lo if lo is not None else F.lit(True)) & (F.col(col) <= hi if hi is not None else F.lit(True))
    for col, value in (("language", language), ("archived", archived), ("fork", fork)):
        out = out & (F.col(col) == value) if value is not None else out
    out = out & F.lower("license").isin([x.lower() for x in licenses]) if licenses else out
    out = out & (F.col("pushed_at") > pushed_after) if pushed_after else out
    out = out & F.arrays_overlap("topics", F.array(*[F.lit(t) for t in topics])) if topics else out
    return out & (F.col("size") <= max_size) if max_size is not None else out


def matrices(spark: SparkSession, path: str, width: int = 512) -> DataFrame:
    """path, row, tokens from .npy and .npz files: rows of a matrix, or a vector cut at every `width`; a file's arrays by name, one after the other."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, content in zip(b["path"], b["content"], strict=True):
                loaded = np.load(io.BytesIO(content), allow_pickle=False)
                first = 0
                for a in [loaded] if isinstance(loaded, np.ndarray) else [loaded[n] for n in sorted(loaded.files)]:
                    a = a if a.ndim == 2 else a[: len(a) // width * width].reshape(-1, width)
                    for at in range(0, len(a), 4096):
                        part = a[at : at + 4096].astype(np.int32)
                        yield pd.DataFrame({"path": p, "row": np.arange(first + at, first + at + len(part)), "tokens": list(part)})
                    first += len(a)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, row long, tokens array<int>")


def training_log(lines: DataFrame, line: str = "value", order: str | None = None) -> DataFrame:
    """One row per step from text or JSON lines; the first record of a step (by `order`) wins."""
    at = F.col(order) if order else F.monotonically_increasing_id()
    js = F.from_json(line, "map<string,string>")
    field = lambda n, p: F.coalesce(F.col("_js")[n], F.nullif(F.regexp_extract(line, f"(?i){p}", 1), F.lit("")))
    rows = lines.withColumns({"_js": js, "_at": at})
    rows = rows.select("_at", *[F.try_to_number(field(n, p), F.lit("999999999999")).cast("long").alias(n) if n == "step" else field(n, p).try_cast("double").alias(n) for n, p in LOG_FIELDS.items()])
    first = rows.where("step IS NOT NULL").groupBy("step").agg(F.min_by(F.struct(*[n for n in LOG_FIELDS if n != "step"]), "_at").alias("x"))
    return first.select("step", "x.*")
