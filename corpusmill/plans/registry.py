"""Named sources, filters and transforms, and pipelines declared as data.

Each entry is a function that makes or changes a DataFrame; a pipeline is a source and a list of steps,
each applied with DataFrame.transform, so that Catalyst sees one plan.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators import dedup, evaluation, filters, quality, score, transform
from corpusmill.sources import readers

KINDS = ("source", "filter", "transform", "reward")
_ENTRIES: dict[str, dict[str, Callable[..., Any]]] = {k: {} for k in KINDS}


def register(kind: str, name: str) -> Callable:
    """Decorator: a source takes (spark, **options), filters and transforms (df, **options); a reward gives a column."""
    def put(f: Callable) -> Callable:
        _ENTRIES[kind][name] = f
        return f

    return put


def get(kind: str, name: str) -> Callable:
    if name not in _ENTRIES[kind]:
        raise KeyError(f"Unknown {kind} '{name}': one of {', '.join(sorted(_ENTRIES[kind]))}")
    return _ENTRIES[kind][name]


def names(kind: str) -> list[str]:
    return sorted(_ENTRIES[kind])


def run(spark: SparkSession, plan: dict[str, Any]) -> DataFrame:
    """plan: {"source": {"name", **options}, "steps": [{"filter" or "transform": name, "enabled"?, **options}]}."""
    source = dict(plan["source"])
    df = get("source", source.pop("name"))(spark, **source)
    for step in plan.get("steps", []):
        options = dict(step)
        if not options.pop("enabled", True):
            continue
        kind = next(k for k in KINDS if k in options)
        df = df.transform(get(kind, options.pop(kind)), **options)
    return df


@register("source", "parquet")
def _parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


register("source", "local")(readers.directory)
register("source", "jsonl")(readers.jsonl)
register("reward", "mix")(evaluation.reward_mix)


@register("filter", "quality")
def _quality(df: DataFrame, mode: str = "conservative", languages: list[str] | None = None, text_col: str = "text") -> DataFrame:
    return quality.filter_code(df, mode, languages, text_col)


@register("filter", "length")
def _length(df: DataFrame, min_lines: int = 5, max_lines: int = 10_000, text_col: str = "text") -> DataFrame:
    return df.where(filters.length_reason(F.col(text_col), min_lines, max_lines).isNull())


@register("filter", "license")
def _license(df: DataFrame, allow_unknown: bool = False, col: str = "license") -> DataFrame:
    return df.where(filters.license_reason(F.col(col), allow_unknown).isNull())


@register("filter", "pii")
def _pii(df: DataFrame, text_col: str = "text") -> DataFrame:
    return df.where(filters.pii_reason(F.col(text_col)).isNull())


@register("filter", "content")
def _content(df: DataFrame, text_col: str = "text") -> DataFrame:
    return df.where(filters.content_reason(F.col(text_col)).isNull())


@register("filter", "score")
def _score(df: DataFrame, threshold: float = 0.4, text_col: str = "text") -> DataFrame:
    """Keeps what reaches the threshold; quality_score stays as a column."""
    return score.with_score(df, text_col).withColumnRenamed("score", "quality_score").drop("signals", "issues", "suggestions").where(F.col("quality_score") >= threshold)


@register("filter", "exact_dedup")
def _exact(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    return dedup.exact_dedup(df, F.col(text_col), id_col)


@register("filter", "near_dedup")
def _near(df: DataFrame, threshold: float = 0.8, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    return dedup.drop_near_copies(df, id_col, text_col, threshold)


@register("transform", "whitespace")
def _whitespace(df: DataFrame, tab_size: int = 4, text_col: str = "text") -> DataFrame:
    return df.withColumn(text_col, transform.normalize_whitespace(F.col(text_col), tab_size))


@register("transform", "metadata")
def _metadata(df: DataFrame, text_col: str = "text") -> DataFrame:
    return transform.with_metadata(df, text_col)


@register("transform", "strip_comments")
def _comments(df: DataFrame, text_col: str = "text") -> DataFrame:
    return df.withColumn(text_col, transform.strip_comments(F.col(text_col)))


@register("transform", "redact_pii")
def _redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    return df.withColumn(text_col, filters.redact_pii(F.col(text_col)))
