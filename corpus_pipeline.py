"""The corpus pipeline: quality classifier, quality rules, exact dedup, near dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents. The stage near_dedup takes candidates from
SimHash and its covering masks, and what lies beyond their radius from MinHash bands; each is checked by Jaccard (the README has the figures).

Defined cases: null and empty texts are rejected by the first stage; a null language is a language of its own, a null source a host of its
own; of rows with equal texts, or equal ids and texts, one stays, and a null doc_id is preferred to no other; a very long text is read
whole by one task of each stage; columns besides those of documents are carried through, whatever their names; an empty table
gives an empty result in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm import exact_dedup, kneser_ney, near_copies as near, packing, quality_rules
from corpusmill.llm.common import table, written
from corpusmill.llm.queries import tokenizer_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return kneser_ney.drop_improbable(docs, trusted)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.drop_bad(docs)


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near.drop_near_copies(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path())


STAGES = [("quality_classifier", quality_classifier), ("quality_rules", rules), ("exact_dedup", copies), ("near_dedup", near_copies), ("packing", pack)]

#: SQL can express neither the model nor the tokenizer: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
