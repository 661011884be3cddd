"""Session settings and table access."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(app: str = "corpusmill", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution and Arrow; conf overrides any setting ('_' for '.')."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("_", "."): v for k, v in conf.items()}
    return SparkSession.builder.appName(app).config(map=settings).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A side of a join is broadcast only when a count has shown that it has no more rows than this.
BROADCAST_ROWS = 200_000


def work_root(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables, below spark.checkpoint.dir.

    A temporary folder takes its place only on a single machine; a cluster must name a shared one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="corpusmill-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/corpusmill-{spark.sparkContext.applicationId}"


def work_dir(spark: SparkSession) -> str:
    """A fresh name in that folder."""
    return f"{work_root(spark)}/{uuid.uuid4().hex}"


def clear_work(spark: SparkSession) -> None:
    """Deletes the intermediate tables of this application. Frames made from them can't be read afterwards: write results first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(work_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame) -> DataFrame:
    """Cuts lineage: df as Parquet in the shared work folder, read again."""
    path = work_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def plain_names(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns named by position, which no column of an operator can clash with; the new name of each."""
    names = [f"_in{k}" for k in range(len(docs.columns))]
    return docs.toDF(*names), dict(zip(docs.columns, names, strict=True))


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, cheap to count, with a broadcast hint if it is small, else as it is for a shuffled join."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
