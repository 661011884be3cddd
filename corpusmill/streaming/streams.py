"""Structured Streaming: windows with watermarks, running statistics, deduplication, stateful detectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Rows before the current one that a z-score compares with, and how many it needs.
WINDOW, ENOUGH, LIMIT = 20, 5, 3.0
#: The deviation counts as this at least.
LEAST = 1e-6


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 16, time_col: str = "ts") -> DataFrame:
    """A stream of the Parquet files at path, with event time as a timestamp. The rate limit is the back-pressure."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", name if name.endswith(".parquet") else "*.parquet")
    return stream.parquet(folder if name.endswith(".parquet") else path).withColumn(time_col, F.col(time_col).cast("timestamp"))


def windowed(events: DataFrame, by: list[str], size: str, slide: str | None = None, late: str | None = None, time_col: str = "ts", value: str = "value") -> DataFrame:
    """start, by, n, total of tumbling or sliding windows; `late` sets the watermark of a stream."""
    timed = events.withWatermark(time_col, late) if late else events
    return timed.groupBy(F.window(time_col, size, slide).alias("w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), *by, "n", "total")


def sessions(events: DataFrame, by: list[str], gap: str, late: str | None = None, time_col: str = "ts") -> DataFrame:
    """start, end, by, n of sessions that end after a gap."""
    timed = events.withWatermark(time_col, late) if late else events
    return timed.groupBy(F.session_window(time_col, gap).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def running_stats(events: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """by, n, mean, least, most (complete or update mode)."""
    return events.groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"))


def deduplicated(events: DataFrame, keys: list[str], late: str = "1 day", time_col: str = "ts") -> DataFrame:
    """The first row of each key; state older than the watermark is dropped."""
    return events.withWatermark(time_col, late).dropDuplicatesWithinWatermark(keys)


class RollingZ(StatefulProcessor):
    """Keeps the last values of a series and emits rows whose z-score is beyond the limit, and those that are NaN or infinite."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "v array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = list(self.last.get()[0]) if self.last.exists() else []
        found = []
        batch = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        for event, v in zip(batch["event_id"], batch["value"], strict=True):
            if v is None or v != v or abs(v) == float("inf"):
                if v is not None:
                    found.append((event, None))  # an anomaly without a z, and no part of the window
                continue
            if len(held) >= ENOUGH:
                s = pd.Series(held)
                z = (v - float(s.mean())) / max(float(s.std()), LEAST)
                if abs(z) > LIMIT:
                    found.append((event, z))
            held = [*held, float(v)][-WINDOW:]
        self.last.update((held,))
        yield pd.DataFrame({"series": key[0], "event_id": [e for e, _ in found], "z": pd.Series([z for _, z in found], dtype="float64")})

    def close(self) -> None:
        pass


def anomalies(events: DataFrame, key: str) -> DataFrame:
    """series, event_id, z of a stream, with state of fixed size for each key."""
    grouped = events.withColumn("series", F.col(key).cast("string")).select("series", "ts", "event_id", "value").groupBy("series")
    return grouped.transformWithStateInPandas(RollingZ(), "series string, event_id long, z double", "Append", "none")


def run_available(df: DataFrame, checkpoint: str, path: str | None = None, mode: str = "append", name: str | None = None) -> None:
    """Runs a stream over what there is: to Parquet at path, or to a table in memory (tests and complete mode)."""
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query = writer.format("parquet").start(path) if path else writer.format("memory").queryName(name).start()
    query.awaitTermination()


def evaluate_each(df: DataFrame, evaluate: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> None:
    """Evaluates each micro-batch of what there is and writes its result to path/batch=n; a batch that runs again replaces its own."""

    def one(batch: DataFrame, n: int) -> None:
        evaluate(batch).write.mode("overwrite").parquet(f"{path}/batch={n}")

    df.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
