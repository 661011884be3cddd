"""Best-fit packing planned on a histogram of lengths.

Documents are encoded once and cut only if they are longer than a sequence; what is written is a narrow row for each
piece. The number of pieces of each length (at most as many rows as a sequence has tokens) is all the driver
sees: best fit, longest first, runs over those counts, filling whole runs of alike sequences in one step. The
plan says which ranks within a length go to which sequences; each piece finds its slot by joining on its length and
looking its rank up among that length's ranges. Ranks within a length are a piece's rank in its input partition, fixed
when it is written, plus the partitions before, so no length, however common, is sorted or gathered anywhere.

Plan size: each length opens or splits at most three runs of sequences, and a run holds fewer than
sqrt(2 * length) different lengths, so for 1024 tokens it stays below some 135,000 ranges whatever the input.

Defined cases: a null text counts as empty and is packed as the end token alone; a text longer than a sequence
is cut into whole sequences behind a shorter first piece; repeated rows are packed each; a null doc_id stays null; an empty
table gives an empty result; other columns are ignored. A task holds the ids of one text at a time besides its batch.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import in_small_batches, small_side, written
from corpusmill.llm.packing import _encoder

LENGTH, END_ID = 1024, 2
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, block long, nth long"


def pieces(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", tokens: bool = False) -> DataFrame:
    """A row for each piece, written: doc_id, piece, start, length, ids_crc32, block (its partition), nth (its rank of its length there), and ids if tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = _encoder(path), np.array([end_id], "<u4").tobytes()
        block, seen = TaskContext.get().partitionId(), [0] * (length + 1)
        names = [field.split()[0] for field in PIECE_SCHEMA.split(", ")]
        types = [pa.int64(), pa.int32(), *[pa.int64()] * 5]

        def flushed(columns: list[list]) -> pa.RecordBatch:
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=False)]
            more = [pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in columns[7]], pa.list_(pa.int32()))] if tokens else []
            return pa.RecordBatch.from_arrays([*arrays, *more], [*names, "ids"] if tokens else names)

        try:
            for b in batches:
                columns: list[list] = [[] for _ in range(8)]
                for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    ids = encoder.encode(text or "") + end
                    total = len(ids) // 4
                    bounds = [0, *range(total % length or length, total, length), total]
                    for k, (at, to) in enumerate(zip(bounds, bounds[1:])):
                        own = ids[4 * at : 4 * to]
                        for column, value in zip(columns, (doc_id, k, at, to - at, zlib.crc32(own), block, seen[to - at], own if tokens else None), strict=True):
                            column.append(value)
                        seen[to - at] += 1
                        if len(columns[0]) >= 4096:
                            yield flushed(columns)
                            columns = [[] for _ in range(8)]
                if columns[0]:
                    yield flushed(columns)
        finally:
            encoder.forget()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return written(in_small_batches(rows).mapInArrow(run, PIECE_SCHEMA + (", ids array<int>" if tokens else "")))


def plan(counts: dict[int, int], length: int = LENGTH) -> tuple[dict[int, list[tuple[int, int, int, int]]], int]:
    """Best fit, longest first, over the number of pieces of each length.

    Gives the ranges of each length, (first rank, first sequence, pieces in each sequence, offset of the first of them) by
    rising rank, and the number of sequences. Sequences of the same contents are a run and are filled together.
    """
    open_runs: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = {}  # by room left: (contents, sequences)

    def put(contents: tuple[tuple[int, int], ...], many: int, left: int) -> None:
        if many:
            open_runs.setdefault(left, []).append((contents, many))

    for size in sorted((s for s, n in counts.items() if n), reverse=True):
        n = counts[size]
        while n:
            room = min((r for r in open_runs if r >= size), default=0)
            if room:
                contents, many = open_runs[room].pop()
                if not open_runs[room]:
                    del open_runs[room]
            else:  # as many new sequences as are needed
                room, contents, many = length, (), n
            each = room // size
            full = min(many, n // each)
            put((*contents, (size, each)), full, room - each * size)
            n -= full * each
            many -= full
            if n and many:  # fewer are left than fit: one sequence takes them
                put((*contents, (size, n)), 1, room - n * size)
                n, many = 0, many - 1
            if contents:
                put(contents, many, room)
    ranges: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for left in sorted(open_runs):
        for contents, many in open_runs[left]:
            offset = 0
            for size, each in contents:
                ranges.setdefault(size, []).append((used.get(size, 0), sequence, each, offset))
                used[size] = used.get(size, 0) + many * each
                offset += each * size
            sequence += many
    return ranges, sequence


def _range_of(ranges: Column, rank: Column, most: int) -> Column:
    """The last of an array of ranges (by rising first rank) that starts at or before rank: a binary search."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(max(1, most).bit_length()))])
    at = F.aggregate(steps, F.lit(1), lambda p, s: F.when((p + s <= F.size(ranges)) & (F.try_element_at(ranges, p + s)["first_rank"] <= rank), p + s).otherwise(p))
    return F.element_at(ranges, at)


def pack(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", tokens: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids if tokens)."""
    own = pieces(docs, path, length, end_id, id_col, text_col, tokens)
    spark = own.sparkSession
    sums = written(own.groupBy("length", "block").agg(F.count("*").alias("n")))
    histogram = {r["length"]: r["n"] for r in sums.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `length` rows
    ranges, _ = plan(histogram, length)
    most = max(map(len, ranges.values()), default=0)
    slots = spark.createDataFrame(sorted(ranges.items()), "length long, ranges array<struct<first_rank: long, first_sequence: long, each: long, at: long>>")
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = written(sums.select("length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))
    ranked = own.join(small_side(bases), ["length", "block"]).withColumn("rank", F.col("base") + F.col("nth"))
    placed = ranked.join(F.broadcast(slots), "length").withColumn("slot", _range_of(F.col("ranges"), F.col("rank"), most)).withColumn("k", F.col("rank") - F.col("slot.first_rank"))
    sequence = F.col("slot.first_sequence") + F.expr("k div slot.each")
    offset = F.col("slot.at") + (F.col("k") % F.col("slot.each")) * F.col("length")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", sequence.alias("sequence_id"), offset.alias("offset"), *["ids"] * tokens)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids, doc_ids, lengths of each packed sequence: what pack(..., tokens=True) gives, gathered. A sequence has at most `length` tokens."""
    inside = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "length", "ids")))
    rows = packed.groupBy("sequence_id").agg(inside.alias("p"))
    return rows.select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.length").alias("lengths"))
