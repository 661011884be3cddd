"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model's symbols are the bytes of UTF-8, so no character is folded, and an n-gram is a number whose last
byte is its last symbol. Every trusted text is counted whole. Counts, discounts, back-off weights and
probabilities of each order are tables sharded by n-gram, made by joins; nothing of them is broadcast or collected but the
counts of counts, four a level.

Documents are scored by joins with these tables, block by block: a block is some tens of MB of text of one
partition, packed and written once in a table bucketed by block. The different n-grams of each block are joined
with the model, so a common n-gram crosses the network once a block and not once for every occurrence,
and what the blocks ask for comes back to them by a co-grouping for which the texts don't move again.
What is moved grows with the corpus; an n-gram that training never saw backs off as the model says.

A language's threshold is a quantile of the perplexities of held-out trusted texts in that language.

Defined cases: a null or empty text has no perplexity and is rejected; a null language is a language
of its own, and one with fewer than LEAST_HELD held-out texts takes the threshold of all; a perplexity equal to the
threshold passes; a very long text is scored whole, in a block of its own; repeated rows score alike; an empty table
gives an empty result; without any trusted text nothing is rejected but empty texts; other columns pass
through, and those named perplexity, threshold or kept are replaced.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from corpusmill.llm.common import in_small_batches, make_room, plain_names, small_side, work_dir, written

#: Bytes of an n-gram of the highest order (up to 7, as one more stands before the text); the byte before a text, which UTF-8 never has.
ORDER, START = 5, b"\xff"
#: One in HELD_OUT trusted texts is kept from training for the thresholds; a language needs so many of them.
HELD_OUT, LEAST_HELD = 5, 20
QUANTILE = 0.995
#: Bytes of text in a block, in a packed part of one, and counted at once in training.
BLOCK, PART, COUNTED = 24 << 20, 1 << 20, 2 << 20


class Model(NamedTuple):
    """For n from 1 to ORDER: p[n] (code, p) of n-grams seen, weight[n] (context, weight) of the contexts they follow."""

    p: dict[int, DataFrame]
    weight: dict[int, DataFrame]


def codes(texts: pa.Array | pa.ChunkedArray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each byte of the texts, one text after the other, and each text's bytes. A null counts as empty."""
    column = pa.concat_arrays([c.cast(pa.large_string()) for c in (texts.chunks if isinstance(texts, pa.ChunkedArray) else [texts])] or [pa.array([], pa.large_string())])
    column = column.fill_null("")
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    a = np.concatenate([np.zeros(order - 1, np.uint8), data]).astype(np.int64)
    out = a[: len(data)]
    for k in range(1, order):
        out = out << 8 | a[k : k + len(data)]
    starts, sizes = bounds[:-1] - bounds[0], np.diff(bounds)
    for k in range(order - 1):  # where less than order - 1 bytes of the text stand before, START does
        at = starts[sizes > k] + k
        out[at] = out[at] & ((1 << 8 * (k + 1)) - 1) | int.from_bytes(START * (order - 1 - k), "big") << 8 * (k + 1)
    return out, sizes


class CodeTable:
    """Finds the places of codes in an array of different ones: open addressing, all steps on whole arrays."""

    def __init__(self, held: np.ndarray):
        bits = max(10, int(len(held)).bit_length() + 2)
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.held, self.at = np.append(held, -1), np.full(1 << bits, -1, np.int32)  # an empty slot leads to the -1 at the end, which is no code
        waiting, slot = np.arange(len(held), dtype=np.int32), self._slot(held)
        while len(waiting):
            free = self.at[slot] < 0
            self.at[slot[free]] = waiting[free]
            left = self.at[slot] != waiting
            waiting, slot = waiting[left], (slot[left] + 1) & self.mask

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def places(self, codes: np.ndarray) -> np.ndarray:
        """-1 for a code that isn't held."""
        slot = self._slot(codes)
        out = self.at[slot]
        waiting = np.flatnonzero((self.held[out] != codes) & (out >= 0))
        slot = slot[waiting]
        while len(waiting):
            slot = (slot + 1) & self.mask
            out[waiting] = self.at[slot]
            left = (self.held[out[waiting]] != codes[waiting]) & (out[waiting] >= 0)
            waiting, slot = waiting[left], slot[left]
        return out


def _context(code: Column) -> Column:
    return F.shiftrightunsigned(code, 8)


def _suffix(code: Column, n: int) -> Column:
    """Of an n-gram, without its first byte."""
    return code.bitwiseAND(F.lit((1 << 8 * (n - 1)) - 1).cast("long"))


def _parts(texts: pa.Array, most: int) -> Iterator[pa.Array]:
    """Slices of consecutive texts of up to so many bytes, or of one longer text."""
    ends = np.cumsum([n or 0 for n in pc.binary_length(texts).to_pylist()])
    begin, done = 0, 0
    while begin < len(ends):
        end = max(begin + 1, int(np.searchsorted(ends, done + most, "right")))
        yield texts.slice(begin, end - begin)
        begin, done = end, int(ends[end - 1])


def count_ngrams(texts: DataFrame, text_col: str = "text", order: int = ORDER) -> DataFrame:
    """code, c: how often each n-gram of the highest order occurs in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        held: list[np.ndarray] = []
        size = 0

        def counted() -> pa.RecordBatch:
            nonlocal held, size
            found, n = np.unique(np.concatenate(held), return_counts=True)
            held, size = [], 0
            return pa.RecordBatch.from_arrays([pa.array(found), pa.array(n.astype(np.int64))], ["code", "c"])

        for b in batches:
            for part in _parts(b.column(0), COUNTED):
                held.append(codes(part, order)[0])
                size += len(held[-1])
                if size >= COUNTED:
                    yield counted()
        if size:
            yield counted()

    part = in_small_batches(texts.select(F.col(text_col).alias("text"))).mapInArrow(run, "code long, c long")
    return part.groupBy("code").agg(F.sum("c").alias("c"))


def _discounts(levels: dict[int, DataFrame]) -> dict[int, list[float]]:
    """Of each order D1, D2, D3+, from how many n-grams occur once to four times."""
    few = [rows.where("c <= 4").groupBy(F.lit(n).alias("n"), "c").agg(F.count("*").alias("times")) for n, rows in levels.items()]
    times = {(r.n, r.c): r.times for r in reduce(DataFrame.union, few).collect()}
    out = {}
    for n in levels:
        n1, n2, n3, n4 = (max(times.get((n, k), 0), 1) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
        out[n] = [min(max(d, 0.05), k - 0.05) for k, d in enumerate(raw, 1)]
    return out


def train(texts: DataFrame, text_col: str = "text", order: int = ORDER) -> Model:
    levels = {order: written(count_ngrams(texts, text_col, order))}
    for n in range(order - 1, 0, -1):  # continuation counts: how many different bytes stand before
        levels[n] = written(levels[n + 1].groupBy(_suffix(F.col("code"), n + 1).alias("code")).agg(F.count("*").alias("c")))
    discounts, model = _discounts(levels), Model({}, {})
    for n in range(1, order + 1):
        d1, d2, d3 = discounts[n]
        cut = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        rows = levels[n].withColumns({"context": _context(F.col("code")), "cut": cut})
        contexts = written(rows.groupBy("context").agg(F.sum("c").alias("total"), (F.sum("cut") / F.sum("c")).alias("weight")))
        own = rows.join(contexts, "context").withColumn("suffix", _suffix(F.col("code"), n))
        below = own.join(model.p[n - 1].select(F.col("code").alias("suffix"), F.col("p").alias("q")), "suffix") if n > 1 else own.withColumn("q", F.lit(1 / 256))
        model.p[n] = written(below.select("code", ((F.col("c") - F.col("cut")) / F.col("total") + F.col("weight") * F.col("q")).alias("p")))
        model.weight[n] = contexts.select("context", "weight")
    return model


def probabilities(model: Model, asked: DataFrame, order: int = ORDER) -> DataFrame:
    """code, p of every different n-gram in asked (a column code, cheap to read again): its own probability, or its context's weight times that of its suffix.

    Each order is written: a plan of all orders in one would be described anew, whole, in the driver's memory whenever one of its dozens of exchanges ends.
    """
    known = asked.sparkSession.range(1).select(F.lit(0).cast("long").alias("code"), F.lit(1 / 256).alias("p"))  # of the empty n-gram
    for n in range(1, order + 1):
        need = asked.select("code") if n == order else asked.select(_suffix(F.col("code"), n + 1).alias("code")).distinct()
        rows = need.withColumns({"context": _context(F.col("code")), "suffix": _suffix(F.col("code"), n)})
        rows = rows.join(model.p[n], "code", "left").join(model.weight[n], "context", "left").join(known.select(F.col("code").alias("suffix"), F.col("p").alias("q")), "suffix")
        known = written(rows.select("code", F.coalesce("p", F.coalesce("weight", F.lit(1.0)) * F.col("q")).alias("p")))
    return known


def _packed(docs: DataFrame, text_col: str, order: int) -> DataFrame:
    """block, packed (documents as compressed Arrow, or null), codes (the different n-grams of the block, or null): a table bucketed by block."""
    at, spark = docs.columns.index(text_col), docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        make_room()
        block, size, known = TaskContext.get().partitionId() << 32, 0, CodeTable(np.empty(0, np.int64))
        names, types = ["block", "packed", "codes"], [pa.int64(), pa.binary(), pa.list_(pa.int64())]

        def row(packed: bytes | None, own: np.ndarray | None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([block], types[0]), pa.array([packed], types[1]), pa.array([own], types[2])], names)

        for b in batches:
            begin = 0
            for texts in _parts(b.column(at), PART):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, b.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))) as out:
                    out.write_batch(b.slice(begin, len(texts)))
                begin += len(texts)
                yield row(sink.getvalue().to_pybytes(), None)
                own, _ = codes(texts, order)
                new = np.unique(own[known.places(own) < 0])
                if len(new):
                    known = CodeTable(np.concatenate([known.held[:-1], new]))
                size += len(own)
                if size >= BLOCK:
                    yield row(None, np.sort(known.held[:-1]))
                    block, size, known = block + 1, 0, CodeTable(np.empty(0, np.int64))
        if size:
            yield row(None, np.sort(known.held[:-1]))

    # the number of buckets follows the text, and is that of shuffles at least; the catalogue's entry isn't needed once the table is resolved
    total = docs.agg(F.sum(F.octet_length(text_col))).head()[0] or 0
    buckets = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BLOCK)), 50_000)
    name = f"corpusmill_{uuid.uuid4().hex}"
    rows = in_small_batches(docs).mapInArrow(run, "block long, packed binary, codes array<long>")
    rows.write.bucketBy(buckets, "block").option("path", work_dir(spark)).saveAsTable(name, format="parquet")
    out = spark.table(name)
    out.schema  # noqa: B018  resolves the table
    spark.sql(f"DROP TABLE {name}")
    return out


def with_perplexity(docs: DataFrame, model: Model, text_col: str = "text", order: int = ORDER) -> DataFrame:
    """docs with a column perplexity (a byte's); all other columns pass through."""
    docs = docs.drop("perplexity")
    at, names = docs.columns.index(text_col), [*docs.columns, "perplexity"]
    stored = _packed(docs, text_col, order)
    asked = stored.where("codes IS NOT NULL").select(F.col("block").alias("of"), F.explode("codes").alias("code"))
    known = probabilities(model, written(asked.select("code").distinct()), order)
    answers = asked.join(known, "code").select("of", "code", F.log2("p").cast("float").alias("bits"))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        make_room()
        known, bits = CodeTable(right["code"].to_numpy()), np.append(right["bits"].to_numpy().astype(np.float64), np.nan)
        done = []
        for packed in left["packed"]:
            for b in pa.ipc.open_stream(packed.as_buffer()):
                own, sizes = codes(b.column(at), order)
                upto = np.concatenate([[0.0], np.cumsum(bits[known.places(own)])])
                ends = np.cumsum(sizes)
                with np.errstate(invalid="ignore"):
                    found = np.exp2((upto[ends - sizes] - upto[ends]) / sizes)
                done.append(pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.float64(), mask=sizes == 0)], names))
        return pa.Table.from_batches(done)

    left = stored.where("packed IS NOT NULL").select("block", "packed").groupBy("block")
    schema = StructType([*docs.schema.fields, StructField("perplexity", DoubleType())])
    return left.cogroup(answers.groupBy("of")).applyInArrow(score, schema)


def thresholds(scored: DataFrame) -> DataFrame:
    """lang (null: of all), cut: the quantile of perplexity, from columns lang and perplexity. A null language counts as empty."""
    rows = scored.where("perplexity IS NOT NULL").select(F.coalesce("lang", F.lit("")).alias("lang"), "perplexity")
    rows = rows.unionByName(rows.withColumn("lang", F.lit(None).cast("string")))
    cuts = rows.groupBy("lang").agg(F.percentile_approx("perplexity", QUANTILE, 100_000).alias("cut"), F.count("*").alias("n"))
    return cuts.where((F.col("n") >= LEAST_HELD) | F.col("lang").isNull()).select("lang", "cut")


def _held_out(id_col: str) -> Column:
    return F.pmod(F.xxhash64(F.col(id_col), F.lit("held out")), F.lit(HELD_OUT)) == 0


def fit(docs: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[Model, DataFrame]:
    """The model and the thresholds by language, from the documents whose ids are in trusted_ids."""
    trusted_ids = small_side(written(trusted_ids.select(F.col(trusted_ids.columns[0]).alias("id")).distinct()))
    narrow = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    trusted = narrow.join(trusted_ids, "id", "left_semi")
    model = train(trusted.where(~_held_out("id")))
    return model, written(thresholds(with_perplexity(trusted.where(_held_out("id")).select("lang", "text"), model)))


def classify(docs: DataFrame, model: tuple[Model, DataFrame], text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs with perplexity, threshold and kept."""
    ngrams, cuts = model
    docs = docs.drop("perplexity", "threshold", "kept")
    plain, name = plain_names(docs)
    overall = [r.cut for r in cuts.where("lang IS NULL").collect()] or [None]
    by_lang = small_side(cuts.where("lang IS NOT NULL").select(F.col("lang").alias("_lang"), F.col("cut").alias("_cut")), 10_000)
    out = with_perplexity(plain, ngrams, name[text_col]).join(by_lang, F.coalesce(F.col(name[lang_col]), F.lit("")) == F.col("_lang"), "left")
    cut = F.coalesce("_cut", F.lit(overall[0]).cast("double"))
    out = out.withColumns({"_cut": cut, "_kept": F.col("perplexity").isNotNull() & F.coalesce(F.col("perplexity") <= cut, F.lit(True))})
    return out.select(*plain.columns, "perplexity", "_cut", "_kept").toDF(*docs.columns, "perplexity", "threshold", "kept")


def drop_improbable(docs: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents that pass, with all their columns."""
    plain, name = plain_names(docs)
    judged = classify(plain, fit(docs, trusted_ids, id_col, text_col, lang_col), name[text_col], name[lang_col])
    return judged.where("kept").select(*plain.columns).toDF(*docs.columns)
