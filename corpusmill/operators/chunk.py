"""Fixed-size chunks of a token stream, and their weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.order import running_total
from corpusmill.functions.text import let, lines_univ, strip, text_or_empty

# What begins a definition, in the order in which the kinds are tried, and where its name stands.
DEFINITIONS = {
    "python": ((r"^(?:async\s+)?def\s+\w+", "function"), (r"^class\s+\w+", "class"), (r"^(?:from|import)\s+", "import")),
    "typescript": (
        (r"^(?:export\s+)?(?:async\s+)?function\s+\w+", "function"), (r"^(?:export\s+)?(?:const|let|var)\s+\w+\s*=\s*(?:async\s+)?\(", "function"),
        (r"^(?:export\s+)?(?:abstract\s+)?class\s+\w+", "class"), (r"^(?:export\s+)?(?:interface|type)\s+\w+", "type"), (r"^import\s+", "import"),
    ),
}
NAMES = (r"(?:function|class|interface|type)\s+(\w+)", r"(?:const|let|var)\s+(\w+)")
PART = "struct<start:int,end:int,kind:string,name:string,chars:int>"


def concat_and_chunk(docs: DataFrame, id_col: str, tokens_col: str = "tokens", size: int = 1024, max_chunks: int | None = None) -> DataFrame:
    """chunk_id, tokens: all documents' tokens in the order of their ids, which are unique, cut at every `size` tokens.

    Where a document starts is computed from lengths alone; the tokens join them afterwards.

    An incomplete last chunk is dropped, and no tokens give no chunk. Each document sends at most one slice
    to each chunk, so a chunk gathers `size` tokens at most.
    """
    n = F.size(tokens_col)
    starts = running_total(docs.select(id_col, n.alias("_n")), F.col(id_col), [], F.col("_n"), "_start").where("_n > 0").drop("_n")
    placed = docs.select(id_col, tokens_col).join(starts, id_col)
    spread = placed.withColumn("chunk_id", F.explode(F.sequence(F.floor(F.col("_start") / size), F.floor((F.col("_start") + n - 1) / size))))
    first = F.greatest(F.col("chunk_id") * size - F.col("_start"), F.lit(0))
    last = F.least((F.col("chunk_id") + 1) * size - F.col("_start"), n)
    pieces = spread.select("chunk_id", (F.col("_start") + first).alias("at"), F.slice(tokens_col, (first + 1).cast("int"), (last - first).cast("int")).alias("piece"))
    chunks = pieces.groupBy("chunk_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "piece"))), lambda x: x["piece"])).alias("tokens"))
    whole = chunks.where(F.size("tokens") == size)
    return whole.where(F.col("chunk_id") < max_chunks) if max_chunks is not None else whole


def truncate(rows: DataFrame, length: int, tokens_col: str = "tokens") -> DataFrame:
    return rows.withColumn(tokens_col, F.slice(tokens_col, 1, length))


def normalised_weights(rows: DataFrame, weight_col: str) -> DataFrame:
    """rows with weights divided by their mean, which is one row joined to all; without weight they fail."""
    mean = rows.agg(F.avg(weight_col).alias("_mean"))
    checked = mean.select(F.when(F.col("_mean") > 0, F.col("_mean")).otherwise(F.raise_error(F.lit("all weights are zero")).cast("double")).alias("_mean"))
    return rows.crossJoin(F.broadcast(checked)).withColumn(weight_col, F.col(weight_col) / F.col("_mean")).drop("_mean")


def definition_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", language: str = "typescript", most: int = 512, least: int = 32) -> DataFrame:
    """id, chunk (from 0), start_line, end_line (from 1), kind, name, content: texts cut where definitions begin.

    A part of fewer than `least` tokens (four characters each) takes the next one in; a part of more than `most` is cut into runs of
    lines, as is a text without definitions. Lines before the first definition are a part if they hold anything.
    """
    language = "typescript" if language == "javascript" else language
    width = max(10, most // 4)
    rows = docs.select(id_col, lines_univ(text_or_empty(F.col(text_col))).alias("_lines"))
    lines, last = F.col("_lines"), F.size("_lines") - 1
    kind = lambda x: F.coalesce(*[F.when(x.rlike(p), F.lit(k)) for p, k in DEFINITIONS[language]])
    name = lambda x, k: F.when(k == "import", "").otherwise(F.coalesce(*[F.nullif(F.regexp_extract(x, p, 1), F.lit("")) for p in NAMES], F.lit("")))
    chars = lambda a, b: F.length(F.array_join(F.slice(lines, a + 1, b - a + 1), "\n"))

    def part(start: Column, end: Column, kind: Column, name: Column, chars: Column) -> Column:
        return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), kind.alias("kind"), name.alias("name"), chars.cast("int").alias("chars"))

    marks = F.filter(F.transform(lines, lambda x, i: let(strip(x), lambda v: let(kind(v), lambda k: F.struct(i.alias("i"), k.alias("kind"), name(v, k).alias("name"))))), lambda m: m["kind"].isNotNull())

    def parts(m: Column) -> Column:
        own = F.transform(m, lambda d, k: let(F.coalesce(F.get(m, k + 1)["i"], F.size(lines)) - 1, lambda end: part(d["i"], end, d["kind"], d["name"], chars(d["i"], end))))
        first = m[0]["i"]
        head = F.when((first > 0) & F.exists(F.slice(lines, 1, first), lambda x: strip(x) != ""), F.array(part(F.lit(0), first - 1, F.lit("module_level"), F.lit(""), chars(F.lit(0), first - 1)))).otherwise(F.array().cast(f"array<{PART}>"))
        return F.concat(head, own)

    def joined(a: Column, b: Column) -> Column:
        return part(a["start"], b["end"], F.when(a["kind"] == b["kind"], a["kind"]).otherwise("mixed"), F.when(a["name"] != "", a["name"]).otherwise(b["name"]), a["chars"] + 1 + b["chars"])

    start = F.struct(F.array().cast(f"array<{PART}>").alias("done"), F.lit(None).cast(PART).alias("now"))
    small = lambda p: F.floor(p["chars"] / 4) < least
    step = lambda s, p: F.when(s["now"].isNull(), F.struct(s["done"].alias("done"), p.alias("now"))).when(
        small(s["now"]), F.struct(s["done"].alias("done"), joined(s["now"], p).alias("now"))).otherwise(F.struct(F.array_append(s["done"], s["now"]).alias("done"), p.alias("now")))
    merged = F.aggregate(let(marks, lambda m: F.when(F.size(m) > 0, parts(m)).otherwise(F.array().cast(f"array<{PART}>"))), start, step, lambda s: F.when(s["now"].isNull(), s["done"]).otherwise(F.array_append(s["done"], s["now"])))

    def cut(p: Column, at_once: bool) -> Column:
        runs = F.transform(F.sequence(p["start"], p["end"], F.lit(width)), lambda a: part(a, F.least(a + width - 1, p["end"]), p["kind"], F.when(a == p["start"], p["name"]).otherwise(""), F.lit(0)))
        return runs if at_once else F.when(F.floor(p["chars"] / 4) > most, runs).otherwise(F.array(p))

    whole = part(F.lit(0), last, F.lit("mixed"), F.lit(""), F.lit(0))
    found = let(merged, lambda m: F.when(F.size(m) > 0, F.flatten(F.transform(m, lambda p: cut(p, False)))).when(last >= 0, cut(whole, True)))
    spread = rows.select(id_col, "_lines", F.posexplode(found).alias("chunk", "_p"))
    content = F.array_join(F.slice("_lines", F.col("_p.start") + 1, F.col("_p.end") - F.col("_p.start") + 1), "\n")
    return spread.select(id_col, "chunk", (F.col("_p.start") + 1).alias("start_line"), (F.col("_p.end") + 1).alias("end_line"), F.col("_p.kind").alias("kind"), F.col("_p.name").alias("name"), content.alias("content"))
