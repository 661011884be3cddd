"""Row transforms: white space, formatting, metadata, fill-in-the-middle, tokens, chats."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.order import uniform
from corpusmill.functions.text import let, lines_nl, text_or_empty
from corpusmill.operators.score import language_of

# Section headings, role prefixes, tab widths by language.
SECTIONS = {"instruction": "### Instruction:\n", "input": "### Input:\n", "response": "### Response:\n"}
ROLE_PREFIX = {"system": "System: ", "user": "User: ", "assistant": "Assistant: "}
TAB_WIDTH = {"python": 4, "typescript": 2, "javascript": 2}
#: Byte tokens of a batch, unless one text has more.
TOKENS = 1 << 22


def normalize_whitespace(text: Column, tab_size: int = 4) -> Column:
    """Tabs to spaces, no blanks at line ends, at most two blank lines in a row."""
    spaced = F.replace(text_or_empty(text), F.lit("\t"), F.lit(" " * tab_size))
    return F.regexp_replace(F.regexp_replace(spaced, " +(\n|$)", "$1"), "\n{4,}", "\n\n\n")


def with_metadata(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with line_count, char_count, content_hash and estimated_language, where they are not there yet."""
    text = text_or_empty(F.col(text_col))
    new = {
        "line_count": F.size(lines_nl(text)), "char_count": F.length(text), "content_hash": F.sha2(text, 256), "estimated_language": language_of(text),
    }
    return docs.withColumns({k: F.coalesce(F.col(k), v) if k in docs.columns else v for k, v in new.items()})


def standardize(docs: DataFrame, text_col: str = "text", tab_width: int = 4) -> DataFrame:
    """docs with standardized text and the counts crlf_fixed, tab_lines, trailing_fixed, newline_added."""
    text = text_or_empty(F.col(text_col))
    lf = F.regexp_replace(text, "\r\n?", "\n")
    out = docs.withColumns({"_lf": lf, "crlf_fixed": F.regexp_count(text, F.lit("\r\n?"))})
    lead = lambda line: F.regexp_extract(line, "^[ \t]*", 0)
    rest = lambda line: F.regexp_replace(line, "^[ \t]*", "")
    spaced = F.transform(lines_nl(F.col("_lf")), lambda x: F.when(lead(x).contains("\t"), F.concat(F.replace(lead(x), F.lit("\t"), F.lit(" " * tab_width)), rest(x))).otherwise(x))
    tabbed = F.size(F.filter(lines_nl(F.col("_lf")), lambda x: lead(x).contains("\t")))
    out = out.withColumns({"tab_lines": tabbed, "_lines": spaced})
    trailing = F.size(F.filter("_lines", lambda x: x.rlike("[ \t]$")))
    body = F.array_join(F.transform("_lines", lambda x: F.regexp_replace(x, "[ \t]+$", "")), "\n")
    out = out.withColumns({"trailing_fixed": trailing, "_body": body})
    ends = F.col("_body").endswith("\n") | (F.col("_body") == "")
    return out.withColumns({"newline_added": ~ends, text_col: F.when(ends, F.col("_body")).otherwise(F.concat("_body", F.lit("\n")))}).drop("_lf", "_lines", "_body")


def strip_comments(text: Column) -> Column:
    """Without lines that are only a comment, and without block comments."""
    blocks = F.regexp_replace(text_or_empty(text), r"(?s)/\*.*?\*/", "")
    return F.regexp_replace(blocks, r"(?m)^[ \t]*(#|//).*\n?", "")


def thinking(text: Column) -> Column:
    """What stands between thinking tags."""
    return F.regexp_extract(text, r"(?s)<think>(.*?)</think>", 1)


def without_thinking(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""))


def instruction_text(instruction: Column, context: Column, output: Column) -> Column:
    """An instruction example; the input section only where there is context."""
    part = lambda name, value: F.concat(F.lit(SECTIONS[name]), value)
    middle = F.when(F.coalesce(context, F.lit("")) != "", part("input", context))
    return F.concat_ws("\n\n", part("instruction", instruction), middle, part("response", output))


def byte_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", offset: int = 0, bos: int | None = None, eos: int | None = None) -> DataFrame:
    """id, tokens array<int>: UTF-8 bytes plus an offset, between optional markers. An empty or null text has the markers alone.

    Tokens leave Python in batches of some TOKENS, or of one text that has more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, tail = (np.array([] if m is None else [m], np.int32) for m in (bos, eos))
        for b in batches:
            ids, begin, held = [], 0, 0
            for k, x in enumerate(b.column(1)):
                ids.append(np.concatenate([head, np.frombuffer((x.as_py() or "").encode(), np.uint8).astype(np.int32) + np.int32(offset), tail]))
                held += len(ids[-1])
                if held >= TOKENS or k == b.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(begin, len(ids)), pa.array(ids, pa.list_(pa.int32()))], [id_col, "tokens"])
                    ids, begin, held = [], k + 1, 0

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, tokens array<int>")


def fim_tokens(rows: DataFrame, id_col: str, tokens_col: str = "tokens", rate: float = 0.5, spm: float = 0.5, seed: int = 42,
               markers: tuple[int, int, int] = (256, 257, 258), length: int | None = None) -> DataFrame:
    """rows with tokens in fill-in-the-middle order for a share `rate` of them, `mode` none, psm or spm.

    Three slots are reserved for the markers (prefix, suffix, middle); the two cuts lie between 10 and
    90 percent. Rows of fewer than ten tokens stay as they are. All draws are hashes of the id.
    """
    t, key = F.col(tokens_col), F.col(id_col)
    room = F.least(F.size(t), F.lit(length - 3)) if length else F.size(t)
    draw = lambda what: uniform(key, F.lit(seed), F.lit(what))
    at = lambda what: F.floor(room * 0.1 + draw(what) * (room * 0.8)).cast("int")
    out = rows.withColumns({"_n": room, "_a": F.least(at("a"), at("b")), "_b": F.greatest(at("a"), at("b")),
                            "mode": F.when((draw("rate") >= rate) | (room < 10), "none").when(draw("mode") < spm, "spm").otherwise("psm")})
    p, s, m = (F.array(F.lit(x)) for x in markers)
    prefix, middle, suffix = F.slice(t, 1, F.col("_a")), F.slice(t, F.col("_a") + 1, F.col("_b") - F.col("_a")), F.slice(t, F.col("_b") + 1, F.col("_n") - F.col("_b"))
    psm, order = F.concat(p, prefix, s, suffix, m, middle), F.concat(s, suffix, p, prefix, m, middle)
    return out.withColumn(tokens_col, F.when(F.col("mode") == "psm", psm).when(F.col("mode") == "spm", order).otherwise(t)).drop("_n", "_a", "_b")


def fim_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = 0.5, seed: int = 42,
             markers: tuple[str, str, str] = ("<fim_prefix>", "<fim_suffix>", "<fim_middle>")) -> DataFrame:
    """docs with text in prefix, suffix, middle order; cut at lines if there are three, else at characters."""
    text, key = text_or_empty(F.col(text_col)), F.col(id_col)
    draw = lambda what: uniform(key, F.lit(seed), F.lit(what))

    def cut(units: Column, n: Column, join: str) -> Column:
        a, b = (F.floor(draw(x) * (n + 1)).cast("int") for x in "ab")
        part = lambda start, count: F.array_join(F.slice(units, start, count), "")
        lo, hi = F.least(a, b), F.greatest(a, b)
        return F.concat(F.lit(markers[0]), part(F.lit(1), lo), F.lit(markers[1]), part(hi + 1, n - hi), F.lit(markers[2]), part(lo + 1, hi - lo))

    lines = F.transform(lines_nl(text), lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.lit("\n"), x)))
    by_line = let(lines, lambda u: cut(u, F.size(u), ""))
    by_char = let(F.split(text, ""), lambda u: cut(u, F.size(u), ""))
    moved = F.when(F.size(lines_nl(text)) >= 3, by_line).when(F.length(text) >= 2, by_char).otherwise(text)
    return docs.withColumn(text_col, F.when(draw("rate") < rate, moved).otherwise(text))


def chat_prompt(rows: DataFrame, budget: int | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, n_turns, prompt: role prefixes joined by blank lines.

    With a budget (in characters of prompt lines), the oldest turns go first; the last turn always stays.
    """
    line = F.concat(F.coalesce(*[F.when(F.col(role) == r, p) for r, p in ROLE_PREFIX.items()], F.lit("")), text_or_empty(F.col(text)))
    kept = rows.select(conv, turn, line.alias("line"))
    if budget is not None:
        newest = Window.partitionBy(conv).orderBy(F.desc(turn), F.desc("line"))
        kept = kept.withColumns({"_used": F.sum(F.length("line")).over(newest.rowsBetween(Window.unboundedPreceding, 0)), "_k": F.row_number().over(newest)})
        kept = kept.where((F.col("_used") <= budget) | (F.col("_k") == 1))
    sorted_lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(turn), F.col("line")))), lambda x: x["line"])
    return kept.groupBy(conv).agg(F.count("*").alias("n_turns"), F.array_join(sorted_lines, "\n\n").alias("prompt"))


def sources_test_pairs(files: DataFrame, path: str = "path", content: str = "content", source_chars: int = 3000, test_chars: int = 4000) -> DataFrame:
    """Training pairs in both directions from test files and the sources their names point to.

    test_x, x_test, x.test and x.spec belong to x; of several sources the one whose directory is nearest wins.
    """
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[A-Za-z]+$", "")
    named = files.select(F.col(path).alias("path"), F.col(content).alias("content"), stem.alias("stem"),
                         F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1).alias("dir"))
    target = F.regexp_replace("stem", r"^test_|_test$|\.test$|\.spec$", "")
    is_test = target != F.col("stem")
    tests = named.where(is_test).select(F.col("path").alias("test_path"), F.col("content").alias("test"), target.alias("key"), F.col("dir").alias("test_dir"))
    sources = named.where(~is_test).select(F.col("path").alias("source_path"), F.col("content").alias("source"), F.col("stem").alias("key"), "dir")
    apart = F.size(F.array_except("dir", "test_dir")) + F.size(F.array_except("test_dir", "dir"))
    nearest = Window.partitionBy("test_path").orderBy(apart, "source_path")
    best = tests.join(sources, "key").withColumn("k", F.row_number().over(nearest)).where("k = 1")
    source, test = F.substring("source", 1, source_chars), F.substring("test", 1, test_chars)
    return best.select("source_path", "test_path", F.explode(F.array(
        F.struct(F.lit("source_to_test").alias("direction"), source.alias("prompt"), test.alias("completion")),
        F.struct(F.lit("test_to_source").alias("direction"), test.alias("prompt"), source.alias("completion")))).alias("p")).select("source_path", "test_path", "p.*")
