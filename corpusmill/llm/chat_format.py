"""Chat formatting in Spark expressions only.

The rows of a conversation are collected as structs, sorted by turn, adjacent turns of one role are
merged, and the turns are joined by a template that marks each one:

    <|im_start|>role\\n text <|im_end|>\\n

Inside roles and texts a backslash is doubled and `<|` becomes `<\\|`, so no control string can
appear there and the step can be undone. The loss mask is an array of (start, length) spans of the
output, in code points: one per assistant text, without markers or the newline that joins merged texts.

Defined cases: a null text or role counts as empty; turns with equal numbers order by role, then
text, and all stay (nulls first); an empty table gives an empty result; other columns are ignored.
A conversation is one row of output, so it is gathered in one task whatever its length; the work on it is
of the order of its length (times its logarithm for the spans), and output and spans hold up to 2^29 code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, BREAK = "<|im_start|>", "<|im_end|>\n", "\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def merged_turns(turns: Column) -> Column:
    """Of sorted structs (turn, role, text): structs (role, texts), adjacent turns of one role together."""
    first = F.filter(F.sequence(F.lit(0), F.size(turns) - 1), lambda i: (i == 0) | (turns[i]["role"] != turns[F.greatest(i - 1, F.lit(0))]["role"]))
    until = lambda k: F.coalesce(F.try_element_at(first, k + 2), F.size(turns))
    return F.transform(first, lambda i, k: F.struct(
        turns[i]["role"].alias("role"), F.transform(F.slice(turns, i + 1, until(k) - i), lambda t: t["text"]).alias("texts")))


def format_chats(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, formatted string, loss_spans array<struct<start,length>>: one row per conversation."""
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    chats = rows.groupBy(F.col(conv_col).alias("conv_id")).agg(F.array_sort(F.collect_list(F.struct(
        F.col(turn_col).alias("turn"), empty(role_col).alias("role"), empty(text_col).alias("text")))).alias("turns"))
    chats = chats.select("conv_id", merged_turns(F.col("turns")).alias("turns"))
    # pieces of the output in order; those under the mask are an assistant's texts
    header = lambda t: F.concat(F.lit(START), F.replace(escape(t["role"]), F.lit("\n"), F.lit("\\\n")), F.lit("\n"))
    piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    no, joint = F.lit(False), F.lit(BREAK)
    body = lambda t: F.flatten(F.transform(t["texts"], lambda x, k: F.when(k == 0, F.array(piece(escape(x), t["role"] == "assistant")))
                                           .otherwise(F.array(piece(joint, no), piece(escape(x), t["role"] == "assistant")))))
    chats = chats.select("conv_id", F.flatten(F.transform("turns", lambda t: F.concat(
        F.array(piece(header(t), no)), body(t), F.array(piece(F.lit(END), no))))).alias("pieces"))
    # where each piece ends, by doubling: n log n additions, however long the conversation
    ends = F.aggregate(F.sequence(F.lit(0), F.ceil(F.log2(F.size("pieces"))).cast("int")), F.transform("pieces", lambda p: F.length(p["text"]).cast("long")),
                       lambda x, k: F.transform(x, lambda v, i: v + F.coalesce(F.get(x, i - F.call_function("shiftleft", F.lit(1), k)), F.lit(0).cast("long"))))
    chats = chats.withColumn("ends", ends)
    spans = F.filter(F.zip_with("pieces", "ends", lambda p, e: F.when(p["loss"], F.struct((e - F.length(p["text"])).alias("start"), F.length(p["text"]).cast("long").alias("length")))), lambda s: s.isNotNull())
    return chats.select("conv_id", F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """The array of (role, text) that a formatted string holds."""
    blocks = F.split(formatted, r"<\|im_end\|>\n", -1)
    role = r"(?s)^<\|im_start\|>((?:\\.|[^\\\n])*)\n"
    return F.transform(F.slice(blocks, 1, F.size(blocks) - 1), lambda b: F.struct(
        unescape(F.regexp_extract(b, role, 1)).alias("role"), unescape(F.regexp_replace(b, role, "")).alias("text")))


def under_mask(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped. Spans are cut from code points of four bytes each, so none is searched for from the start."""
    first = F.lit(bytearray("x".encode("utf-32-be")))  # a mark of byte order that begins a span would else be taken as one
    cut = lambda points, s: F.substring(F.decode(F.concat(first, F.substr(points, (4 * s["start"] + 1).cast("int"), (4 * s["length"]).cast("int"))), "UTF-32"), 2, 1 << 30)
    return F.transform(F.array(F.encode(formatted, "UTF-32")), lambda points: F.array_join(F.transform(spans, lambda s: unescape(cut(points, s))), ""))[0]
