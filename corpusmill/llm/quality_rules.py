"""Quality rules in Spark expressions only: rules on a document, and lines frequent across documents.

The base rules count words, symbols, repeated lines and repeated three-word windows of each text.
Across documents, normalised lines are hashed with their host and the different documents of each are
counted, equal texts once. A line above the limit of its host is removed, except from the text with
the smallest hash, so that what many documents share stays once; documents that this depletes are rejected.
The counts cover all lines of all documents. Only lines that occur often at all, a set that
is counted before it is broadcast, are counted a second time by document.

Defined cases: a null or empty text has no words and fails the base rules; a very long text is one row, its lines and windows an array of it;
of texts that share a removed line the one with the smallest hash keeps it, and equal hashes are equal texts here; a null host is a host of its own; copies of a text at one
host share its verdict; rows that repeat a doc_id are one document here, with a row each in the result;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import BROADCAST_ROWS, plain_names, small_side, written

SPACES = " \t\n\x0b\x0c\r"
WORD_BREAK = r"[ \t-\r]+"
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEATED = 50, 0.5
#: A line is above its host's limit if it is in more than so many of the host's documents, and more than this share of them.
LINE_DOCS, LINE_SHARE = 30, 0.01
#: A document is depleted if less than this share of its words is left.
LEFT = 0.25


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def _without(text: Column, characters: str) -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WORD_BREAK))


def repeated_words(words: Column) -> Column:
    """How many words stand in a three-word window that occurs twice or more."""

    def covered(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda s, x, k: s[k]["h"] == x["h"]
        twice = _let(ordered, lambda s: F.filter(s, lambda x, k: (
            (k > 0) & same(s, x, F.greatest(k - 1, F.lit(0)))) | ((k < F.size(s) - 1) & same(s, x, F.least(k + 1, F.size(s) - 1)))))
        return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    def count(w: Column) -> Column:
        windows = F.transform(F.slice(w, 1, F.size(w) - 2), lambda x, i: F.xxhash64(x, w[i + 1], w[i + 2]))
        return F.when(F.size(w) < 4, F.lit(0)).otherwise(_let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))))

    return _let(words, count)


def lines_of(text: Column) -> Column:
    """The \\n-split lines that have a word."""
    return F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != "")


def base_rules(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the columns n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = words_of(text)
    counted = _let(words, lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("repeated")))
    out = docs.withColumn("_words", counted)
    dup = _let(lines_of(text), lambda x: F.size(x) - F.size(F.array_distinct(x)))
    out = out.withColumns({
        "n_words": F.col("_words.n").cast("long"), "word_chars": F.length(_without(text, SPACES)).cast("long"),
        "n_symbols": (F.octet_length(text) - F.octet_length(_without(text, SYMBOLS))).cast("long"),
        "n_dup_lines": dup.cast("long"), "n_repeat_words": F.col("_words.repeated").cast("long"),
    }).drop("_words")
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words")))


def text_hash(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _normal(line: Column) -> Column:
    return F.lower(F.regexp_replace(F.btrim(line, F.lit(SPACES)), WORD_BREAK, " "))


def _removed_lines(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """doc_id, host, text (its hash), key, words: the lines above their host's limit, without those of the text that keeps them."""
    text, host = F.coalesce(F.col(text_col), F.lit("")), F.coalesce(F.col(host_col), F.lit(""))
    of = F.transform(lines_of(text), lambda x: _let(_normal(x), lambda y: F.struct(
        F.xxhash64(host, y).alias("key"), (F.length(y) - F.length(F.replace(y, F.lit(" "), F.lit(""))) + 1).alias("words"))))
    lines = written(docs.select(F.col(id_col).alias("doc_id"), host.alias("host"), text_hash(text).alias("text"), F.explode(of).alias("x"))
                    .select("doc_id", "host", "text", "x.key", "x.words"))
    often = small_side(written(lines.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > LINE_DOCS).select("key")))
    per_line = (lines.join(often, "key", "left_semi").groupBy("key", "host", "text").agg(F.lit(1).alias("one"))
                .groupBy("key", "host").agg(F.count("*").alias("n"), F.min("text").alias("stays")).where(F.col("n") > LINE_DOCS))
    hosts = lines.groupBy("host", "text").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("*").alias("docs"))
    above = small_side(written(per_line.join(hosts, "host").where(F.col("n") > LINE_SHARE * F.col("docs")).select("key", "stays")))
    return lines.join(above, "key").where("text <> stays").drop("stays")


def removed_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """doc_id, removed: words of a document's removed lines, where there are any."""
    return _removed_lines(docs, id_col, text_col, host_col).groupBy("doc_id").agg(F.sum("words").alias("removed"))


def _depleted() -> Column:
    return F.col("n_words") - F.col("removed") < LEFT * F.col("n_words")


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """doc_id, the base counts, base_failed, removed_words and kept: one row per document."""
    removed = small_side(written(removed_words(docs, id_col, text_col, host_col).where("removed > 0")))
    base = base_rules(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text").drop("text")
    out = base.join(removed, "doc_id", "left").withColumn("removed", F.coalesce("removed", F.lit(0)))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      F.col("removed").alias("removed_words"), (~F.col("base_failed") & ~_depleted()).alias("kept"))


def _cleaned(docs: DataFrame, cut: DataFrame, text_col: str, host_col: str) -> DataFrame:
    """docs with keys (of the lines that cut (_host, _text, keys) lists for a host and text) and cleaned, the text without those lines."""
    text, host = F.coalesce(F.col(text_col), F.lit("")), F.coalesce(F.col(host_col), F.lit(""))
    # what is broadcast is bounded by the lines, not only by the texts that have some
    few = (cut.agg(F.sum(F.size("keys"))).head()[0] or 0) <= BROADCAST_ROWS
    out = docs.join(F.broadcast(cut) if few else cut, (host == F.col("_host")) & (text_hash(text) == F.col("_text")), "left")
    stays = lambda line: (F.btrim(line, F.lit(SPACES)) == "") | ~F.array_contains("keys", F.xxhash64(host, _normal(line)))
    kept = F.array_join(F.filter(F.split(F.col(text_col), "\n"), stays), "\n")
    return out.withColumn("cleaned", F.when(F.col("keys").isNull(), F.col(text_col)).otherwise(kept)).drop("_host", "_text")


def clean(docs: DataFrame, text_col: str = "text", host_col: str = "source", chars_col: str = "n_chars") -> DataFrame:
    """All documents and columns, the text without its removed lines and chars_col, where docs has it, as its length."""
    plain, name = plain_names(docs)
    out = _cleaned(plain, _cuts(docs, text_col, host_col), name[text_col], name[host_col])
    return _with_cleaned(out, docs, name, text_col, chars_col)


def _cuts(docs: DataFrame, text_col: str, host_col: str) -> DataFrame:
    lines = _removed_lines(docs.select(F.lit(0).alias("_id"), text_col, host_col), "_id", text_col, host_col)
    return written(lines.groupBy(F.col("host").alias("_host"), F.col("text").alias("_text")).agg(F.collect_set("key").alias("keys")))


def _with_cleaned(plain: DataFrame, docs: DataFrame, name: dict[str, str], text_col: str, chars_col: str) -> DataFrame:
    """plain's column cleaned in the place of the text, and its length in that of chars_col; the columns of docs."""
    new = {text_col: F.col("cleaned"), chars_col: F.length("cleaned").cast(dict(docs.dtypes).get(chars_col, "long"))}
    return plain.select(*[new.get(c, F.col(name[c])).alias(c) for c in docs.columns])


def drop_bad(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", chars_col: str = "n_chars") -> DataFrame:
    """The documents that pass, with all their columns; texts and chars_col as clean gives them."""
    plain, name = plain_names(docs)
    words = words_of(F.coalesce(F.col(name[text_col]), F.lit("")))
    # one chain that computes the words once: as columns of their own the optimiser would repeat them in the filter
    sound = _let(words, lambda w: (F.size(w) >= MIN_WORDS) & ~(repeated_words(w) > MAX_REPEATED * F.size(w)))
    out = _cleaned(plain.where(sound), _cuts(docs, text_col, host_col), name[text_col], name[host_col])
    # only a text that loses lines is counted again
    depleted = F.col("keys").isNotNull() & (F.size(words_of(F.col("cleaned"))) < LEFT * F.size(words))
    return _with_cleaned(out.where(~depleted), docs, name, text_col, chars_col)
