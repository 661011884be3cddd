"""Corpus statistics: lengths, languages, entropy, repetition, frequencies, diversity, vocabulary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.order import global_rank
from corpusmill.functions.text import code_tokens, let, lines_univ, lstrip, ngrams, rstrip, strip, text_or_empty, tokens, total, words_ws
from corpusmill.session import written

PERCENTILES = (0.10, 0.25, 0.50, 0.75, 0.90, 0.99)
# Upper bounds of the entropy labels.
ENTROPY_LABELS = ((2.0, "trivial"), (3.5, "simple"), (5.0, "moderate"), (7.0, "complex"))


def length_stats(rows: DataFrame, length: Column, by: list[str] | None = None) -> DataFrame:
    """n, mean, population std, min, max and exact percentiles with linear interpolation."""
    p = F.percentile(length, F.lit(list(PERCENTILES)))
    out = rows.groupBy(*(by or [])).agg(F.count(length).alias("n"), F.avg(length).alias("mean"), F.stddev_pop(length).alias("std"), F.min(length).alias("least"), F.max(length).alias("most"), p.alias("_p"))
    return out.select(*(by or []), "n", "mean", "std", "least", "most", *[F.col("_p")[k].alias(f"p{round(100 * q)}") for k, q in enumerate(PERCENTILES)])


def shares(rows: DataFrame, col: str) -> DataFrame:
    """col, n, share."""
    counts = rows.groupBy(col).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def summary(docs: DataFrame, quality: Column, text_col: str = "text") -> DataFrame:
    """One row: samples, white-space tokens, their mean, least and most characters, mean quality to four digits."""
    n, chars = F.size(words_ws(F.col(text_col))), F.length(text_col)
    return docs.agg(F.count("*").alias("samples"), F.sum(n).alias("tokens"), F.avg(n).alias("mean_tokens"), F.min(chars).alias("least_chars"),
                    F.max(chars).alias("most_chars"), F.approx_count_distinct(F.xxhash64(text_col)).alias("about_unique"), F.round(F.avg(quality), 4).alias("mean_quality"))


def _entropy(items: Column) -> Column:
    """Shannon bits of an array's values: runs in the sorted array are the counts."""
    def of(s: Column) -> Column:
        n = F.size(s)
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (s[i] != s[F.greatest(i - 1, F.lit(0))]))
        counts = let(starts, lambda b: F.transform(b, lambda x, k: F.coalesce(F.try_element_at(b, k + 2), n) - x))
        return total(F.transform(counts, lambda c: -(c / n) * F.log2(c / n)))

    return let(F.sort_array(items), lambda s: F.when(F.size(s) == 0, 0.0).otherwise(of(s)))


def char_entropy(text: Column) -> Column:
    return _entropy(F.split(text_or_empty(text), ""))


def token_entropy(text: Column) -> Column:
    return _entropy(code_tokens(text_or_empty(text)))


def bigram_entropy(text: Column) -> Column:
    return _entropy(let(code_tokens(text_or_empty(text)), lambda t: ngrams(t, 2)))


def line_length_entropy(text: Column) -> Column:
    return _entropy(F.transform(lines_univ(text_or_empty(text)), F.length))


def run_length_ratio(text: Column) -> Column:
    """Length with runs of a character as one, over length; 1 for an empty text."""
    t = text_or_empty(text)
    return F.coalesce(F.try_divide(F.length(F.regexp_replace(t, r"(?s)(.)\1+", "$1")), F.length(t)), F.lit(1.0))


def entropy_issues(text: Column) -> Column:
    """What stands out: low_entropy (boilerplate), high_entropy (minified), few_types, long_runs."""

    def of(t: Column) -> Column:
        bits, n, types = _entropy(t), F.size(t), F.size(F.array_distinct(t))
        found = F.array(F.when((bits < 1.5) & (n > 20), "low_entropy"), F.when(bits > 8.0, "high_entropy"), F.when((types > 0) & (types < 0.05 * n), "few_types"), F.when(run_length_ratio(text) < 0.3, "long_runs"))
        return F.filter(found, lambda x: x.isNotNull())

    return let(code_tokens(text_or_empty(text)), of)


def entropy_label(bits: Column) -> Column:
    out = F.when(bits < ENTROPY_LABELS[0][0], ENTROPY_LABELS[0][1])
    for bound, label in ENTROPY_LABELS[1:]:
        out = out.when(bits < bound, label)
    return out.otherwise("highly_complex")


def _repeated(items: Column) -> Column:
    return F.when(F.size(items) > 0, (F.size(items) - F.size(F.array_distinct(items))) / F.size(items)).otherwise(0.0)


def repetition(text: Column) -> Column:
    """.4 repeated lines, .4 repeated three-line blocks of at least 20 characters, .2 repeated token trigrams.

    Lines lose white space at their ends only; fewer than six lines have no blocks.
    """
    lines = F.filter(F.transform(lines_univ(text_or_empty(text)), rstrip), lambda x: x != "")
    by_line = let(lines, _repeated)
    blocks = let(lines, lambda x: F.when(F.size(x) < 6, F.lit(0.0)).otherwise(_repeated(F.filter(ngrams(x, 3, "\n"), lambda b: F.length(lstrip(b)) >= 20))))
    trigrams = let(tokens(text_or_empty(text)), lambda t: _repeated(ngrams(t, 3)))
    return F.least(F.lit(1.0), 0.4 * by_line + 0.4 * blocks + 0.2 * trigrams)


def exploded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(id_col, F.explode(tokens(text_or_empty(F.col(text_col)))).alias("token"))


def token_stats(docs: DataFrame, by: list[str], text_col: str = "text") -> DataFrame:
    """total, unique, ttr, the mean ratio and the mean share of repeated tokens of single documents (0 for one without tokens), and diversity: half the normalised entropy, half the mean ratio."""
    t = tokens(text_or_empty(F.col(text_col)))
    per = docs.select(*by, t.alias("t"))

    def own(t: Column) -> Column:
        n = F.greatest(F.size(t), F.lit(1))
        once = let(F.sort_array(t), lambda s: F.size(F.filter(s, lambda x, i: ((i == 0) | (s[F.greatest(i - 1, F.lit(0))] != x)) & ((i == F.size(s) - 1) | (s[F.least(i + 1, F.size(s) - 1)] != x)))))
        return F.struct((F.size(F.array_distinct(t)) / n).alias("ttr"), ((F.size(t) - once) / n).alias("repeated"))

    mean = per.select(*by, let(F.col("t"), own).alias("x")).groupBy(*by).agg(F.avg("x.ttr").alias("mean_ttr"), F.avg("x.repeated").alias("mean_repeated"))
    all_tokens = per.select(*by, F.explode("t").alias("token")).groupBy(*by, "token").agg(F.count("*").alias("n"))
    # entropy from sums: log2(total) - sum(n log2 n) / total
    whole = all_tokens.groupBy(*by).agg(F.sum("n").alias("total"), F.count("*").alias("unique"), F.sum(F.col("n") * F.log2("n")).alias("_nlogn"))
    whole = whole.withColumns({"ttr": F.col("unique") / F.col("total"), "_bits": F.log2("total") - F.col("_nlogn") / F.col("total")})
    even = F.when(F.col("unique") > 1, F.col("_bits") / F.log2("unique")).otherwise(0.0)
    return whole.join(mean, by).withColumn("diversity", 0.5 * even + 0.5 * F.col("mean_ttr")).drop("_nlogn", "_bits")


def frequencies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """token, n over all documents."""
    return exploded(docs, id_col, text_col).groupBy("token").agg(F.count("*").alias("n"))


def top_tokens(counts: DataFrame, k: int) -> DataFrame:
    return counts.orderBy(F.desc("n"), "token").limit(k)


def ranked(counts: DataFrame) -> DataFrame:
    """token, n, rank from 1 by falling frequency."""
    return global_rank(counts, -F.col("n"), [F.col("token")], "_r").withColumn("rank", F.col("_r") + 1).drop("_r")


def zipf(counts: DataFrame) -> DataFrame:
    """One row: entropy in bits, Zipf fit from 0 to 1 (1 if there is nothing to correlate), hapax types."""
    out = ranked(counts).crossJoin(F.broadcast(counts.agg(F.sum("n").alias("_all"))))
    x, y = F.log(F.col("n") + 1.0), F.log(1.0 / F.col("rank"))
    r = F.when(F.min("n") == F.max("n"), 1.0).otherwise(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))
    fit = (F.coalesce(r, F.lit(1.0)) + 1) / 2
    share = F.col("n") / F.col("_all")
    return out.agg(F.sum("n").alias("total"), F.count("*").alias("types"), F.sum(-share * F.log2(share)).alias("entropy"),
                   F.greatest(F.lit(0.0), F.least(F.lit(1.0), fit)).alias("zipf"), F.count_if(F.col("n") == 1).alias("hapax"))


def frequency_bands(counts: DataFrame) -> DataFrame:
    """band, types, tokens: by rank very_frequent up to a tenth of the types, common up to half, rare up to nine tenths; hapax counts types of one token."""
    one = counts.agg(F.count("*").alias("_types"))
    cut = lambda q: F.greatest(F.lit(1), F.floor(F.col("_types") * q))
    r = ranked(counts).crossJoin(F.broadcast(one))
    band = F.when(F.col("rank") <= cut(0.1), "very_frequent").when(F.col("rank") <= cut(0.5), "common").when(F.col("rank") <= cut(0.9), "rare")
    own = r.withColumn("band", band).where("band IS NOT NULL").groupBy("band").agg(F.count("*").alias("types"), F.sum("n").alias("tokens"))
    return own.union(counts.where("n = 1").agg(F.lit("hapax").alias("band"), F.count("*").alias("types"), F.count("*").alias("tokens")))


def out_of_vocabulary(rows: DataFrame, known: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """id, n_tokens, n_oov: tokens that `known` (a column token) doesn't have."""
    own = exploded(rows, id_col, text_col).groupBy(id_col, "token").agg(F.count("*").alias("n"))
    marked = own.join(known.select("token").distinct().withColumn("_k", F.lit(1)), "token", "left")
    return marked.groupBy(id_col).agg(F.sum("n").alias("n_tokens"), F.sum(F.when(F.col("_k").isNull(), F.col("n")).otherwise(0)).alias("n_oov"))


def unused(vocabulary: DataFrame, used: DataFrame) -> DataFrame:
    """Tokens of the vocabulary that never occur."""
    return vocabulary.select("token").subtract(used.select("token"))


def distinct_n(docs: DataFrame, by: list[str], n: int, text_col: str = "text") -> DataFrame:
    """Different n-grams over n-grams in each group."""
    grams = docs.select(*by, F.explode(let(words_ws(text_or_empty(F.col(text_col))), lambda t: ngrams(t, n))).alias("gram"))
    counts = grams.groupBy(*by, "gram").agg(F.count("*").alias("c"))
    return counts.groupBy(*by).agg(F.count("*").alias("different"), F.sum("c").alias("all"), (F.count("*") / F.sum("c")).alias("distinct_n"))


def self_overlap(docs: DataFrame, by: str, id_col: str, text_col: str = "text", n: int = 2) -> DataFrame:
    """id, overlap: the clipped share of a text's n-grams that some other text of its group has.

    The clip is the highest count in any other text; from the two highest counts of an n-gram it follows for all.
    """
    grams = docs.select(by, id_col, F.explode(let(words_ws(text_or_empty(F.col(text_col))), lambda t: ngrams(t, n))).alias("gram"))
    own = grams.groupBy(by, id_col, "gram").agg(F.count("*").alias("c"))
    best = own.groupBy(by, "gram").agg(F.max("c").alias("m1"), F.count("*").alias("texts"), F.max_by(id_col, F.struct("c", id_col)).alias("who"))
    joined = own.join(best, [by, "gram"])
    second = joined.where(F.col(id_col) != F.col("who")).groupBy(by, "gram").agg(F.max("c").alias("m2"))
    clip = F.least("c", F.coalesce(F.when(F.col(id_col) == F.col("who"), F.col("m2")).otherwise(F.col("m1")), F.lit(0)))
    return joined.join(second, [by, "gram"], "left").groupBy(id_col).agg((F.sum(clip) / F.sum("c")).alias("overlap"))


def tokenizer_coverage(docs: DataFrame, encoded_len: Column, by: list[str], text_col: str = "text") -> DataFrame:
    """Tokens for each word and characters for each token."""
    words = F.size(words_ws(F.col(text_col)))
    return docs.groupBy(*by).agg((F.sum(encoded_len) / F.sum(words)).alias("tokens_per_word"), (F.sum(F.length(text_col)) / F.sum(encoded_len)).alias("chars_per_token"))


def difficulty(text: Column) -> Column:
    """.4 deepest indentation of 32 (of lines that aren't blank), .2 lines of 500, .4 share of different words; 0 without lines."""
    t = text_or_empty(text)

    def of(lines: Column) -> Column:
        indent = F.coalesce(F.array_max(F.transform(F.filter(lines, lambda x: strip(x) != ""), lambda x: F.length(x) - F.length(lstrip(x)))), F.lit(0))
        share = let(words_ws(t), lambda x: F.size(F.array_distinct(x)) / F.greatest(F.size(x), F.lit(1)))
        return F.when(F.size(lines) == 0, 0.0).otherwise(0.4 * F.least(indent / 32, F.lit(1.0)) + 0.4 * share + 0.2 * F.least(F.size(lines) / 500, F.lit(1.0)))

    return let(lines_univ(t), of)


def too_hard(text: Column, most: float) -> Column:
    return difficulty(text) > most


# Words and signs by which a text is taken for one of three programming languages.
LANGUAGE_SIGNS = {
    "python": r"\bdef\b|\bclass\b.*:|\bimport\b|\bself\b",
    "typescript": r"\binterface\b|\btype\b\s+\w+\s*=|\bconst\b|\blet\b",
    "javascript": r"\bfunction\b|\bvar\b|\brequire\(",
}


def code_language(text: Column) -> Column:
    """python, typescript, javascript or other: the one with most signs, in this order of equal ones."""
    count = {k: F.regexp_count(text_or_empty(text), F.lit(f"(?d){p}")) for k, p in LANGUAGE_SIGNS.items()}
    found = F.struct(*[c.alias(k) for k, c in count.items()])
    return let(found, lambda n: F.when((n["python"] > 0) & (n["python"] >= n["typescript"]) & (n["python"] >= n["javascript"]), "python")
               .when(n["typescript"] > n["javascript"], "typescript").when(n["javascript"] > 0, "javascript").otherwise("other"))


def vocabulary_efficiency(docs: DataFrame, vocabulary: DataFrame, rare: float = 0.0001, text_col: str = "text") -> DataFrame:
    """One row: vocabulary size, its unused tokens, rare tokens, tokens for each word (1 without words), the share of different words of one token, tokens seen, and coverage and out-of-vocabulary shares."""
    counts = written(frequencies(docs, docs.columns[0], text_col))
    known = vocabulary.select("token").distinct()
    seen = counts.join(known.withColumn("_k", F.lit(1)), "token", "left")
    per_text = docs.select(F.size(words_ws(text_or_empty(F.col(text_col)))).alias("w"), F.size(tokens(text_or_empty(F.col(text_col)))).alias("t")).where("w > 0")
    parts = per_text.agg(F.coalesce(F.sum("t") / F.sum("w"), F.lit(1.0)).alias("fragmentation"))
    words = docs.select(F.explode(words_ws(text_or_empty(F.col(text_col)))).alias("word")).distinct()
    single = words.agg((F.count_if(F.size(tokens(F.col("word"))) == 1) / F.greatest(F.count("*"), F.lit(1))).alias("single_token"))
    whole = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens_seen"))
    usage = seen.agg(F.count_if(F.col("_k").isNotNull()).alias("_used"), (F.coalesce(F.sum(F.when(F.col("_k").isNull(), F.col("n"))), F.lit(0)) / F.greatest(F.sum("n"), F.lit(1))).alias("oov"))
    low = counts.crossJoin(F.broadcast(whole)).agg(F.count_if(F.col("n") < rare * F.greatest(F.col("tokens_seen"), F.lit(1))).alias("n_rare"))
    size = known.agg(F.count("*").alias("vocab_size"))
    out = size.crossJoin(usage).crossJoin(low).crossJoin(parts).crossJoin(single).crossJoin(whole)  # one row each
    return out.withColumns({"n_unused": F.col("vocab_size") - F.col("_used"), "coverage": F.try_divide("_used", "vocab_size")}).drop("_used")


def self_bleu(docs: DataFrame, by: str, id_col: str, text_col: str = "text") -> DataFrame:
    """id, bleu: the geometric mean of the clipped shares of tokens and of bigrams that other texts of the group have; the first alone for a text of one token."""
    one = self_overlap(docs, by, id_col, text_col, 1).withColumnRenamed("overlap", "_p1")
    two = self_overlap(docs, by, id_col, text_col, 2).withColumnRenamed("overlap", "_p2")
    both = docs.select(id_col).join(one, id_col, "left").join(two, id_col, "left")
    bleu = F.when(F.col("_p1").isNull(), 0.0).when(F.col("_p2").isNull(), F.col("_p1")).when((F.col("_p1") == 0) | (F.col("_p2") == 0), 0.0).otherwise(F.sqrt(F.col("_p1") * F.col("_p2")))
    return both.select(id_col, bleu.alias("bleu"))
