"""Queries on statistics, metric series, evaluation, vectors, search and rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.operators import evaluation, metrics, search, stats, vector
from corpusmill.session import table

#: The series of the events table: a user is a run, an event type a metric.
SERIES = metrics.Series(["user_id", "event_type"], ["ts", "event_id"])


def _docs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value")


def _rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


def q_length_stats(spark, sf_dir) -> DataFrame:
    out = stats.length_stats(_docs(spark, sf_dir), F.length("text"), ["lang"])
    return _rounded(out, *[c for c in out.columns if c not in ("lang", "n", "least", "most")])


def q_lang_mix(spark, sf_dir) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(stats.code_language(F.col("html")).alias("language"))
    return _rounded(stats.shares(pages, "language"), "share")


def q_lang_shares(spark, sf_dir) -> DataFrame:
    return _rounded(stats.shares(_docs(spark, sf_dir), "lang"), "share")


def q_dataset_summary(spark, sf_dir) -> DataFrame:
    out = stats.summary(_docs(spark, sf_dir), F.least(F.length("text") / 1000.0, F.lit(1.0)))
    # the estimate of different texts is within 15 % (three deviations of the sketch), or is shown
    exact = _docs(spark, sf_dir).agg(F.count_distinct(F.xxhash64("text")).alias("n"))
    close = F.abs(F.col("about_unique") - F.col("n")) <= 0.15 * F.col("n")
    return _rounded(out.crossJoin(exact).withColumn("unique_is_close", close).drop("about_unique", "n"), "mean_tokens")


def q_entropy_char(spark, sf_dir) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.round(stats.char_entropy(F.col("text")), 6).alias("bits"))


def q_entropy_token(spark, sf_dir) -> DataFrame:
    bits = stats.token_entropy(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.round(bits, 6).alias("bits"), stats.entropy_label(F.round(bits, 6)).alias("label"))


def q_entropy_bigram(spark, sf_dir) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.round(stats.bigram_entropy(F.col("text")), 6).alias("bits"))


def q_entropy_line(spark, sf_dir) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.round(stats.line_length_entropy(F.col("text")), 6).alias("bits"))


def q_run_length(spark, sf_dir) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.round(stats.run_length_ratio(F.col("text")), 6).alias("ratio"))


def q_entropy_issues(spark, sf_dir) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.array_join(stats.entropy_issues(F.col("text")), ",").alias("issues"))


def q_repetition(spark, sf_dir) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.round(stats.repetition(F.col("text")), 6).alias("score"))


def q_difficulty(spark, sf_dir) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.round(stats.difficulty(F.col("text")), 6).alias("score"))


def q_difficulty_filter(spark, sf_dir) -> DataFrame:
    return _docs(spark, sf_dir).where(~stats.too_hard(F.col("text"), 0.35)).select("doc_id")


def q_token_stats(spark, sf_dir) -> DataFrame:
    return _rounded(stats.token_stats(_docs(spark, sf_dir), ["lang"]), "ttr", "mean_ttr", "mean_repeated", "diversity")


def q_token_frequency(spark, sf_dir) -> DataFrame:
    return stats.top_tokens(stats.frequencies(_docs(spark, sf_dir)), 100)


def q_zipf(spark, sf_dir) -> DataFrame:
    return _rounded(stats.zipf(stats.frequencies(_docs(spark, sf_dir))), "entropy", "zipf")


def q_freq_bands(spark, sf_dir) -> DataFrame:
    return stats.frequency_bands(stats.frequencies(_docs(spark, sf_dir)))


def q_oov(spark, sf_dir) -> DataFrame:
    return stats.out_of_vocabulary(table(spark, sf_dir, "benchmark"), stats.frequencies(_docs(spark, sf_dir)), "item_id")


def q_vocab_unused(spark, sf_dir) -> DataFrame:
    return stats.unused(stats.frequencies(table(spark, sf_dir, "benchmark"), "item_id"), stats.frequencies(_docs(spark, sf_dir)))


def q_distinct_n(spark, sf_dir) -> DataFrame:
    return _rounded(stats.distinct_n(_docs(spark, sf_dir), ["lang"], 2), "distinct_n")


def q_self_overlap(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark").withColumn("g", F.col("item_id") % 4)
    return _rounded(stats.self_overlap(rows, "g", "item_id"), "overlap")


def q_tokenizer_coverage(spark, sf_dir) -> DataFrame:
    return _rounded(stats.tokenizer_coverage(_docs(spark, sf_dir), F.octet_length("text"), ["lang"]), "tokens_per_word", "chars_per_token")


def q_moving_avg(spark, sf_dir) -> DataFrame:
    return _rounded(metrics.moving_average(_events(spark, sf_dir), SERIES), "ma").select("event_id", "ma")


def q_divergence(spark, sf_dir) -> DataFrame:
    return metrics.divergence(_events(spark, sf_dir), SERIES).select("event_id", "diverged")


def q_rolling_z(spark, sf_dir) -> DataFrame:
    return _rounded(metrics.rolling_z(_events(spark, sf_dir), SERIES), "z").select("event_id", "z", "anomaly", "severity")


def q_jumps(spark, sf_dir) -> DataFrame:
    return _rounded(metrics.jumps(_events(spark, sf_dir), SERIES), "ratio").select("event_id", "ratio")


def q_rate_of_change(spark, sf_dir) -> DataFrame:
    out = metrics.rate_of_change(_events(spark, sf_dir), SERIES, F.unix_seconds(F.col("ts").cast("timestamp")))
    return _rounded(out, "rate").select("event_id", "rate")


def q_down_sample(spark, sf_dir) -> DataFrame:
    return metrics.down_sample(_events(spark, sf_dir), SERIES, 10).select("event_id")


def q_plateau(spark, sf_dir) -> DataFrame:
    return metrics.plateaus(_events(spark, sf_dir), SERIES, 5, 0.5, 3)


def q_oscillation(spark, sf_dir) -> DataFrame:
    return _rounded(metrics.oscillation(_events(spark, sf_dir), SERIES), "sign_changes")


def q_trend(spark, sf_dir) -> DataFrame:
    return _rounded(metrics.trend(_events(spark, sf_dir), SERIES), "slope")


def q_ema(spark, sf_dir) -> DataFrame:
    # exact sums of decimals often tie at the sixth digit: decimal rounding at the ninth first settles them alike in any order of summing
    return metrics.ema(_events(spark, sf_dir), SERIES).withColumn("ema", F.round(F.col("ema").cast("decimal(28,9)"), 6).cast("double"))


def q_patience(spark, sf_dir) -> DataFrame:
    return metrics.patience(_events(spark, sf_dir), SERIES)


def q_asof_metric(spark, sf_dir) -> DataFrame:
    """The latest purchase value of the user at each error."""
    ev = _events(spark, sf_dir)
    asked = ev.where("event_type = 'error'").select("user_id", "ts").distinct()
    known = ev.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return metrics.as_of(asked, known, ["user_id"], "ts", "value")


def q_asof_lerp(spark, sf_dir) -> DataFrame:
    ev = _events(spark, sf_dir).withColumn("sec", F.unix_seconds(F.col("ts").cast("timestamp")))
    asked = ev.where("event_type = 'error'").select("user_id", "sec").distinct()
    known = ev.where("event_type = 'purchase'").groupBy("user_id", "sec").agg(F.max("value").alias("value"))
    return _rounded(metrics.as_of_interpolated(asked, known, ["user_id"], "sec", "value"), "value")


def q_leaderboard(spark, sf_dir) -> DataFrame:
    runs = _events(spark, sf_dir).groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("loss"))
    return metrics.leaderboard(runs, "loss", 20, "user_id")


def q_metric_diff(spark, sf_dir) -> DataFrame:
    ev = _events(spark, sf_dir)
    of = lambda kind: ev.where(F.col("event_type") == kind).groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("v"))
    return _rounded(metrics.compare(of("view"), of("click"), "user_id", "v"), "delta")


def q_pass_at_k(spark, sf_dir) -> DataFrame:
    labels = table(spark, sf_dir, "labels").withColumn("problem", F.col("doc_id") % 50)
    return _rounded(evaluation.mean_pass_at_k(labels, "problem", F.col("quality") == 1, [1, 3, 5]), "pass_at_k")


def q_group_advantage(spark, sf_dir) -> DataFrame:
    return _rounded(evaluation.group_advantage(_events(spark, sf_dir), ["user_id", "event_type"], "value"), "advantage").select("event_id", "advantage")


def _judged(spark, sf_dir) -> DataFrame:
    docs = _docs(spark, sf_dir).select("doc_id", "lang", F.least(F.length("text") / 3000.0, F.lit(1.0)).alias("confidence"))
    return docs.join(table(spark, sf_dir, "labels"), "doc_id")


def q_ece(spark, sf_dir) -> DataFrame:
    out = evaluation.calibration_error(_judged(spark, sf_dir), F.col("confidence"), F.col("quality").cast("double"))
    return _rounded(out, "ece", "largest_gap", "over", "under")


def q_reliability(spark, sf_dir) -> DataFrame:
    return _rounded(evaluation.reliability(_judged(spark, sf_dir), F.col("confidence"), F.col("quality").cast("double")), "confidence", "accuracy", "gap")


def _routed(spark, sf_dir) -> DataFrame:
    return _docs(spark, sf_dir).select(F.col("lang").alias("actual"), F.when(F.col("text").rlike("ß|ü"), "de").when(F.col("text").rlike("ñ|ó"), "es").when(F.col("text").rlike("è|ç"), "fr").otherwise("en").alias("predicted"))


def q_confusion(spark, sf_dir) -> DataFrame:
    return evaluation.confusion(_routed(spark, sf_dir), "actual", "predicted")


def q_per_class(spark, sf_dir) -> DataFrame:
    return evaluation.per_class(_routed(spark, sf_dir), "actual", "predicted")


def q_macro_f1(spark, sf_dir) -> DataFrame:
    return _rounded(evaluation.macro(_routed(spark, sf_dir), "actual", "predicted"), "macro_f1", "weighted_f1")


def q_agreement(spark, sf_dir) -> DataFrame:
    return _rounded(evaluation.agreement(_judged(spark, sf_dir), F.col("confidence") * 4 + 1, F.col("quality") * 4.0 + 1), "mae", "rmse", "pearson")


def q_perplexity_rollup(spark, sf_dir) -> DataFrame:
    out = evaluation.perplexity_rollup(_events(spark, sf_dir), "event_type", F.col("value") / 100, F.struct("ts", "event_id"))
    out = _rounded(out, "current", "least", "most", "mean", digits=4)
    return out.withColumn("level", evaluation.perplexity_level(F.col("mean")))


def q_cosine_knn(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    out = vector.nearest(rows, rows.where("vec_id % 100 = 0"), 10)
    return _rounded(out, "similarity", digits=5).select("query", "id", "similarity", "rank")


def q_embedding_stats(spark, sf_dir) -> DataFrame:
    return _rounded(vector.norm_stats(table(spark, sf_dir, "embeddings")), "mean_norm", "std_norm", "least_norm", "most_norm")


def q_dead_dims(spark, sf_dir) -> DataFrame:
    return _rounded(vector.dimension_stats(table(spark, sf_dir, "embeddings")), "mean", "variance")


def q_mean_pair_cosine(spark, sf_dir) -> DataFrame:
    return _rounded(vector.mean_pair_cosine(table(spark, sf_dir, "embeddings")), "mean_cosine")


def q_kmeans(spark, sf_dir) -> DataFrame:
    return vector.clusters(table(spark, sf_dir, "embeddings"), 5).groupBy("cluster").agg(F.count("*").alias("n"))


def q_silhouette(spark, sf_dir) -> DataFrame:
    return _rounded(vector.silhouette(table(spark, sf_dir, "embeddings"), "label").select("vec_id", "silhouette"), "silhouette")


def q_cluster_quality(spark, sf_dir) -> DataFrame:
    return _rounded(vector.cluster_quality(table(spark, sf_dir, "embeddings"), "label"), "inside", "between", "estimate")


def q_pca(spark, sf_dir) -> DataFrame:
    return vector.projected(table(spark, sf_dir, "embeddings")).select("vec_id", F.round(F.abs(F.col("projection")[0]), 4).alias("x"))


def q_topk_sampling(spark, sf_dir) -> DataFrame:
    return _rounded(vector.top_k_cut(table(spark, sf_dir, "embeddings"), "vec_id", 5), "probability")


def q_topp(spark, sf_dir) -> DataFrame:
    return _rounded(vector.top_p_cut(table(spark, sf_dir, "embeddings"), "vec_id", 0.5), "probability")


def q_tfidf_search(spark, sf_dir) -> DataFrame:
    return _rounded(search.search(_docs(spark, sf_dir), table(spark, sf_dir, "benchmark"), 5), "score")


def q_domain_scores(spark, sf_dir) -> DataFrame:
    return _rounded(search.domains(table(spark, sf_dir, "pages"), "page_id", "html"), "confidence")


def q_safety_findings(spark, sf_dir) -> DataFrame:
    return search.findings(table(spark, sf_dir, "pages"), "page_id", "html")


def q_safety_gate(spark, sf_dir) -> DataFrame:
    return search.safety_gate(table(spark, sf_dir, "pages"), "page_id", "html", "medium")


QUERIES = {k: v for k, v in globals().items() if k.startswith("q_")}

_TOKENS = r"regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}\p{M}_]+|[^\p{L}\p{N}\p{M}_\s]')"
_CODE_TOKENS = r"regexp_extract_all(coalesce(text, ''), '[A-Za-z_][\p{L}\p{N}_]*|[0-9]+(?:\.[0-9]+)?|[^\s\x0b\x1c-\x1f\x85\p{Z}\p{L}\p{N}_]')"
_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\s\x0b\x1c-\x1f\x85\p{Z}]+'), lambda x: x <> '')"
_SPLIT = r"string_split_regex(coalesce({0}, ''), '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{{2028}}\x{{2029}}]')"


def _lines(col: str = "text") -> str:
    """Lines as Python splits them."""
    p = _SPLIT.format(col)
    return f"({p})[1:len({p}) - CASE WHEN ({p})[-1] = '' THEN 1 ELSE 0 END]"


_RSTRIP = r"regexp_replace(x, '[\s\x0b\x1c-\x1f\x85\p{Z}]+$', '')"
_LSTRIP = r"regexp_replace(x, '^[\s\x0b\x1c-\x1f\x85\p{Z}]+', '')"
_STRIP = r"regexp_replace(x, '^[\s\x0b\x1c-\x1f\x85\p{Z}]+|[\s\x0b\x1c-\x1f\x85\p{Z}]+$', '', 'g')"
_W = "(PARTITION BY user_id, event_type ORDER BY ts, event_id{0})"
_P = "(PARTITION BY user_id, event_type)"


def _w(frame: str = "") -> str:
    return _W.format(f" ROWS BETWEEN {frame}" if frame else "")


def _bits(items: str, kind: str = "VARCHAR", label: str = "") -> str:
    return f"""
        WITH t AS (SELECT doc_id, unnest({items}) AS u FROM documents), c AS (SELECT doc_id, u, count(*) AS c FROM t GROUP BY doc_id, u),
        s AS (SELECT doc_id, c / sum(c) OVER (PARTITION BY doc_id) AS p FROM c), b AS (SELECT doc_id, round(sum(-p * log2(p)), 6) AS bits FROM s GROUP BY doc_id)
        SELECT doc_id, coalesce(bits, 0) AS bits{label} FROM documents LEFT JOIN b USING (doc_id)"""


_LABEL = ", CASE WHEN coalesce(bits, 0) < 2 THEN 'trivial' WHEN bits < 3.5 THEN 'simple' WHEN bits < 5 THEN 'moderate' WHEN bits < 7 THEN 'complex' ELSE 'highly_complex' END AS label"
_GRAM2 = "list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1])"
_REP = "CASE WHEN len({0}) > 0 THEN (len({0}) - len(list_distinct({0}))) / len({0}) ELSE 0 END"
_DIFFICULTY = f"""SELECT doc_id, CASE WHEN len(l) = 0 THEN 0 ELSE 0.4 * least(coalesce(list_max(list_transform(list_filter(l, lambda x: {_LSTRIP} <> ''), lambda x: length(x) - length({_LSTRIP}))), 0) / 32, 1)
    + 0.4 * (len(list_distinct(w)) / greatest(len(w), 1)) + 0.2 * least(len(l) / 500, 1) END::DOUBLE AS s FROM (SELECT doc_id, {_lines()} AS l, {_WORDS} AS w FROM documents)"""
_FREQ = f"WITH f AS (SELECT token, count(*) AS n FROM (SELECT unnest({_TOKENS}) AS token FROM documents) GROUP BY token), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, token) AS rank, count(*) OVER () AS types, sum(n) OVER () AS whole FROM f)"
_JUDGED = "WITH j AS (SELECT least(length(text) / 3000.0::DOUBLE, 1.0) AS confidence, quality FROM documents JOIN labels USING (doc_id)), b AS (SELECT least(floor(confidence * 10), 9)::INT AS bin, count(*) AS n, avg(confidence) AS c, avg(quality) AS a, count(*) FILTER (confidence > quality) AS over, count(*) FILTER (confidence < quality) AS under FROM j GROUP BY 1)"
_ROUTED = "WITH r AS (SELECT lang AS actual, CASE WHEN regexp_matches(text, 'ß|ü') THEN 'de' WHEN regexp_matches(text, 'ñ|ó') THEN 'es' WHEN regexp_matches(text, 'è|ç') THEN 'fr' ELSE 'en' END AS predicted FROM documents)"
_CLASSES = f"""{_ROUTED}, a AS (SELECT actual AS class, count(*) AS support, count(*) FILTER (actual = predicted) AS tp FROM r GROUP BY actual), p AS (SELECT predicted AS class, count(*) AS found FROM r GROUP BY predicted),
    m AS (SELECT class, support, coalesce(tp / nullif(coalesce(found, 0), 0), 0) AS p, tp / support AS r FROM a LEFT JOIN p USING (class)),
    k AS (SELECT class, support, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM m)"""
_V = "embedding::DOUBLE[]"
_NORM = f"sqrt(list_sum(list_transform({_V}, lambda x: x * x)))"
_TERMS = r"list_filter(string_split_regex(lower(regexp_replace(coalesce(text, ''), '([a-z])([A-Z])', '\1 \2', 'g')), '[^a-zA-Z0-9_]+'), lambda w: length(w) >= 2 AND NOT regexp_full_match(w, '[0-9]+'))"
_ASOF = "a AS (SELECT DISTINCT user_id, {0} AS sec FROM events WHERE event_type = 'error'), k AS (SELECT user_id, {0} AS sec, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY ALL)"


def _domain_sql() -> str:
    count = lambda p: f"len(regexp_extract_all(t, {_q(p)}))"
    points = {d: f"({w} * (3 * ({' + '.join(count('(?i)' + p) for p in imports)}) + {' + '.join(map(count, words))}))::DOUBLE" for d, (imports, words, w) in search.DOMAINS.items()}
    rows = ", ".join(f"{{'points': {p}, 'k': {-k}, 'domain': '{d}'}}" for k, (d, p) in enumerate(points.items()))
    return f"""
        WITH s AS (SELECT page_id, [{rows}] AS s FROM (SELECT page_id, coalesce(html, '') AS t FROM pages)),
        c AS (SELECT page_id, list_max(s) AS top, list_sum(list_transform(s, lambda x: x.points)) AS n FROM s)
        SELECT page_id, CASE WHEN n = 0 OR top.points / n < 0.15 THEN 'general' ELSE top.domain END AS domain, round(CASE WHEN n = 0 THEN 1 WHEN top.points / n < 0.15 THEN 0.5 ELSE top.points / n END::DOUBLE, 6) AS confidence FROM c"""


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_LEVEL = "CASE " + " ".join(f"WHEN mean > {b} THEN '{n}'" for b, n in evaluation.LEVELS) + f" ELSE '{evaluation.BEST_LEVEL}' END"
ORACLES = {
    "q_length_stats": "SELECT lang, count(*) AS n, round(avg(l), 6) AS mean, round(stddev_pop(l), 6) AS std, min(l) AS least, max(l) AS most, " + ", ".join(f"round(quantile_cont(l, {p}), 6) AS p{round(100 * p)}" for p in stats.PERCENTILES) + " FROM (SELECT lang, length(text) AS l FROM documents) GROUP BY lang",
    "q_lang_mix": f"""
        WITH c AS (SELECT {", ".join(f"len(regexp_extract_all(coalesce(html, ''), {_q(p)})) AS {k}" for k, p in stats.LANGUAGE_SIGNS.items())} FROM pages),
        l AS (SELECT CASE WHEN python > 0 AND python >= typescript AND python >= javascript THEN 'python' WHEN typescript > javascript THEN 'typescript' WHEN javascript > 0 THEN 'javascript' ELSE 'other' END AS language FROM c)
        SELECT language, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM l GROUP BY language""",
    "q_lang_shares": "SELECT lang, n, round(n / sum(n) OVER (), 6) AS share FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang)",
    "q_dataset_summary": r"SELECT count(*) AS samples, sum(w)::BIGINT AS tokens, round(avg(w), 6) AS mean_tokens, min(l) AS least_chars, max(l) AS most_chars, round(avg(least(l / 1000.0::DOUBLE, 1.0)), 4) AS mean_quality, true AS unique_is_close FROM (SELECT length(text) AS l, len(list_filter(string_split_regex(text, '[\s\x0b\x1c-\x1f\x85\p{Z}]+'), lambda x: x <> '')) AS w FROM documents)",
    "q_entropy_char": _bits("string_split(coalesce(text, ''), '')"),
    "q_entropy_token": _bits(_CODE_TOKENS, label=_LABEL),
    "q_entropy_bigram": _bits(_GRAM2.format("w")).replace("FROM documents)", f"FROM (SELECT doc_id, {_CODE_TOKENS} AS w FROM documents))", 1),
    "q_entropy_line": _bits(f"list_transform({_lines()}, lambda x: length(x))"),
    "q_run_length": """WITH c AS (SELECT doc_id, string_split(coalesce(text, ''), '') AS c FROM documents)
        SELECT doc_id, round(CASE WHEN len(c) = 0 OR c[1] = '' THEN 1 ELSE (1 + len(list_filter(range(2, len(c) + 1), lambda i: c[i] <> c[i - 1]))) / len(c) END::DOUBLE, 6) AS ratio FROM c""",
    "q_entropy_issues": f"""
        WITH p AS (SELECT doc_id, {_CODE_TOKENS} AS w, string_split(coalesce(text, ''), '') AS c FROM documents), t AS (SELECT doc_id, unnest(w) AS u FROM p), n AS (SELECT doc_id, u, count(*) AS n FROM t GROUP BY ALL),
        b AS (SELECT doc_id, sum(-q * log2(q)) AS bits FROM (SELECT doc_id, n / sum(n) OVER (PARTITION BY doc_id) AS q FROM n) GROUP BY doc_id),
        f AS (SELECT doc_id, coalesce(bits, 0) AS bits, len(w) AS n, len(list_distinct(w)) AS types, CASE WHEN len(c) = 0 OR c[1] = '' THEN 1 ELSE (1 + len(list_filter(range(2, len(c) + 1), lambda i: c[i] <> c[i - 1]))) / len(c) END AS runs FROM p LEFT JOIN b USING (doc_id))
        SELECT doc_id, concat_ws(',', CASE WHEN bits < 1.5 AND n > 20 THEN 'low_entropy' END, CASE WHEN bits > 8 THEN 'high_entropy' END, CASE WHEN types > 0 AND types < 0.05 * n THEN 'few_types' END, CASE WHEN runs < 0.3 THEN 'long_runs' END) AS issues FROM f""",
    "q_repetition": f"""
        WITH p AS (SELECT doc_id, list_filter(list_transform({_lines()}, lambda x: {_RSTRIP}), lambda x: x <> '') AS l, {_TOKENS} AS t FROM documents),
        g AS (SELECT doc_id, l, list_filter(list_transform(range(1, len(l) - 1), lambda i: l[i] || chr(10) || l[i + 1] || chr(10) || l[i + 2]), lambda x: length({_LSTRIP}) >= 20) AS b, list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]) AS g FROM p)
        SELECT doc_id, round(least(1.0, 0.4 * {_REP.format('l')} + 0.4 * CASE WHEN len(l) < 6 THEN 0 ELSE {_REP.format('b')} END + 0.2 * {_REP.format('g')})::DOUBLE, 6) AS score FROM g""",
    "q_difficulty": f"SELECT doc_id, round(s, 6) AS score FROM ({_DIFFICULTY})",
    "q_difficulty_filter": f"SELECT doc_id FROM ({_DIFFICULTY}) WHERE NOT s > 0.35",
    "q_token_stats": f"""
        WITH t AS (SELECT doc_id, lang, {_TOKENS} AS t FROM documents), e AS (SELECT doc_id, lang, unnest(t) AS u FROM t), d AS (SELECT doc_id, u, count(*) AS n FROM e GROUP BY ALL),
        r AS (SELECT doc_id, sum(n) FILTER (n > 1) / sum(n) AS r FROM d GROUP BY doc_id),
        a AS (SELECT lang, avg(len(list_distinct(t)) / greatest(len(t), 1)) AS m, avg(coalesce(r, 0)) AS rep FROM t LEFT JOIN r USING (doc_id) GROUP BY lang),
        c AS (SELECT lang, u, count(*) AS n FROM e GROUP BY ALL), s AS (SELECT *, n / sum(n) OVER (PARTITION BY lang) AS q FROM c),
        w AS (SELECT lang, sum(n)::BIGINT AS total, count(*) AS types, sum(-q * log2(q)) AS bits FROM s GROUP BY lang)
        SELECT lang, total, types AS "unique", round(types / total, 6) AS ttr, round(m, 6) AS mean_ttr, round(rep, 6) AS mean_repeated, round(0.5 * CASE WHEN types > 1 THEN bits / log2(types) ELSE 0 END + 0.5 * m, 6) AS diversity FROM w JOIN a USING (lang)""",
    "q_token_frequency": f"{_FREQ} SELECT token, n FROM f ORDER BY n DESC, token LIMIT 100",
    "q_zipf": f"{_FREQ} SELECT sum(n)::BIGINT AS total, count(*) AS types, round(sum(-(n / whole) * log2(n / whole)), 6) AS entropy, round((CASE WHEN min(n) = max(n) THEN 1 ELSE corr(ln(n + 1.0::DOUBLE), ln(1.0::DOUBLE / rank)) END + 1) / 2, 6) AS zipf, count(*) FILTER (n = 1) AS hapax FROM r",
    "q_freq_bands": f"""{_FREQ}, b AS (SELECT *, CASE WHEN rank <= greatest(1, floor(types * 0.1)) THEN 'very_frequent' WHEN rank <= greatest(1, floor(types * 0.5)) THEN 'common' WHEN rank <= greatest(1, floor(types * 0.9)) THEN 'rare' END AS band FROM r)
        SELECT band, count(*) AS types, sum(n)::BIGINT AS tokens FROM b WHERE band IS NOT NULL GROUP BY band UNION ALL SELECT 'hapax', count(*), count(*) FROM f WHERE n = 1""",
    "q_oov": f"SELECT item_id, count(*) AS n_tokens, count(*) FILTER (token NOT IN (SELECT unnest({_TOKENS}) FROM documents)) AS n_oov FROM (SELECT item_id, unnest({_TOKENS}) AS token FROM benchmark) GROUP BY item_id",
    "q_vocab_unused": f"SELECT unnest({_TOKENS}) AS token FROM benchmark EXCEPT SELECT unnest({_TOKENS}) FROM documents",
    "q_distinct_n": f"""SELECT lang, count(DISTINCT g) AS different, count(*) AS "all", round(count(DISTINCT g) / count(*), 6) AS distinct_n FROM (SELECT lang, unnest({_GRAM2.format('w')}) AS g FROM (SELECT lang, {_WORDS} AS w FROM documents)) GROUP BY lang""",
    "q_self_overlap": f"""
        WITH g AS (SELECT item_id, item_id % 4 AS k, unnest({_GRAM2.format('w')}) AS g FROM (SELECT item_id, {_WORDS} AS w FROM benchmark)), c AS (SELECT item_id, k, g, count(*) AS c FROM g GROUP BY ALL),
        o AS (SELECT a.item_id, a.g, any_value(a.c) AS c, max(b.c) AS m FROM c a LEFT JOIN c b ON a.k = b.k AND a.g = b.g AND a.item_id <> b.item_id GROUP BY a.item_id, a.g)
        SELECT item_id, round(sum(least(c, coalesce(m, 0))) / sum(c), 6) AS overlap FROM o GROUP BY item_id""",
    "q_tokenizer_coverage": r"SELECT lang, round(sum(strlen(text)) / sum(len(list_filter(string_split_regex(text, '[\s\x0b\x1c-\x1f\x85\p{Z}]+'), lambda x: x <> ''))), 6) AS tokens_per_word, round(sum(length(text)) / sum(strlen(text)), 6) AS chars_per_token FROM documents GROUP BY lang",
    "q_moving_avg": f"SELECT event_id, round(avg(value) OVER {_w('19 PRECEDING AND CURRENT ROW')}, 6) AS ma FROM events",
    "q_divergence": f"SELECT event_id, coalesce(value > 2 * avg(value) OVER {_w('UNBOUNDED PRECEDING AND 1 PRECEDING')}, false) AS diverged FROM events",
    "q_rolling_z": f"""WITH w AS (SELECT event_id, value, avg(value) OVER x AS m, stddev_samp(value) OVER x AS s, count(value) OVER x AS n FROM events WHERE isfinite(value) WINDOW x AS {_w('20 PRECEDING AND 1 PRECEDING')}),
        z AS (SELECT event_id, CASE WHEN n >= 5 THEN (value - m) / greatest(s, 1e-6::DOUBLE) END AS z FROM w)
        SELECT event_id, round(z, 6) AS z, coalesce(abs(z) > 3, false) AS anomaly, CASE WHEN abs(z) > 3 THEN 'warning' END AS severity FROM z
        UNION ALL SELECT event_id, NULL, value IS NOT NULL, CASE WHEN value IS NOT NULL THEN 'critical' END FROM events WHERE value IS NULL OR NOT isfinite(value)""",
    "q_jumps": f"SELECT event_id, round(r, 6) AS ratio FROM (SELECT event_id, value / nullif(lag(value) OVER {_w()}, 0) AS r FROM events) WHERE r > 10 OR r < 0.1",
    "q_rate_of_change": f"SELECT event_id, round(dv / ds, 6) AS rate FROM (SELECT event_id, value - lag(value) OVER {_w()} AS dv, floor(epoch(ts))::BIGINT - lag(floor(epoch(ts))::BIGINT) OVER {_w()} AS ds FROM events) WHERE ds <> 0",
    "q_down_sample": f"""WITH k AS (SELECT event_id, user_id, event_type, row_number() OVER {_w()} - 1 AS k, count(*) OVER {_P} AS n FROM events), i AS (SELECT unnest(range(0, 10)) AS i)
        SELECT event_id FROM k WHERE n <= 10 OR k IN (SELECT floor(i * (n - 1) / 9) FROM i)""",
    "q_plateau": f"""WITH m AS (SELECT *, avg(value) OVER {_w('4 PRECEDING AND CURRENT ROW')} AS ma, row_number() OVER {_w()} - 1 AS k FROM events), f AS (SELECT *, coalesce(lag(ma) OVER {_w()} - ma < 0.5, false) AS flat FROM m),
        i AS (SELECT *, k - sum(flat::INT) OVER {_w('UNBOUNDED PRECEDING AND CURRENT ROW')} AS island FROM f)
        SELECT user_id, event_type, min(k) - 1 AS start_step, max(k) AS end_step, count(*) + 1 AS n FROM i WHERE flat GROUP BY user_id, event_type, island HAVING count(*) + 1 >= 3""",
    "q_oscillation": f"""WITH d AS (SELECT *, value - lag(value) OVER {_w()} > 0 AS up FROM events), t AS (SELECT *, (up <> lag(up) OVER {_w()})::INT AS t FROM d), s AS (SELECT user_id, event_type, coalesce(sum(t), 0) / greatest(count(up), 1) AS s, count(*) AS n FROM t GROUP BY ALL)
        SELECT user_id, event_type, round(s, 6) AS sign_changes, n >= 4 AND s > 0.6 AS oscillating FROM s""",
    "q_trend": f"SELECT user_id, event_type, round(regr_slope(value, k), 6) AS slope, count(*) AS n FROM (SELECT *, row_number() OVER {_w()} AS k FROM events) GROUP BY user_id, event_type",
    "q_ema": "SELECT user_id, event_type, round(list_reduce(v, lambda e, x: 0.1 * x + 0.9 * e)::DECIMAL(28, 9), 6)::DOUBLE AS ema FROM (SELECT user_id, event_type, list(value::DOUBLE ORDER BY ts, event_id) AS v FROM events GROUP BY ALL)",
    "q_patience": f"SELECT user_id, event_type, min(value) AS best, (count(*) - arg_min(k, (value, k)))::BIGINT AS stale FROM (SELECT *, row_number() OVER {_w()} AS k FROM events) GROUP BY user_id, event_type",
    "q_asof_metric": f"WITH {_ASOF.format('ts')} SELECT a.user_id, a.sec AS ts, k.value FROM a ASOF LEFT JOIN k ON a.user_id = k.user_id AND a.sec >= k.sec",
    "q_asof_lerp": f"""WITH {_ASOF.format('floor(epoch(ts))::BIGINT')},
        b AS (SELECT a.user_id, a.sec, lo.sec AS x0, lo.value AS y0 FROM a ASOF LEFT JOIN k lo ON a.user_id = lo.user_id AND a.sec >= lo.sec),
        c AS (SELECT b.*, hi.sec AS x1, hi.value AS y1 FROM b ASOF LEFT JOIN k hi ON b.user_id = hi.user_id AND b.sec <= hi.sec)
        SELECT user_id, sec, round(CASE WHEN x0 IS NULL THEN y1 WHEN x1 IS NULL OR x0 = sec THEN y0 ELSE y0 + (y1 - y0) * (sec - x0) / (x1 - x0) END, 6) AS value FROM c""",
    "q_leaderboard": "SELECT user_id, loss, rank() OVER (ORDER BY loss) AS rank FROM (SELECT user_id, round(avg(value), 6) AS loss FROM events GROUP BY user_id ORDER BY 2, 1 LIMIT 20)",
    "q_metric_diff": """WITH a AS (SELECT user_id, round(avg(value), 6) AS a FROM events WHERE event_type = 'view' GROUP BY 1), b AS (SELECT user_id, round(avg(value), 6) AS b FROM events WHERE event_type = 'click' GROUP BY 1)
        SELECT user_id, a, b, round(b - a, 6) AS delta, CASE WHEN b IS NULL THEN 'only_a' WHEN a IS NULL THEN 'only_b' WHEN b - a < -1e-9 THEN 'improved' WHEN b - a > 1e-9 THEN 'regressed' ELSE 'unchanged' END AS state FROM a FULL JOIN b USING (user_id)""",
    "q_pass_at_k": """WITH c AS (SELECT doc_id % 50 AS p, count(*) AS n, count(*) FILTER (quality = 1) AS c FROM labels GROUP BY 1),
        e AS (SELECT k, CASE WHEN n < k THEN NULL WHEN n - c < k THEN 1.0 ELSE 1 - list_product(list_transform(range(0, k), lambda i: (n - c - i) / (n - i))) END AS v FROM c, (SELECT unnest([1, 3, 5]) AS k))
        SELECT k, count(v) AS problems, round(coalesce(avg(v), 0), 6) AS pass_at_k FROM e GROUP BY k""",
    "q_group_advantage": f"SELECT event_id, round(coalesce((value - avg(value) OVER {_P}) / (stddev_samp(value) OVER {_P} + 1e-8), 0), 6) AS advantage FROM events",
    "q_ece": f"{_JUDGED} SELECT round(sum(n * abs(c - a)) / sum(n), 6) AS ece, round(max(abs(c - a)), 6) AS largest_gap, round(sum(over) / sum(n), 6) AS over, round(sum(under) / sum(n), 6) AS under FROM b",
    "q_reliability": f"{_JUDGED} SELECT bin, n, round(c, 6) AS confidence, round(a, 6) AS accuracy, round(abs(c - a), 6) AS gap FROM b",
    "q_confusion": f"{_ROUTED} SELECT actual, predicted, count(*) AS n FROM r GROUP BY ALL",
    "q_per_class": f"{_CLASSES} SELECT * FROM k",
    "q_macro_f1": f"{_CLASSES} SELECT round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1, sum(support)::BIGINT AS n FROM k",
    "q_agreement": "WITH j AS (SELECT least(length(text) / 3000.0::DOUBLE, 1.0) * 4 + 1 AS s, quality * 4.0::DOUBLE + 1 AS l FROM documents JOIN labels USING (doc_id)) SELECT round(avg(abs(s - l)), 6) AS mae, round(sqrt(avg((s - l) * (s - l))), 6) AS rmse, round(corr(s, l), 6) AS pearson FROM j",
    "q_perplexity_rollup": f"SELECT *, {_LEVEL} AS level FROM (SELECT event_type, round(arg_max(exp(value / 100), (ts, event_id)), 4) AS current, round(min(exp(value / 100)), 4) AS least, round(max(exp(value / 100)), 4) AS most, round(avg(exp(value / 100)), 4) AS mean, count(*) AS n FROM events GROUP BY ROLLUP (event_type))",
    "q_cosine_knn": f"""WITH e AS (SELECT vec_id, {_V} AS v, {_NORM} AS n FROM embeddings), s AS (SELECT q.vec_id AS query, e.vec_id AS id, round(list_sum(list_transform(range(1, 65), lambda i: q.v[i] * e.v[i])) / (q.n * e.n), 9) AS s FROM e q, e WHERE q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, id) AS rank FROM s) SELECT query, id, round(s, 5) AS similarity, rank FROM r WHERE rank <= 10""",
    "q_silhouette": """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), d AS (SELECT a.vec_id, a.label, b.label AS other, sum(list_distance(a.v, b.v) ** 2) AS s, count(*) AS n FROM v a, v b GROUP BY ALL),
        m AS (SELECT vec_id, max(s / greatest(n - 1, 1)) FILTER (other = label) AS a, max(n) FILTER (other = label) AS n, min(s / n) FILTER (other <> label) AS b FROM d GROUP BY vec_id)
        SELECT vec_id, round(CASE WHEN n = 1 THEN 0 WHEN b IS NOT NULL THEN (b - a) / greatest(a, b) END, 6) AS silhouette FROM m""",
    "q_cluster_quality": """WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(0, 64))::INT AS d FROM embeddings), m AS (SELECT label, d, avg(x) AS x FROM e GROUP BY label, d), c AS (SELECT label, list(x ORDER BY d) AS c FROM m GROUP BY label),
        i AS (SELECT label, count(*) AS n, var_pop(list_distance(embedding::DOUBLE[], c)) AS v FROM embeddings JOIN c USING (label) GROUP BY label), b AS (SELECT avg(list_distance(x.c, y.c)) AS b FROM c x JOIN c y ON x.label < y.label),
        q AS (SELECT count(*) AS k, sum(n)::BIGINT AS n, avg(v) FILTER (n >= 2) AS i FROM i)
        SELECT k AS n_clusters, n, round(i, 6) AS inside, round(b, 6) AS between, round((b - i) / greatest(b, i), 6) AS estimate FROM q, b""",
    "q_embedding_stats": f"SELECT count(*) AS n, round(avg(x), 6) AS mean_norm, round(stddev_pop(x), 6) AS std_norm, round(min(x), 6) AS least_norm, round(max(x), 6) AS most_norm FROM (SELECT {_NORM} AS x FROM embeddings)",
    "q_dead_dims": "SELECT dim, round(avg(x), 6) AS mean, round(var_pop(x), 6) AS variance, var_pop(x) < 1e-8 AS dead FROM (SELECT unnest(embedding)::DOUBLE AS x, unnest(range(0, 64))::INT AS dim FROM embeddings) GROUP BY dim",
    "q_mean_pair_cosine": f"""WITH u AS (SELECT unnest(list_transform({_V}, lambda x: x / n)) AS x, unnest(range(0, 64)) AS d FROM (SELECT embedding, {_NORM} AS n FROM embeddings) WHERE n > 0), s AS (SELECT sum(x) AS s, count(*) AS n FROM u GROUP BY d)
        SELECT max(n) AS n, round((sum(s * s) - max(n)) / (max(n) * (max(n) - 1.0::DOUBLE)), 6) AS mean_cosine FROM s""",
    "q_topk_sampling": "WITH s AS (SELECT vec_id, unnest(embedding) AS x, unnest(range(0, 64))::INT AS token FROM embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, token) AS r FROM s) SELECT vec_id, token, round(exp(x::DOUBLE) / sum(exp(x::DOUBLE)) OVER (PARTITION BY vec_id), 6) AS probability FROM r WHERE r <= 5",
    "q_topp": """WITH s AS (SELECT vec_id, unnest(embedding) AS x, unnest(range(0, 64))::INT AS token FROM embeddings), q AS (SELECT *, exp(x::DOUBLE) / sum(exp(x::DOUBLE)) OVER (PARTITION BY vec_id) AS q FROM s),
        b AS (SELECT *, round(coalesce(sum(q) OVER (PARTITION BY vec_id ORDER BY x DESC, token ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 12) AS b FROM q) SELECT vec_id, token, round(q / sum(q) OVER (PARTITION BY vec_id), 6) AS probability FROM b WHERE b < 0.5""",
    "q_tfidf_search": f"""
        WITH d AS (SELECT doc_id, {_TERMS} AS t FROM documents), p AS (SELECT doc_id, term, count(*) / any_value(n) AS tf FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM d) GROUP BY doc_id, term),
        i AS (SELECT term, ln((1.0::DOUBLE + (SELECT count(*) FROM documents)) / (1.0 + count(*))) + 1 AS idf FROM p GROUP BY term), a AS (SELECT item_id, unnest(list_distinct({_TERMS})) AS term FROM benchmark),
        s AS (SELECT item_id, doc_id, round(sum(tf * idf), 9) AS score FROM a JOIN i USING (term) JOIN p USING (term) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s)
        SELECT item_id, doc_id, round(score, 6) AS score, rank FROM r WHERE rank <= 5""",
    "q_domain_scores": _domain_sql(),
    # without the rule that needs a syntax tree: no page of the tables is Python
    "q_safety_findings": f"WITH l AS (SELECT page_id, unnest({_lines('html')}) AS x, unnest(range(1, len({_lines('html')}) + 1))::INT AS line FROM pages) " + " UNION ALL ".join(f"SELECT page_id, line, '{n}' AS rule, '{s}' AS severity FROM l WHERE regexp_matches(x, {_q(p)})" for n, (p, s) in search.RULES.items()),
    "q_safety_gate": "SELECT page_id, (['safe', 'low', 'medium', 'high', 'critical'])[w + 1] AS worst, w < 2 AS passed FROM (SELECT page_id, greatest(0, " + ", ".join(f"CASE WHEN len(list_filter({_lines('html')}, lambda x: regexp_matches(x, {_q(p)}))) > 0 THEN {search.SEVERITIES.index(s)} ELSE 0 END" for p, s in search.RULES.values()) + ") AS w FROM pages)",
}
