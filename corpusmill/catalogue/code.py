"""Queries on complexity, similarity, vocabularies, training series, and on what is read and written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.catalogue.analysis import _CODE_TOKENS, _LSTRIP, _P, _TOKENS, _W, _WORDS, SERIES, _events, _lines, _q, _rounded, _w
from corpusmill.catalogue.quality import STRIP
from corpusmill.operators import chunk, complexity, dedup, evaluation, filters, folds, metrics, mix, stats, transform
from corpusmill.plans import registry
from corpusmill.session import table, work_dir
from corpusmill.sources import readers, sinks


def _docs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _complexity(source: str, id_col: str, text_col: str, language: str):
    def query(spark, sf_dir) -> DataFrame:
        out = complexity.with_complexity(table(spark, sf_dir, source), text_col, language)
        more = ["avg_function", "max_function"] if language == "python" else []
        return _rounded(out.select(id_col, "cyclomatic", "cognitive", "nesting", "lines", "functions", "classes", "imports", "comment_ratio", "avg_line", *more, "bucket"), "comment_ratio", "avg_line", *more[:1])

    return query


def q_nearest_items(spark, sf_dir) -> DataFrame:
    """Each user turn against all benchmark items."""
    turns = table(spark, sf_dir, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    return _rounded(dedup.nearest_items(turns, table(spark, sf_dir, "benchmark")), "mean")


def q_edit_similarity(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    a = rows.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("a"))
    b = rows.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("b"))
    plain = lambda c: F.regexp_replace(c, r"[^\x00-\x7f]", "?")  # noqa: E731  the SQL's edit distance counts bytes
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", F.round(dedup.edit_similarity(plain("a"), plain("b")), 6).alias("similarity"))


def q_vocab_efficiency(spark, sf_dir) -> DataFrame:
    known = stats.frequencies(table(spark, sf_dir, "benchmark"), "item_id")
    return _rounded(stats.vocabulary_efficiency(_docs(spark, sf_dir), known), "fragmentation", "single_token", "oov", "coverage")


def q_self_bleu(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark").withColumn("g", F.col("item_id") % 4)
    return _rounded(stats.self_bleu(rows, "g", "item_id"), "bleu")


def q_noise(spark, sf_dir) -> DataFrame:
    return _rounded(metrics.noise(_events(spark, sf_dir), SERIES), "noise_scale", "snr", "batch_factor").select("event_id", "noise_scale", "snr", "batch_factor")


def q_stability(spark, sf_dir) -> DataFrame:
    out = metrics.stability(_events(spark, sf_dir), SERIES, F.col("event_id") % 7)
    # means of values with two decimals often lie half way between two roundings: these are decimal ones, at the ninth digit first
    return out.withColumns({c: F.round(F.col(c).cast("decimal(28,9)"), 6).cast("double") for c in ("variance", "oscillation", "sensitivity")})


def q_grid(spark, sf_dir) -> DataFrame:
    rows = _events(spark, sf_dir).groupBy("event_type", (F.col("event_id") % 5).alias("run"), (F.col("event_id") % 97).alias("step")).agg(F.max("value").alias("value"))
    return _rounded(metrics.on_grid(rows, ["event_type", "run"], "step", "value", [-5, 0, 10, 33, 50, 96, 200]), "value")


def q_stagnation(spark, sf_dir) -> DataFrame:
    return metrics.stagnation(_events(spark, sf_dir), SERIES, 5)


def q_stagnation_windows(spark, sf_dir) -> DataFrame:
    return folds.stagnations(_events(spark, sf_dir), SERIES, 5, 0.5)


def q_early_stop(spark, sf_dir) -> DataFrame:
    return folds.stopped(_events(spark, sf_dir), SERIES, 20, 0.5)


def q_curriculum(spark, sf_dir) -> DataFrame:
    docs = metrics.curriculum(_docs(spark, sf_dir), F.least(F.length("text") / 5000.0, F.lit(1.0)), 300, 1000)
    return docs.select("doc_id", "band", "eligible")


def q_truncate_tokens(spark, sf_dir) -> DataFrame:
    cut = chunk.truncate(transform.byte_tokens(_docs(spark, sf_dir)), 100)
    return cut.select("doc_id", F.size("tokens").alias("n"), F.try_element_at("tokens", F.lit(-1)).alias("last"))


def q_definition_chunks(spark, sf_dir) -> DataFrame:
    out = chunk.definition_chunks(table(spark, sf_dir, "pages"), "page_id", "html")
    return out.select("page_id", "chunk", "start_line", "end_line", "kind", "name", F.md5("content").alias("content_md5"))


def q_cap_per_group(spark, sf_dir) -> DataFrame:
    return mix.cap_per_group(_docs(spark, sf_dir), "source", 20, [F.col("doc_id")]).select("source", "doc_id")


def q_labelled_set(spark, sf_dir) -> DataFrame:
    docs = _docs(spark, sf_dir).withColumn("confidence", F.least(F.length("text") / 2000.0, F.lit(1.0)))
    return mix.labelled_set(docs, "lang", "confidence", "text", "doc_id", 25).select("lang", "doc_id", F.md5("text").alias("text_md5"))


def q_sample_per_language(spark, sf_dir) -> DataFrame:
    return readers.sample_per_language(_docs(spark, sf_dir), 60).select("lang", "doc_id")


def q_length_filter(spark, sf_dir) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", filters.length_reason(F.col("text"), 5, 40).alias("reason"))


def q_strip_comments(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(transform.strip_comments(F.col("html")), 256).alias("sha"))


def q_thinking(spark, sf_dir) -> DataFrame:
    """The first half of each answer as a thought, taken out again."""
    rows = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    half = F.floor(F.length("text") / 2).cast("int")
    marked = F.concat(F.lit("<think>"), F.substr("text", F.lit(1), half), F.lit("</think>"), F.substr("text", half + 1))
    return rows.select("conv_id", "turn", F.md5(transform.thinking(marked)).alias("thought"), F.md5(transform.without_thinking(marked)).alias("rest"))


def q_reward_mix(spark, sf_dir) -> DataFrame:
    score = lambda k: (F.pmod("doc_id", F.lit(k)) / F.lit(k)).cast("double")
    return _docs(spark, sf_dir).select("doc_id", F.round(registry.get("reward", "mix")({"type": score(3), "syntax": score(5), "style": score(7), "completeness": score(11)}), 6).alias("reward"))


def q_mix_candidates(spark, sf_dir) -> DataFrame:
    out = mix.candidates(spark, ["python", "rust", "typescript"], 8).withColumn("many", F.lit(True))
    return _rounded(out.union(mix.candidates(spark, ["a", "b"], 4).withColumn("many", F.lit(False))), "weight")


def q_repository_tier(spark, sf_dir) -> DataFrame:
    """Sources as repositories, their labels as test results."""
    rows = _docs(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id").groupBy("source").agg(F.count_if(F.col("quality") == 1).alias("passed"), F.count_if(F.col("quality") == 0).alias("failed"), F.count_if(F.col("toxic") == 1).alias("skipped"))
    tier = evaluation.repository_tier(F.col("passed"), F.col("failed"), F.col("skipped"), F.lit(True))
    return rows.select("source", F.round(tier["pass_rate"], 6).alias("pass_rate"), tier["tier"].alias("tier"), tier["weight"].alias("weight"))


def q_registry_run(spark, sf_dir) -> DataFrame:
    steps = [{"filter": "length", "min_lines": 2, "max_lines": 100}, {"filter": "exact_dedup"}, {"filter": "pii", "enabled": False}, {"transform": "whitespace"}]
    return registry.run(spark, {"source": {"name": "parquet", "path": f"{sf_dir}/documents.parquet"}, "steps": steps}).select("doc_id")


def q_split_sink(spark, sf_dir) -> DataFrame:
    path = work_dir(spark)
    sinks.write_split(mix.split(_docs(spark, sf_dir).select("doc_id"), "doc_id", 0.2), path)
    return spark.read.parquet(path).groupBy("split").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


def q_manifest_sink(spark, sf_dir) -> DataFrame:
    path = work_dir(spark)
    sinks.write_with_manifest(_docs(spark, sf_dir).select("doc_id", "lang"), path, {"from": "documents"}, b"tokenizer")
    found = sinks.read_manifest(spark, path)
    return spark.createDataFrame([(found["rows"], ",".join(c for c, _ in found["columns"]), found["lineage"]["from"], found["tokenizer_sha256"])], "n long, columns string, origin string, tokenizer string")


def q_result_store(spark, sf_dir) -> DataFrame:
    store, labels = work_dir(spark), table(spark, sf_dir, "labels")
    for name, quality in (("good", 1), ("bad", 0), ("gone", 0)):
        sinks.save_result(labels.where(F.col("quality") == quality).select("doc_id"), store, name)
    sinks.delete_result(spark, store, "gone")
    return sinks.load_results(spark, store).groupBy("name").agg(F.count("*").alias("n"))


def q_report_sinks(spark, sf_dir) -> DataFrame:
    """The same report through CSV, JSON and Markdown, read back as lines."""
    report = _docs(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n"))
    path = work_dir(spark)
    for kind in ("csv", "json", "markdown"):
        sinks.write_report(report, f"{path}/{kind}", kind, ["lang"])
    lines = [spark.read.text(f"{path}/{kind}").select(F.lit(kind).alias("kind"), F.col("value").alias("line")) for kind in ("csv", "json", "markdown")]
    return lines[0].union(lines[1]).union(lines[2])


def q_jsonl_reader(spark, sf_dir) -> DataFrame:
    path = work_dir(spark)
    docs = _docs(spark, sf_dir)
    line = F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("not json "), F.col("doc_id").cast("string"))).when(F.col("doc_id") % 2 == 0, F.to_json(F.struct(F.col("text").alias("content")))).otherwise(F.to_json(F.struct("text", F.lit("other").alias("code"))))
    docs.select(line.alias("value")).write.text(path)
    return readers.jsonl(spark, path).select(F.md5("text").alias("text_md5"), "malformed")


def q_text_reader(spark, sf_dir) -> DataFrame:
    """Pages as files of their own: short ones with a long line are one sample."""
    path = work_dir(spark)
    pages = table(spark, sf_dir, "pages").where("page_id < 40")
    pages.select(F.col("page_id").cast("string").alias("page"), F.col("html").alias("value")).repartition(8, "page").write.partitionBy("page").option("lineSep", "\n").text(path)
    return readers.text_samples(spark, f"{path}/*/*.txt").select(F.md5("text").alias("text_md5"))


def q_corpus_reader(spark, sf_dir) -> DataFrame:
    path = work_dir(spark)
    _docs(spark, sf_dir).select(F.col("text").alias("content"), "lang").write.partitionBy("lang").parquet(path)
    return readers.corpus(spark, path, ["de", "fr"], min_chars=100).select(F.md5("content").alias("text_md5"), "lang")


def q_training_log(spark, sf_dir) -> DataFrame:
    ev = _events(spark, sf_dir).where("event_id < 3000")
    text = F.concat(F.lit("step="), F.col("event_id").cast("string"), F.lit(" loss: "), F.round("value", 2).cast("string"), F.lit(" tok/s=12.5"))
    js = F.to_json(F.struct(F.col("event_id").alias("step"), F.round("value", 2).alias("loss"), F.lit(0.5).alias("lr")))
    out = readers.training_log(ev.select(F.when(F.col("event_id") % 3 == 0, js).otherwise(text).alias("value"), "event_id"), order="event_id")
    return out.select("step", "loss", "lr", "tokens_per_sec")


QUERIES = {k: v for k, v in globals().items() if k.startswith("q_")}
QUERIES |= {"q_complexity_python": _complexity("documents", "doc_id", "text", "python"), "q_complexity_typescript": _complexity("pages", "page_id", "html", "typescript")}


def _count(p: str) -> str:
    return f"len(regexp_extract_all(t, {_q(p)}))"


def _points(x: str, bounds: tuple[int, ...]) -> str:
    return "(1" + "".join(f" + ({x} > {b})::INT" for b in bounds) + ")"


def _complexity_sql(source: str, id_col: str, text_col: str, language: str) -> str:
    strip, width = STRIP.format("x"), f"(length(x) - length({_LSTRIP}))"
    comments = " OR ".join(f"starts_with({strip}, '{c}')" for c in complexity.COMMENTS[language])
    tail = f"len(regexp_extract_all({{0}}, {_q(complexity.LOGIC[language])}))"
    if language == "python":
        deep = f"coalesce(list_max(list_transform(list_filter(l, lambda x: {_LSTRIP} <> '' AND NOT starts_with({_LSTRIP}, '#')), lambda x: {width} // 4)), 0)"
        think = f"coalesce(list_sum(list_transform(l, lambda x: CASE WHEN regexp_matches(x, {_q(complexity.BRANCHES[language])}) THEN {width} // 4 + 1 ELSE 0 END + {tail.format(_LSTRIP)})), 0)"
        extra = f""", f AS (SELECT id, l, list_filter(range(1, len(l) + 1), lambda i: regexp_matches(l[i], '^\\s*(?:async\\s+)?def\\s+\\w+')) AS s FROM p),
            g AS (SELECT id, i - s[k] + 1 AS n FROM (SELECT id, s, k, list_max(list_filter(range(s[k], CASE WHEN k < len(s) THEN s[k + 1] ELSE len(l) + 1 END), lambda i: regexp_matches(l[i], '\\S'))) AS i FROM f, unnest(range(1, len(s) + 1)) AS u(k))),
            h AS (SELECT id, avg(n) AS a, max(n) AS m FROM g GROUP BY id)"""
        columns, join = ", round(coalesce(a, 0), 6) AS avg_function, coalesce(m, 0) AS max_function", "LEFT JOIN h USING (id)"
        nest = f"{deep} AS nesting, {think} AS cognitive"
    else:
        # depth after each brace is the running sum less its lowest value so far (at most 0)
        extra = f""", b AS (SELECT id, unnest(range(1, length(s) + 1)) AS i, unnest(list_transform(range(1, length(s) + 1), lambda i: CASE substr(s, i, 1) WHEN '{{' THEN 1 ELSE -1 END)) AS d
                FROM (SELECT id, regexp_replace(regexp_replace(t, '(?s)"[^"]*("|\\z)|''[^'']*(''|\\z)|`[^`]*(`|\\z)', '', 'g'), '[^{{}}]+', '', 'g') AS s FROM p)),
            r AS (SELECT id, i, sum(d) OVER (PARTITION BY id ORDER BY i) AS r FROM b), n AS (SELECT id, max(x) AS deepest FROM (SELECT id, r - least(0, min(r) OVER (PARTITION BY id ORDER BY i)) AS x FROM r) GROUP BY id),
            li AS (SELECT id, i, l[i] AS x FROM p, unnest(range(1, len(l) + 1)) AS u(i)),
            lb AS (SELECT id, i, x, sum(length(regexp_replace(x, '[^{{]+', '', 'g')) - length(regexp_replace(x, '[^}}]+', '', 'g'))) OVER (PARTITION BY id ORDER BY i) AS r FROM li),
            ld AS (SELECT id, i, x, r - least(0, min(r) OVER (PARTITION BY id ORDER BY i)) AS depth FROM lb),
            c AS (SELECT id, sum(len(regexp_extract_all(x, {_q(complexity.BRANCHES[language])})) * (1 + before) + {tail.format('x')}) AS think FROM (SELECT *, coalesce(lag(depth) OVER (PARTITION BY id ORDER BY i), 0) AS before FROM ld) GROUP BY id)"""
        columns, join, nest = "", "LEFT JOIN n USING (id) LEFT JOIN c USING (id)", "coalesce(deepest, 0) AS nesting, coalesce(think, 0) AS cognitive"
    return f"""
        WITH p AS (SELECT {id_col} AS id, coalesce({text_col}, '') AS t, {_lines(text_col)} AS l FROM {source}){extra},
        q AS (SELECT *, CASE WHEN len(l) = 0 THEN 1 ELSE 1 + {' + '.join(map(_count, complexity.DECISIONS[language]))} END AS cyclomatic, {nest}, len(l) AS lines, {_count(complexity.FUNCTIONS[language])} AS functions, {_count(complexity.CLASSES)} AS classes, {_count(complexity.IMPORTS[language])} AS imports,
              CASE WHEN len(l) = 0 THEN 0 ELSE len(list_filter(l, lambda x: {comments})) / len(l) END AS ratio, coalesce(list_avg(list_transform(list_filter(l, lambda x: {strip} <> ''), lambda x: length(x))), 0) AS avg_line FROM p {join}),
        s AS (SELECT *, {_points('cyclomatic', complexity.POINTS['cyclomatic'])} + {_points('nesting', complexity.POINTS['nesting'])} + {_points('lines', complexity.POINTS['lines'])} + {_points('(functions + classes)', complexity.POINTS['definitions'])} AS score FROM q)
        SELECT id AS {id_col}, cyclomatic, cognitive::BIGINT AS cognitive, nesting::BIGINT AS nesting, lines, functions, classes, imports, round(ratio::DOUBLE, 6) AS comment_ratio, round(avg_line, 6) AS avg_line{columns}, {_points('score', complexity.BUCKETS)} AS bucket FROM s"""


_PAIR = "FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'"
_JACCARD = "CASE WHEN len({0}1) = 0 AND len({0}2) = 0 THEN 1 WHEN len({0}1) = 0 OR len({0}2) = 0 THEN 0 ELSE len(list_intersect({0}1, {0}2)) / (len({0}1) + len({0}2) - len(list_intersect({0}1, {0}2))) END"
_SETS = f"CASE WHEN length(coalesce(text, '')) < 3 THEN [] ELSE list_distinct(list_transform(range(1, length(text) - 1), lambda i: substr(text, i, 3))) END AS c, list_distinct(list_transform(range(1, len({_CODE_TOKENS}) - 1), lambda i: array_to_string(({_CODE_TOKENS})[i:i + 2], ' '))) AS t"
_FOLD = f"""WITH RECURSIVE n AS (SELECT *, row_number() OVER {_w()} - 1 AS k FROM events), f AS (
            SELECT user_id, event_type, k, CASE WHEN isfinite(value) THEN value END AS best, CASE WHEN isfinite(value) THEN 0 END AS since FROM n WHERE k = 0
            UNION ALL SELECT n.user_id, n.event_type, n.k, CASE WHEN g.up THEN n.value ELSE g.best END, CASE WHEN g.up THEN 0 ELSE g.since + 1 END
            FROM (SELECT f.*, m.value AS v, coalesce(isfinite(m.value) AND (f.best IS NULL OR m.value < f.best - 0.5), false) AS up FROM f JOIN n m ON m.user_id = f.user_id AND m.event_type = f.event_type AND m.k = f.k + 1) g
            JOIN n ON n.user_id = g.user_id AND n.event_type = g.event_type AND n.k = g.k + 1)"""

ORACLES = {
    "q_complexity_python": _complexity_sql("documents", "doc_id", "text", "python"),
    "q_complexity_typescript": _complexity_sql("pages", "page_id", "html", "typescript"),
    "q_nearest_items": f"""
        WITH a AS (SELECT conv_id * 1000 + turn AS doc_id, {_SETS} FROM conversations WHERE role = 'user'), b AS (SELECT item_id, {_SETS} FROM benchmark),
        p AS (SELECT doc_id, item_id, a.c AS c1, b.c AS c2, a.t AS t1, b.t AS t2 FROM a, b), s AS (SELECT doc_id, item_id, round((0.5 * {_JACCARD.format('c')} + 0.5 * {_JACCARD.format('t')})::DOUBLE, 9) AS s FROM p)
        SELECT doc_id, max(s) AS most, round(avg(s), 6) AS mean, arg_min(item_id, (-s, item_id)) AS nearest FROM s GROUP BY doc_id""",
    "q_edit_similarity": f"SELECT conv_id, turn, round(1 - levenshtein(x, y) / greatest(length(x), length(y))::DOUBLE, 6) AS similarity FROM (SELECT u.conv_id, u.turn, regexp_replace(u.text, '[^\\x00-\\x7f]', '?', 'g') AS x, regexp_replace(a.text, '[^\\x00-\\x7f]', '?', 'g') AS y {_PAIR})",
    "q_vocab_efficiency": f"""
        WITH f AS (SELECT token, count(*) AS n FROM (SELECT unnest({_TOKENS}) AS token FROM documents) GROUP BY token), v AS (SELECT DISTINCT unnest({_TOKENS}) AS token FROM benchmark), w AS (SELECT DISTINCT unnest({_WORDS}) AS text FROM documents)
        SELECT (SELECT count(*) FROM v) AS vocab_size, round((SELECT sum(n) FROM f WHERE token NOT IN (SELECT token FROM v)) / sum(n), 6) AS oov, count(*) FILTER (n < 0.0001 * (SELECT sum(n) FROM f)) AS n_rare,
            (SELECT round(sum(len({_TOKENS})) / sum(len({_WORDS})), 6) FROM documents WHERE len({_WORDS}) > 0) AS fragmentation, (SELECT round(count(*) FILTER (len({_TOKENS}) = 1) / count(*), 6) FROM w) AS single_token, sum(n)::BIGINT AS tokens_seen,
            (SELECT count(*) FROM v WHERE token NOT IN (SELECT token FROM f)) AS n_unused, round((SELECT count(*) FROM v WHERE token IN (SELECT token FROM f)) / (SELECT count(*) FROM v), 6) AS coverage FROM f""",
    "q_self_bleu": "WITH " + ", ".join(f"""
        g{n} AS (SELECT item_id, item_id % 4 AS k, unnest(list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' '))) AS g FROM (SELECT item_id, {_WORDS} AS w FROM benchmark)), c{n} AS (SELECT item_id, k, g, count(*) AS c FROM g{n} GROUP BY ALL),
        o{n} AS (SELECT a.item_id, a.g, any_value(a.c) AS c, max(b.c) AS m FROM c{n} a LEFT JOIN c{n} b ON a.k = b.k AND a.g = b.g AND a.item_id <> b.item_id GROUP BY a.item_id, a.g), p{n} AS (SELECT item_id, sum(least(c, coalesce(m, 0))) / sum(c) AS p FROM o{n} GROUP BY item_id)""" for n in (1, 2)) + """
        SELECT item_id, round(CASE WHEN p1.p IS NULL THEN 0 WHEN p2.p IS NULL THEN p1.p ELSE sqrt(p1.p * p2.p) END, 6) AS bleu FROM benchmark LEFT JOIN p1 USING (item_id) LEFT JOIN p2 USING (item_id)""",
    "q_noise": f"""WITH w AS (SELECT event_id, avg(value) OVER x AS m, coalesce(var_samp(value) OVER x, 0) AS v, count(*) OVER x AS n FROM events WHERE isfinite(value) WINDOW x AS {_w('49 PRECEDING AND CURRENT ROW')}),
        s AS (SELECT event_id, CASE WHEN m < 1e-12 THEN 'inf'::DOUBLE ELSE sqrt(v) / (m + 1e-12) END AS noise, CASE WHEN m < 1e-12 THEN 0 ELSE m * m / (v + 1e-12) END AS snr FROM w WHERE n >= 10)
        SELECT event_id, round(noise, 6) AS noise_scale, round(snr, 6) AS snr, round(greatest(0.1, least(10, CASE WHEN snr > 1e-9 THEN sqrt(1 / snr) ELSE 4 END)), 6) AS batch_factor FROM s""",
    "q_stability": f"""WITH b AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS b FROM events), l AS (SELECT user_id, event_type, value, abs(value - lag(value) OVER {_w()}) AS dv, abs(event_id % 7 - lag(event_id % 7) OVER {_w()}) AS dx FROM b WHERE b <= 20)
        SELECT user_id, event_type, round(var_samp(value)::DECIMAL(28, 9), 6)::DOUBLE AS variance, round(avg(dv)::DECIMAL(28, 9), 6)::DOUBLE AS oscillation, round((avg(dv / dx) FILTER (dx > 1e-15))::DECIMAL(28, 9), 6)::DOUBLE AS sensitivity FROM l GROUP BY user_id, event_type""",
    "q_grid": """
        WITH k AS (SELECT event_type, event_id % 5 AS run, event_id % 97 AS step, max(value) AS value FROM events GROUP BY ALL), a AS (SELECT event_type, run, unnest([-5, 0, 10, 33, 50, 96, 200]) AS step FROM (SELECT DISTINCT event_type, run FROM k)),
        b AS (SELECT a.*, lo.step AS x0, lo.value AS y0 FROM a ASOF LEFT JOIN k lo ON a.event_type = lo.event_type AND a.run = lo.run AND a.step >= lo.step), c AS (SELECT b.*, hi.step AS x1, hi.value AS y1 FROM b ASOF LEFT JOIN k hi ON b.event_type = hi.event_type AND b.run = hi.run AND b.step <= hi.step)
        SELECT event_type, run, step, round(CASE WHEN x0 IS NULL THEN y1 WHEN x1 IS NULL OR x0 = step THEN y0 ELSE y0 + (y1 - y0) * (step - x0) / (x1 - x0) END, 6) AS value FROM c""",
    "q_stagnation": f"""WITH m AS (SELECT *, row_number() OVER {_w()} - 1 AS k, min(value) OVER {_w('UNBOUNDED PRECEDING AND 1 PRECEDING')} AS best FROM events), i AS (SELECT *, max(CASE WHEN best IS NULL OR value < best THEN k END) OVER {_w('UNBOUNDED PRECEDING AND CURRENT ROW')} AS i FROM m)
        SELECT user_id, event_type, min(k) AS fired_at FROM i WHERE k - i >= 5 GROUP BY user_id, event_type""",
    "q_stagnation_windows": f"{_FOLD} SELECT user_id, event_type, k AS fired_at, best FROM f WHERE since = 5",
    "q_early_stop": f"{_FOLD} SELECT user_id, event_type, min(k) FILTER (since >= 20) AS stopped_at FROM f GROUP BY user_id, event_type",
    "q_curriculum": "SELECT doc_id, least(floor(d * 5), 4)::INT AS band, d <= 0.05 + 0.95 * 0.3 AS eligible FROM (SELECT doc_id, least(length(text) / 5000.0::DOUBLE, 1.0) AS d FROM documents)",
    "q_truncate_tokens": "SELECT doc_id, least(strlen(text), 100) AS n, CASE WHEN text <> '' THEN ('0x' || substr(hex(encode(text)), 2 * least(strlen(text), 100) - 1, 2))::INT END AS last FROM documents",
    "q_cap_per_group": "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents) WHERE k <= 20",
    "q_labelled_set": "SELECT lang, doc_id, md5(substr(text, 1, 2000)) AS text_md5 FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k FROM documents WHERE length(text) >= 50 AND least(length(text) / 2000.0::DOUBLE, 1.0) >= 0.3) WHERE k <= 25",
    "q_sample_per_language": "SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k FROM documents) WHERE k <= 60 // (SELECT count(DISTINCT lang) FROM documents)",
    "q_length_filter": "SELECT doc_id, CASE WHEN n < 5 THEN 'too_short' WHEN n > 40 THEN 'too_long' END AS reason FROM (SELECT doc_id, len(string_split(coalesce(text, ''), chr(10))) AS n FROM documents)",
    "q_strip_comments": r"SELECT page_id, sha256(regexp_replace(regexp_replace(coalesce(html, ''), '(?s)/\*.*?\*/', '', 'g'), '(?m)^[ \t]*(#|//).*\n?', '', 'g')) AS sha FROM pages",
    "q_thinking": "SELECT conv_id, turn, md5(substr(text, 1, length(text) // 2)) AS thought, md5(trim(substr(text, length(text) // 2 + 1))) AS rest FROM conversations WHERE role = 'assistant'",
    "q_reward_mix": "SELECT doc_id, round((0.4 * (doc_id % 3) / 3 + 0.2 * (doc_id % 5) / 5 + 0.1 * (doc_id % 7) / 7 + 0.3 * (doc_id % 11) / 11)::DOUBLE, 6) AS reward FROM documents",
    "q_mix_candidates": """
        WITH u AS (SELECT i AS candidate, s AS source, -ln((('0x' || substr(md5(i || ':' || s || ':42'), 1, 8))::UBIGINT + 0.5) / 4294967296.0::DOUBLE) AS e FROM range(8) AS r(i), (SELECT unnest(['python', 'rust', 'typescript']) AS s))
        SELECT candidate, source, round(e / sum(e) OVER (PARTITION BY candidate), 6) AS weight, true AS many FROM u
        UNION ALL SELECT i, s, round(CASE s WHEN 'a' THEN (i + 1) / 5 ELSE 1 - (i + 1) / 5 END::DOUBLE, 6), false FROM range(4) AS r(i), (SELECT unnest(['a', 'b']) AS s)""",
    "q_repository_tier": "SELECT source, round(p / (p + f), 6) AS pass_rate, CASE WHEN p / (p + f) >= 0.9 THEN 'verified' ELSE 'tested' END AS tier, CASE WHEN p / (p + f) >= 0.9 THEN 3.0 ELSE 2.0 END::DOUBLE AS weight FROM (SELECT source, count(*) FILTER (quality = 1) AS p, count(*) FILTER (quality = 0) AS f FROM documents JOIN labels USING (doc_id) GROUP BY source)",
    "q_registry_run": "SELECT min(doc_id) AS doc_id FROM documents WHERE len(string_split(coalesce(text, ''), chr(10))) BETWEEN 2 AND 100 GROUP BY text",
    "q_split_sink": "SELECT split, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM (SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY ('0x' || substr(md5(doc_id || ':42'), 1, 8))::UBIGINT, doc_id) <= (SELECT greatest(1, floor(count(*) * 0.2)) FROM documents) THEN 'val' ELSE 'train' END AS split FROM documents) GROUP BY split",
    "q_manifest_sink": "SELECT count(*) AS n, 'doc_id,lang' AS columns, 'documents' AS origin, sha256('tokenizer') AS tokenizer FROM documents",
    "q_result_store": "SELECT CASE quality WHEN 1 THEN 'good' ELSE 'bad' END AS name, count(*) AS n FROM labels GROUP BY quality",
    "q_report_sinks": """WITH r AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang)
        SELECT 'csv' AS kind, 'lang,n' AS line UNION ALL SELECT 'csv', lang || ',' || n FROM r UNION ALL SELECT 'json', '{"lang":"' || lang || '","n":' || n || '}' FROM r
        UNION ALL SELECT 'markdown', unnest(['| lang | n |', '| --- | --- |']) UNION ALL SELECT 'markdown', '| ' || lang || ' | ' || n || ' |' FROM r""",
    "q_jsonl_reader": "SELECT md5(CASE WHEN doc_id % 10 = 0 THEN 'not json ' || doc_id ELSE text END) AS text_md5, doc_id % 10 = 0 AS malformed FROM documents",
    "q_text_reader": """WITH l AS (SELECT t, list_filter(string_split(t, chr(10)), lambda x: trim(x) <> '') AS l FROM (SELECT html || chr(10) AS t FROM pages WHERE page_id < 40))
        SELECT md5(x) AS text_md5 FROM (SELECT unnest(CASE WHEN len(l) < 100 AND len(list_filter(l, lambda x: length(x) > 200)) > 0 THEN [t] ELSE l END) AS x FROM l)""",
    "q_corpus_reader": "SELECT md5(text) AS text_md5, lang FROM documents WHERE lang IN ('de', 'fr') AND length(text) >= 100",
    "q_training_log": "SELECT event_id AS step, round(value, 2) AS loss, CASE WHEN event_id % 3 = 0 THEN 0.5 END::DOUBLE AS lr, CASE WHEN event_id % 3 <> 0 THEN 12.5 END::DOUBLE AS tokens_per_sec FROM events WHERE event_id < 3000",
}
