"""Queries on quality checks, filters and scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import text_or_empty
from corpusmill.operators import filters, quality, score
from corpusmill.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _quote(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _any(x: str, needles, test: str) -> str:
    return "(" + " OR ".join(f"{test}({x}, {_quote(n)})" for n in needles) + ")"


def _sum(x: str, needles) -> str:
    return "(" + " + ".join(f"contains({x}, {_quote(n)})::INT" for n in needles) + ")"


STRIP = "regexp_replace({0}, '^[\\s\\x0b\\x1c-\\x1f\\x85\\p{{Z}}]+|[\\s\\x0b\\x1c-\\x1f\\x85\\p{{Z}}]+$', '', 'g')"
DOCS = "SELECT doc_id, lang, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents"
PARTS = f"SELECT *, list_filter(list_transform(lines, lambda x: {STRIP.format('x')}), lambda x: x <> '') AS nb FROM ({DOCS})"


def _checks_sql(limits: quality.Limits) -> dict[str, str]:
    """The reason code of each check as an expression over t, lines and nb."""
    csv = "list_transform(list_filter(lines[1:50], lambda x: regexp_matches(x, '[^\\s]')), lambda x: length(x) - length(replace(x, ',', '')))"
    names = f"list_filter(regexp_extract_all(t, '{quality.NAME_PATTERN}', 1), lambda x: lower(x) NOT IN ({', '.join(map(_quote, quality.SHORT_NAMES))}))"
    opened, closed = (f"(length(t) - length(replace(t, '{b}', '')))" for b in "{}")
    off = f"abs({opened} - {closed})"
    secrets = " OR ".join(f"regexp_matches(t, {_quote(p)})" for p in quality.SECRETS)
    when = lambda test, reason: f"CASE WHEN {test} THEN '{reason}' END"
    return {
        "length": f"CASE WHEN len(lines) < {limits.min_lines} THEN 'too_short' WHEN len(lines) > {limits.max_lines} THEN 'too_long' END",
        "avg_line_length": when(f"(length(t) - (len(lines) - 1)) / len(lines) > {limits.max_avg_line}", "minified"),
        "max_line_length": when(f"list_max(list_transform(lines, lambda x: length(x))) > {limits.max_line}", "long_line"),
        "character_diversity": when(f"length(t) >= 100 AND len(list_distinct(string_split(t, ''))) / least(length(t), 1000) < {limits.min_diversity}", "low_diversity"),
        "not_autogenerated": when(_any("lower(array_to_string(lines[1:10], chr(10)))", quality.AUTOGENERATED, "contains"), "autogenerated"),
        "not_data_file": f"""CASE WHEN least(len(lines), 50) <= 10 THEN NULL
            WHEN len(list_filter(lines[1:50], lambda x: {_any(STRIP.format('x'), ('{', '[', ']', '}'), 'starts_with')})) / least(len(lines), 50) > 0.8 THEN 'data_file_json'
            WHEN len(list_filter(lines[1:50], lambda x: regexp_matches({STRIP.format('x')}, '^[0-9a-fA-F\\s]{{40,}}$'))) / least(len(lines), 50) > 0.5 THEN 'data_file_hex'
            WHEN list_min({csv}) > 3 AND list_var_pop({csv}) < 2.0 AND list_avg({csv}) > 5 THEN 'data_file_csv' END""",
        "comment_ratio": when(f"len(nb) >= 10 AND len(list_filter(nb, lambda x: {_any('x', quality.COMMENT_STARTS, 'starts_with')})) > {limits.max_comments} * len(nb)", "mostly_comments"),
        "not_test_heavy": when(f"len(nb) >= 20 AND len(list_filter(nb, lambda x: {_any('x', quality.ASSERT_STARTS, 'starts_with')})) > {limits.max_asserts} * len(nb)", "assertion_dump"),
        "js_ts_parseable": when(f"{_sum('t', quality.JS_SIGNS)} >= 2 AND {off} > 5 AND {off} / greatest({opened}, 1) > 0.2", "js_brace_imbalance"),
        "has_functions_or_classes": when(f"len(list_filter(lines, lambda x: {_any('x', quality.DEFINITIONS, 'contains')} AND NOT {_any(STRIP.format('x'), ('#', '//', '*'), 'starts_with')})) = 0", "no_structure"),
        "naming_quality": when(f"len(regexp_extract_all(t, '{quality.NAME_PATTERN}', 1)) >= 5 AND list_avg(list_transform({names}, lambda x: length(x))) < 3.0", "short_names"),
        "code_to_blank_ratio": when("len(lines) >= 10 AND len(nb) < 0.5 * len(lines)", "too_sparse"),
        "no_obvious_copy_paste": when("len(list_filter(nb, lambda x: length(x) > 10)) >= 20 AND 1 - len(list_distinct(list_filter(nb, lambda x: length(x) > 10))) / len(list_filter(nb, lambda x: length(x) > 10)) > 0.3", "internal_duplication"),
        "has_some_documentation": when(f"len(lines) > 50 AND NOT {_any('t', quality.DOC_SIGNS, 'contains')}", "no_documentation"),
        "no_hardcoded_secrets": when(f"({secrets})", "hardcoded_secret"),
    }


def _check_query(name: str):
    def query(spark, sf_dir) -> DataFrame:
        limits = quality.STRICT if name in quality.STRICT_ONLY else quality.CONSERVATIVE
        reason = quality.CHECKS[name](text_or_empty(F.col("text")), limits)
        return table(spark, sf_dir, "documents").select("doc_id", reason.alias("reason_code")).withColumn("keep", F.col("reason_code").isNull())

    return query


for _name in quality.CHECKS:
    QUERIES[f"q_check_{_name}"] = _check_query(_name)
    _sql = _checks_sql(quality.STRICT if _name in quality.STRICT_ONLY else quality.CONSERVATIVE).get(_name)
    if _sql:
        ORACLES[f"q_check_{_name}"] = f"SELECT doc_id, r AS reason_code, r IS NULL AS keep FROM (SELECT doc_id, {_sql} AS r FROM ({PARTS}))"

#: The languages of the filter queries: prose in natural languages takes no Python parser.
LANGUAGES = ["typescript"]


def _first_sql(mode: str) -> str:
    sql = _checks_sql(quality.MODES[mode])
    return "coalesce(" + ", ".join(sql[n] for n in quality.checks_for(mode, LANGUAGES)) + ")"


def _filter_query(mode: str):
    def query(spark, sf_dir) -> DataFrame:
        return quality.with_verdict(table(spark, sf_dir, "documents"), mode, LANGUAGES).select("doc_id", "reason_code", "keep")

    return query


def _score_query(mode: str):
    def query(spark, sf_dir) -> DataFrame:
        scored = quality.score_code(table(spark, sf_dir, "documents"), mode, LANGUAGES)
        return scored.select("doc_id", F.round("score", 6).alias("score"), quality.score_bucket(F.col("score")).alias("bucket"))

    return query


def _score_sql(mode: str) -> str:
    sql = _checks_sql(quality.MODES[mode])
    one = lambda n: f"CASE WHEN ({sql[n]}) IS NULL THEN 1.0 WHEN ({sql[n]}) = 'too_long' THEN 0.3 ELSE {quality.FAIL_SCORES[n]} END"
    names = list(quality.checks_for(mode, LANGUAGES))
    return f"SELECT doc_id, ({' + '.join(f'({one(n)})::DOUBLE' for n in names)}) / {len(names)} AS s FROM ({PARTS})"


for _mode in quality.MODES:
    QUERIES[f"q_filter_{_mode}"] = _filter_query(_mode)
    ORACLES[f"q_filter_{_mode}"] = f"SELECT doc_id, r AS reason_code, r IS NULL AS keep FROM (SELECT doc_id, {_first_sql(_mode)} AS r FROM ({PARTS}))"
    QUERIES[f"q_score_{_mode}"] = _score_query(_mode)
    ORACLES[f"q_score_{_mode}"] = f"SELECT doc_id, round(s, 6) AS score, least(floor(s * 5 + 1e-9), 4)::INT AS bucket FROM ({_score_sql(_mode)})"


def q_filter_stats(spark, sf_dir) -> DataFrame:
    """Rejection reasons of the conservative filter by language, with subtotals."""
    docs = table(spark, sf_dir, "documents")
    judged = docs.select("lang", F.coalesce(quality.first_failure(F.col("text"), "conservative", LANGUAGES), F.lit("kept")).alias("reason_code"))
    return judged.rollup("lang", "reason_code").agg(F.count("*").alias("n"))


def q_score_hist(spark, sf_dir) -> DataFrame:
    scored = quality.score_code(table(spark, sf_dir, "documents"), "strict", LANGUAGES)
    return scored.groupBy("lang", quality.score_bucket(F.col("score")).alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"))


def q_filter_vs_labels(spark, sf_dir) -> DataFrame:
    """Precision, recall and F1 of the filter's rejections against the labelled bad documents."""
    judged = quality.with_verdict(table(spark, sf_dir, "documents"), "conservative", LANGUAGES).select("doc_id", "keep")
    return filters.against_labels(judged.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id"), F.col("keep"), F.col("quality") == 1)


QUERIES |= {"q_filter_stats": q_filter_stats, "q_score_hist": q_score_hist, "q_filter_vs_labels": q_filter_vs_labels}
ORACLES |= {
    "q_filter_stats": f"SELECT lang, r AS reason_code, count(*) AS n FROM (SELECT lang, coalesce({_first_sql('conservative')}, 'kept') AS r FROM ({PARTS})) GROUP BY ROLLUP (lang, r)",
    "q_score_hist": f"SELECT lang, least(floor(s * 5 + 1e-9), 4)::INT AS bucket, count(*) AS n, round(avg(s), 6) AS mean_score FROM ({_score_sql('strict')}) JOIN documents USING (doc_id) GROUP BY ALL",
    "q_filter_vs_labels": f"""
        WITH j AS (SELECT {_first_sql('conservative')} IS NULL AS keep, quality = 1 AS good FROM ({PARTS}) JOIN labels USING (doc_id)),
        c AS (SELECT count(*) FILTER (keep AND good) AS tp, count(*) FILTER (keep AND NOT good) AS fp, count(*) FILTER (NOT keep AND good) AS fn, count(*) FILTER (NOT keep AND NOT good) AS tn FROM j)
        SELECT tp, fp, fn, tn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall,
               round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round((tp + fp) / (tp + fp + fn + tn), 6) AS keep_rate FROM c""",
}


def _signal_query(name: str):
    def query(spark, sf_dir) -> DataFrame:
        text = text_or_empty(F.col("text"))
        return table(spark, sf_dir, "documents").select("doc_id", F.round(score.SIGNALS[name](text, score.language_of(text)), 6).alias("signal"))

    return query


for _name in score.SIGNALS:
    QUERIES[f"q_signal_{_name}"] = _signal_query(_name)


def q_code_score(spark, sf_dir) -> DataFrame:
    scored = score.with_score(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", F.round("score", 6).alias("score"), "tier", F.round("weight", 6).alias("weight"), F.size("issues").alias("n_issues"), F.size("suggestions").alias("n_suggestions"))


def q_tier_weight(spark, sf_dir) -> DataFrame:
    """Tier and training weight of each order's discounted share, as scores from 0 to 1."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.pmod("o_orderkey", F.lit(1000)) / 1000.0).alias("score"))
    return rows.groupBy(score.tier(F.col("score")).alias("tier")).agg(
        F.count("*").alias("n"), F.round(F.avg(score.weight(F.col("score"))), 6).alias("mean_weight"), F.round(F.max(score.weight(F.col("score"))), 6).alias("max_weight"))


QUERIES |= {"q_code_score": q_code_score, "q_tier_weight": q_tier_weight}
# Line-based signals on prose: lines without their trailing empty one.
_UNIV = "CASE WHEN lines[-1] = '' THEN lines[:-2] ELSE lines END"
_LENGTHS = f"list_transform({_UNIV}, lambda x: length(x))"
_LONG = f"list_filter(list_transform({_UNIV}, lambda x: {STRIP.format('x')}), lambda x: length(x) > 10)"
_LANGUAGE = f"CASE WHEN {_sum('t', quality.JS_VETO)} < 2 AND {_sum('t', quality.PYTHON_SIGNS)} >= 2 THEN 'python' WHEN {_sum('t', quality.JS_SIGNS)} >= 2 THEN 'typescript' ELSE 'unknown' END"
_DUP = f"1 - len(list_distinct({_LONG})) / len({_LONG})"
ORACLES |= {
    "q_signal_length": f"SELECT doc_id, CASE WHEN n < 5 THEN 0.1 WHEN n < 10 THEN 0.4 WHEN n <= 300 THEN 1.0 WHEN n <= 500 THEN 0.9 WHEN n <= 1000 THEN 0.7 WHEN n <= 2000 THEN 0.5 WHEN n <= 5000 THEN 0.3 ELSE 0.1 END::DOUBLE AS signal FROM (SELECT doc_id, len({_UNIV}) AS n FROM ({DOCS}))",
    "q_signal_line_quality": f"""
        SELECT doc_id, round(CASE WHEN n = 0 THEN 0 WHEN m > 500 THEN 0.1 WHEN a > 200 THEN 0.15 ELSE
          0.6 * CASE WHEN a < 10 THEN 0.3 WHEN a <= 80 THEN 1 WHEN a <= 100 THEN 0.8 WHEN a <= 120 THEN 0.6 ELSE 0.4 END
          + 0.4 * CASE WHEN m <= 100 THEN 1 WHEN m <= 120 THEN 0.9 WHEN m <= 200 THEN 0.7 WHEN m <= 300 THEN 0.5 ELSE 0.3 END END::DOUBLE, 6) AS signal
        FROM (SELECT doc_id, len({_LENGTHS}) AS n, list_max({_LENGTHS}) AS m, list_avg({_LENGTHS}) AS a FROM ({DOCS}))""",
    "q_signal_duplication": f"SELECT doc_id, CASE WHEN len({_LONG}) < 20 THEN 0.8 WHEN {_DUP} <= 0.05 THEN 1.0 WHEN {_DUP} <= 0.15 THEN 0.85 WHEN {_DUP} <= 0.25 THEN 0.65 WHEN {_DUP} <= 0.35 THEN 0.45 WHEN {_DUP} <= 0.5 THEN 0.25 ELSE 0.1 END::DOUBLE AS signal FROM ({DOCS})",
    "q_signal_documentation": f"""SELECT doc_id, CASE WHEN {_any('t', ('"""', "'''", '/**'), 'contains')} THEN 0.7 WHEN len({_UNIV}) > 50 THEN 0.2 ELSE 0.4 END::DOUBLE AS signal FROM ({DOCS})""",
    "q_signal_comments": f"""SELECT doc_id, CASE WHEN r BETWEEN 0.05 AND 0.25 THEN 1.0 WHEN r BETWEEN 0.02 AND 0.40 THEN 0.6 WHEN r < 0.02 THEN 0.3 ELSE 0.2 END::DOUBLE AS signal FROM (
        SELECT doc_id, coalesce(list_sum(list_transform(list_filter({_UNIV}, lambda x: {_any(STRIP.format('x'), ('#', '//', '/*', '*'), 'starts_with')}), lambda x: length(x))), 0)::DOUBLE / greatest(length(t), 1) AS r FROM ({DOCS}))""",
    "q_signal_complexity": f"""SELECT doc_id, CASE WHEN n = 0 THEN 0 WHEN w = 0 THEN 0.5 WHEN w / n <= 0.15 THEN 1 WHEN w / n <= 0.25 THEN 0.7 WHEN w / n <= 0.4 THEN 0.4 ELSE 0.2 END::DOUBLE AS signal FROM (
        SELECT doc_id, len({_UNIV}) AS n, len(list_filter(regexp_extract_all(t, '[\\p{{L}}\\p{{N}}\\p{{M}}_]+'), lambda x: x IN ('if', 'else', 'elif', 'for', 'while', 'switch', 'case', 'try', 'catch', 'except', 'finally'))) AS w FROM ({DOCS}))""",
    "q_signal_formatting": f"""
        WITH l AS (SELECT doc_id, {_UNIV} AS x FROM ({DOCS})),
        c AS (SELECT doc_id, len(x) AS n, len(list_filter(x, lambda x: {STRIP.format('x')} = '')) / len(x) AS b, len(list_filter(x, lambda x: starts_with(x, chr(9)))) AS t, len(list_filter(x, lambda x: starts_with(x, ' '))) AS s FROM l)
        SELECT doc_id, round(CASE WHEN n = 0 THEN 0 ELSE 0.6 * CASE WHEN b BETWEEN 0.05 AND 0.25 THEN 1 WHEN b BETWEEN 0.01 AND 0.35 THEN 0.6 WHEN b < 0.01 THEN 0.3 ELSE 0.2 END
          + 0.4 * CASE WHEN t + s = 0 THEN 0.8 WHEN least(t, s) / (t + s) > 0.05 THEN 0.3 WHEN least(t, s) / (t + s) > 0.01 THEN 0.6 ELSE 1 END END::DOUBLE, 6) AS signal FROM c""",
    "q_signal_naming": f"""
        WITH m AS (SELECT doc_id, regexp_extract_all(t, '{quality.NAME_PATTERN}', 1) AS a FROM ({DOCS})), n AS (SELECT doc_id, len(a) AS k, list_filter(a, lambda x: lower(x) NOT IN ({', '.join(map(_quote, quality.SHORT_NAMES))})) AS m FROM m),
        c AS (SELECT *, len(m) AS n, {', '.join(f"len(list_filter(m, lambda x: regexp_matches(x, '{p}'))) / len(m) AS {c}" for c, p in (('snake', '^[a-z][a-z0-9_]*$'), ('camel', '^[a-z][a-zA-Z0-9]*$'), ('pascal', '^[A-Z][a-zA-Z0-9]*$'), ('upper_', '^[A-Z][A-Z0-9_]+$')))} FROM n),
        r AS (SELECT *, greatest(snake, camel) + pascal + upper_ AS c FROM c)
        SELECT doc_id, CASE WHEN k < 5 OR n = 0 THEN 0.5 WHEN len(list_filter(m, lambda x: length(x) <= 1)) / n > 0.5 THEN 0.2 WHEN list_avg(list_transform(m, lambda x: length(x))) < 3 THEN 0.25 WHEN c > 0.8 THEN 1 WHEN c > 0.6 THEN 0.7 WHEN c > 0.4 THEN 0.5 ELSE 0.3 END::DOUBLE AS signal FROM r""",
    "q_signal_structure": f"""
        WITH l AS (SELECT doc_id, {_LANGUAGE} = 'python' AS py, list_transform({_UNIV}, lambda x: {STRIP.format('x')}) AS x FROM ({DOCS})),
        c AS (SELECT doc_id, greatest(len(x), 1) AS n,
              CASE WHEN py THEN len(list_filter(x, lambda v: starts_with(v, 'def '))) ELSE len(list_filter(x, lambda v: regexp_matches(v, '^(export\\s+)?(async\\s+)?function\\s+\\w+'))) + len(list_filter(x, lambda v: regexp_matches(v, '^(export\\s+)?(const|let)\\s+\\w+\\s*=\\s*(async\\s+)?\\('))) END AS f,
              CASE WHEN py THEN len(list_filter(x, lambda v: starts_with(v, 'class '))) ELSE len(list_filter(x, lambda v: regexp_matches(v, '^(export\\s+)?(default\\s+)?class\\s+\\w+'))) END AS k,
              len(list_filter(x, lambda v: starts_with(v, 'import ') OR py AND starts_with(v, 'from '))) AS i FROM l)
        SELECT doc_id, round(CASE WHEN f = 0 AND k = 0 THEN CASE WHEN n < 20 THEN 0.3 ELSE 0.2 END ELSE least(1, least(1, CASE WHEN 100 * f / n BETWEEN 3 AND 15 THEN 1 WHEN 100 * f / n BETWEEN 1 AND 25 THEN 0.7 ELSE 0.4 END + CASE WHEN k > 0 THEN 0.1 ELSE 0 END) + CASE WHEN i > 0 THEN 0.05 ELSE 0 END) END::DOUBLE, 6) AS signal FROM c""",
    "q_signal_security": f"""SELECT doc_id, round(greatest(0, 1 - CASE WHEN {' OR '.join(f'regexp_matches(t, {_quote(p)})' for p in quality.SECRETS)} THEN 0.5 ELSE 0 END
        - least(0.15 * (len(regexp_extract_all(t, '\\beval\\s*\\(')) + len(regexp_extract_all(t, '\\bexec\\s*\\('))), 0.3) - least(0.1 * len(regexp_extract_all(t, '(?i)(?:SELECT|INSERT|UPDATE|DELETE|WHERE)[\\s\\x0b\\x85\\p{{Z}}]+[^"'']+["''\\s\\x0b\\x85\\p{{Z}}]*\\+')), 0.2)
        - CASE WHEN regexp_matches(t, '(?s)\\bsubprocess\\b.*\\bshell\\s*=\\s*True\\b') THEN 0.1 ELSE 0 END - CASE WHEN regexp_matches(t, '\\bos\\.system\\s*\\([^)]*\\+') THEN 0.1 ELSE 0 END)::DOUBLE, 6) AS signal FROM ({DOCS})""",
    "q_tier_weight": """
        WITH s AS (SELECT (o_orderkey % 1000) / 1000.0::DOUBLE AS score FROM orders),
        t AS (SELECT score, CASE WHEN score >= 0.8 THEN 'excellent' WHEN score >= 0.6 THEN 'good' WHEN score >= 0.4 THEN 'average' WHEN score >= 0.2 THEN 'poor' ELSE 'reject' END AS tier,
                     CASE WHEN score < 0.2 THEN 0 WHEN score < 0.4 THEN 0.3 + (score - 0.2) / 0.2 * 0.7 WHEN score < 0.6 THEN 1.0 + (score - 0.4) / 0.2 * 0.5 WHEN score < 0.8 THEN 1.5 + (score - 0.6) / 0.2 * 0.5 ELSE 2.0 END::DOUBLE AS w FROM s)
        SELECT tier, count(*) AS n, round(avg(w), 6) AS mean_weight, round(max(w), 6) AS max_weight FROM t GROUP BY tier""",
}


def q_license_filter(spark, sf_dir) -> DataFrame:
    docs = filters.with_declared_license(table(spark, sf_dir, "documents"))
    return docs.select("doc_id", F.col("license").alias("license"), filters.license_reason(F.col("license")).alias("reason_code"))


def q_pii_filter(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", filters.pii_reason(F.col("text")).alias("reason_code"))


def q_pii_redact(spark, sf_dir) -> DataFrame:
    red = filters.redact_pii(text_or_empty(F.col("text")))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(red, 256).alias("redacted_sha256"), F.length(red).alias("n_chars"))


def q_content_filter(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", filters.content_reason(F.col("text")).alias("reason_code"))


def q_low_quality(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.round(filters.four_criteria(F.col("text")), 6).alias("score"), F.length(text_or_empty(F.col("text"))).alias("n"))
    return docs.where((F.col("n") < 10) | (F.col("score") < 0.5)).select("doc_id", "score")


QUERIES |= {f.__name__: f for f in (q_license_filter, q_pii_filter, q_pii_redact, q_content_filter, q_low_quality)}
_T = "coalesce(text, '')"
ORACLES |= {
    "q_license_filter": f"""SELECT doc_id, l AS license, CASE WHEN l IS NULL THEN 'no_license' WHEN l NOT IN ({', '.join(map(_quote, filters.PERMISSIVE))}) THEN 'non_permissive' END AS reason_code
        FROM (SELECT doc_id, CASE {' '.join(f"WHEN contains({_T}, {_quote(n)}) THEN {_quote(i)}" for i, n in filters.DECLARED.items())} END AS l FROM documents)""",
    "q_pii_filter": f"SELECT doc_id, CASE {' '.join(f'WHEN {filters.pii_sql(n)} THEN {_quote(n)}' for n in filters.PII)} END AS reason_code FROM documents",
    "q_pii_redact": f"SELECT doc_id, sha256(r) AS redacted_sha256, length(r) AS n_chars FROM (SELECT doc_id, {reduce(lambda x, p: f'regexp_replace({x}, {_quote(p[1])}, {_quote(f"<{p[0].upper()}>")}, {_quote("g")})', filters.PII.items(), _T)} AS r FROM documents)",
    "q_content_filter": f"""SELECT doc_id, CASE WHEN {_any(_T, filters.LOCK_SIGNS, 'contains')} THEN 'lock_file' WHEN {_any(f'lower({_T})', quality.AUTOGENERATED, 'contains')} THEN 'autogenerated'
        WHEN list_max(list_transform(string_split({_T}, chr(10)), lambda x: length(x))) > 1000 THEN 'minified'
        WHEN length({_T}) >= 200 AND length(regexp_replace({_T}, '[^0-9,;\\t]', '', 'g')) / length({_T}) > 0.6 THEN 'data_dump' END AS reason_code FROM documents""",
    "q_low_quality": f"""WITH s AS (SELECT doc_id, length({_T}) AS n, ((length({_T}) >= 20)::INT + regexp_matches({_T}, '[a-zA-Z]{{2,}}')::INT + (length({_T}) > 0 AND len(list_distinct(string_split({_T}, ''))) >= 0.1 * length({_T}))::INT + regexp_matches({_T}, '[^\\s]')::INT) / 4 AS score FROM documents)
        SELECT doc_id, round(score, 6) AS score FROM s WHERE n < 10 OR score < 0.5""",
}
