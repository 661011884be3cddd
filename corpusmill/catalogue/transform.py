"""Queries on row transforms, chunking and chats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.catalogue.quality import _sum
from corpusmill.operators import chunk, quality, transform
from corpusmill.session import table


def q_normalize_ws(spark, sf_dir) -> DataFrame:
    out = table(spark, sf_dir, "pages").select("page_id", transform.normalize_whitespace(F.col("html")).alias("t"))
    return out.select("page_id", F.sha2("t", 256).alias("sha"), F.length("t").alias("n_chars"))


def q_formatting_std(spark, sf_dir) -> DataFrame:
    out = transform.standardize(table(spark, sf_dir, "pages"), "html")
    return out.select("page_id", F.sha2("html", 256).alias("sha"), "crlf_fixed", "tab_lines", "trailing_fixed", "newline_added")


def q_metadata(spark, sf_dir) -> DataFrame:
    return transform.with_metadata(table(spark, sf_dir, "documents")).select("doc_id", "line_count", "char_count", "content_hash", "estimated_language")


def q_byte_tokens(spark, sf_dir) -> DataFrame:
    out = transform.byte_tokens(table(spark, sf_dir, "documents"), offset=3, bos=1, eos=2)
    return out.select("doc_id", F.size("tokens").alias("n_tokens"), F.aggregate("tokens", F.lit(0).cast("long"), lambda s, x: s + x).alias("token_sum"))


def _byte_chunks(spark, sf_dir) -> DataFrame:
    return chunk.concat_and_chunk(transform.byte_tokens(table(spark, sf_dir, "documents"), eos=256), "doc_id", size=512)


def q_concat_chunk(spark, sf_dir) -> DataFrame:
    total = F.aggregate("tokens", F.lit(0).cast("long"), lambda s, x: s + x)
    return _byte_chunks(spark, sf_dir).select("chunk_id", F.size("tokens").alias("n"), total.alias("token_sum"), F.col("tokens")[0].alias("first"), F.col("tokens")[511].alias("last"))


def q_chunk_weights(spark, sf_dir) -> DataFrame:
    """Training weights of documents, divided by their mean."""
    docs = table(spark, sf_dir, "documents").select("doc_id", (1.0 + F.length("text") % 7).alias("weight"))
    return chunk.normalised_weights(docs, "weight").select("doc_id", F.round("weight", 6).alias("weight"))


def _fim(mode: str):
    def query(spark, sf_dir) -> DataFrame:
        tokens = transform.byte_tokens(table(spark, sf_dir, "documents"))
        out = transform.fim_tokens(tokens, "doc_id", rate=1.0, spm=float(mode == "spm"))
        where = lambda m: F.array_position("tokens", m)
        return out.select("doc_id", F.size("tokens").alias("n"), where(256).alias("prefix_at"), where(257).alias("suffix_at"), where(258).alias("middle_at"))

    return query


def q_fim_text(spark, sf_dir) -> DataFrame:
    out = transform.fim_text(table(spark, sf_dir, "documents").select("doc_id", "text"), rate=0.5)
    return out.select("doc_id", F.length("text").alias("n_chars"), F.col("text").startswith("<fim_prefix>").alias("moved"))


def q_chat_format(spark, sf_dir) -> DataFrame:
    out = transform.chat_prompt(table(spark, sf_dir, "conversations"))
    return out.select("conv_id", "n_turns", F.sha2("prompt", 256).alias("sha"))


def q_chat_truncate(spark, sf_dir) -> DataFrame:
    out = transform.chat_prompt(table(spark, sf_dir, "conversations"), budget=1000)
    return out.select("conv_id", "n_turns", F.sha2("prompt", 256).alias("sha"))


def q_turn_stats(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return rows.groupBy("role").agg(F.count("*").alias("turns"), F.count_distinct("conv_id").alias("conversations"),
                                    F.round(F.avg(F.length("text")), 6).alias("mean_chars"), F.max("turn").alias("last_turn"))


def q_instruction_text(spark, sf_dir) -> DataFrame:
    """Each user turn and the answer that follows it as an instruction example."""
    rows = table(spark, sf_dir, "conversations")
    asked = rows.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("q"))
    told = rows.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("a"))
    out = asked.join(told, ["conv_id", "turn"]).select("conv_id", "turn", transform.instruction_text(F.col("q"), F.lit(None).cast("string"), F.col("a")).alias("t"))
    return out.select("conv_id", "turn", F.sha2("t", 256).alias("sha"))


QUERIES = {f.__name__: f for f in (q_normalize_ws, q_formatting_std, q_metadata, q_byte_tokens, q_concat_chunk, q_chunk_weights, q_fim_text, q_chat_format, q_chat_truncate, q_turn_stats, q_instruction_text)}
QUERIES |= {"q_fim_psm": _fim("psm"), "q_fim_spm": _fim("spm")}

_BYTES = "list_transform(range(0, strlen(t)), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::INT)"
_HASH = "(('0x' || substr(md5(doc_id || ':42:{0}'), 1, 8))::UBIGINT + 0.5) / 4294967296.0"
_CHAT = "CASE role WHEN 'system' THEN 'System: ' WHEN 'user' THEN 'User: ' WHEN 'assistant' THEN 'Assistant: ' ELSE '' END || coalesce(text, '')"


def _fim_sql(mode: str) -> str:
    at = lambda x: f"floor(n * 0.1 + {_HASH.format(x)} * (n * 0.8))::INT"
    spots = "1 AS prefix_at, a + 2 AS suffix_at, a + 3 + n - b AS middle_at" if mode == "psm" else "n - b + 2 AS prefix_at, 1 AS suffix_at, n - b + a + 3 AS middle_at"
    return f"""
    WITH d AS (SELECT doc_id, strlen(coalesce(text, '')) AS n FROM documents),
    c AS (SELECT doc_id, n, least({at('a')}, {at('b')}) AS a, greatest({at('a')}, {at('b')}) AS b FROM d)
    SELECT doc_id, CASE WHEN n < 10 THEN n ELSE n + 3 END AS n, {', '.join(f"CASE WHEN n < 10 THEN 0 ELSE {x.split(' AS ')[0]} END AS {x.split(' AS ')[1]}" for x in spots.split(', '))} FROM c"""


_HEAD = "coalesce(text, '')"
ORACLES = {
    "q_metadata": f"""SELECT doc_id, len(string_split(coalesce(text, ''), chr(10))) AS line_count, length(coalesce(text, '')) AS char_count, sha256(coalesce(text, '')) AS content_hash,
        CASE WHEN {_sum(_HEAD, quality.JS_VETO)} < 2 AND {_sum(_HEAD, quality.PYTHON_SIGNS)} >= 2 THEN 'python' WHEN {_sum(_HEAD, quality.JS_SIGNS)} >= 2 THEN 'typescript' ELSE 'unknown' END AS estimated_language FROM documents""",
    "q_normalize_ws": r"SELECT page_id, sha256(t) AS sha, length(t) AS n_chars FROM (SELECT page_id, regexp_replace(regexp_replace(replace(coalesce(html, ''), chr(9), '    '), ' +(\n|$)', '\1', 'g'), '\n{4,}', chr(10) || chr(10) || chr(10), 'g') AS t FROM pages)",
    "q_formatting_std": r"""
        WITH a AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
        b AS (SELECT page_id, len(regexp_extract_all(t, '\r\n?')) AS crlf_fixed, string_split(regexp_replace(t, '\r\n?', chr(10), 'g'), chr(10)) AS x FROM a),
        c AS (SELECT *, len(list_filter(x, lambda v: regexp_matches(v, '^[ \t]*\t'))) AS tab_lines,
              list_transform(x, lambda v: replace(regexp_extract(v, '^[ \t]*'), chr(9), '    ') || regexp_replace(v, '^[ \t]*', '')) AS y FROM b),
        d AS (SELECT *, len(list_filter(y, lambda v: regexp_matches(v, '[ \t]$'))) AS trailing_fixed, array_to_string(list_transform(y, lambda v: regexp_replace(v, '[ \t]+$', '')), chr(10)) AS z FROM c)
        SELECT page_id, sha256(CASE WHEN z = '' OR ends_with(z, chr(10)) THEN z ELSE z || chr(10) END) AS sha, crlf_fixed, tab_lines, trailing_fixed, NOT (z = '' OR ends_with(z, chr(10))) AS newline_added FROM d""",
    "q_byte_tokens": f"SELECT doc_id, n + 2 AS n_tokens, (coalesce(list_sum({_BYTES}), 0) + 3 * n + 3)::BIGINT AS token_sum FROM (SELECT doc_id, coalesce(text, '') AS t, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents)",
    "q_concat_chunk": f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, hex(encode(coalesce(text, ''))) AS h FROM documents),
        s AS (SELECT doc_id, list_append({_BYTES}, 256) AS x, strlen(t) + 1 AS n FROM d),
        o AS (SELECT x, n, sum(n) OVER (ORDER BY doc_id) - n AS start FROM s),
        p AS (SELECT start + i AS pos, x[i + 1] AS tok FROM (SELECT start, x, unnest(range(0, n)) AS i FROM o))
        SELECT (pos // 512)::BIGINT AS chunk_id, count(*) AS n, sum(tok)::BIGINT AS token_sum, arg_min(tok, pos) AS first, arg_max(tok, pos) AS last FROM p GROUP BY pos // 512 HAVING count(*) = 512""",
    "q_chunk_weights": "SELECT doc_id, round(w / avg(w) OVER (), 6) AS weight FROM (SELECT doc_id, 1.0::DOUBLE + length(text) % 7 AS w FROM documents)",
    "q_fim_psm": _fim_sql("psm"),
    "q_fim_spm": _fim_sql("spm"),
    "q_fim_text": f"SELECT doc_id, (length(t) + CASE WHEN m THEN 36 ELSE 0 END) AS n_chars, m AS moved FROM (SELECT doc_id, coalesce(text, '') AS t, {_HASH.format('rate')} < 0.5 AND length(coalesce(text, '')) >= 2 AS m FROM documents)",
    "q_chat_format": f"SELECT conv_id, count(*) AS n_turns, sha256(string_agg(l, chr(10) || chr(10) ORDER BY turn, l)) AS sha FROM (SELECT conv_id, turn, {_CHAT} AS l FROM conversations) GROUP BY conv_id",
    "q_chat_truncate": f"""
        WITH r AS (SELECT conv_id, turn, {_CHAT} AS l FROM conversations),
        k AS (SELECT *, sum(length(l)) OVER w AS used, row_number() OVER w AS k FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC, l DESC ROWS UNBOUNDED PRECEDING))
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(l, chr(10) || chr(10) ORDER BY turn, l)) AS sha FROM k WHERE used <= 1000 OR k = 1 GROUP BY conv_id""",
    "q_turn_stats": "SELECT role, count(*) AS turns, count(DISTINCT conv_id) AS conversations, round(avg(length(text)), 6) AS mean_chars, max(turn) AS last_turn FROM conversations GROUP BY role",
    "q_instruction_text": "SELECT u.conv_id, u.turn, sha256('### Instruction:' || chr(10) || u.text || chr(10) || chr(10) || '### Response:' || chr(10) || a.text) AS sha FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'",
}
