"""Queries on deduplication, leakage, mixing, balancing and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.operators import dedup, mix
from corpusmill.session import table

WEIGHTS = {"src0": 0.5, "src1": 0.3, "src2": 0.2}


def q_exact_dedup(spark, sf_dir) -> DataFrame:
    return dedup.exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), F.col("text")).select("doc_id")


def q_duplicate_pairs(spark, sf_dir) -> DataFrame:
    return dedup.duplicate_pairs(table(spark, sf_dir, "documents").select("doc_id", "text"), F.col("text"))


def q_cross_dedup(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return dedup.cross_dedup(docs.where("source = 'src0'"), docs.where("source <> 'src0'")).select("doc_id")


def q_priority_dedup(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return dedup.priority_dedup(docs, F.col("text"), F.substring("source", 4, 9).cast("int")).select("doc_id")


def q_minhash_signature(spark, sf_dir) -> DataFrame:
    signed = dedup.signatures(table(spark, sf_dir, "documents")).where("signature IS NOT NULL")
    return signed.select("doc_id", F.col("signature")[0].alias("s0"), F.col("signature")[63].alias("s63"), F.aggregate("signature", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


def q_lsh_bands(spark, sf_dir) -> DataFrame:
    signed = dedup.signatures(table(spark, sf_dir, "documents")).where("signature IS NOT NULL")
    return signed.select("doc_id", F.explode(dedup.band_keys(F.col("signature"))).alias("k")).select("doc_id", "k.band", "k.key")


def q_near_dup(spark, sf_dir) -> DataFrame:
    return dedup.near_duplicates(table(spark, sf_dir, "documents")).withColumn("similarity", F.round("similarity", 6))


def q_near_classes(spark, sf_dir) -> DataFrame:
    return dedup.near_classes(table(spark, sf_dir, "documents"))


def q_cross_near_dedup(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return dedup.cross_near_dedup(docs.where("source = 'src0'"), docs.where("source <> 'src0'")).select("doc_id")


def q_near_dedup(spark, sf_dir) -> DataFrame:
    return dedup.drop_near_copies(table(spark, sf_dir, "documents")).select("doc_id")


def q_containment(spark, sf_dir) -> DataFrame:
    found = dedup.containment(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("containment", F.round("containment", 6))


def q_leakage_report(spark, sf_dir) -> DataFrame:
    found = dedup.leakage(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("containment", F.round("containment", 6))


def q_leakage_rate(spark, sf_dir) -> DataFrame:
    return dedup.leakage_rate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumn("rate", F.round("rate", 6))


def q_pair_jaccard(spark, sf_dir) -> DataFrame:
    """Similarity of each user turn and the answer that follows it."""
    rows = table(spark, sf_dir, "conversations")
    a = rows.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("a"))
    b = rows.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("b"))
    out = dedup.pair_similarity(a.join(b, ["conv_id", "turn"]), "a", "b")
    return out.select("conv_id", "turn", F.round("char_jaccard", 6).alias("char_jaccard"), F.round("token_jaccard", 6).alias("token_jaccard"))


def q_mix_concat(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mix.concat({s: docs.where(F.col("source") == s) for s in WEIGHTS}, {"src1": 7}, "doc_id").select("doc_id", "dataset")


def q_mix_interleave(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mix.interleave(docs, mix.weights_table(spark, WEIGHTS)).select("doc_id", "source", "position")


def q_mix_weighted(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mix.draw_with_replacement(docs, mix.weights_table(spark, WEIGHTS), 1000)


def q_mix_drain(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mix.weighted_drain(docs, mix.weights_table(spark, WEIGHTS)).withColumn("race", F.round("race", 6))


def q_mix_from_loss(spark, sf_dir) -> DataFrame:
    losses = table(spark, sf_dir, "events").groupBy("event_type").agg(F.avg("value").alias("loss"))
    return mix.weights_from_losses(losses).select("event_type", F.round("weight", 6).alias("weight"))


def q_class_weights(spark, sf_dir) -> DataFrame:
    return mix.class_weights(table(spark, sf_dir, "documents"), "lang").withColumn("weight", F.round("weight", 6))


def _balanced(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return mix.balance(docs, "lang", F.least(F.length("text") / 5000.0, F.lit(1.0)), F.octet_length("text"), "source")


def q_balance_weights(spark, sf_dir) -> DataFrame:
    return _balanced(spark, sf_dir).select("doc_id", F.round("weight", 6).alias("weight"))


def q_kish_ess(spark, sf_dir) -> DataFrame:
    return _balanced(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n"), F.round(mix.effective_size(F.col("weight")), 4).alias("effective"))


def q_imbalance(spark, sf_dir) -> DataFrame:
    return mix.imbalance(table(spark, sf_dir, "documents"), "lang", 0.5).withColumn("share", F.round("share", 6))


def q_hash_fold(spark, sf_dir) -> DataFrame:
    return mix.hash_fold(table(spark, sf_dir, "pages").select("page_id", "url"), F.col("url"), 5).select("page_id", "fold")


def q_group_kfold(spark, sf_dir) -> DataFrame:
    return mix.group_folds(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", 5).select("doc_id", "fold")


def q_group_kfold_by_size(spark, sf_dir) -> DataFrame:
    return mix.group_folds(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", 5, by_size=True).select("doc_id", "fold")


def q_fold_leakage(spark, sf_dir) -> DataFrame:
    """Texts that stand in more than one hash fold."""
    docs = mix.hash_fold(table(spark, sf_dir, "documents"), F.col("doc_id").cast("string"), 5)
    return mix.fold_leakage(docs.select(F.md5("text").alias("text_md5"), "fold"), "text_md5")


def q_train_val_split(spark, sf_dir) -> DataFrame:
    return mix.split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 0.1)


def q_three_way_split(spark, sf_dir) -> DataFrame:
    return mix.three_way(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


QUERIES = {k: v for k, v in globals().items() if k.startswith("q_")}

_NORMAL = r"trim(regexp_replace(lower(coalesce(text, '')), '[ \t\n\r\x0b\x0c]+', ' ', 'g'))"
_GRAMS = "list_distinct(list_transform(range(0, greatest(len(w) - 8, 0) + 1), lambda i: array_to_string(w[i + 1:i + 8], ' ')))"
_W = "(VALUES ('src0', 0.5::DOUBLE), ('src1', 0.3::DOUBLE), ('src2', 0.2::DOUBLE)) AS w(source, weight)"
_U = "(('0x' || substr(md5({0}), 1, 8))::UBIGINT + 0.5) / 4294967296.0"
_H = "('0x' || substr(md5({0}), 1, 8))::UBIGINT"
_A, _B = dedup.coefficients()
_SIGNED = f"""
    WITH t AS (SELECT doc_id, {_NORMAL} AS t FROM documents),
    s AS (SELECT DISTINCT doc_id, substr(t, i, 5) AS u FROM (SELECT doc_id, t, unnest(range(1, greatest(length(t) - 4, 1) + 1)) AS i FROM t WHERE t <> '')),
    h AS (SELECT doc_id, ('0x' || substr(md5(u), 1, 8))::BIGINT % {dedup.PRIME} AS h FROM s),
    c AS (SELECT unnest({_A.tolist()}) AS a, unnest({_B.tolist()}) AS b, unnest(range(0, 128)) AS k),
    g AS (SELECT doc_id, k, min((h * a + b) % {dedup.PRIME}) AS m FROM h, c GROUP BY doc_id, k)"""


def _signatures_sql(name: str, where: str = "true") -> str:
    """CTEs: name_t (doc_id, t: the smallest id of each normalised text), name_g (doc_id, k, m: its signature), name_b (doc_id, band, key)."""
    return f"""
        {name}_t AS (SELECT min(doc_id) AS doc_id, t FROM (SELECT doc_id, {_NORMAL} AS t FROM documents WHERE {where}) GROUP BY t),
        {name}_s AS (SELECT DISTINCT doc_id, substr(t, i, 5) AS u FROM (SELECT doc_id, t, unnest(range(1, greatest(length(t) - 4, 1) + 1)) AS i FROM {name}_t WHERE t <> '')),
        {name}_h AS (SELECT doc_id, ('0x' || substr(md5(u), 1, 8))::BIGINT % {dedup.PRIME} AS h FROM {name}_s),
        {name}_g AS (SELECT doc_id, k, min((h * a + b) % {dedup.PRIME}) AS m FROM {name}_h, c GROUP BY doc_id, k),
        {name}_b AS (SELECT doc_id, k // 8 AS band, string_agg(m::VARCHAR, ',' ORDER BY k) AS key FROM {name}_g GROUP BY doc_id, k // 8)"""


_C = f"WITH c AS (SELECT unnest({_A.tolist()}) AS a, unnest({_B.tolist()}) AS b, unnest(range(0, 128)) AS k)"
_NEAR = """
        p AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM {0}_b x JOIN {1}_b y ON x.band = y.band AND x.key = y.key WHERE {2}),
        near AS (SELECT a, b, count(*) FILTER (x.m = y.m) / 128 AS s FROM p JOIN {0}_g x ON x.doc_id = a JOIN {1}_g y ON y.doc_id = b AND x.k = y.k GROUP BY a, b HAVING count(*) FILTER (x.m = y.m) >= 0.8 * 128)"""
_CONTAINED = f"""
    WITH i AS (SELECT item_id, text, unnest({_GRAMS}) AS gram, len({_GRAMS}) AS total FROM (SELECT item_id, text, string_split({_NORMAL}, ' ') AS w FROM benchmark)),
    d AS (SELECT doc_id, unnest({_GRAMS}) AS gram FROM (SELECT doc_id, string_split({_NORMAL}, ' ') AS w FROM documents)),
    f AS (SELECT item_id, doc_id, count(*) / total AS containment FROM i JOIN d USING (gram) GROUP BY item_id, doc_id, total),
    best AS (SELECT item_id, arg_min(doc_id, (-containment, doc_id)) AS doc_id, max(containment) AS containment, count(*) AS n_docs FROM f WHERE containment >= 0.5 GROUP BY item_id)"""
_BALANCE = """
    WITH d AS (SELECT doc_id, lang, source, least(floor(least(length(text) / 5000.0::DOUBLE, 1.0) * 5), 4) AS bin, strlen(text) AS size FROM documents),
    w AS (SELECT doc_id, lang, least(greatest(
        0.4 * (count(*) OVER ())::DOUBLE / (SELECT count(DISTINCT lang) FROM d) / count(*) OVER (PARTITION BY lang) + 0.2 * (count(*) OVER ())::DOUBLE / 5 / count(*) OVER (PARTITION BY bin)
        + 0.2 * (1 - 0.3 * size / max(size) OVER ()) + 0.2 * (count(*) OVER ())::DOUBLE / (SELECT count(DISTINCT source) FROM d) / count(*) OVER (PARTITION BY source), 0.1), 3.0) AS weight FROM d)"""
_SHUFFLED = "row_number() OVER (ORDER BY " + _H.format("{0} || ':42'") + ", {0}) - 1"
ORACLES = {
    "q_exact_dedup": "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text",
    "q_duplicate_pairs": "SELECT first_id, doc_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first_id FROM documents) WHERE first_id < doc_id",
    "q_cross_dedup": "SELECT doc_id FROM documents WHERE source <> 'src0' AND text NOT IN (SELECT text FROM documents WHERE source = 'src0')",
    "q_priority_dedup": "SELECT doc_id FROM (SELECT doc_id, substr(source, 4)::INT AS p, min(substr(source, 4)::INT) OVER (PARTITION BY text) AS best FROM documents) WHERE p = best",
    "q_minhash_signature": f"{_SIGNED} SELECT doc_id, max(m) FILTER (k = 0) AS s0, max(m) FILTER (k = 63) AS s63, sum(m)::BIGINT AS total FROM g GROUP BY doc_id",
    "q_lsh_bands": f"{_SIGNED} SELECT doc_id, (k // 8)::INT AS band, md5(string_agg(m::VARCHAR, ',' ORDER BY k)) AS key FROM g GROUP BY doc_id, k // 8",
    "q_near_classes": f"SELECT doc_id, min(doc_id) OVER (PARTITION BY {_NORMAL}) AS class_id FROM documents",
    "q_near_dup": f"{_C}, {_signatures_sql('d')}, {_NEAR.format('d', 'd', 'x.doc_id < y.doc_id')} SELECT a AS first_id, b AS id, round(s, 6) AS similarity FROM near",
    "q_near_dedup": f"""{_C.replace('WITH', 'WITH RECURSIVE', 1)}, {_signatures_sql('d')}, {_NEAR.format('d', 'd', 'x.doc_id < y.doc_id')},
        nodes AS (SELECT b, list(a) AS earlier, row_number() OVER (ORDER BY b) AS k FROM near GROUP BY b),
        greedy AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS dropped UNION ALL SELECT nodes.k, CASE WHEN len(list_filter(earlier, lambda x: NOT list_contains(dropped, x))) > 0 THEN list_append(dropped, b) ELSE dropped END FROM greedy JOIN nodes ON nodes.k = greedy.k + 1)
        SELECT doc_id FROM d_t WHERE NOT list_contains((SELECT arg_max(dropped, k) FROM greedy), doc_id)""",
    "q_cross_near_dedup": f"""{_C}, {_signatures_sql('one', "source = 'src0'")}, {_signatures_sql('other', "source <> 'src0'")}, {_NEAR.format('one', 'other', 'true')}
        SELECT doc_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY {_NORMAL}) AS class_id FROM documents WHERE source <> 'src0') WHERE class_id NOT IN (SELECT b FROM near)""",
    "q_containment": f"{_CONTAINED} SELECT item_id, doc_id, round(containment, 6) AS containment FROM f",
    "q_leakage_report": f"{_CONTAINED} SELECT item_id, doc_id, round(containment, 6) AS containment, n_docs, substr(text, 1, 100) AS preview FROM best JOIN benchmark USING (item_id)",
    "q_leakage_rate": f"{_CONTAINED} SELECT (SELECT count(*) FROM benchmark) AS n_items, count(*) AS n_leaked, round(count(*) / (SELECT count(*) FROM benchmark), 6) AS rate FROM best",
    "q_pair_jaccard": f"""
        WITH n AS (SELECT conv_id, turn, role, {_NORMAL} AS t FROM conversations),
        s AS (SELECT *, CASE WHEN length(t) < 3 THEN [] ELSE list_distinct(list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3))) END AS g, list_filter(list_distinct(string_split(t, ' ')), lambda x: x <> '') AS w FROM n),
        p AS (SELECT a.conv_id, a.turn, a.g AS g1, b.g AS g2, a.w AS w1, b.w AS w2 FROM s a JOIN s b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant')
        SELECT conv_id, turn, {', '.join(f"round(CASE WHEN len({x}1) = 0 AND len({x}2) = 0 THEN 1 WHEN len({x}1) = 0 OR len({x}2) = 0 THEN 0 ELSE len(list_intersect({x}1, {x}2)) / len(list_distinct(list_concat({x}1, {x}2))) END::DOUBLE, 6) AS {y}" for x, y in (('g', 'char_jaccard'), ('w', 'token_jaccard')))} FROM p""",
    "q_mix_concat": "SELECT doc_id, source AS dataset FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents WHERE source IN ('src0', 'src1', 'src2')) WHERE source <> 'src1' OR k <= 7",
    "q_mix_interleave": f"SELECT doc_id, source, row_number() OVER (ORDER BY t, source, doc_id) - 1 AS position FROM (SELECT doc_id, source, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 0.5) / weight AS t FROM documents JOIN {_W} USING (source))",
    "q_mix_weighted": f"""
        WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS k, count(*) OVER (PARTITION BY source) AS n FROM documents WHERE source IN ('src0', 'src1', 'src2')),
        d AS (SELECT i AS draw, {_U.format("i || ':42:source'")} AS u, {_H.format("i || ':42:row'")} AS h FROM range(1000) AS x(i)),
        s AS (SELECT draw, h, CASE WHEN u < 0.5 THEN 'src0' WHEN u < 0.8 THEN 'src1' ELSE 'src2' END AS source FROM d)
        SELECT draw, source, doc_id FROM s JOIN r USING (source) WHERE k = h % n""",
    "q_mix_drain": f"SELECT doc_id, source, round(-ln({_U.format(chr(39).join(['doc_id || ', ':42', '']))}) / weight, 6) AS race FROM documents JOIN {_W} USING (source)",
    "q_mix_from_loss": "SELECT event_type, round(l / sum(l) OVER (), 6) AS weight FROM (SELECT event_type, avg(value) AS l FROM events GROUP BY event_type)",
    "q_class_weights": "SELECT lang, n, round((sum(n) OVER ())::DOUBLE / count(*) OVER () / n, 6) AS weight FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang)",
    "q_balance_weights": f"{_BALANCE} SELECT doc_id, round(weight, 6) AS weight FROM w",
    "q_kish_ess": f"{_BALANCE} SELECT lang, count(*) AS n, round(sum(weight) * sum(weight) / sum(weight * weight), 4) AS effective FROM w GROUP BY lang",
    "q_imbalance": "SELECT arg_max(lang, (n, lang)) AS top, round(max(n) / sum(n), 6) AS share, max(n) / sum(n) > 0.5 AS dominant, sum(n) < 100 AS few FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang)",
    "q_hash_fold": f"SELECT page_id, ({_H.format('url')} % 5)::INT AS fold FROM pages",
    "q_group_kfold": f"SELECT doc_id, fold FROM documents JOIN (SELECT source, (({_SHUFFLED.format('source')}) % 5)::INT AS fold FROM (SELECT DISTINCT source FROM documents)) USING (source)",
    "q_group_kfold_by_size": f"SELECT doc_id, fold FROM documents JOIN (SELECT source, ((row_number() OVER (ORDER BY n DESC, {_H.format(chr(39).join(['source || ', ':42', '']))}, source) - 1) % 5)::INT AS fold FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)) USING (source)",
    "q_fold_leakage": f"SELECT md5(text) AS text_md5, count(DISTINCT {_H.format('doc_id::VARCHAR')} % 5) AS n_folds FROM documents GROUP BY text HAVING count(DISTINCT {_H.format('doc_id::VARCHAR')} % 5) > 1",
    "q_train_val_split": f"SELECT doc_id, CASE WHEN {_SHUFFLED.format('doc_id')} < greatest(1, floor((SELECT count(*) FROM documents) * 0.1)) THEN 'val' ELSE 'train' END AS split FROM documents",
    "q_three_way_split": f"SELECT doc_id, CASE WHEN k < floor(n * 0.8) THEN 'train' WHEN k < floor(n * 0.8) + floor(n * 0.1) THEN 'val' ELSE 'test' END AS split FROM (SELECT doc_id, {_SHUFFLED.format('doc_id')} AS k, count(*) OVER () AS n FROM documents)",
}
