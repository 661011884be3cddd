"""Queries on changed texts: line diffs of lists of orders against a later state of them, near copies against their first text, contrastive pairs,
variants of code and code with bugs, a function for each order.

A later list lacks some orders, has others changed and notes added. All lines of a list differ, so SQL knows from the keys which stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.operators import contrast, dedup, diff, rewrite
from corpusmill.session import table

CONTEXT = 2


def _lists(spark, sf_dir) -> DataFrame:
    """part, a, b: lists of up to 64 orders and their later state."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.expr("o_orderkey div 64").alias("part"), F.expr("o_orderkey % 16").alias("r"), "o_orderpriority")
    line = F.format_string("order %d %s", "o_orderkey", "o_orderpriority")
    later = F.when(F.col("r") == 3, F.array().cast("array<string>")).when(F.col("r").isin(7, 8, 13), F.array(F.concat(line, F.lit(" sent")))).when(
        F.col("r").isin(0, 12), F.array(line, F.format_string("note %d", "o_orderkey"))).otherwise(F.array(line))
    grouped = orders.select("part", F.struct("o_orderkey", line.alias("a"), later.alias("b")).alias("x")).groupBy("part").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return grouped.select("part", F.array_join("x.a", "\n").alias("a"), F.array_join(F.flatten("x.b"), "\n").alias("b"))


def q_diff_stats(spark, sf_dir) -> DataFrame:
    return diff.stats(_lists(spark, sf_dir), "a", "b").withColumn("change_ratio", F.round("change_ratio", 9))


def q_diff_hunks(spark, sf_dir) -> DataFrame:
    return diff.hunks(_lists(spark, sf_dir), "a", "b", CONTEXT)


def q_diff_aligned(spark, sf_dir) -> DataFrame:
    return diff.aligned(_lists(spark, sf_dir), "a", "b")


def q_near_copy_diff(spark, sf_dir) -> DataFrame:
    """The changes from the first text that each near copy is linked to: one diff for each copy."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    links = dedup.near_duplicates(docs).groupBy(F.col("id").alias("doc_id")).agg(F.min("first_id").alias("first_id"))
    first = docs.select(F.col("doc_id").alias("first_id"), F.col("text").alias("first"))
    return diff.stats(links.join(docs, "doc_id").join(first, "first_id"), "first", "text")


def q_contrastive_pairs(spark, sf_dir) -> DataFrame:
    pairs = contrast.contrastive_pairs(table(spark, sf_dir, "documents"))
    return pairs.select("same", "a_id", "b_id", F.md5("a").alias("a"), F.md5("b").alias("b"))


FUNCTION = "import sys\nimport os\n# order {k}\ndef order_{k}(amount):\n    total = amount + 3  # {p}\n    if total < 10:\n        return total\n    return amount\n"
BROKEN = "def order_{k}(\n"


#: Orders whose code one task rewrites.
TASK_ROWS = 50_000


def _functions(spark, sf_dir) -> DataFrame:
    """Code of a function for each order; that of every tenth doesn't parse."""
    text = F.when(F.expr("o_orderkey % 10 = 7"), BROKEN).otherwise(FUNCTION)
    filled = F.replace(F.replace(text, F.lit("{k}"), F.col("o_orderkey").cast("string")), F.lit("{p}"), F.col("o_orderpriority"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    tasks = max(spark.sparkContext.defaultParallelism, orders.count() // TASK_ROWS)  # orders are few files; their count is in them
    return orders.repartition(tasks, "o_orderkey").select("o_orderkey", filled.alias("text"))


def q_code_variants(spark, sf_dir) -> DataFrame:
    return rewrite.augmented(_functions(spark, sf_dir), "o_orderkey")


def q_code_bugs(spark, sf_dir) -> DataFrame:
    return rewrite.with_bugs(_functions(spark, sf_dir), "o_orderkey").withColumn("code", F.md5("code"))


QUERIES = {name: f for name, f in globals().items() if name.startswith("q_")}

# kept: the orders that stay, by place; gone and come: lines of one side only, by the number of orders kept before them (gap)
_LISTS = """WITH o AS (SELECT o_orderkey AS k, o_orderkey // 64 AS part, o_orderkey % 16 AS r, 'order ' || o_orderkey || ' ' || o_orderpriority AS line FROM orders),
    f AS (SELECT *, r NOT IN (3, 7, 8, 13) AS stays FROM o),
    g AS (SELECT *, count(*) FILTER (stays) OVER (PARTITION BY part ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap FROM f),
    e AS (SELECT part, k, gap, 2 AS side, line, 0 AS sub FROM g WHERE stays UNION ALL SELECT part, k, gap, 0, line, 0 FROM g WHERE NOT stays
        UNION ALL SELECT part, k, gap, 1, line || ' sent', 0 FROM g WHERE r IN (7, 8, 13) UNION ALL SELECT part, k, gap + 1, 1, 'note ' || k, 1 FROM g WHERE r IN (0, 12)),
    c AS (SELECT part, gap, count(*) FILTER (side = 0) AS n, count(*) FILTER (side = 1) AS m FROM e WHERE side < 2 GROUP BY part, gap),
    t AS (SELECT part, count(*) FILTER (side = 2) AS kept FROM e GROUP BY part)"""
_SPAN = "CASE WHEN {n} = 1 THEN ({a} + 1)::VARCHAR WHEN {n} = 0 THEN {a} || ',0' ELSE ({a} + 1) || ',' || {n} END"

_CODE = f"""WITH o AS (SELECT o_orderkey, o_orderkey AS k, o_orderpriority AS p, replace(replace('{FUNCTION}', '{{k}}', o_orderkey::VARCHAR), '{{p}}', o_orderpriority) AS text FROM orders WHERE o_orderkey % 10 <> 7)"""
# Each kind's possible changes in the order of the text, written by hand: line, the line as it becomes ({p} is the order's), what became what.
_CHANGES = {
    "off_by_one": ((5, "    total = amount + 2  # {p}", "3 became 2"), (5, "    total = amount + 4  # {p}", "3 became 4"), (6, "    if total < 11:", "10 became 11"), (6, "    if total < 9:", "10 became 9")),
    "wrong_operator": ((5, "    total = amount * 3  # {p}", "+ became *"), (5, "    total = amount - 3  # {p}", "+ became -"), (6, "    if total <= 10:", "< became <="), (6, "    if total == 10:", "< became =="),
                       (6, "    if total > 10:", "< became >")),
    "missing_return": ((7, "        pass", "return total became pass"), (8, "    pass", "return amount became pass")),
    "wrong_variable": ((5, "    total = total + 3  # {p}", "amount became total"), (6, "    if amount < 10:", "total became amount"), (7, "        return amount", "total became amount"), (8, "    return total", "amount became total")),
    "type_error": ((5, '    total = amount + "3"  # {p}', '3 became "3"'), (6, '    if total < "10":', '10 became "10"')),
}
_BUGS = ", ".join(f"('{bug}', {len(all_)}, {n}, {line}, '{new}', '{note}')" for bug, all_ in _CHANGES.items() for n, (line, new, note) in enumerate(all_))


def _draw(what: str, n: int | str) -> str:
    return f"(('0x' || substr(md5(k || ':42:' || {what}), 1, 8))::BIGINT % {n})"


#: Lines before which something may be put: number, indent, text; drawn by kind.
_PLACES = "(VALUES (0, 2, '', 'import os'), (1, 4, '', 'def order_' || k || '(amount):'), (2, 6, '    ', '    if total < 10:'), (3, 8, '    ', '    return amount'))"


def _put(kind: str, lines: str) -> str:
    return f"""SELECT o_orderkey, '{kind}' AS strategy, replace(text, chr(10) || line || chr(10), chr(10) || {lines} || line || chr(10)) AS code, true AS changed, 'before line ' || place AS note
        FROM o, LATERAL (SELECT * FROM {_PLACES} v(q, place, i, line) WHERE q = {_draw(f"'{kind}'", 4)})"""


_NEW = "'total_' || substr(md5(k || ':42:rename:order_' || k || ':total'), 5, 4)"

ORACLES = {
    "q_code_variants": f"""{_CODE} SELECT o_orderkey, 'variable_rename' AS strategy, replace(text, 'total', {_NEW}) AS code, true AS changed, 'total>' || {_NEW} AS note FROM o
        UNION ALL SELECT o_orderkey, 'comment_remove', replace(replace(text, '# order ' || k || chr(10), ''), '  # ' || p, ''), true, '2 removed' FROM o
        UNION ALL SELECT o_orderkey, 'import_reorder', replace(text, 'import sys' || chr(10) || 'import os', 'import os' || chr(10) || 'import sys'), true, '2 sorted' FROM o
        UNION ALL {_put('comment_add', f"i || '# ' || ['step', 'see the caller', 'checked', 'kept as it is'][1 + {_draw(chr(39) + 'remark' + chr(39), 4)}] || chr(10)")}
        UNION ALL {_put('whitespace_vary', f"repeat(chr(10), (1 + {_draw(chr(39) + 'blank' + chr(39), 2)})::INT)")}
        UNION ALL {_put('dead_code_insert', "i || 'if False:' || chr(10) || i || '    pass' || chr(10)")}""",
    "q_code_bugs": f"""{_CODE}, b(bug, n, q, line, new, note) AS (VALUES {_BUGS}),
        x AS (SELECT o_orderkey, bug, line, string_split(text, chr(10))[line] AS original, replace(new, '{{p}}', p) AS modified, note, text FROM o JOIN b ON q = {_draw('bug', 'n')})
        SELECT o_orderkey, bug, md5(replace(text, original || chr(10), modified || chr(10))) AS code, line::INT AS line, original, modified, note FROM x""",
    "q_diff_stats": f"""{_LISTS}, s AS (SELECT t.part, coalesce(sum(m) FILTER (n = 0), 0)::INT AS additions, coalesce(sum(n) FILTER (m = 0), 0)::INT AS deletions,
        coalesce(sum(greatest(n, m)) FILTER (n > 0 AND m > 0), 0)::INT AS modifications, any_value(kept)::INT AS unchanged FROM t LEFT JOIN c USING (part) GROUP BY t.part)
        SELECT *, round((additions + deletions + modifications) / (additions + deletions + modifications + unchanged), 9) AS change_ratio FROM s""",
    "q_diff_hunks": f"""{_LISTS}, w AS (SELECT *, CASE WHEN gap - lag(gap) OVER (PARTITION BY part ORDER BY gap) <= {2 * CONTEXT} THEN 0 ELSE 1 END AS opens FROM c),
        v AS (SELECT *, sum(opens) OVER (PARTITION BY part ORDER BY gap) - 1 AS hunk FROM w),
        h AS (SELECT part, hunk, greatest(min(gap) - {CONTEXT}, 0) AS lo, max(gap) + {CONTEXT} AS hi, min(gap) AS first, max(gap) AS last FROM v GROUP BY part, hunk),
        x AS (SELECT h.part, h.hunk, count(*) FILTER (e.side <> 1 AND inside) AS n, count(*) FILTER (e.side <> 0 AND inside) AS m, count(*) FILTER (e.side <> 1 AND before) AS a, count(*) FILTER (e.side <> 0 AND before) AS b,
            string_agg(substr('-+ ', e.side + 1, 1) || line, chr(10) ORDER BY e.gap, e.side, e.k, e.sub) FILTER (inside) AS lines
            FROM h JOIN (SELECT * FROM e) e ON e.part = h.part, LATERAL (SELECT CASE WHEN e.side = 2 THEN e.gap >= lo AND e.gap < hi ELSE e.gap >= first AND e.gap <= last END AS inside,
                CASE WHEN e.side = 2 THEN e.gap < lo ELSE e.gap < first END AS before) GROUP BY h.part, h.hunk)
        SELECT part, hunk::INT AS hunk, a::INT AS a, n::INT AS n, b::INT AS b, m::INT AS m, '@@ -' || {_SPAN.format(a='a', n='n')} || ' +' || {_SPAN.format(a='b', n='m')} || ' @@' || chr(10) || lines AS text FROM x""",
    "q_diff_aligned": f"""{_LISTS}, p AS (SELECT *, row_number() OVER (PARTITION BY part, gap, side ORDER BY k, sub) AS q FROM e),
        j AS (SELECT coalesce(x.part, y.part) AS part, coalesce(x.gap, y.gap) AS gap, 0 AS late, coalesce(x.q, y.q) AS q, x.line AS a_text, y.line AS b_text,
                CASE WHEN x.q IS NULL THEN 'insert' WHEN y.q IS NULL THEN 'delete' ELSE 'replace' END AS mark
                FROM (SELECT * FROM p WHERE side = 0) x FULL JOIN (SELECT * FROM p WHERE side = 1) y ON x.part = y.part AND x.gap = y.gap AND x.q = y.q
            UNION ALL SELECT part, gap, 1, q, line, line, 'equal' FROM p WHERE side = 2)
        SELECT part, (row_number() OVER w - 1)::INT AS place, mark, CASE WHEN a_text IS NOT NULL THEN (count(a_text) OVER w)::INT END AS a_line, a_text,
            CASE WHEN b_text IS NOT NULL THEN (count(b_text) OVER w)::INT END AS b_line, b_text FROM j WINDOW w AS (PARTITION BY part ORDER BY gap, late, q)""",
    "q_contrastive_pairs": rf"""WITH t AS (SELECT md5(text) AS d, sha256(text) AS h, text, min(doc_id) AS id FROM documents WHERE text IS NOT NULL GROUP BY text),
        n AS (SELECT id, h, d, ('0x' || substr(md5(h || ':42'), 1, 8))::UBIGINT AS u FROM t),
        r AS (SELECT id, d, coalesce(lead(id) OVER w, first_value(id) OVER w) AS b_id, coalesce(lead(d) OVER w, first_value(d) OVER w) AS b FROM n WINDOW w AS (ORDER BY u, h)),
        f AS (SELECT id, d, text, array_to_string(list_transform(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+'),
            lambda w: coalesce(MAP {{{', '.join(f"'{k}': '{v}'" for k, v in contrast.NAMES.items())}}}[w], w)), '') AS renamed FROM t),
        p AS (SELECT *, array_to_string(list_transform(string_split(text, chr(10)), lambda x: regexp_extract(x, '^[ \t]*') || regexp_replace(regexp_replace(ltrim(x, ' ' || chr(9)), ' {{2,}}', ' ', 'g'), '[ \t]*([+\-*/=,:])[ \t]*', '\1', 'g')), chr(10)) AS tight FROM f)
        SELECT true AS same, id AS a_id, id AS b_id, d AS a, md5(CASE WHEN renamed <> text THEN renamed WHEN tight <> text THEN tight ELSE rtrim(text, chr(10)) || chr(10) END) AS b FROM p
        UNION ALL SELECT false, id, b_id, d, b FROM r WHERE id <> b_id""",
}
