"""Queries on functions, calls and documentation: modules of code that Spark writes from the orders, sixteen keys to a module.

Every tenth module ends in a definition that is never closed, so it doesn't parse. The SQL derives what must be found from the orders,
without reading code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.operators import extract, patterns
from corpusmill.session import table

# What an order's function looks like, by its key's remainder by four: text, where its definition begins (lines after the first).
FORMS = (
    ('def order_{k}(amount: int, *rest):\n    """{p} order."""\n    if amount > 3 and rest:\n        return {c}(amount)\n    return amount', 0),
    ("@cached\nasync def order_{k}(amount, rate=1.0) -> float:\n    total = [{c}(x) for x in rate]\n    return scale(total)", 1),
    ('class Order{k}:\n    def order_{k}(self, amount):\n        """Counts.\n\n        Args:\n            amount: how much\n        Returns:\n            int: {p}\n        """\n        with {c}(self) as x:\n            return x', 1),
    ("def order_{k}():\n    pass", 0),
)
SCRIPT = (
    "/**\n * {p} order.\n * @param {number} q\n * @returns {number} sum\n */\nexport async function order_{k}(q: number, ...rest) { return {c}(q) }",
    "/** {p}\n * @param amount how much\n */\nexport const order_{k} = () => {c}(1)",
    "/** @internal */\nfunction order_{k}(x) { return {c}(x) }",
    "/** no callable: {p} */\nlet order_{k} = 1",
)
IDIOMATIC = (
    "def f{k}(a, b=[]):\n    return [x for x in a if x]",
    "try:\n    y{k} = load({k})\nexcept:\n    z = lambda: f'{y}'",
    "class C{k}(A, B):\n    async def g(self, *a, **k) -> int:\n        yield a if self else {1: 2}",
    "assert (x, 'm')\nprint(*a, {b: c for b in d})",
)
BROKEN = "def broken("
MODULE, REST = "o_orderkey div 16", "o_orderkey % 4"


def _filled(text: str) -> Column:
    out = F.lit(text)
    for mark, value in (("{k}", F.col("o_orderkey").cast("string")), ("{p}", F.col("o_orderpriority")), ("{c}", F.col("callee"))):
        out = F.replace(out, F.lit(mark), value)
    return out


def _modules(spark, sf_dir, forms: tuple[str, ...], broken: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.expr(MODULE).alias("module"))
    before = F.lag("o_orderkey").over(Window.partitionBy("module").orderBy("o_orderkey"))
    form = F.coalesce(*[F.when(F.expr(f"{REST} = {k}"), _filled(t)) for k, t in enumerate(forms)])
    parts = orders.withColumn("callee", F.coalesce(F.concat(F.lit("order_"), before.cast("string")), F.lit("len"))).select("module", F.struct("o_orderkey", form.alias("text")).alias("part"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda x: x["text"]), "\n")
    end = F.when(F.expr("module % 10 = 7"), F.lit("\n" + broken)).otherwise("")
    return parts.groupBy("module").agg(text.alias("text")).select("module", F.concat("text", end).alias("text"))


def _python(spark, sf_dir) -> DataFrame:
    return _modules(spark, sf_dir, tuple(t for t, _ in FORMS), BROKEN)


def q_functions(spark, sf_dir) -> DataFrame:
    listed = {c: F.array_join(F.array_sort(c), ",").alias(c) for c in ("calls", "refs")}
    kept = ("is_async", "is_method", "start_line", "end_line", "complexity", "returns", "doc")
    return extract.functions(_python(spark, sf_dir)).select(
        "module", "name", F.array_join("params", ",").alias("params"), F.element_at("annotations", "amount").alias("annotation"), F.array_join("decorators", ",").alias("decorators"), *listed.values(), *kept, F.md5("source").alias("source"))


def q_call_edges(spark, sf_dir) -> DataFrame:
    return extract.call_edges(extract.functions(_python(spark, sf_dir)), "module")


def q_function_pairs(spark, sf_dir) -> DataFrame:
    return extract.function_pairs(extract.functions(_python(spark, sf_dir))).select("module", "name", "prompt", "completion")


def q_doc_pairs(spark, sf_dir) -> DataFrame:
    return extract.documented(_python(spark, sf_dir)).select("module", "doc", extract.signature().alias("signature"), "line")


def q_comment_pairs(spark, sf_dir) -> DataFrame:
    return extract.commented(_modules(spark, sf_dir, SCRIPT, "/** open")).select("module", "doc", extract.signature("typescript").alias("signature"), "line")


def q_code_patterns(spark, sf_dir) -> DataFrame:
    out = patterns.frequencies(_modules(spark, sf_dir, IDIOMATIC, BROKEN), "module")
    return out.withColumn("examples", F.array_join("examples", " | "))


def q_pattern_comparison(spark, sf_dir) -> DataFrame:
    code = _modules(spark, sf_dir, IDIOMATIC, BROKEN)
    return patterns.comparison(code.where("module % 3 = 0"), code.where("module % 3 <> 0")).withColumn("log_ratio", F.round("log_ratio", 6))


QUERIES = {name: f for name, f in globals().items() if name.startswith("q_")}


def _by_form(values, otherwise: str = "") -> str:
    return f"CASE r {' '.join(f'WHEN {k} THEN {v}' for k, v in enumerate(values))} {otherwise} END"


def _text_sql(text: str) -> str:
    quoted = text.replace("'", "''")
    return f"replace(replace(replace('{quoted}', '{{k}}', k::VARCHAR), '{{p}}', p), '{{c}}', c)"


def _orders(forms: tuple[str, ...]) -> str:
    lines = [t.count("\n") + 1 for t in forms]
    return f"""o AS (SELECT *, o_orderkey % 4 AS r, o_orderkey AS k, o_orderpriority AS p, o_orderkey // 16 AS module, coalesce('order_' || lag(o_orderkey) OVER (PARTITION BY o_orderkey // 16 ORDER BY o_orderkey), 'len') AS c FROM orders),
        s AS (SELECT *, sum({_by_form(lines)}) OVER (PARTITION BY module ORDER BY k) - {_by_form(lines)} AS above FROM o)"""


_BEGIN = _by_form(b for _, b in FORMS)
_PY = "WITH " + _orders(tuple(t for t, _ in FORMS))
_SOURCE = _by_form(_text_sql("\n".join(t.split("\n")[b:])) for t, b in FORMS)
_HEADS = ("def order_{k}(amount: int, *rest):", "async def order_{k}(amount, rate=1.0) -> float:", "    def order_{k}(self, amount):", "def order_{k}():")
_BODIES = (
    '"""{p} order."""\nif amount > 3 and rest:\n    return {c}(amount)\nreturn amount', "total = [{c}(x) for x in rate]\nreturn scale(total)",
    '"""Counts.\n\nArgs:\n    amount: how much\nReturns:\n    int: {p}\n"""\nwith {c}(self) as x:\n    return x', "pass",
)
_GUESSED = ("def order_{k}(amount, *rest):", "def order_{k}(amount):")

# The patterns of each form, written by hand: what a form is named for, with the line (from 0) and the line's text; its subtrees, with their numbers.
_NAMED = (
    (0, "construct", "def(2_args)", 0, "def f{k}(a, b=[]):"), (0, "anti_pattern", "mutable_default_arg", 0, "def f{k}(a, b=[]):"), (0, "idiom", "list_comprehension", 1, "return [x for x in a if x]"),
    (1, "anti_pattern", "bare_except", 2, "except:"), (1, "idiom", "lambda", 3, "z = lambda: f'{y}'"), (1, "idiom", "fstring", 3, "z = lambda: f'{y}'"),
    (2, "construct", "class(2_bases)", 0, "class C{k}(A, B):"), (2, "construct", "async:def(3_args):->annot", 1, "async def g(self, *a, **k) -> int:"),
    (2, "idiom", "yield", 2, "yield a if self else {1: 2}"), (2, "idiom", "conditional_expression", 2, "yield a if self else {1: 2}"),
    (3, "anti_pattern", "assert_tuple", 0, "assert (x, 'm')"), (3, "idiom", "starred_unpack", 1, "print(*a, {b: c for b in d})"), (3, "idiom", "dict_comprehension", 1, "print(*a, {b: c for b in d})"),
)
_SUBTREES = (
    {"FunctionDef>arguments>Return": 1, "arguments>arg>arg>List": 1, "Return>ListComp": 1, "arg": 2, "List>Load": 1, "ListComp>Name>comprehension": 1, "Load": 4, "Name>Load": 3, "comprehension>Name>Name>Name": 1, "Name>Store": 1, "Store": 1},
    {"Try>Assign>ExceptHandler": 1, "Assign>Name>Call": 1, "ExceptHandler>Assign": 1, "Name>Store": 2, "Call>Name>Constant": 1, "Assign>Name>Lambda": 1, "Store": 2, "Name>Load": 2, "Constant": 1, "Lambda>arguments>JoinedStr": 1, "Load": 2,
     "arguments": 1, "JoinedStr>FormattedValue": 1, "FormattedValue>Name": 1},
    {"ClassDef>Name>Name>AsyncFunctionDef": 1, "Name>Load": 5, "AsyncFunctionDef>arguments>Expr>Name": 1, "Load": 5, "arguments>arg>arg>arg": 1, "Expr>Yield": 1, "arg": 3, "Yield>IfExp": 1, "IfExp>Name>Name>Dict": 1, "Dict>Constant>Constant": 1, "Constant": 2},
    {"Assert>Tuple": 1, "Expr>Call": 1, "Tuple>Name>Constant>Load": 1, "Call>Name>Starred>DictComp": 1, "Name>Load": 6, "Constant": 1, "Load": 8, "Starred>Name>Load": 1, "DictComp>Name>Name>comprehension": 1, "comprehension>Name>Name": 1, "Name>Store": 1, "Store": 1},
)
_TOPS = ("'FunctionDef'", "'Try'", "'ClassDef'", "'Assert>Expr'")


def _quoted(*values) -> str:
    return f"({', '.join(str(v) if isinstance(v, int) else chr(39) + v.replace(chr(39), chr(39) * 2) + chr(39) for v in values)})"


_PATTERNS = f"""WITH {_orders(IDIOMATIC)}, w AS (SELECT * FROM s WHERE module % 10 <> 7),
        v(r, kind, signature, line, code) AS (VALUES {', '.join(_quoted(*x) for x in _NAMED)}), t(r, signature, n) AS (VALUES {', '.join(_quoted(r, x, n) for r, d in enumerate(_SUBTREES) for x, n in d.items())}),
        e AS (SELECT module, kind, signature, 1 AS n, above + line AS line, replace(code, '{{k}}', k::VARCHAR) AS code FROM w JOIN v USING (r)
            UNION ALL SELECT module, 'subtree', signature, n, NULL, NULL FROM w JOIN t USING (r) UNION ALL SELECT module, 'subtree', 'Module>' || string_agg({_by_form(_TOPS)}, '>' ORDER BY k), 1, NULL, NULL FROM w GROUP BY module)"""

ORACLES = {
    "q_functions": f"""{_PY} SELECT module, 'order_' || k AS name, {_by_form(("'amount,*rest'", "'amount,rate'", "'self,amount'", "''"))} AS params, CASE WHEN r = 0 THEN 'int' END AS annotation,
        CASE WHEN r = 1 THEN 'cached' ELSE '' END AS decorators, {_by_form(("c", "list_aggregate(list_sort([c, 'scale']), 'string_agg', ',')", "c", "''"))} AS calls,
        {_by_form(("list_aggregate(list_sort(['int', c]), 'string_agg', ',')", "list_aggregate(list_sort(['cached', 'float', 'scale', 'x', c]), 'string_agg', ',')", "list_aggregate(list_sort([c, 'x']), 'string_agg', ',')", "''"))} AS refs,
        r = 1 AS is_async, r = 2 AS is_method, (above + 1 + {_BEGIN})::INT AS start_line, (above + {_by_form(t.count(chr(10)) + 1 for t, _ in FORMS)})::INT AS end_line, {_by_form((3, 2, 2, 1))} AS complexity,
        CASE WHEN r = 1 THEN 'float' END AS returns, CASE r WHEN 0 THEN p || ' order.' WHEN 2 THEN {_text_sql(chr(10).join(("Counts.", "", "Args:", "    amount: how much", "Returns:", "    int: {p}")))} END AS doc, md5({_SOURCE}) AS source FROM s WHERE module % 10 <> 7""",
    "q_call_edges": f"{_PY} SELECT module, 'order_' || k AS caller, c AS callee FROM s WHERE module % 10 <> 7 AND r < 3 AND c <> 'len'",
    "q_function_pairs": f"{_PY} SELECT module, 'order_' || k AS name, {_by_form(map(_text_sql, _HEADS))} AS prompt, {_by_form(map(_text_sql, _BODIES))} AS completion FROM s WHERE module % 10 <> 7",
    "q_doc_pairs": f"""{_PY} SELECT module, p || ' order.' AS doc, CASE WHEN module % 10 = 7 THEN {_text_sql(_GUESSED[0])} ELSE {_text_sql("def order_{k}(amount):")} END AS signature, CASE WHEN module % 10 <> 7 THEN (above + 1)::INT END AS line FROM s WHERE r = 0
        UNION ALL SELECT module, CASE WHEN module % 10 = 7 THEN {_text_sql(chr(10).join(("Counts.", "", "        Args:", "            amount: how much", "        Returns:", "            int: {p}")))} ELSE {_text_sql(chr(10).join(("Counts.", "", "Args:", "    amount: how much", "Returns:", "    int: {p}")))} END,
        CASE WHEN module % 10 = 7 THEN {_text_sql("def order_{k}(amount):")} ELSE {_text_sql("def order_{k}(amount) -> int:")} END, CASE WHEN module % 10 <> 7 THEN (above + 2)::INT END FROM s WHERE r = 2""",
    "q_comment_pairs": f"""WITH {_orders(SCRIPT)} SELECT module, p || CASE WHEN r = 0 THEN ' order.' ELSE '' END AS doc, CASE WHEN r = 0 THEN {_text_sql("function order_{k}(q, rest): number")} ELSE {_text_sql("function order_{k}(amount)")} END AS signature,
        (above + 1)::INT AS line FROM s WHERE r < 2""",
    "q_code_patterns": f"""{_PATTERNS}, x AS (SELECT *, row_number() OVER (PARTITION BY kind, signature ORDER BY module, line) AS q FROM e)
        SELECT kind, signature, sum(n)::BIGINT AS n, count(DISTINCT module) AS texts, coalesce(string_agg(code, ' | ' ORDER BY q) FILTER (q <= 3), '') AS examples FROM x GROUP BY kind, signature
        UNION ALL SELECT 'total', 'texts', count(DISTINCT module), count(DISTINCT module), '' FROM w UNION ALL SELECT 'total', 'nodes', sum(n)::BIGINT, count(DISTINCT module), '' FROM e WHERE kind = 'subtree'""",
    "q_pattern_comparison": f"""{_PATTERNS}, c AS (SELECT kind, signature, sum(n * (module % 3 = 0)::INT)::BIGINT AS a, sum(n * (module % 3 <> 0)::INT)::BIGINT AS b FROM e GROUP BY kind, signature)
        SELECT kind, signature, a, b, b - a AS delta, round(log2(((b + 1) / (sum(b) OVER (PARTITION BY kind) + count(*) OVER (PARTITION BY kind))) / ((a + 1) / (sum(a) OVER (PARTITION BY kind) + count(*) OVER (PARTITION BY kind)))), 6) AS log_ratio FROM c""",
}
