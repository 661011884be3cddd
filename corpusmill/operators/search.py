"""TF-IDF search, weighted keyword domains, per-line safety rules."""

from __future__ import annotations

import ast
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from corpusmill.functions.text import let, lines_univ, text_or_empty
from corpusmill.session import small_side, written

# The patterns by which a domain is recognised: of imports (in any case), of keywords, and the domain's weight.
DOMAINS = {
    "react": (
        (r"from\s+['\"]react['\"]", r"import\s+React", r"from\s+['\"]react-dom['\"]", r"from\s+['\"]@radix-ui", r"from\s+['\"]@headlessui"),
        (r"useState\s*\(", r"useEffect\s*\(", r"useRef\s*\(", r"useMemo\s*\(", r"useCallback\s*\(", r"<[A-Z][a-zA-Z]*", r"React\.FC", r"React\.Component", r"className=", r"onClick=", r"jsx|tsx"),
        1.0,
    ),
    "nextjs": (
        (r"from\s+['\"]next/", r"from\s+['\"]next['\"]", r"import\s+.*\s+from\s+['\"]next/"),
        (r"getServerSideProps", r"getStaticProps", r"getStaticPaths", r"NextPage", r"NextApiRequest", r"NextApiResponse", r"useRouter\s*\(", r"next\.config", r"middleware\.ts", r"app/.*/(page|layout|loading|error)\.(tsx?|jsx?)"),
        1.2,
    ),
    "graphql": (
        (r"from\s+['\"]graphql['\"]", r"from\s+['\"]@apollo", r"from\s+['\"]urql", r"from\s+['\"]graphql-tag", r"from\s+['\"]@graphql-codegen"),
        (r"gql\s*`", r"type\s+Query\s*\{", r"type\s+Mutation\s*\{", r"type\s+Subscription\s*\{", r"@Resolver", r"@Query\s*\(", r"@Mutation\s*\(", r"GraphQLSchema", r"GraphQLObjectType", r"useQuery\s*\(", r"useMutation\s*\("),
        1.3,
    ),
    "prisma": (
        (r"from\s+['\"]@prisma/client['\"]", r"from\s+['\"]prisma['\"]"),
        (r"PrismaClient", r"prisma\.\w+\.(findMany|findUnique|create|update|delete)", r"model\s+\w+\s*\{", r"@@map", r"@@index", r"datasource\s+db", r"generator\s+client"),
        1.3,
    ),
    "zod": (
        (r"from\s+['\"]zod['\"]", r"import\s+.*z\s+from\s+['\"]zod['\"]", r"import\s+\{\s*z\s*\}\s+from\s+['\"]zod['\"]"),
        (r"z\.object\s*\(", r"z\.string\s*\(", r"z\.number\s*\(", r"z\.array\s*\(", r"z\.enum\s*\(", r"z\.union\s*\(", r"z\.infer\s*<", r"\.parse\s*\(", r"\.safeParse\s*\("),
        1.2,
    ),
    "testing": (
        (r"from\s+['\"]jest['\"]", r"from\s+['\"]vitest['\"]", r"from\s+['\"]@testing-library", r"from\s+['\"]mocha['\"]", r"from\s+['\"]chai['\"]", r"from\s+['\"]supertest['\"]"),
        (r"describe\s*\(", r"it\s*\(", r"\btest\s*\(", r"expect\s*\(", r"beforeEach\s*\(", r"afterEach\s*\(", r"beforeAll\s*\(", r"afterAll\s*\(", r"jest\.mock\s*\(", r"vi\.mock\s*\(", r"\.test\.(ts|tsx|js|jsx)$", r"\.spec\.(ts|tsx|js|jsx)$"),
        1.0,
    ),
}
SEVERITIES = ("safe", "low", "medium", "high", "critical")
# Rules on a line, with their severity.
RULES = {
    "eval_call": (r"\beval\s*\(", "critical"),
    "exec_call": (r"\bexec\s*\(", "critical"),
    "compile_call": (r"\bcompile\s*\(", "high"),
    "dunder_import": (r"__import__\s*\(", "high"),
    "os_system": (r"\bos\.system\s*\(", "critical"),
    "os_popen": (r"\bos\.popen\s*\(", "critical"),
    "subprocess_call": (r"\bsubprocess\.(?:call|run|Popen|check_output|check_call)\s*\(", "high"),
    "shutil_rmtree": (r"\bshutil\.rmtree\s*\(", "high"),
    "os_remove": (r"\bos\.remove\s*\(", "medium"),
    "os_unlink": (r"\bos\.unlink\s*\(", "medium"),
    "hardcoded_secret": (r"""(?i)(?:api_key|apikey|secret|password|token|passwd|pwd)\s*=\s*["'][^"']{8,}["']""", "high"),
    "token_literal": (r"(?:sk-|ghp_|glpat-|xoxb-|xoxp-)[a-zA-Z0-9]{10,}", "critical"),
    "while_true": (r"\bwhile\s+True\s*:", "low"),
    "socket_use": (r"\bsocket\.", "low"),
    "urllib_fetch": (r"\burllib\.request\b|\burllib\.urlopen\b", "low"),
    "requests_call": (r"\brequests\.(get|post|put|delete|patch|head)\s*\(", "low"),
    "httpx_call": (r"\bhttpx\.(get|post|put|delete|patch|head|AsyncClient)\b", "low"),
    "pickle_load": (r"\bpickle\.loads?\s*\(", "high"),
    "yaml_load_unsafe": (r"\byaml\.(?:load|unsafe_load)\s*\(", "medium"),
}
#: The rule that needs a syntax tree.
ENDLESS = ("infinite_loop_no_break", "medium")


def terms(text: Column) -> Column:
    """Small words of at least two ASCII letters, digits or underscores, not all digits, with camel case split."""
    split = F.regexp_replace(text_or_empty(text), "([a-z])([A-Z])", "$1 $2")
    return F.filter(F.split(F.lower(split), r"[^a-zA-Z0-9_]+"), lambda w: (F.length(w) >= 2) & ~w.rlike("^[0-9]+$"))


def _spread(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, n (terms of the document), term: one row for each occurrence."""
    return docs.select(id_col, let(terms(F.col(text_col)), lambda t: F.struct(t.alias("t"), F.size(t).alias("n"))).alias("x")).select(id_col, "x.n", F.explode("x.t").alias("term"))


def _weighted(postings: DataFrame, n: int) -> DataFrame:
    return postings.groupBy("term").agg((F.log((1.0 + n) / (1.0 + F.count("*"))) + 1.0).alias("idf"))


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """postings (id, term, tf) and terms (term, idf), written. tf is the share of the document's terms."""
    postings = written(_spread(docs, id_col, text_col).groupBy(id_col, "term", "n").agg((F.count("*") / F.col("n")).alias("tf")).select(id_col, "term", "tf"))
    return postings, written(_weighted(postings, docs.count()))


def search(docs: DataFrame, queries: DataFrame, k: int, id_col: str = "doc_id", query_id: str = "item_id", text_col: str = "text") -> DataFrame:
    """query_id, id, score, rank: the k best documents of each query by summed tf x idf over its different terms.

    Only occurrences of asked terms leave the scan of the documents.
    """
    asked = written(queries.select(query_id, F.explode(F.array_distinct(terms(F.col(text_col)))).alias("term")))
    wanted = small_side(written(asked.select("term").distinct()))
    postings = _spread(docs, id_col, text_col).join(wanted, "term").groupBy(id_col, "term", "n").agg((F.count("*") / F.col("n")).alias("tf"))
    postings = written(postings.select(id_col, "term", "tf"))
    weighted = written(asked.join(_weighted(postings, docs.count()), "term"))
    scores = postings.join(small_side(weighted), "term").groupBy(query_id, id_col).agg(F.round(F.sum(F.col("tf") * F.col("idf")), 9).alias("score"))
    w = Window.partitionBy(query_id).orderBy(F.desc("score"), id_col)
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def domains(docs: DataFrame, id_col: str, text_col: str, rules: dict | None = None) -> DataFrame:
    """id, domain, confidence: three points for each import, one for each keyword, times the domain's weight, over all points.

    The first of equal domains; general, with confidence 1, without any point, and with .5 if the best is below .15.
    """
    text, rules = text_or_empty(F.col(text_col)), rules or DOMAINS
    count = lambda p: F.regexp_count(text, F.lit(f"(?d){p}"))
    points = {d: (3 * sum((count(f"(?i){p}") for p in imports), F.lit(0)) + sum((count(p) for p in words), F.lit(0))) * weight for d, (imports, words, weight) in rules.items()}
    scored = docs.select(id_col, F.array(*[F.struct(p.alias("points"), F.lit(-k).alias("k"), F.lit(d).alias("domain")) for k, (d, p) in enumerate(points.items())]).alias("s"))
    top = scored.select(id_col, F.array_max("s").alias("top"), F.aggregate("s", F.lit(0.0), lambda a, x: a + x["points"]).alias("n"))
    share = F.coalesce(F.try_divide("top.points", "n"), F.lit(0.0))
    return top.select(id_col, F.when(share < 0.15, "general").otherwise(F.col("top.domain")).alias("domain"),
                      F.when(F.col("n") == 0, 1.0).when(share < 0.15, 0.5).otherwise(share).alias("confidence"))


def endless_loops(source: str) -> list[int]:
    """Lines of `while True` loops without a break, where the text is Python."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    loops = [n for n in ast.walk(tree) if isinstance(n, ast.While) and isinstance(n.test, ast.Constant) and n.test.value is True]
    return sorted({n.lineno for n in loops if not any(isinstance(x, ast.Break) for x in ast.walk(n))})


@F.pandas_udf(ArrayType(IntegerType()))
def _endless_lines(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(endless_loops)


def _endless(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, lines of endless loops; only texts with such a loop's first words reach Python."""
    return docs.where(F.col(text_col).rlike(r"while\s+\(?\s*True")).select(id_col, _endless_lines(text_col).alias("lines")).where(F.size("lines") > 0)


def findings(docs: DataFrame, id_col: str, text_col: str, rules: dict | None = None) -> DataFrame:
    """id, line (from 1), rule, severity: once for each rule and line. Rules are matched in the scan, without a join."""
    rules = rules or RULES
    hit = lambda x: F.filter(F.array(*[F.when(x.rlike(p), F.lit(n)) for n, (p, _) in rules.items()]), lambda r: r.isNotNull())
    lines = docs.select(id_col, F.posexplode(F.transform(lines_univ(text_or_empty(F.col(text_col))), hit)).alias("k", "rules"))
    severity = F.from_json(F.lit(json.dumps({n: s for n, (_, s) in rules.items()})), "map<string,string>")
    found = lines.select(id_col, (F.col("k") + 1).alias("line"), F.explode("rules").alias("rule")).withColumn("severity", severity[F.col("rule")])
    tree = _endless(docs, id_col, text_col).select(id_col, F.explode("lines").alias("line"), F.lit(ENDLESS[0]).alias("rule"), F.lit(ENDLESS[1]).alias("severity"))
    return found.unionByName(tree)


def safety_gate(docs: DataFrame, id_col: str, text_col: str, block_on: str = "medium", rules: dict | None = None) -> DataFrame:
    """id, worst (safe without findings), passed: nothing as severe as block_on."""
    level = {s: k for k, s in enumerate(SEVERITIES)}
    text = text_or_empty(F.col(text_col))
    lines = lines_univ(text)
    # a rule is looked for line by line only where the text has its pattern at all
    by_line = lambda p: text.rlike(p) & F.exists(lines, lambda x: x.rlike(p))
    loop = F.when(text.rlike(r"while\s+\(?\s*True"), F.size(_endless_lines(text)) > 0).otherwise(False)
    rows = docs.select(id_col, F.greatest(F.lit(0), *[F.when(by_line(p), level[s]).otherwise(0) for p, s in (rules or RULES).values()]).alias("_w"), loop.alias("_loop"))
    worst = F.greatest("_w", F.when(F.col("_loop"), level[ENDLESS[1]]).otherwise(0))
    return rows.select(id_col, F.get(F.array(*[F.lit(s) for s in SEVERITIES]), worst).alias("worst"), (worst < level[block_on]).alias("passed"))
