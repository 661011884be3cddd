"""Seeded rewriting of Python code: variants that mean the same, and variants with one injected bug.

A text is parsed once; edits are placed by the syntax tree, so that strings and comments stay as they are. A local name is renamed where
its own scope alone uses it, to a name that stands nowhere in the text. Every choice comes from the MD5 of key, seed and what is
chosen, so the same key and seed give the same code on any cluster. What no longer parses is not returned: an edit that puts a token
of the same kind, or whole lines, in a text without the marks of UNSURE leaves a text that parses; all others are parsed again.

Defined cases: a null, empty or unparsable text gives no rows; a strategy that finds nothing to do gives the text itself, unchanged; a bug
that finds no place gives no row; a null key counts as the word null; repeated rows give repeated results; other columns are carried through.
"""

from __future__ import annotations

import ast
import builtins
import hashlib
import keyword
import tokenize
import warnings
from collections.abc import Callable
from functools import cached_property
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

VARIANT = "array<struct<strategy:string,code:string,changed:boolean,note:string>>"
BUG = "array<struct<bug:string,code:string,line:int,original:string,modified:string,note:string>>"

# What an operator is mistaken for.
MISTAKEN = {
    "==": ("!=", "<", ">"), "!=": ("==", "<", ">"), "<": ("<=", ">", "=="), ">": (">=", "<", "=="), "<=": ("<", ">", "!="), ">=": (">", "<", "!="),
    "+": ("-", "*"), "-": ("+", "*"), "*": ("+", "//"), "/": ("*", "+"), "//": ("/", "%"), "%": ("+", "*"), "**": ("*", "+"),
    "and": ("or",), "or": ("and",),
}
REMARKS = ("step", "see the caller", "checked", "kept as it is")
DEAD = ("if False:", "    pass")
SCOPES = (ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda, ast.ClassDef, ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp)
FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
BUILTINS = frozenset(dir(builtins))
#: In a text with these, or with a match statement or an f-string, edited code is parsed again: lines that go on in the next one, and page feeds.
UNSURE = (b"\\\n", b"\\\r", b"\x0c")
WORD = frozenset(b"_0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ\"'")
LOOKS = frozenset(("locals", "vars", "eval", "exec", "dir", "globals"))

Edit = tuple[int, int, str]


class Code:
    """A parsed text with byte offsets of its nodes and tokens."""

    def __init__(self, text: str, key: str) -> None:
        self.text, self.key, self.data = text, key, text.encode()
        self.tree = ast.parse(text)
        self.all = _walk(self.tree)
        kinds = {type(x) for x in self.all}
        self.lines = [x.decode() for x in self.data.splitlines(keepends=True)]
        self.starts = list(accumulate((len(x.encode()) for x in self.lines), initial=0))
        self.nodes, self.shown = self.all, frozenset()
        if ast.JoinedStr in kinds:
            inside = {id(x) for f in self.all if isinstance(f, ast.JoinedStr) for x in _walk(f)}
            self.nodes = [x for x in self.all if id(x) not in inside]  # bugs leave f-strings alone
            shown = [f for f in self.all if isinstance(f, ast.FormattedValue) and self.data[self.span(f.value)[1] :].lstrip()[:1] == b"="]
            self.shown = {id(x) for f in shown for x in _walk(f)}  # f"{x=}" prints the name
        self.sure = not kinds & {ast.Match, ast.JoinedStr} and not any(x in self.data for x in UNSURE)

    @cached_property
    def tokens(self) -> list[tuple[int, tokenize.TokenInfo]]:
        feed = iter(self.lines)
        found = [t for t in tokenize.generate_tokens(lambda: next(feed, "")) if t.start[0] <= len(self.lines)]
        if len(self.data) == len(self.text):
            return [(self.starts[t.start[0] - 1] + t.start[1], t) for t in found]
        return [(self.starts[t.start[0] - 1] + len(self.lines[t.start[0] - 1][: t.start[1]].encode()), t) for t in found]

    @cached_property
    def tokenized(self) -> bool:
        try:
            return bool(self.tokens)
        except (SyntaxError, tokenize.TokenError):
            return False

    @cached_property
    def names(self) -> set[str]:
        return {t.string for _, t in self.tokens if t.type == tokenize.NAME} | BUILTINS

    def span(self, node: ast.AST) -> tuple[int, int]:
        return self.starts[node.lineno - 1] + node.col_offset, self.starts[node.end_lineno - 1] + node.end_col_offset

    def between(self, left: ast.AST, right: ast.AST) -> list[tuple[int, str]]:
        lo, hi = self.span(left)[1], self.span(right)[0]
        gap = self.data[lo:hi].decode()
        if (op := gap.strip(" \t()")) in MISTAKEN:
            return [(lo + gap.index(op), op)]
        if not self.tokenized:
            return []
        return [(at, t.string) for at, t in self.tokens if lo <= at < hi and t.string in MISTAKEN]

    def draw(self, n: int, *what) -> int:
        digest = hashlib.md5(":".join([self.key, *map(str, what)]).encode()).hexdigest()  # noqa: S324
        return int(digest[:8], 16) % n

    def edited(self, edits: list[Edit]) -> str | None:
        """The text with edits that don't overlap; none if it no longer parses."""
        out, at = [], 0
        for lo, hi, new in sorted(edits):
            out += [self.data[at:lo], new.encode()]
            at = hi
        code = b"".join([*out, self.data[at:]]).decode()
        return code if (self.sure and all(map(self.stands_alone, edits))) or parses(code) else None

    def stands_alone(self, edit: Edit) -> bool:
        """Whether an edit removes a comment, puts whole lines, or puts a token that touches no other which it could become one with."""
        lo, hi, new = edit
        touching = self.data[max(lo - 1, 0) : lo] + self.data[hi : hi + 1]
        return not new or new.endswith("\n") or not any(x > 127 or x in WORD for x in touching)

    @cached_property
    def places(self) -> list[tuple[int, str]]:
        """Lines (from 0) before which a statement or remark may stand, with their indent: those that begin with a statement after the first of its block."""
        found = []
        for block in (getattr(x, f) for x in self.all for f in ("body", "orelse", "finalbody") if isinstance(getattr(x, f, None), list)):
            for s in block[1:]:
                line = min([s.lineno, *(d.lineno for d in getattr(s, "decorator_list", []))]) - 1
                head = self.lines[line]
                indent = head[: len(head) - len(head.lstrip(" \t"))]
                own = len(indent.encode()) == s.col_offset and (line != s.lineno - 1 or not head[: s.col_offset].strip())
                after_future = not (isinstance(s, ast.ImportFrom) and s.module == "__future__")
                previous = self.lines[line - 1].rstrip("\r\n") if line else ""
                if own and after_future and not previous.endswith("\\"):
                    found.append((line, indent))
        return sorted(set(found))


def parses(code: str) -> bool:
    try:
        ast.parse(code)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False
    return True


def parsed(text: str | None, key: str) -> Code | None:
    try:
        return Code(text, key) if text else None
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def _children(node: ast.AST) -> list[ast.AST]:
    """The nodes below one that have fields themselves, in their order; found once and kept with it."""
    found = node.__dict__.get("_below")
    if found is None:
        found = []
        for x in node.__dict__.values():
            if x.__class__ is list:
                found += [y for y in x if isinstance(y, ast.AST) and y._fields]
            elif x.__class__ is not int and isinstance(x, ast.AST) and x._fields:
                found.append(x)
        node._below = found
    return found


def _walk(node: ast.AST) -> list[ast.AST]:
    """The nodes of ast.walk that have fields, in its order."""
    out = [node]
    for x in out:
        out += _children(x)
    return out


def _own(node: ast.AST) -> list[ast.AST]:
    """Nodes of a scope, and the roots of those inside it."""
    out, left = [], _children(node)[::-1]
    while left:
        x = left.pop()
        out.append(x)
        if not isinstance(x, SCOPES):
            left += _children(x)[::-1]
    return out


def local_names(function: ast.AST) -> dict[str, list[ast.Name]]:
    """Names that a function assigns and that nothing but Name nodes of its own body uses, with these nodes in order."""
    used: dict[str, list[ast.Name]] = {}
    refused = {a.arg for a in _walk(function.args) if isinstance(a, ast.arg)}
    assigned = set()
    for part in function.body:
        for x in [part, *(() if isinstance(part, SCOPES) else _own(part))]:
            if isinstance(x, SCOPES):
                refused |= {n.id for n in _walk(x) if isinstance(n, ast.Name)} | {getattr(x, "name", "")} | {n for g in _walk(x) if isinstance(g, ast.Global | ast.Nonlocal) for n in g.names}
            elif isinstance(x, ast.Name):
                used.setdefault(x.id, []).append(x)
                assigned |= {x.id} if isinstance(x.ctx, ast.Store) else set()
            elif isinstance(x, ast.Global | ast.Nonlocal):
                refused |= set(x.names)
            elif isinstance(x, ast.alias):
                refused.add((x.asname or x.name).split(".")[0])
            else:
                refused |= {n for n in (getattr(x, "name", None), getattr(x, "rest", None)) if isinstance(n, str)}
    if LOOKS & (used.keys() | refused):
        return {}
    return {n: used[n] for n in sorted(assigned - refused) if not n.startswith("__")}


def _rename(c: Code) -> tuple[list[Edit], str]:
    edits, told, taken = [], [], set(c.names)
    for f in (x for x in c.all if isinstance(x, FUNCTIONS)):
        for name, nodes in local_names(f).items():
            if any(id(n) in c.shown for n in nodes):
                continue
            new = f"{name}_{c.draw(16**4, 'rename', f.name, name):04x}"
            while new in taken or keyword.iskeyword(new):
                new += "_"
            taken.add(new)
            told.append(f"{name}>{new}")
            edits += [(*c.span(n), new) for n in nodes]
    return edits, ",".join(told)


def _uncomment(c: Code) -> tuple[list[Edit], str]:
    edits = []
    for at, t in c.tokens:
        row = t.start[0] - 1
        if t.type != tokenize.COMMENT or (row < 2 and (t.string.startswith("#!") or "coding" in t.string)):
            continue
        head = c.lines[row][: t.start[1]]
        whole = not head.strip()
        lo = c.starts[row] if whole else at - len(head.encode()) + len(head.rstrip().encode())
        edits.append((lo, c.starts[row + 1] if whole else at + len(t.string.encode()), ""))
    return edits, f"{len(edits)} removed"


def _inserted(c: Code, what: str, lines: Callable[[], tuple[str, ...]]) -> tuple[list[Edit], str]:
    places = c.places
    if not places:
        return [], ""
    line, indent = places[c.draw(len(places), what)]
    end = "\r\n" if c.lines[line].endswith("\r\n") else "\n"
    new = "".join(f"{indent if x else ''}{x}{end}" for x in lines())
    return [(c.starts[line], c.starts[line], new)], f"before line {line + 1}"


def _remark(c: Code) -> tuple[list[Edit], str]:
    return _inserted(c, "comment_add", lambda: (f"# {REMARKS[c.draw(len(REMARKS), 'remark')]}",))


def _space(c: Code) -> tuple[list[Edit], str]:
    return _inserted(c, "whitespace_vary", lambda: ("",) * (1 + c.draw(2, "blank")))


def _dead(c: Code) -> tuple[list[Edit], str]:
    return _inserted(c, "dead_code_insert", lambda: DEAD)


def _imports(c: Code) -> tuple[list[Edit], str]:
    """Sorts each run of whole-line plain imports of a module's top level, which bind different names."""
    edits, run = [], []
    for s in [*c.tree.body, None]:
        plain = isinstance(s, ast.Import) and s.lineno == s.end_lineno and c.lines[s.lineno - 1].strip() == ast.get_source_segment(c.text, s)
        if plain and (not run or run[-1].lineno + 1 == s.lineno):
            run.append(s)
            continue
        texts = [c.lines[x.lineno - 1].strip() for x in run]
        bound = [(a.asname or a.name).split(".")[0] for x in run for a in x.names]
        if sorted(texts) != texts and len(set(bound)) == len(bound):
            edits += [(*c.span(x), t) for x, t in zip(run, sorted(texts), strict=True)]
        run = [s] if plain else []
    return edits, f"{len(edits)} sorted"


STRATEGIES = {"variable_rename": _rename, "comment_remove": _uncomment, "comment_add": _remark, "whitespace_vary": _space, "import_reorder": _imports, "dead_code_insert": _dead}


def variants(text: str | None, key: str) -> list[dict]:
    c = parsed(text, key)
    out = []
    for name, f in STRATEGIES.items() if c and c.tokenized else ():
        edits, note = f(c)
        code = c.edited(edits) if edits else None
        changed = code is not None and code != text
        out.append({"strategy": name, "code": code if changed else text, "changed": changed, "note": note if changed else ""})
    return out


def _numbers(c: Code) -> list[ast.Constant]:
    return [x for x in c.nodes if isinstance(x, ast.Constant) and type(x.value) is int]


def _off_by_one(c: Code) -> list[list[Edit]]:
    return [[(*c.span(x), str(x.value + d))] for x in _numbers(c) for d in (1, -1) if x.value + d >= 0]


def _wrong_operator(c: Code) -> list[list[Edit]]:
    sides = []
    for x in c.nodes:
        if isinstance(x, ast.Compare):
            sides += list(zip([x.left, *x.comparators], x.comparators, strict=False))
        elif isinstance(x, ast.BoolOp):
            sides += list(zip(x.values, x.values[1:], strict=False))
        elif isinstance(x, ast.BinOp):
            sides.append((x.left, x.right))
    return [[(at, at + len(op), new)] for pair in sides for at, op in c.between(*pair)[:1] for new in MISTAKEN[op]]


def _missing_return(c: Code) -> list[list[Edit]]:
    return [[(*c.span(x), "pass")] for x in c.nodes if isinstance(x, ast.Return) and x.value is not None]


def _wrong_variable(c: Code) -> list[list[Edit]]:
    out, seen = [], {id(x) for x in c.nodes}
    for f in (x for x in c.all if isinstance(x, FUNCTIONS)):
        known = sorted({a.arg for a in _walk(f.args) if isinstance(a, ast.arg)} | set(local_names(f)))
        loads = [x for s in f.body if not isinstance(s, SCOPES) for x in [s, *_own(s)] if isinstance(x, ast.Name) and isinstance(x.ctx, ast.Load) and x.id in known and id(x) in seen]
        out += [[(*c.span(x), other)] for x in loads for other in known if other != x.id]
    return out


def _type_error(c: Code) -> list[list[Edit]]:
    swapped = {True: "False", False: "True"}
    flags = [x for x in c.nodes if isinstance(x, ast.Constant) and type(x.value) is bool]
    return [[(*c.span(x), f'"{x.value}"')] for x in _numbers(c)] + [[(*c.span(x), swapped[x.value])] for x in flags]


BUGS = {"off_by_one": _off_by_one, "wrong_operator": _wrong_operator, "missing_return": _missing_return, "wrong_variable": _wrong_variable, "type_error": _type_error}


def bugs(text: str | None, key: str) -> list[dict]:
    """One bug of each kind, at a place drawn from all places in the order of the text."""
    c = parsed(text, key)
    out = []
    for name, f in BUGS.items() if c else ():
        choices = sorted(f(c))
        edit = choices[c.draw(len(choices), name)] if choices else None
        code = c.edited(edit) if edit else None
        if code is None:
            continue
        (lo, hi, new), = edit
        line = next(k for k, s in enumerate(c.starts) if s > lo) - 1
        old = c.data[lo:hi].decode()
        original = c.lines[line].rstrip("\r\n")
        before = c.data[c.starts[line] : lo].decode()
        rest = c.data[hi : max(hi, c.starts[line + 1])].decode().split("\n")[0].rstrip("\r")
        out.append({"bug": name, "code": code, "line": line + 1, "original": original, "modified": before + new + rest, "note": f"{old} became {new}"})
    return out


def _rows(docs: DataFrame, of: Callable[[str | None, str], list[dict]], schema: str, id_col: str, text_col: str, seed: int) -> DataFrame:
    def run(texts: pd.Series, keys: pd.Series) -> pd.Series:
        with warnings.catch_warnings():  # of the texts' own syntax
            warnings.simplefilter("ignore")
            return pd.Series([of(t, k) for t, k in zip(texts, keys, strict=True)], dtype=object)

    key = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(f":{seed}"))
    kept = [c for c in docs.columns if c != text_col]
    held = docs.where(F.length(text_col) > 0).withColumn("_found", pandas_udf(run, schema)(F.col(text_col), key))
    # outer, as a plain explode would have Spark call the function once more for a filter on empty arrays
    return held.select(*kept, F.explode_outer("_found").alias("_r")).where("_r IS NOT NULL").select(*kept, "_r.*")


def augmented(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42) -> DataFrame:
    """docs without their text, a row for each strategy: strategy, code, changed, note."""
    return _rows(docs, variants, VARIANT, id_col, text_col, seed)


def with_bugs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42) -> DataFrame:
    """docs without their text, a row for each kind of bug that finds a place: bug, code, line, original and modified line, note."""
    return _rows(docs, bugs, BUG, id_col, text_col, seed)
