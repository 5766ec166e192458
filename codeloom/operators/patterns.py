"""Structural search: $X stands for one node, $$$X for any number of siblings. Python by its own trees, all other
languages by token trees (trees.py)."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.predicates import canonical_language, search_language
from codeloom.operators import trees
from codeloom.operators.trees import InvalidPattern, TooComplex

SHOWN, STEPS = 100, 100_000
RELATIONS = ("inside", "has", "precedes", "follows")
SCHEMA = "file string, kind string, text string, start_line int, start_col int, end_line int, end_col int, captures map<string,string>, start_byte long, end_byte long, problem string"
_ONE, _MANY = "loomone_", "loommany_"


def check_pattern(pattern: str, lang: str) -> None:
    """Raises InvalidPattern for what is no pattern in the language."""
    try:
        compile_pattern(pattern) if lang == "python" else trees.compile_pattern(pattern, lang)
    except (SyntaxError, ValueError) as e:
        raise InvalidPattern(str(e)) from e


def compile_pattern(pattern: str) -> ast.AST:
    """The tree of a pattern of Python: an expression, or one statement."""
    text = re.sub(r"\$\$\$(\w+)", rf"{_MANY}\1", pattern)
    text = re.sub(r"\$(\w+)", rf"{_ONE}\1", text)
    body = ast.parse(text).body
    if len(body) != 1:
        raise ValueError("a pattern is one expression or statement")
    return body[0].value if isinstance(body[0], ast.Expr) else body[0]


def atoms(pattern: str) -> list[str]:
    """Words that any match must hold: a text without one of them needs no parsing."""
    return sorted(set(re.findall(r"\w{2,}", re.sub(r"\$+\w+", " ", pattern))))


def _name(node) -> str | None:
    node = node.value if isinstance(node, ast.Expr) else node
    name = node.id if isinstance(node, ast.Name) else node.arg if isinstance(node, (ast.arg, ast.keyword)) and node.arg else None
    return name if name and name.startswith((_ONE, _MANY)) else None


class Match:
    def __init__(self, text: str):
        self.text, self.steps = text, 0

    def source(self, node) -> str:
        return ast.get_source_segment(self.text, node) or (node if isinstance(node, str) else "")

    def node(self, p, n, caught: dict) -> dict | None:
        self.steps += 1
        if self.steps > STEPS:
            raise TooComplex("pattern_too_complex")
        if isinstance(p, ast.AST) and (name := _name(p)) and name.startswith(_ONE):
            return caught | {name[len(_ONE) :]: self.source(n)} if isinstance(n, ast.AST) else None
        if isinstance(p, str) and p.startswith(_ONE) and isinstance(n, str):
            return caught | {p[len(_ONE) :]: n}
        if isinstance(p, list):
            return self.siblings(p, n, caught) if isinstance(n, list) else None
        if not isinstance(p, ast.AST):
            return caught if p == n and type(p) is type(n) else None
        if type(p) is not type(n):
            return None
        for f in p._fields:
            if f in ("ctx", "type_comment", "kind"):
                continue
            caught = self.node(getattr(p, f, None), getattr(n, f, None), caught)
            if caught is None:
                return None
        return caught

    def siblings(self, ps: list, ns: list, caught: dict) -> dict | None:
        if not ps:
            return caught if not ns else None
        name = _name(ps[0])
        if name and name.startswith(_MANY):
            for k in range(len(ns) + 1):
                rest = self.siblings(ps[1:], ns[k:], caught | {name[len(_MANY) :]: ", ".join(map(self.source, ns[:k]))})
                if rest is not None:
                    return rest
            return None
        if not ns or (first := self.node(ps[0], ns[0], caught)) is None:
            return None
        return self.siblings(ps[1:], ns[1:], first)


def _related(node, parents: dict, order: dict, relations: dict[str, str]) -> bool:
    for way, kind in relations.items():
        if way == "inside":
            at, ok = parents.get(node), False
            while at is not None and not ok:
                ok, at = type(at).__name__ == kind, parents.get(at)
        elif way == "has":
            ok = any(type(x).__name__ == kind for x in ast.walk(node) if x is not node)
        else:
            around, i = order.get(node, ([], 0))
            ok = any(type(x).__name__ == kind for x in (around[i + 1 :] if way == "precedes" else around[:i]))
        if not ok:
            return False
    return True


def search_text(pattern: str, text: str, relations: dict[str, str] | None = None, lang: str = "python") -> list[dict]:
    """Matches in reading order; a name that repeats in a pattern takes its last value."""
    if lang != "python":
        return trees.search(lang, pattern, text, relations)
    wanted = compile_pattern(pattern)
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return []
    starts = [0]
    for line in text.split("\n"):
        starts.append(starts[-1] + len(line.encode()) + 1)
    parents, order = {}, {}
    for p in ast.walk(tree):
        for _, v in ast.iter_fields(p):
            around = [x for x in v if isinstance(x, ast.AST)] if isinstance(v, list) else [v] if isinstance(v, ast.AST) else []
            for i, c in enumerate(around):
                parents[c], order[c] = p, (around, i)
    out, match = [], Match(text)
    for n in ast.walk(tree):
        if type(n) is type(wanted) and hasattr(n, "lineno"):
            caught = match.node(wanted, n, {})
            if caught is not None and _related(n, parents, order, relations or {}):
                at = {"start_byte": starts[n.lineno - 1] + n.col_offset, "end_byte": starts[n.end_lineno - 1] + n.end_col_offset}
                out.append({"kind": type(n).__name__, "text": ast.get_source_segment(text, n), "start_line": n.lineno, "start_col": n.col_offset, "end_line": n.end_lineno, "end_col": n.end_col_offset, "captures": caught, **at})
    return sorted(out, key=lambda m: (m["start_byte"], -m["end_byte"]))


def literal_atoms(pattern: str, lang: str) -> list[str]:
    return atoms(pattern) if lang == "python" else trees.atoms(pattern)


def constrained(captures: dict[str, str], constraints: dict[str, str]) -> bool:
    """Regular expressions on captures, unanchored; a leading ! turns one round."""
    return all((re.search(c.removeprefix("!"), captures.get(k, "")) is None) == c.startswith("!") for k, c in constraints.items())


_COLUMNS = [c.split()[0] for c in SCHEMA.replace("map<string,string>", "x").split(", ")]


def search(sources: DataFrame, pattern: str, relations: dict[str, str] | None = None, constraints: dict[str, str] | None = None, lang: str = "python") -> DataFrame:
    """Matches in (path, text): texts that lack one of the pattern's words are dropped on the JVM, before any parser. A
    text that takes too many steps gives one row with a problem."""
    check_pattern(pattern, lang)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for p, t in zip(f.path, f.text, strict=True):
                try:
                    rows += [{"file": p, **m} for m in search_text(pattern, t, relations, lang) if constrained(m["captures"], constraints or {})]
                except TooComplex as e:
                    rows.append({"file": p, "problem": str(e)})
            out = pd.DataFrame(rows, columns=_COLUMNS)
            for c in ("start_line", "start_col", "end_line", "end_col", "start_byte", "end_byte"):
                out[c] = out[c].astype("Int64")
            yield out.astype(object).where(out.notna(), None)

    for a in literal_atoms(pattern, lang):
        sources = sources.filter(F.col("text").contains(a))
    return sources.filter("text is not null").select("path", "text").mapInPandas(run, SCHEMA)


def languages_of(paths: list[str]) -> list[str]:
    return sorted({lang for p in paths if (lang := search_language(p))})


def search_all(sources: DataFrame, pattern: str, relations: dict[str, str] | None = None, language: str | None = None) -> DataFrame:
    """Matches in (path, text, lang), each file in its own language, or in those of one language only. A pattern that is
    none in a language finds nothing there; one that is none in any raises InvalidPattern."""
    wanted = [canonical_language(language)] if language else sorted(r.lang for r in sources.select("lang").dropna().distinct().collect())
    if None in wanted:
        raise InvalidPattern(f"unknown language {language}")
    found, problem = [], None
    for lang in wanted:
        try:
            kept = F.col("lang").isin("typescript", "tsx") if lang == "typescript" and language else F.col("lang") == lang
            found.append(search(sources.filter(kept), pattern, relations, None, lang))
        except InvalidPattern as e:
            problem = e
    if not found and problem:
        raise problem
    return reduce(DataFrame.unionByName, found) if found else sources.sparkSession.createDataFrame([], SCHEMA)


def plan_rewrites(text: str, matches: list[dict], template: str | None = None) -> tuple[str, int]:
    """(the rewritten text, how many): the first of overlapping matches wins, adjacent ones are both taken; ${X}, $X and
    $$$X take captures. Without a template each match has its own (key rewrite)."""
    raw, out, at, n = text.encode(), [], 0, 0
    for m in sorted(matches, key=lambda m: (m["start_byte"], m["end_byte"])):
        if m["start_byte"] < at:
            continue
        shape = template if template is not None else m["rewrite"]
        out += [raw[at : m["start_byte"]], re.sub(r"(?:\$\$)?\$\{?(\w+)\}?", lambda g: m["captures"].get(g[1], g[0]), shape).encode()]
        at, n = m["end_byte"], n + 1
    return b"".join([*out, raw[at:]]).decode(), n
