"""Other languages, by a scanner over comment- and string-free text.

Approximate: declarations, supertypes, imports, calls and control flow by pattern; a body ends at its matching brace,
or where the indentation falls back in languages without braces.
"""

from __future__ import annotations

import re

from codeloom.schema import ENTITY, SYMBOL

_HASH = {"ruby", "bash", "elixir", "python"}
_NO_BRACES = {"ruby": r"^\s*end\b", "lua": r"^\s*end\b", "elixir": r"^\s*end\b", "bash": r"^\s*(?:\}|done|fi|esac)"}
_TYPE = re.compile(r"\b(class|interface|trait|struct|enum|protocol|module|contract|object|record|impl)\s+(?:[A-Za-z_]\w*(?:<[^>]*>)?\s+for\s+)?([A-Za-z_]\w*)([^{;\n]*)")
_FUNCTION = re.compile(r"\b(?:func|fn|def|fun|function|defp|sub|local function)\s+(?:\([^)]*\)\s*)?(?:self\.)?([A-Za-z_][\w.:]*[?!]?)\s*(?:<[^>]*>)?\s*\(?|\b(?:public|private|protected|internal|static|final|override|async|virtual|abstract|\s)+[\w<>\[\],.?]+\s+([A-Za-z_]\w*)\s*\([^;{)]*\)\s*(?:throws\s+[\w.,\s]+)?\{|\b(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?(?:\([^)]*\)|[A-Za-z_$][\w$]*)\s*=>")
_IMPORT = re.compile(r"^\s*(?:import\s+(?:static\s+)?(?:[\w*{},\s$]+\s+from\s+)?[\"']?([\w./@:\-*]+)[\"']?|use\s+([\w:\\]+)|using\s+(?:static\s+)?([\w.]+)\s*;|require(?:_relative)?[\s(]+[\"']([^\"']+)[\"']|#include\s+[\"<]([^\">]+)[\">]|alias\s+([\w.]+)|source\s+([\w./]+))", re.M)
_CALL = re.compile(r"(?<![\w.:])((?:[A-Za-z_$][\w$]*(?:\.|::|->))*[A-Za-z_$][\w$]*[!?]?)\s*\(")
_FLOW = re.compile(r"\b(if|elif|elsif|for|foreach|while|until|switch|case|match|when|catch|rescue|return|break|continue|unless|try)\b")
_WORDS = {"if", "for", "while", "switch", "catch", "return", "function", "func", "fn", "def", "match", "when", "foreach", "sizeof", "elif", "until", "unless", "fun", "with", "new", "super", "and", "or", "not", "in"}


def blank(lang: str, text: str) -> str:
    """The text with comments and strings as spaces, of the same length."""
    line = r"#[^\n]*" if lang in _HASH else r"--[^\n]*" if lang in ("lua", "haskell") else r"//[^\n]*"
    pattern = re.compile(rf"/\*.*?(?:\*/|$)|{line}|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S)
    keep = lambda m: m[0] if re.match(r"[\"'`]", m[0]) and re.search(r"(?:import|from|require(?:_relative)?|#include|source|use)[\s(]*$", text[max(0, m.start() - 24) : m.start()]) else re.sub(r"[^\n]", " ", m[0])
    return pattern.sub(keep, text)


def _end(lang: str, text: str, at: int) -> int:
    """Behind the body that begins after at."""
    if lang in _NO_BRACES:
        start = text.rfind("\n", 0, at) + 1
        indent = len(text[start:]) - len(text[start:].lstrip(" \t"))
        for m in re.finditer(_NO_BRACES[lang], text[at:], re.M):
            if len(m[0].lstrip("\n")) - len(m[0].strip()) <= indent:
                return at + m.end()
        return len(text)
    brace, semi = text.find("{", at), text.find(";", at)
    if brace < 0 or 0 <= semi < brace:
        return semi + 1 if semi >= 0 else text.find("\n", at) if "\n" in text[at:] else len(text)
    depth = 0
    for m in re.finditer(r"[{}]", text[brace:]):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return brace + m.end()
    return len(text)


def extract(lang: str, text: str) -> tuple[list[dict], list[dict], str | None]:
    bare = blank(lang, text)
    breaks = [i for i, c in enumerate(text) if c == "\n"]
    import bisect

    def span(a: int, b: int) -> dict:
        la, lb = bisect.bisect_left(breaks, a), bisect.bisect_left(breaks, b)
        col = lambda p, n: p - (breaks[n - 1] + 1 if n else 0)
        return {"start_byte": len(text[:a].encode()), "end_byte": len(text[:b].encode()), "start_line": la + 1, "start_col": col(a, la), "end_line": lb + 1, "end_col": col(b, lb)}

    found: list[tuple[int, int, str, str, dict]] = []
    types, functions = [], []
    for m in _TYPE.finditer(bare):
        kind = "interface" if m[1] in ("interface", "trait", "protocol") or m[1] == "module" and lang == "ruby" else "class"
        end = _end(lang, bare, m.end())
        types.append((m.start(), end, m[2]))
        if m[1] != "impl":
            found.append((m.start(), end, kind, m[2], {}))
        for word, kind_ in re.findall(r"\b(extends|implements|:|<|for)\s*([\w.,\s<>]+)", m[3]):
            for i, sup in enumerate(re.split(r"\s*,\s*", re.sub(r"<[^>]*>", "", kind_).strip())):
                if name := sup.strip().split(" ")[0]:
                    rel = "implements" if word == "implements" or word == ":" and (i or re.match("I[A-Z]", name)) else "extends"
                    found.append((m.start(), m.end(), rel, name, {"enclosing_function": m[2]}))
    for m in _FUNCTION.finditer(bare):
        name = m[1] or m[2] or m[3]
        if name and name not in _WORDS:
            end = _end(lang, bare, m.end() - (bare[m.end() - 1] == "{"))
            functions.append((m.start(), end, name))
            found.append((m.start(), end, "function", name, {"is_async": "async" in m[0] or "suspend" in bare[max(0, m.start() - 10) : m.start()], "body": text[m.start() : end], "is_test": bool(re.search(r"#\[(?:\w+::)*(?:test|rstest)\]\s*(?:pub\s+|async\s+)*$", text[max(0, m.start() - 80) : m.start()]))}))
    for m in _IMPORT.finditer(bare):
        if name := next(filter(None, m.groups()), None):
            found.append((m.start(), m.end(), "import", name, {}))
    names = {(a, n) for a, _, n in functions}
    for m in _CALL.finditer(bare):
        if m[1] not in _WORDS and not any(a <= m.start() < a + 40 and n == m[1] for a, n in names if a <= m.start()):
            found.append((m.start(), m.end(), "call", m[1], {}))
    found += [(m.start(), m.end(), "control_flow", m[1], {}) for m in _FLOW.finditer(bare)]
    inner = lambda spans, a, b: min(((e - s, n) for s, e, n in spans if s <= a and b <= e and (s, e) != (a, b)), default=(0, None))[1]
    rows = []
    for a, b, kind, name, more in sorted(found, key=lambda x: (x[0], -x[1])):
        rows.append({"kind": ENTITY[kind], "name": name, "enclosing_function": inner(functions, a, b), "owner_type": inner(types, a, b), "is_test": False, **span(a, b), **more})
    symbols = [{"kind": SYMBOL["reference"], "name": m[0], **span(m.start(), m.end())} for m in re.finditer(r"[A-Za-z_$][\w$]*", bare) if m[0] not in _WORDS]
    return rows, symbols, None
