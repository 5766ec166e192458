"""Tokens of a source text, with the mate of each bracket: the ground that the other front ends and the pattern search
stand on."""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass
from functools import lru_cache

OPEN, CLOSE = {"(": ")", "[": "]", "{": "}"}, {")": "(", "]": "[", "}": "{"}
HASH_COMMENTS = {"python", "ruby", "bash", "elixir", "php"}
DASH_COMMENTS = {"lua", "haskell"}
#: Languages in which a backtick holds a text, and in which three quotes do.
BACKTICK = {"javascript", "typescript", "tsx", "go", "bash", "ruby"}
TRIPLE = {"python", "kotlin", "swift", "java", "scala", "dart", "elixir", "csharp"}
#: A slash after one of these begins a regular expression in JavaScript.
_BEFORE_REGEX = set("(,=:[!&|?{};+-*%<>~^") | {"return", "typeof", "case", "=>", "&&", "||", "==", "===", "!=", "!=="}
_OPS = r"===|!==|\.\.\.|<=>|->>|=>|->|<-|::|\?\.|\?\?|:=|==|!=|<=|>=|&&|\|\||\+=|-=|\*=|/=|\+\+|--|\.\.|[^\w\s]"


@dataclass(slots=True)
class Token:
    """kind: id, num, str, pp (a preprocessor line) or op; mate: where the bracket's other half is, -1 if nowhere."""

    kind: str
    text: str
    start: int
    end: int
    mate: int = -1


@lru_cache(32)
def _pattern(lang: str) -> re.Pattern:
    line = r"#(?!\[)[^\n]*|//[^\n]*" if lang == "php" else r"#[^\n]*" if lang in HASH_COMMENTS else r"--(?!\[\[)[^\n]*" if lang in DASH_COMMENTS else r"//[^\n]*"
    block = r"--\[\[.*?(?:\]\]|\Z)" if lang == "lua" else r"\{-.*?(?:-\}|\Z)" if lang == "haskell" else r"/\*.*?(?:\*/|\Z)"
    strings = []
    if lang in TRIPLE:
        strings.append(r"[rRbBfFuU$@]{0,2}\"\"\".*?(?:\"\"\"|\Z)")
    if lang == "python":
        strings.append(r"[rRbBfFuU]{0,2}'''.*?(?:'''|\Z)")
    if lang == "rust":
        strings += [r"b?r(?P<hashes>#*)\".*?\"(?P=hashes)", r"b?'(?:\\(?:u\{[^}]*\}|x..|.)|[^\\'\n])'"]
    if lang == "csharp":
        strings.append(r"\$?@\$?\"(?:[^\"]|\"\")*\"")
    if lang in BACKTICK:
        strings.append(r"`(?:\\.|[^`\\])*(?:`|\Z)" if lang != "go" else r"`[^`]*(?:`|\Z)")
    strings.append(r"[bfrLu$]{0,2}\"(?:\\.|[^\"\\\n])*(?:\"|(?=\n)|\Z)")
    if lang not in ("rust", "haskell"):
        strings.append(r"'(?:\\.|[^'\\\n])*(?:'|(?=\n)|\Z)")
    pp = r"|(?P<pp>^[ \t]*\#[ \t]*\w+(?:\\\n|[^\n])*)" if lang in ("c", "cpp", "csharp") else ""
    word = r"'?[^\W\d][\w$]*|\$[\w$]+|@[\"']?" if lang == "rust" else r"[^\W\d][\w$]*[!?]?(?=\s*\()|[^\W\d][\w$]*|\$[\w$]*" if lang in ("ruby", "elixir") else r"[^\W\d][\w$]*|\$[\w$]*"
    return re.compile(rf"(?P<skip>\s+|{block}|{line}){pp}|(?P<str>{'|'.join(strings)})|(?P<num>\d[\w.]*)|(?P<id>{word})|(?P<op>{_OPS})", re.S | re.M)


_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/\w*")


def tokenize(lang: str, text: str) -> tuple[list[Token], bool]:
    """(tokens, whether brackets don't fit)."""
    out: list[Token] = []
    pattern, at, odd = _pattern(lang), 0, False
    slashes = lang in ("javascript", "typescript", "tsx")
    stack: list[int] = []
    while at < len(text):
        if slashes and text[at] == "/" and text[at : at + 2] not in ("//", "/*") and (not out or out[-1].text in _BEFORE_REGEX) and (m := _REGEX.match(text, at)):
            out.append(Token("str", m[0], at, m.end()))
            at = m.end()
            continue
        m = pattern.match(text, at)
        if m is None:
            at += 1
            continue
        at, kind = m.end(), m.lastgroup if m.lastgroup != "hashes" else "str"
        if kind == "skip":
            continue
        token = Token(kind, m[0], m.start(), m.end())
        if kind == "op":
            if token.text in OPEN:
                stack.append(len(out))
            elif token.text in CLOSE:
                # a stray bracket closes what it fits, and what stands open in between fits nothing
                place = next((k for k in range(len(stack) - 1, -1, -1) if out[stack[k]].text == CLOSE[token.text]), None)
                if place is None:
                    odd = True
                else:
                    odd |= place != len(stack) - 1
                    token.mate = stack[place]
                    out[stack[place]].mate = len(out)
                    del stack[place:]
        out.append(token)
    return out, odd or bool(stack)


class Places:
    """Lines, columns and byte offsets of character offsets."""

    def __init__(self, text: str):
        self.breaks = [i for i, c in enumerate(text) if c == "\n"]
        self.plain = text.isascii()
        self.bytes = None
        if not self.plain:
            self.bytes = [0]
            for c in text:
                n = ord(c)
                self.bytes.append(self.bytes[-1] + (1 if n < 0x80 else 2 if n < 0x800 else 3 if n < 0x10000 else 4))

    def byte(self, at: int) -> int:
        return at if self.plain else self.bytes[at]

    def line(self, at: int) -> int:
        return bisect_left(self.breaks, at) + 1

    def column(self, at: int) -> int:
        n = bisect_left(self.breaks, at)
        return self.byte(at) - self.byte(self.breaks[n - 1] + 1 if n else 0)

    def span(self, a: int, b: int) -> dict:
        return {"start_byte": self.byte(a), "end_byte": self.byte(b), "start_line": self.line(a), "start_col": self.column(a), "end_line": self.line(max(a, b - 1)) if b > a else self.line(b), "end_col": self.column(b)}
