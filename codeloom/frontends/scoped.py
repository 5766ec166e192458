"""Languages with braces, by their tokens and a stack of scopes: one reader, told apart by what a language's words mean.

Types, functions, methods, closures, parameters, variables with their types, supertypes, imports with the names that
they bind, exports, calls, routes, decorators, control flow, catches and throws. A text whose brackets don't fit keeps
what can be read of it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from codeloom.frontends.tokens import Places, Token, tokenize
from codeloom.schema import ENTITY, SYMBOL

VERBS = {"get", "post", "put", "delete", "patch", "head", "options"}
ROUTE_VERBS = VERBS | {"route", "all", "any", "handle", "handlefunc", "mapget", "mappost", "mapput", "mapdelete", "mappatch"}
_FLOW = "if else for while do switch case break continue return try catch finally goto"
_MODIFIERS = set("public private protected internal static final override async abstract virtual sealed readonly export default const pub open inline suspend extern unsafe synchronized native transient volatile partial required external mutating nonisolated fileprivate lateinit data companion operator infix tailrec implicit lazy payable view pure nullable function constexpr explicit friend mutable noexcept get set declare factory late covariant".split())


@dataclass
class Language:
    """types: words that begin a type, and what it is; functions: words that begin a named function; variables: words
    that begin variables; named_first: whether a name stands before its type; c_style: whether functions are written
    type, name, parameters; colon: whether a colon leads the supertypes."""

    types: dict[str, str]
    functions: set[str]
    variables: set[str] = field(default_factory=set)
    flow: set[str] = field(default_factory=lambda: set(_FLOW.split()))
    named_first: bool = True
    c_style: bool = False
    colon: bool = False


def _flow(more: str, less: str = "") -> set[str]:
    return set(_FLOW.split()) - set(less.split()) | set(more.split())


_JS = Language({"class": "class", "interface": "interface", "enum": "class"}, {"function"}, {"const", "let", "var"}, _flow("of", "of"))
LANGUAGES = {
    "javascript": _JS, "typescript": _JS, "tsx": _JS,
    "go": Language({}, {"func"}, {"var", "const"}, _flow("select defer range fallthrough", "while do try catch finally")),
    "java": Language({"class": "class", "interface": "interface", "enum": "class", "record": "class"}, set(), {"var"}, _flow("yield assert"), False, True),
    "csharp": Language({"class": "class", "interface": "interface", "enum": "class", "struct": "class", "record": "class"}, set(), {"var"}, _flow("foreach yield lock"), False, True, True),
    "rust": Language({"struct": "class", "enum": "class", "trait": "interface", "union": "class"}, {"fn"}, {"let", "const", "static"}, _flow("match loop", "switch case do try catch finally goto")),
    "kotlin": Language({"class": "class", "interface": "interface", "object": "class"}, {"fun"}, {"val", "var"}, _flow("when", "switch case goto"), colon=True),
    "swift": Language({"class": "class", "struct": "class", "enum": "class", "protocol": "interface", "actor": "class", "extension": ""}, {"func"}, {"let", "var"}, _flow("guard repeat defer fallthrough", "goto try finally"), colon=True),
    "scala": Language({"class": "class", "object": "class", "trait": "interface", "enum": "class"}, {"def"}, {"val", "var"}, _flow("match yield", "switch goto")),
    "php": Language({"class": "class", "interface": "interface", "trait": "class", "enum": "class"}, {"function"}, set(), _flow("foreach elseif match"), False),
    "dart": Language({"class": "class", "mixin": "class", "enum": "class"}, set(), {"var", "final", "const"}, _flow("rethrow assert", "goto"), False, True),
    "solidity": Language({"contract": "class", "library": "class", "interface": "interface", "struct": "class", "enum": "class"}, {"function", "modifier"}, set(), _flow("revert require", "switch case goto"), False),
    "c": Language({"struct": "class", "union": "class", "enum": "class"}, set(), set(), _flow("", "try catch finally"), False, True),
    "cpp": Language({"class": "class", "struct": "class", "union": "class", "enum": "class"}, set(), {"auto"}, _flow("co_return co_yield"), False, True, True),
}
#: Words that are never a call, a reference or a function's name: in all languages, and in each.
_COMMON = set("if else for while do switch case break continue return try catch finally new delete in throw class enum import const void null nil true false this self super default".split())
RESERVED = {
    lang: _COMMON | set(words.split())
    for lang, words in {
        "javascript": "typeof instanceof of yield await async function interface extends implements export from let var undefined static get set with as", "go": "func interface struct package var range chan map defer go select type fallthrough goto",
        "java": "instanceof throws interface extends implements package public private protected internal static final abstract yield assert var record sealed permits synchronized", "csharp": "typeof is as interface struct using namespace public private protected internal static readonly abstract sealed override virtual async await foreach lock var yield when where nameof sizeof base out ref operator",
        "rust": "fn let mut ref match loop impl trait struct mod use crate pub move unsafe where dyn as extern static type async await", "kotlin": "fun val var when is as interface object package public private protected internal override open abstract throw companion init by typealias",
        "swift": "func let var guard repeat defer protocol struct extension inout is as where public private internal fileprivate static init deinit throws rethrows", "scala": "def val var match yield trait object extends with package override sealed abstract implicit lazy type", "php": "function extends implements interface trait public private protected static final abstract foreach elseif match namespace use echo unset isset empty require require_once include include_once list array fn",
        "dart": "extends implements with mixin var final static abstract async await yield on rethrow assert is as late required factory export part", "solidity": "function modifier contract library interface struct is returns public private external internal view pure payable memory storage calldata event emit mapping pragma using constructor", "c": "struct union typedef static extern sizeof goto unsigned signed register volatile inline",
        "cpp": "struct union typedef static extern sizeof goto namespace using template typename public private protected virtual override operator friend noexcept constexpr auto explicit inline mutable decltype",
    }.items()
}
RESERVED |= {"typescript": RESERVED["javascript"] | {"interface", "type", "declare", "namespace", "readonly", "abstract", "keyof"}, "tsx": RESERVED["javascript"] | {"interface", "type"}}


class Reader:
    def __init__(self, lang: str, text: str):
        self.lang, self.text, self.spec = lang, text, LANGUAGES[lang]
        self.tokens, self.odd = tokenize(lang, text)
        self.places = Places(text)
        self.entities: list[dict] = []
        self.symbols: list[dict] = []
        self.scopes: list[tuple[int, str, str]] = []  # (index behind it, function or type, name)
        self.decorators: list[dict] = []
        self.reserved = RESERVED[lang]
        self.names: set[int] = set()  # tokens that are no references: declared names, parameters, members

    # places and words

    def at(self, i: int) -> Token | None:
        return self.tokens[i] if 0 <= i < len(self.tokens) else None

    def word(self, i: int) -> str:
        t = self.at(i)
        return t.text if t else ""

    def is_id(self, i: int) -> bool:
        t = self.at(i)
        return t is not None and t.kind == "id"

    def innermost(self, kind: str) -> str | None:
        return next((n for _, k, n in reversed(self.scopes) if k == kind), None)

    def add(self, kind: str, name: str, first: int, last: int, **more) -> dict | None:
        """A row for the tokens first to last."""
        if not name.strip() and kind not in ("control_flow", "catch", "throw", "callable_boundary"):
            return None
        a, b = self.tokens[first].start, self.tokens[min(last, len(self.tokens) - 1)].end
        row = {"kind": ENTITY[kind], "name": name, "enclosing_function": self.innermost("function"), "owner_type": self.innermost("type"), "is_test": False, **self.places.span(a, b)} | more
        self.entities.append(row)
        return row

    def chain_start(self, i: int) -> int:
        """Where the qualified name that ends at i begins."""
        links = (".", "::", "->", "?.", "\\") if self.lang in ("c", "cpp", "php") else (".", "::", "?.")
        while self.word(i - 1) in links and i >= 2:
            j = i - 2
            if self.word(j) in (")", "]") and self.tokens[j].mate >= 0:
                j = self.tokens[j].mate
                if self.is_id(j - 1) or self.word(j - 1) in (")", "]"):
                    j -= 1
            elif self.word(j) == ">" or not self.is_id(j):
                return i if self.word(i - 1) != "\\" else i - 1
            i = j
        return i - 1 if self.word(i - 1) == "\\" else i

    def qualified(self, i: int, end: int) -> tuple[str, int]:
        """The qualified name that begins at i, and where it ends (behind it)."""
        parts, j, named = [], i, False
        while j < end and (self.is_id(j) and not named or self.word(j) in (".", "::", "\\") and (named or j == i)):
            named = self.is_id(j)
            parts.append(self.word(j))
            j += 1
        return "".join(parts), j

    def skip_angles(self, i: int, end: int) -> int:
        """Behind the generics that begin at i."""
        depth = 0
        for j in range(i, min(end, i + 400)):
            w = self.word(j)
            depth += (w == "<") - (w == ">")
            if w in ("{", ";") or w == "(" and not depth:
                return i
            if not depth:
                return j + 1
        return i

    def body_after(self, i: int, end: int) -> tuple[int, int]:
        """(its opening brace or -1, the last token) of a declaration whose head goes on at i."""
        line = self.places.line
        j = i
        while j < end:
            t = self.tokens[j]
            if t.text == "{":
                return j, t.mate if t.mate >= 0 else end - 1
            if t.text == ";":
                return -1, j
            if t.text == "}" or t.text == "," and self.lang not in ("java", "cpp", "csharp", "solidity", "php", "scala", "rust"):
                return -1, j - 1
            if t.text in ("=", "=>") and self.lang in ("kotlin", "scala", "csharp", "dart"):
                return self.expression(j + 1, end)
            if j > i and self.lang in ("go", "kotlin", "swift", "scala", "typescript", "tsx", "javascript") and line(t.start) > line(self.tokens[j - 1].end) and t.text not in ("{", "where", "->", "throws", ":", "="):
                return -1, j - 1
            j = t.mate + 1 if t.mate > j else j + 1
        return -1, end - 1

    def expression(self, i: int, end: int) -> tuple[int, int]:
        """(an opening brace or -1, the last token) of the expression at i."""
        if self.word(i) == "{" and self.tokens[i].mate > i:
            return i, self.tokens[i].mate
        line, j = self.places.line, i
        while j < end:
            t = self.tokens[j]
            if t.text in (";", ",", ")", "]", "}"):
                return -1, j - 1
            if j > i and line(t.start) > line(self.tokens[j - 1].end) and t.text not in (".", "?.", "->", "+", "&&", "||", "?", ":"):
                return -1, j - 1
            j = t.mate + 1 if t.mate > j else j + 1
        return -1, end - 1

    # declarations

    def modifiers(self, i: int) -> set[str]:
        """The words right before token i."""
        found = set()
        while i > 0 and self.is_id(i - 1) and self.word(i - 1) in _MODIFIERS:
            i -= 1
            found.add(self.word(i))
        return found

    def is_test(self, i: int) -> bool:
        """Whether an attribute right before the function at i makes it a test (Rust)."""
        while self.lang == "rust" and i > 0:
            if self.is_id(i - 1) and self.word(i - 1) in ("pub", "async", "unsafe", "const", "extern"):
                i -= 1
            elif self.word(i - 1) == ")" and self.word(self.tokens[i - 1].mate - 1) == "pub":
                i = self.tokens[i - 1].mate - 1
            elif self.word(i - 1) == "]" and self.word(self.tokens[i - 1].mate - 1) == "#":
                first = self.tokens[i - 1].mate
                name, _ = self.qualified(first + 1, i - 1)
                if name.rpartition("::")[2] in ("test", "rstest"):
                    return True
                i = first - 1
            else:
                break
        return False

    def flush(self, name: str) -> None:
        """Decorators seen before belong to the declaration of this name."""
        for row in self.decorators:
            row["enclosing_function"] = name
        self.decorators = []

    def parameters(self, i: int, close: int) -> None:
        """The names in a parameter list between the brackets i and close."""
        j, piece = i + 1, []
        pieces = []
        while j < close:
            t = self.tokens[j]
            if t.text == ",":
                pieces.append(piece)
                piece = []
            elif t.text == "<" and (k := self.skip_angles(j, close)) > j:
                j = k
                continue
            else:
                piece.append(j)
                if t.mate > j and t.text != "{" or t.mate > j and piece[0] != j:
                    j = t.mate
            j += 1
        names = []
        for piece in [*pieces, piece]:
            ids = [k for k in piece if self.is_id(k) and self.word(k) not in _MODIFIERS and self.word(k) not in ("mut", "ref", "out", "params", "inout", "vararg", "var", "val")]
            stop = next((k for k in piece if self.word(k) in ("=", ":") and (self.word(k) == "=" or self.spec.named_first)), None)
            if stop is not None:
                ids = [k for k in ids if k < stop]
            if not ids:
                continue
            if self.lang == "go":
                names.append(ids[0])
            elif self.spec.named_first and self.lang != "swift":
                names += ids if piece and self.word(piece[0]) in ("{", "[") else ids[:1]
            elif len(ids) > 1 or self.lang in ("php", "swift", "dart"):
                names.append(ids[-1])
            if names and stop is not None and self.word(stop) == ":" and self.is_id(stop + 1):
                self.add("type_ref", self.qualified(stop + 1, close)[0], stop + 1, stop + 1, enclosing_function=self.word(names[-1]))
            elif names and not self.spec.named_first and len(ids) > 1 and names[-1] == ids[-1]:
                self.add("type_ref", self.qualified(ids[0], close)[0], ids[0], ids[0], enclosing_function=self.word(ids[-1]))
        for k in names:
            self.names.add(k)
            self.add("parameter", self.word(k), k, k)

    def function(self, name: str, first: int, name_at: int, open_: int, end: int, owner: str | None = None) -> int:
        """A function whose parameters begin at open_; where to go on."""
        close = self.tokens[open_].mate
        if close < 0:  # cut off
            self.add("function", name, first, open_, body="")
            return open_ + 1
        after = close + 1
        if self.lang == "cpp" and self.word(after) == ":":  # initialisers
            while after < end and self.word(after) not in ("{", ";"):
                after = self.tokens[after].mate + 1 if self.tokens[after].mate > after and self.word(after) != "{" else after + 1
        brace, last = self.body_after(after, end)
        words = {self.word(k) for k in range(first, max(name_at, first + 1))} | self.modifiers(first)
        is_async = bool(words & {"async", "suspend"}) or any(self.word(k) == "async" for k in range(close + 1, brace if brace > 0 else close + 1))
        more = {"owner_type": owner} if owner is not None else {}
        body = self.text[self.tokens[first].start : self.tokens[last].end]
        self.add("function", name, first, last, is_async=is_async, is_test=self.is_test(first), body=body, **more)
        if name_at >= 0:
            self.names.add(name_at)
        self.flush(name)
        if owner is not None:
            self.scopes.append((last + 1, "type", owner))
        self.scopes.append((last + 1, "function", name))
        self.parameters(open_, close)
        return close + 1

    def supertypes(self, name: str, kind: str, i: int, end: int) -> None:
        """Rows for what a type's head, tokens i to end, names above it."""
        way, j, n = None, i, 0
        while j < end:
            w = self.word(j)
            if w in ("extends", "is") or w == ":" and (self.spec.colon or self.lang == "rust"):
                way, n, j = "extends", 0, j + 1
            elif w in ("implements", "with"):
                way, n, j = "implements", 0, j + 1
            elif w in ("where", "permits"):
                return
            elif w == "<" and (k := self.skip_angles(j, end)) > j:
                j = k
            elif self.tokens[j].mate > j:
                j = self.tokens[j].mate + 1
            elif self.is_id(j) and way and w not in _MODIFIERS:
                sup, k = self.qualified(j, end)
                rel, base = way, sup.rpartition(".")[2].rpartition("::")[2]
                if w != ":" and self.spec.colon and way == "extends" and self.lang != "cpp" and kind != "interface":
                    looks = bool(re.match("I[A-Z]", base)) if self.lang == "csharp" else self.word(k) != "(" and self.lang == "kotlin"
                    rel = "implements" if n or looks else "extends"
                self.add(rel, sup, j, k - 1, enclosing_function=name)
                n, j = n + 1, k
            else:
                j += 1

    def type(self, first: int, name_at: int, kind: str, end: int) -> int:
        name = self.word(name_at)
        j = name_at + 1
        while j < end and self.word(j) not in ("{", ";", "}"):
            if self.lang in ("kotlin", "scala", "swift") and j > name_at + 1 and self.places.line(self.tokens[j].start) > self.places.line(self.tokens[j - 1].end) and self.word(j) not in (":", "extends", "with", "(") and self.word(j - 1) not in (":", ",", "with", "extends"):
                break
            j = self.tokens[j].mate + 1 if self.tokens[j].mate > j else j + 1
        if self.lang in ("c", "cpp") and (self.word(j) != "{" or self.word(name_at + 1) not in ("{", ":", "final", "<")):
            return first + 1  # a use of the type or a declaration ahead
        last = self.tokens[j].mate if self.word(j) == "{" and self.tokens[j].mate > j else min(j, end - 1) - (self.word(j) != ";")
        self.names.add(name_at)
        if kind:
            self.add(kind, name, first, max(last, name_at))
            self.flush(name)
        self.supertypes(name, kind, name_at + 1, j)
        if kind and self.lang in ("java", "csharp", "kotlin", "scala") and self.word(name_at + 1) == "(":  # fields in the head
            self.scopes.append((j, "type", name))
            self.parameters(name_at + 1, self.tokens[name_at + 1].mate)
            self.scopes.pop()
        self.scopes.append((last + 1, "type", name))
        return j + 1 if self.word(j) == "{" else j

    # statements

    def imports(self, i: int, end: int) -> int | None:
        """Reads an import at i; where to go on, or None if there is none."""
        w, lang = self.word(i), self.lang
        statement = i == 0 or self.word(i - 1) in (";", "}", "{", ")") or self.places.line(self.tokens[i].start) > self.places.line(self.tokens[i - 1].end) or self.word(i - 1) in _MODIFIERS
        js = lang in ("javascript", "typescript", "tsx")
        if js and w in ("import", "export") and statement and self.word(i + 1) not in ("(", "."):
            bound, j = [], i + 1
            while j < end and self.word(j) != ";" and j < i + 400:
                t = self.tokens[j]
                if t.kind == "str" and (w == "import" or self.word(j - 1) == "from"):
                    if j == i + 1 or self.word(j - 1) == "from":
                        type_only = {"body_shape": "type_only"} if self.word(i + 1) == "type" and self.word(i + 2) != "from" else {}
                        self.add("import", t.text, i, j, owner_type=",".join(bound) or None, **type_only)
                        for k in range(i, j):
                            self.names.add(k)
                        for b in bound:
                            self.symbols.append({"kind": SYMBOL["binding"], "name": b, **self.places.span(self.tokens[i].start, t.end)})
                        return j + 1
                    return None
                if w == "export" and t.text in ("function", "class", "const", "let", "var", "interface", "enum", "default", "async", "abstract", "="):
                    return None
                if t.kind == "id" and t.text not in ("from", "as", "type", "import"):
                    if self.word(j - 1) == "as" and bound:
                        bound.pop()
                    bound.append(t.text)
                j += 1
            return None
        if lang == "go" and w == "import" and statement:
            last = self.tokens[i + 1].mate if self.word(i + 1) == "(" else i + 2 if self.is_id(i + 1) else i + 1
            for j in range(i + 1, min(last, end - 1) + 1):
                if self.tokens[j].kind == "str":
                    alias = self.word(j - 1) if self.is_id(j - 1) and self.word(j - 1) != "import" else self.tokens[j].text.strip('"`').rpartition("/")[2]
                    self.add("import", self.tokens[j].text.strip('"`'), j, j, owner_type=alias)
                    self.symbols.append({"kind": SYMBOL["binding"], "name": alias, **self.places.span(self.tokens[j].start, self.tokens[j].end)})
                self.names.add(j)
            return last + 1
        if lang == "rust" and w in ("use", "mod") and statement and (w == "use" or self.word(i + 2) == ";"):
            last = next((j for j in range(i, end) if self.word(j) == ";"), end - 1)
            for path, bound in self.use_paths(i + 1, last):
                self.add("import", path, i, last, owner_type=bound)
            self.names.update(range(i, last))
            return last + 1
        if (lang in ("java", "kotlin", "scala", "swift", "dart", "solidity") and w == "import" or lang == "csharp" and w == "using" and self.word(i + 1) != "(" and self.word(i + 1) != "var" or lang == "php" and w == "use" and not self.scopes) and statement:
            line, j = self.places.line(self.tokens[i].start), i + 1
            while j < end and self.word(j) != ";" and (lang in ("java", "csharp", "php", "dart", "solidity") or self.places.line(self.tokens[j].start) == line):
                j += 1
            words = [k for k in range(i + 1, j) if self.word(k) not in ("static", "function", "const", "global")]
            text = next((self.tokens[k].text.strip("'\"") for k in words if self.tokens[k].kind == "str"), None)
            if text is None:
                names = [k for k in words if self.is_id(k) or self.word(k) in (".", "\\", "*")]
                alias = next((self.word(k + 1) for k in words if self.word(k) in ("as", "=")), None)
                if alias and self.word(words[1] if len(words) > 1 else i) == "=":
                    names, alias = names[1:], self.word(words[0])
                group = next((k for k in words if self.word(k) == "{"), None)
                head = "".join(self.word(k) for k in names if group is None or k < group)
                if alias and alias != head and head.endswith(alias) and "as" in [self.word(k) for k in words]:
                    head = head[: -len(alias) - 2] if head.endswith("as" + alias) else head
                heads = [head] if group is None else [head + self.word(k) for k in range(group + 1, max(group, self.tokens[group].mate)) if self.is_id(k)]
            else:
                heads, alias = [text], next((self.word(k + 1) for k in words if self.word(k) == "as"), None)
            for h in heads:
                self.add("import", h if text is not None else h.removesuffix(".*").strip("."), i, j - 1, owner_type=alias or re.split(r"[./\\]", h.removesuffix(".*"))[-1] or None)
            self.names.update(range(i, j))
            return j
        return None

    def use_paths(self, i: int, end: int) -> list[tuple[str, str]]:
        """(path, bound name) of a use tree."""
        out, prefix, j, path = [], [], i, ""
        while j <= end:
            w = self.word(j)
            if w == "{":
                prefix.append(path)
            elif w in (",", "}", ";"):
                if path and (not prefix or path != prefix[-1]):
                    out.append((path.removesuffix("::self"), path.removesuffix("::self").rpartition("::")[2]))
                if w == "}" and prefix:
                    prefix.pop()
                path = prefix[-1] if prefix and w == "," else ""
            elif w == "as" and out is not None:
                out.append((path, self.word(j + 1)))
                path, j = "", j + 1
            elif w != "pub":
                path += w
            j += 1
        return out

    def variable(self, i: int, end: int) -> None:
        """The names that a variable's word at i declares."""
        j = i + 1
        if self.word(j) == "mut":
            j += 1
        if self.word(j) in ("{", "[", "(") and self.tokens[j].mate > j:
            for k in range(j + 1, self.tokens[j].mate):
                if self.is_id(k) and self.word(k + 1) != ":" and self.word(k) not in _MODIFIERS:
                    self.names.add(k)
                    self.add("variable", self.word(k), k, k)
            return
        while self.is_id(j) and self.word(j) in _MODIFIERS:
            j += 1
        if self.is_id(j):
            if self.lang in ("java", "csharp", "dart", "cpp") and self.is_id(j + 1):
                j += 1
            self.names.add(j)
            self.add("variable", self.word(j), j, j)
            if self.word(j + 1) == ":" and self.is_id(j + 2):
                self.add("type_ref", self.qualified(j + 2, end)[0], j + 2, j + 2, enclosing_function=self.word(j))
            elif self.word(j + 1) in ("=", ":=") and self.word(j + 2) == "new" and self.is_id(j + 3):
                self.add("type_ref", self.qualified(j + 3, end)[0], j + 3, j + 3, enclosing_function=self.word(j))

    def decorator(self, i: int) -> int | None:
        """Reads an annotation at i."""
        w = self.word(i)
        if w == "@" and self.is_id(i + 1) and self.word(i + 1) != "interface":
            first, last_name = i, i + 1
        elif self.lang == "csharp" and w == "[" and self.is_id(i + 1) and self.word(i - 1) in ("", "{", "}", ";", "]", ")", ",") or self.lang == "rust" and w == "[" and self.word(i - 1) == "#":
            first, last_name = i, i + 1
        else:
            return None
        name, j = self.qualified(last_name, len(self.tokens))
        close = self.tokens[j].mate if self.word(j) == "(" else -1
        verb = re.sub(r"^http|mapping$", "", name.rpartition(".")[2].lower())
        text = next((t.text.strip("\"'`") for t in self.tokens[j + 1 : close] if t.kind == "str"), None) if close > 0 else None
        known = verb in VERBS or verb in ("request", "route", "path")
        row = self.add("decorator", name, first, close if close > 0 else j - 1, method=verb.upper() if verb in VERBS else None, path=text if known else None)
        if row:
            self.decorators.append(row)
        self.names.update(range(first, (close if close > 0 else j - 1) + 1))
        after = close + 1 if close > 0 else j
        return self.tokens[i].mate + 1 if w == "[" and self.tokens[i].mate > 0 else after

    def call(self, i: int, end: int) -> None:
        """The call whose name ends at i, right before its brackets."""
        open_ = i + 1
        if self.word(open_) == "!" and self.lang == "rust":
            open_ += 1
        start = self.chain_start(i)
        close = self.tokens[open_].mate
        name = self.text[self.tokens[start].start : self.tokens[i].end] + ("!" if open_ > i + 1 else "")
        self.add("call", re.sub(r"\s+", "", name), start, close if close > 0 else open_)
        verb = self.word(i).lower()
        if start < i and verb in ROUTE_VERBS and close > 0:
            strings = [k for k in (open_ + 1,) if self.tokens[k].kind == "str" and self.tokens[k].text[1:2] in ("/", "")]
            if strings:
                handler = close - 1
                known = self.is_id(handler) and self.word(handler - 1) in (",", ".", "::")
                method = verb.removeprefix("map").upper() if verb.removeprefix("map") in VERBS else next((t.text.strip("\"'") for t in self.tokens[open_ + 2 : close] if t.kind == "str" and t.text.strip("\"'").lower() in VERBS), "ANY").upper()
                self.add("route", self.word(handler) if known else f"{method} {self.tokens[strings[0]].text.strip(chr(34) + chr(39) + '`')}", start, close, method=method, path=self.tokens[strings[0]].text.strip("\"'`"), status="handler" if known else None)

    def read(self) -> None:
        tokens, spec, lang = self.tokens, self.spec, self.lang
        end, i = len(tokens), 0
        js = lang in ("javascript", "typescript", "tsx")
        while i < end:
            while self.scopes and i >= self.scopes[-1][0]:
                self.scopes.pop()
            t, w = tokens[i], tokens[i].text
            if t.kind == "pp":
                if m := re.match(r"\s*#\s*include\s*[<\"]([^>\"]+)", w):
                    self.add("import", m[1], i, i)
                elif m := re.match(r"\s*#\s*(if|ifdef|ifndef|elif)\b", w):
                    self.add("control_flow", m[1], i, i)
                i += 1
                continue
            if t.kind == "op":
                if (to := self.decorator(i)) is not None:
                    i = to
                    continue
                if w == "=>" and (js or lang in ("csharp", "dart")) and not self.arrow(i, end):
                    i += 1
                    continue
                if w == "->" and lang == "java" and (self.word(i - 1) == ")" or self.is_id(i - 1) and self.word(i - 2) in ("(", ",", "=", "return")):
                    first = tokens[i - 1].mate if self.word(i - 1) == ")" else i - 1
                    self.add("callable_boundary", "", first, self.expression(i + 1, end)[1])
                if lang == "go" and w == ":=":
                    k = i - 1
                    while self.is_id(k):
                        self.names.add(k)
                        self.add("variable", self.word(k), k, k)
                        k = k - 2 if self.word(k - 1) == "," else -1
                i += 1
                continue
            if t.kind != "id" or i in self.names:
                i += 1
                continue
            if (to := self.imports(i, end)) is not None:
                i = max(to, i + 1)
                continue
            member = self.word(i - 1) in (".", "?.", "->") or self.word(i - 1) == "::" and lang != "rust"
            if (not member or lang == "cpp" and self.word(i - 1) == "::") and self.declaration(i, end):
                i = self.next
                continue
            if w in spec.flow and not member:
                if w == "catch":
                    inner = self.qualified(i + 2, end)[0] if self.word(i + 1) == "(" else ""
                    self.add("catch", inner, i, i)
                self.add("control_flow", w, i, i)
                i += 1
                continue
            if w in ("throw", "raise", "revert") and not member:
                self.add("throw", self.qualified(i + 1 + (self.word(i + 1) == "new"), end)[0], i, i)
                i += 1
                continue
            if w == "require" and js and self.word(i + 1) == "(" and self.at(i + 2) and tokens[i + 2].kind == "str":
                self.add("import", tokens[i + 2].text, i, i + 3, owner_type=self.word(i - 2) if self.word(i - 1) == "=" else None)
                i += 4
                continue
            called = self.word(i + 1) == "(" or lang == "rust" and self.word(i + 1) == "!" and self.word(i + 2) in ("(", "[", "{")
            if called and (member or w not in self.reserved):
                self.call(i, end)
            if w not in self.reserved and not member:
                self.symbols.append({"kind": SYMBOL["reference"], "name": w, **self.places.span(t.start, t.end)})
            i += 1

    def arrow(self, i: int, end: int) -> bool:
        """An arrow at i: a closure, or a function if a name is given to it."""
        first = tokens_first = self.tokens[i - 1].mate if self.word(i - 1) == ")" else i - 1
        if first < 0 or self.lang == "csharp" and self.word(i - 1) != ")" and not self.is_id(i - 1):
            return False
        if self.word(first - 1) == "async":
            first -= 1
        brace, last = self.expression(i + 1, end)
        named = self.word(first - 1) == "=" and self.is_id(first - 2) and self.lang != "csharp"
        if named:
            name, name_at = self.word(first - 2), first - 2
            start = name_at - 1 if self.word(name_at - 1) in ("const", "let", "var") else name_at
            self.add("function", name, start, last, is_async=self.word(first) == "async", body=self.text[self.tokens[start].start : self.tokens[last].end])
            self.scopes.append((last + 1, "function", name))
            if self.word(i - 1) == ")":
                self.parameters(tokens_first, i - 1)
        else:
            self.add("callable_boundary", "", first, last)
        return False

    def declaration(self, i: int, end: int) -> bool:
        """Reads a declaration that begins at word i; self.next is where to go on."""
        w, spec, lang, tokens = self.word(i), self.spec, self.lang, self.tokens
        js = lang in ("javascript", "typescript", "tsx")
        self.next = i + 1
        if js and w == "export":
            j = i + 1
            while self.word(j) in ("default", "async", "abstract", "declare", "function", "class", "const", "let", "var", "interface", "enum", "type", "*"):
                j += 1
            if self.is_id(j):
                self.add("export", self.word(j), i, j)
            return True
        if w in spec.types and self.is_id(i + 1) and (self.word(i + 1) not in self.reserved or lang == "cpp" and self.word(i + 1) == "class"):
            name_at = i + 2 if self.word(i + 1) in ("class", "object", "interface") and self.is_id(i + 2) else i + 1
            self.next = max(self.type(i, name_at, spec.types[w], end), i + 1)
            return True
        if lang == "go" and w == "type" and self.is_id(i + 1):
            j = self.skip_angles(i + 2, end) if self.word(i + 2) == "[" else i + 2
            kind = {"struct": "class", "interface": "interface"}.get(self.word(j))
            if kind and self.word(j + 1) == "{":
                name, last = self.word(i + 1), tokens[j + 1].mate if tokens[j + 1].mate > 0 else end - 1
                self.names.add(i + 1)
                self.add(kind, name, i, last)
                self.scopes.append((last + 1, "type", name))
                line = self.places.line
                for k in range(j + 2, last):  # a name alone on its line is embedded; in an interface, one with brackets is a method
                    alone = line(tokens[k].start) > line(tokens[k - 1].end) or self.word(k - 1) == "{"
                    if self.is_id(k) and alone or self.word(k) == "*" and alone and self.is_id(k + 1):
                        k2 = k + (self.word(k) == "*")
                        sup, behind = self.qualified(k2, last + 1)
                        if self.word(behind) == "(" and kind == "interface":
                            close = tokens[behind].mate
                            self.add("function", sup, k, max(close, behind), body="")
                        elif line(tokens[behind].start) > line(tokens[behind - 1].end) or self.word(behind) in ("}", ";"):
                            self.add("extends", sup, k, behind - 1, enclosing_function=name)
                        self.names.add(k2)
                self.next = j + 2
                return True
            return False
        if lang == "rust" and w == "impl":
            j = self.skip_angles(i + 1, end) if self.word(i + 1) == "<" else i + 1
            brace = next((k for k in range(j, min(end, j + 200)) if self.word(k) == "{"), -1)
            if brace > 0:
                at = next((k for k in range(j, brace) if self.word(k) == "for"), -1)
                target = self.qualified(at + 1 if at > 0 else j, brace)[0].rpartition("::")[2]
                if at > 0:
                    self.add("implements", self.qualified(j, at)[0], j, at - 1, enclosing_function=target)
                self.scopes.append((tokens[brace].mate + 1 if tokens[brace].mate > 0 else end, "type", target))
                self.names.update(range(i, brace))
                self.next = brace + 1
                return True
            return False
        if w in spec.functions or w in ("constructor", "init") and lang in ("typescript", "tsx", "javascript", "kotlin", "swift", "solidity") and self.scopes and self.scopes[-1][1] == "type" and self.word(i + 1) == "(":
            j, owner = i + 1, None
            if w in ("constructor", "init"):
                self.next = self.function(w, i, i, i + 1, end)
                return True
            if lang == "go" and self.word(j) == "(" and self.is_id(tokens[j].mate + 1) and self.word(tokens[j].mate + 2) in ("(", "["):
                ids = [k for k in range(j + 1, tokens[j].mate) if self.is_id(k)]
                owner = self.word(ids[1] if len(ids) > 1 else ids[0]) if ids else None
                self.names.update(ids)
                j = tokens[j].mate + 1
            if self.word(j) in ("*", "&"):
                j += 1
            if lang == "kotlin" and self.word(j) == "<":
                j = self.skip_angles(j, end)
            while lang == "kotlin" and self.is_id(j) and self.word(j + 1) in (".", "?."):  # an extension's receiver
                owner, j = self.word(j), j + 2
            if j + 1 >= end:
                return False
            if self.is_id(j) or lang in ("scala", "swift") and tokens[j].kind == "op" and self.word(j) not in ("(", "{"):
                open_ = self.skip_angles(j + 1, end) if self.word(j + 1) in ("<", "[") and lang != "scala" else tokens[j + 1].mate + 1 if self.word(j + 1) == "[" else j + 1
                if lang == "go" and self.word(j + 1) == "[":
                    open_ = tokens[j + 1].mate + 1
                if self.word(open_) == "(":
                    first = i
                    while self.is_id(first - 1) and self.word(first - 1) in _MODIFIERS:
                        first -= 1
                    self.next = self.function(self.word(j), first, j, open_, end, owner)
                    return True
                if lang == "scala":
                    brace, last = self.body_after(j + 1, end)
                    self.add("function", self.word(j), i, last, is_async=False, body=self.text[tokens[i].start : tokens[last].end])
                    self.names.add(j)
                    self.scopes.append((last + 1, "function", self.word(j)))
                    self.next = j + 1
                    return True
            elif self.word(j) == "(":
                _, last = self.body_after(tokens[j].mate + 1, end) if tokens[j].mate > 0 else (-1, j)
                named = js and self.word(i - 1) == "=" and self.is_id(i - 2)
                if named:
                    self.next = self.function(self.word(i - 2), i, -1, j, end)
                else:
                    self.add("callable_boundary", "", i, last)
                    self.next = j + 1
                return True
            return False
        if w in spec.variables and (self.is_id(i + 1) or self.word(i + 1) in ("{", "[", "(")) and self.word(i + 1) not in spec.functions:
            self.variable(i, end)
            return True
        in_type = bool(self.scopes) and self.scopes[-1][1] == "type"
        open_ = self.skip_angles(i + 1, end) if self.word(i + 1) == "<" else i + 1
        if self.word(open_) == "(" and w not in self.reserved and tokens[open_].mate > 0:
            close, before = tokens[open_].mate, self.word(i - 1)
            after = self.word(close + 1)
            if js and in_type and (before in ("{", "}", ";", "*", "") or before in _MODIFIERS or self.places.line(t_start(self, i)) > self.places.line(tokens[i - 1].end)) and after in ("{", ":", ";"):
                self.next = self.function(w, i, i, open_, end)
                return True
            if spec.c_style and before not in (".", "->", "new", "return", "=", "(", ",", "throw", "else", "await", "&&", "||", "!", "+", "?", "case", "yield"):
                typed = self.is_id(i - 1) and before not in self.reserved - {"void", "const", "override", "static"} or before in (">", "]", "*", "&", "?", "::", "~") or in_type and (before in ("{", "}", ";", ")", ":") or before in _MODIFIERS)
                scoped = lang == "cpp" and before == "::"
                if (typed or scoped) and (after in ("{", "throws", "const", "noexcept", "override", "async", "where", "=>", "final", "->") or after == ":" and lang in ("cpp", "csharp") or after == ";" and in_type and (self.is_id(i - 1) or before in (">", "]", "*", "&")) or after == "=" and in_type and lang == "cpp"):
                    owner = self.word(i - 2) if scoped and self.is_id(i - 2) else None
                    first = i - 2 if scoped else i
                    while first > 0 and (self.is_id(first - 1) and (self.word(first - 1) in _MODIFIERS or self.word(first - 1) not in self.reserved or self.word(first - 1) == "void") or self.word(first - 1) in ("*", "&", "?") or self.word(first - 1) == ">" and first > 1):
                        if self.word(first - 1) == ">":
                            depth, k = 0, first - 1
                            while k >= 0:
                                depth += (self.word(k) == ">") - (self.word(k) == "<")
                                if not depth or self.word(k) in (";", "{", "}"):
                                    break
                                k -= 1
                            if depth:
                                break
                            first = k
                        else:
                            first -= 1
                    self.next = self.function(w, first, i, open_, end, owner)
                    return True
        if spec.c_style or lang in ("php", "solidity"):
            typed = self.is_id(i - 1) and self.word(i - 1) not in self.reserved or self.word(i - 1) in (">", "]")
            if lang == "php" and w.startswith("$") and self.word(i + 1) == "=" or typed and self.word(i + 1) in ("=", ";") and w not in self.reserved and self.word(i - 1) != "return":
                self.names.add(i)
                self.add("variable", w, i, i)
                if lang != "php" and self.is_id(i - 1):
                    self.add("type_ref", self.word(i - 1), i - 1, i - 1, enclosing_function=w)
                return True
        return False


def t_start(reader: Reader, i: int) -> int:
    return reader.tokens[i].start


def extract(lang: str, text: str) -> tuple[list[dict], list[dict], str | None]:
    reader = Reader(lang, text)
    reader.read()
    rows = sorted(reader.entities, key=lambda r: (r["start_byte"], -r["end_byte"]))
    return rows, reader.symbols, "syntax error: brackets don't fit" if reader.odd else None
