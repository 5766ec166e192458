"""Python, through the language's own parser."""

from __future__ import annotations

import ast

from codeloom.schema import ENTITY, SYMBOL

VERBS = {"get", "post", "put", "delete", "patch", "head", "options", "route"}
FLOW = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.With, ast.AsyncWith, ast.Try, ast.TryStar, ast.Return, ast.Break, ast.Continue, ast.IfExp)


class Walker:
    def __init__(self, text: str):
        self.text = text
        self.lines = text.split("\n")
        self.starts = [0]
        for line in self.lines:
            self.starts.append(self.starts[-1] + len(line.encode()) + 1)
        self.entities: list[dict] = []
        self.symbols: list[dict] = []
        self.functions: list[str] = []
        self.types: list[str] = []

    def span(self, node) -> dict:
        first = node.lineno
        return {
            "start_byte": self.starts[first - 1] + node.col_offset, "end_byte": self.starts[node.end_lineno - 1] + node.end_col_offset,
            "start_line": first, "start_col": node.col_offset, "end_line": node.end_lineno, "end_col": node.end_col_offset,
        }

    def source(self, node) -> str:
        return ast.get_source_segment(self.text, node) or ""

    def add(self, kind: str, name: str, node, **more) -> None:
        if not name.strip() and kind not in ("control_flow", "catch", "throw", "callable_boundary"):
            return
        row = {"kind": ENTITY[kind], "name": name, "enclosing_function": self.functions[-1] if self.functions else None, "owner_type": self.types[-1] if self.types else None, "is_test": False, **self.span(node)}
        self.entities.append(row | more)

    def symbol(self, kind: str, name: str, node) -> None:
        self.symbols.append({"kind": SYMBOL[kind], "name": name, **self.span(node)})

    def decorators(self, node) -> None:
        for d in node.decorator_list:
            call = d if isinstance(d, ast.Call) else None
            name = self.source(call.func if call else d)
            verb = name.rpartition(".")[2].lower()
            first = call.args[0].value if call and call.args and isinstance(call.args[0], ast.Constant) and isinstance(call.args[0].value, str) else None
            self.add("decorator", name, d, enclosing_function=node.name, method=verb.upper() if verb in VERBS and first is not None else None, path=first if verb in VERBS else None)

    def visit(self, node, guarded: bool = False) -> None:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            self.add("function", node.name, node, is_async=isinstance(node, ast.AsyncFunctionDef), body=self.source(node))
            self.decorators(node)
            args = node.args
            self.functions.append(node.name)
            for a in [*args.posonlyargs, *args.args, *args.kwonlyargs, *filter(None, (args.vararg, args.kwarg))]:
                self.add("parameter", a.arg, a)
            for child in [*node.decorator_list, *args.defaults, *filter(None, args.kw_defaults), *node.body]:
                self.visit(child, guarded)
            self.functions.pop()
            return
        if isinstance(node, ast.ClassDef):
            self.add("class", node.name, node)
            self.decorators(node)
            for b in node.bases:
                self.add("extends", self.source(b).partition("[")[0], b, enclosing_function=node.name)
            self.types.append(node.name)
            for child in node.body:
                self.visit(child, guarded)
            self.types.pop()
            return
        if isinstance(node, (ast.Import, ast.ImportFrom)):
            shape = {"body_shape": "type_only"} if guarded else {}
            bound = ",".join(a.asname or a.name.partition(".")[0] for a in node.names)
            if isinstance(node, ast.Import):
                for a in node.names:
                    self.add("import", a.name, node, owner_type=a.asname or a.name.partition(".")[0], **shape)
            else:
                dots = "./" if node.level == 1 else "../" * (node.level - 1)
                self.add("import", (dots if node.level else "") + (node.module or ""), node, owner_type=bound, **shape)
            for a in node.names:
                self.symbol("binding", a.asname or a.name.partition(".")[0], node)
            return
        if isinstance(node, ast.Lambda):
            self.add("callable_boundary", "", node)
        if isinstance(node, (ast.Assign, ast.AnnAssign)):
            for t in node.targets if isinstance(node, ast.Assign) else [node.target]:
                for n in ast.walk(t):
                    if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store):
                        self.add("variable", n.id, n)
            if isinstance(node, ast.AnnAssign) and isinstance(node.target, ast.Name):
                self.add("type_ref", self.source(node.annotation).partition("[")[0], node.annotation, enclosing_function=node.target.id)
        if isinstance(node, ast.Call):
            self.add("call", self.source(node.func), node)
        if isinstance(node, FLOW):
            self.add("control_flow", type(node).__name__.lower(), node)
        if isinstance(node, ast.ExceptHandler):
            self.add("catch", self.source(node.type) if node.type else "", node)
        if isinstance(node, ast.Raise):
            self.add("throw", self.source(node.exc) if node.exc else "", node)
        if isinstance(node, ast.Name) and isinstance(node.ctx, ast.Load):
            self.symbol("reference", node.id, node)
        inside = guarded or isinstance(node, ast.If) and self.source(node.test).endswith("TYPE_CHECKING")
        for child in ast.iter_child_nodes(node):
            self.visit(child, inside)


def extract(text: str) -> tuple[list[dict], list[dict], str | None]:
    try:
        tree = ast.parse(text)
        w = Walker(text)
        for node in tree.body:
            w.visit(node)
    except (SyntaxError, ValueError, RecursionError) as e:
        return [], [], f"syntax error: {e}"
    return w.entities, w.symbols, None
