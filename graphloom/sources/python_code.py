"""Facts of Python source, from its syntax tree."""

from __future__ import annotations

import ast
from collections.abc import Iterator

from graphloom.schema import COMBINATORS
from graphloom.sources import lineage
from graphloom.sources.facts import Fact, module_of

VERBS = ("get", "post", "put", "delete", "patch", "options", "head")
#: Types that are no references of interest, in lower case, with or without ``typing.``. Fixed values.
PLAIN_TYPES = frozenset("int str float bool list dict set tuple any none object bytes callable iterable iterator generator optional union type generic typevar".split())


def dotted(node: ast.AST) -> str | None:
    """``a.b.c`` of a chain of names."""
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        head = dotted(node.value)
        return f"{head}.{node.attr}" if head else None
    if isinstance(node, ast.Call):
        return dotted(node.func)
    return None


class _Walk(ast.NodeVisitor):
    def __init__(self, path: str):
        self.path, self.module, self.out = path, module_of(path, "."), []
        self.names: list[str] = []  # enclosing classes and functions
        self.classes: list[bool] = []
        self.calls: dict[str, int] = {}
        self.top: set[str] = set()
        self.methods: dict[str, set[str]] = {}
        self.assigned: dict[int, str] = {}  # the first name that is assigned on a line
        self.extents: list[tuple[int, int, str]] = []

    @property
    def scope(self) -> str:
        return f"{self.module}::{'.'.join(self.names)}" if self.names else self.module

    def add(self, fact: str, name: str, node: ast.AST | None = None, **more) -> None:
        line = getattr(node, "lineno", 1)
        self.out.append(Fact(fact, name, more.pop("qualified_name", self.scope), start_line=line, end_line=getattr(node, "end_lineno", line) or line, **more))

    def refer(self, targets: list[str], node: ast.AST) -> None:
        """Columns and shapes."""
        for t in targets:
            self.add("type", t, node, target=t)

    def assign(self, node: ast.Assign | ast.AnnAssign, targets: list[ast.expr]) -> None:
        name = next((x.id for x in ast.walk(targets[0]) if isinstance(x, ast.Name)), None)
        if name:
            self.assigned.setdefault(node.lineno, name)
        if node.value is not None:
            self.refer(lineage.of_assignment(targets, node.value), node)

    def visit_Assign(self, node: ast.Assign) -> None:
        self.assign(node, node.targets)
        self.generic_visit(node)

    def document(self, node) -> None:
        text = ast.get_docstring(node, clean=True)
        if text:
            self.add("doc", self.names[-1] if self.names else self.module, node.body[0], kind="Docstring", target=text)

    def decorators(self, node) -> list[tuple[str, ast.AST]]:
        return [(d, x) for x in node.decorator_list if (d := dotted(x))]

    def types(self, node: ast.AST | None) -> None:
        if isinstance(node, ast.Constant) and isinstance(node.value, str):
            try:
                node = ast.parse(node.value, mode="eval")
            except SyntaxError:
                return
        for x in ast.walk(node) if node is not None else ():
            name = dotted(x) if isinstance(x, ast.Name | ast.Attribute) else None
            if name and name.lower().removeprefix("typing.") not in PLAIN_TYPES and not (isinstance(x, ast.Name) and name == "typing"):
                self.add("type", name.rsplit(".", 1)[-1], x, target=name)

    def visit_Module(self, node: ast.Module) -> None:
        lines = max((getattr(x, "end_lineno", 1) or 1 for x in node.body), default=1)
        self.out.append(Fact("symbol", self.module.rsplit(".", 1)[-1], self.module, "Module", None, 1, lines))
        for x in node.body:
            if isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                self.top.add(x.name)
            if isinstance(x, ast.ClassDef):
                self.methods[x.name] = {y.name for y in x.body if isinstance(y, ast.FunctionDef | ast.AsyncFunctionDef)}
        self.document(node)
        self.generic_visit(node)

    def visit_Import(self, node: ast.Import) -> None:
        for a in node.names:
            self.add("import", a.asname or a.name, node, qualified_name=self.module, target=a.name)

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        base = node.module or ""
        if node.level:
            parts = self.module.split(".")[: -node.level]
            base = ".".join([*parts, *([base] if base else [])])
        for a in node.names:
            self.add("import", a.asname or a.name, node, qualified_name=self.module, target=f"{base}.{a.name}" if base else a.name)

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        self.names.append(node.name)
        self.classes.append(True)
        self.add("symbol", node.name, node, kind="Class")
        self.extents.append((node.lineno, node.end_lineno or node.lineno, self.scope))
        bases = [b for b in map(dotted, node.bases) if b]
        for b in bases:
            self.add("base", b.rsplit(".", 1)[-1], node, target=b)
        for d, x in self.decorators(node):
            self.add("decorator", d, x, target=d)
        if node.name.startswith("Test"):
            self.add("test", node.name, node, kind="Class", detail={"framework": "pytest"})
        self.document(node)
        if any(b.rsplit(".", 1)[-1] == "BaseModel" for b in bases):
            self.model(node)
        if any(b.rsplit(".", 1)[-1] == "Module" for b in bases):
            self.submodules(node)
        self.generic_visit(node)
        self.names.pop()
        self.classes.pop()

    def submodules(self, node: ast.ClassDef) -> None:
        """What the constructor of a module of a network assigns to ``self``, as symbols of the class."""
        for init in (x for x in node.body if isinstance(x, ast.FunctionDef) and x.name == "__init__"):
            for x in ast.walk(init):
                for t in x.targets if isinstance(x, ast.Assign) else ():
                    if isinstance(t, ast.Attribute) and isinstance(t.value, ast.Name) and t.value.id == "self":
                        self.add("symbol", t.attr, x, qualified_name=f"{self.scope}.{t.attr}", kind="Unknown")

    def model(self, node: ast.ClassDef) -> None:
        self.add("model", node.name, node)
        for x in node.body:
            if isinstance(x, ast.AnnAssign) and isinstance(x.target, ast.Name):
                default = ast.unparse(x.value) if x.value else None
                needed = default is None or "..." in default or "Ellipsis" in default
                self.add("field", x.target.id, x, kind=ast.unparse(x.annotation), target=default, detail={"required": str(needed).lower()})
            if isinstance(x, ast.FunctionDef):
                for d in x.decorator_list:
                    kind = (dotted(d) or "").rsplit(".", 1)[-1]
                    if kind in ("validator", "field_validator", "model_validator", "root_validator"):
                        fields = [a.value for a in d.args if isinstance(a, ast.Constant)] if isinstance(d, ast.Call) else []
                        self.add("validator", x.name, x, kind="field" if kind in ("validator", "field_validator") else "model", target=",".join(map(str, fields)))

    def function(self, node) -> None:
        method = bool(self.classes and self.classes[-1])
        self.names.append(node.name)
        self.classes.append(False)
        self.add("symbol", node.name, node, kind="Method" if method else "Function")
        decorators = self.decorators(node)
        marks = {d for d, _ in decorators}
        for d, x in decorators:
            self.add("decorator", d, x, target=d)
            last = d.rsplit(".", 1)[-1].lower()
            if "." in d and isinstance(x, ast.Call) and x.args and isinstance(x.args[0], ast.Constant) and (last in VERBS or last == "route"):
                kw = {k.arg: k.value for k in x.keywords}
                methods = [last.upper()] if last in VERBS else [e.value for e in getattr(kw.get("methods"), "elts", [])] or ["GET"]
                for m in methods:
                    self.add("route", node.name, node, kind=str(m).upper(), target=str(x.args[0].value), detail={"response_model": dotted(kw["response_model"]) or ""} if "response_model" in kw else {})
        if marks & {"fixture", "pytest.fixture"}:
            self.add("test", node.name, node, kind="Fixture", detail={"framework": "pytest"})
        elif node.name.startswith("test_"):
            self.add("test", node.name, node, kind="Function", detail={"framework": "pytest", "parametrized": str(any(m.endswith("parametrize") for m in marks)).lower()})
        a = node.args
        if node.name.startswith("test_"):  # what a test asks for by its parameters
            for arg in (*a.posonlyargs, *a.args, *a.kwonlyargs):
                if arg.arg not in ("self", "cls"):
                    self.add("link", arg.arg, arg, target=arg.arg)
        for arg in (*a.posonlyargs, *a.args, *a.kwonlyargs, a.vararg, a.kwarg):
            if arg is not None:
                self.refer(lineage.of_annotation(arg.arg, arg.annotation), arg)
                self.types(arg.annotation)
        self.types(node.returns)
        self.extents.append((node.lineno, node.end_lineno or node.lineno, self.scope))
        self.document(node)
        for x in node.body:
            self.visit(x)
        self.names.pop()
        self.classes.pop()

    visit_FunctionDef = visit_AsyncFunctionDef = function

    def visit_AnnAssign(self, node: ast.AnnAssign) -> None:
        self.assign(node, [node.target])
        if isinstance(node.target, ast.Name):
            self.refer(lineage.of_annotation(node.target.id, node.annotation), node)
        self.types(node.annotation)
        self.generic_visit(node)

    def call(self, name: str, node: ast.AST, **detail: str) -> None:
        """The known target with full confidence, or the text with less."""
        owner = next((n for n, c in zip(reversed(self.names), reversed(self.classes), strict=True) if c), None)
        if name.startswith(("self.", "cls.")) and owner:
            method = name.split(".", 1)[1]
            known = method in self.methods.get(owner, ())
            target, sure = (f"{self.module}::{owner}.{method}", "1.0") if known else (f"{owner}.{method}", "0.8")
        elif "." not in name:
            target, sure = (f"{self.module}::{name}", "1.0") if name in self.top else (name, "0.7")
        else:
            target, sure = name, "0.5"
        k = self.calls[self.scope] = self.calls.get(self.scope, -1) + 1
        self.add("call", name.rsplit(".", 1)[-1], node, target=target, ordering=k, detail={"confidence": sure} | detail)

    def visit_Call(self, node: ast.Call) -> None:
        name = dotted(node.func)
        self.refer(lineage.of_call(node), node)
        if name:
            last, more = name.rsplit(".", 1)[-1], {}
            if last == "partial" and node.args and (f := dotted(node.args[0])):
                more = {"placeholders": self.unfilled(f, len(node.args) - 1, {k.arg for k in node.keywords})}
                self.call(f, node, **more)
            else:
                self.call(name, node)
            if last in COMBINATORS:
                for x in node.args:
                    if isinstance(x, ast.Name | ast.Attribute) and (bare := dotted(x)):
                        self.call(bare, x)
        self.generic_visit(node)

    def unfilled(self, name: str, given: int, named: set) -> str:
        for x in ast.walk(self.tree):
            if isinstance(x, ast.FunctionDef) and x.name == name:
                return ", ".join(a.arg for a in x.args.args[given:] if a.arg not in named)
        return "?"

    def run(self, text: str) -> list[Fact]:
        self.tree = ast.parse(text)
        self.visit(self.tree)
        for line, target in lineage.notes(text, self.assigned):
            inner = max((e for e in self.extents if e[0] <= line <= e[1]), default=None)  # the one that begins last
            self.out.append(Fact("type", target, inner[2] if inner else self.module, target=target, start_line=line, end_line=line))
        return self.out


def extract(path: str, text: str) -> Iterator[Fact]:
    yield from _Walk(path).run(text)
