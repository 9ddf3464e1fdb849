"""Columns and tensor shapes that Python source names, as targets of type references.

``col::a`` is a column in use, ``col::x <- op(col::a, col::b)`` how one comes from others, ``shape::[b, c]`` a shape and
``shape::x::[b, c]`` that of a variable.
"""

from __future__ import annotations

import ast
import io
import re
import tokenize
from collections.abc import Iterator

#: Methods whose arguments name columns. Fixed values.
COLUMN_METHODS = frozenset("select with_columns filter groupby group_by agg drop rename join merge alias".split())
#: Those of them whose keyword arguments make columns. Fixed values.
MAKING_METHODS = frozenset("with_columns select agg".split())

_NAME = re.compile(r"\w+")
_SHAPE_NOTE = re.compile(r"shape:(.*)|Tensor\[([^\]]*)\]")


def _text(node: ast.AST) -> str | None:
    return node.value if isinstance(node, ast.Constant) and isinstance(node.value, str) and node.value else None


def _bare(node: ast.AST) -> str | None:
    """A string that could be a column's name."""
    text = _text(node)
    return text if text and _NAME.fullmatch(text) else None


def _column_call(node: ast.AST) -> list[str] | None:
    """Strings given to ``col(…)`` or ``x.col(…)``; None if it isn't such a call."""
    if isinstance(node, ast.Call) and (node.func.attr if isinstance(node.func, ast.Attribute) else getattr(node.func, "id", None)) == "col":
        return [t for a in node.args if (t := _text(a))]
    return None


def columns_in(node: ast.AST, bare: bool = True) -> Iterator[str]:
    """Columns that an expression reads: of column calls anywhere in it and, if ``bare``, of plain strings."""
    named = _column_call(node)
    if named is not None:
        yield from named
    elif bare and (name := _bare(node)):
        yield name
    else:
        for child in ast.iter_child_nodes(node):
            yield from columns_in(child, bare)


def _derived(column: str, how: str, sources: Iterator[str]) -> list[str]:
    found = sorted(set(sources))
    return [f"col::{column} <- {how}({', '.join(f'col::{s}' for s in found)})", f"col::{column}"] if found else []


def of_call(node: ast.Call) -> list[str]:
    """What a call of a table's method says of columns."""
    method = node.func.attr if isinstance(node.func, ast.Attribute) else getattr(node.func, "id", "")
    if method not in COLUMN_METHODS:
        return []
    out = []
    for k in node.keywords if method in MAKING_METHODS else ():
        out += _derived(k.arg, method, columns_in(k.value)) if k.arg else []
    if method == "alias" and isinstance(node.func, ast.Attribute):
        name = next((t for a in node.args if (t := _text(a))), None)
        out += _derived(name, "select", columns_in(node.func.value)) if name else []
    for table in node.args if method == "rename" else ():
        for key, value in zip(table.keys, table.values, strict=True) if isinstance(table, ast.Dict) else ():
            if key is not None and (old := _text(key)) and (new := _text(value)):
                out += _derived(new, "rename", iter([old]))
    for argument in (*node.args, *node.keywords):
        out += [f"col::{c}" for c in columns_in(argument, bare=False)]
    for argument in node.args:
        out += [f"col::{c}" for x in (argument.elts if isinstance(argument, ast.List) else [argument]) if (c := _bare(x))]
    return out


def _shape(name: str | None, text: str) -> list[str]:
    dims = [d.strip() for d in text.split(",") if d.strip()]
    shape = f"[{', '.join(dims)}]"
    return ([f"shape::{name}::{shape}"] if name else []) + [f"shape::{shape}"] if dims else []


def of_annotation(name: str, annotation: ast.AST | None) -> list[str]:
    """The shape within a tensor's annotation."""
    text = ast.unparse(annotation) if annotation is not None else ""
    m = re.search(r"\[(.*)\]", text, re.S) if "Tensor" in text or "Parameter" in text else None
    return _shape(name, m[1].strip().strip("'\"")) if m else []


def _identifiers(node: ast.AST) -> list[str]:
    return [x.id for x in ast.walk(node) if isinstance(x, ast.Name)]


def of_assignment(targets: list[ast.expr], value: ast.AST) -> list[str]:
    """``a, b = x.shape`` and ``df["x"] = …``."""
    out = []
    for left in targets:
        if isinstance(value, ast.Attribute) and value.attr == "shape":
            out += _shape(ast.unparse(value.value), ", ".join(_identifiers(left)))
        if isinstance(left, ast.Subscript) and re.search("df|data", ast.unparse(left.value)):
            column = left.slice.id if isinstance(left.slice, ast.Name) else _bare(left.slice)
            out += _derived(column, "assign", columns_in(value)) if column else []
    return out


def notes(text: str, assigned: dict[int, str]) -> Iterator[tuple[int, str]]:
    """``line, target`` of shapes in comments; ``assigned``: the first name that is assigned on a line.

    The variable is the one of the comment's line or else of the next.
    """
    if "shape:" not in text and "Tensor[" not in text:
        return
    for token in tokenize.generate_tokens(io.StringIO(text).readline):
        m = _SHAPE_NOTE.search(token.string) if token.type == tokenize.COMMENT else None
        if m:
            line = token.start[0]
            name = assigned.get(line) or assigned.get(line + 1)
            for target in _shape(name, (m[1] or m[2] or "").strip().strip("()[]'\"")):
                yield line, target
