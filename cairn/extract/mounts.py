"""Routers and where they are mounted: x = APIRouter(prefix=...), p.include_router(c, prefix=...)."""

from __future__ import annotations

import ast
from collections.abc import Iterator

MOUNTS = "source_file string, ord int, kind string, router string, child string, prefix string"
# Constructors of routers, and their names of the prefix.
ROUTERS = ("APIRouter", "Router", "Blueprint", "FastAPI", "Flask")
PREFIXES = ("prefix", "url_prefix")
INCLUDES = ("include_router", "register_blueprint", "mount")


def _prefix(call: ast.Call) -> str:
    return next((str(k.value.value) for k in call.keywords if k.arg in PREFIXES and isinstance(k.value, ast.Constant)), "")


def _name(node: ast.expr) -> str | None:
    return node.id if isinstance(node, ast.Name) else f"{_name(node.value)}.{node.attr}" if isinstance(node, ast.Attribute) and _name(node.value) else None


def mounts(path: str, text: str) -> Iterator[dict]:
    if not any(x in text for x in (*INCLUDES, "Router(", "Blueprint(")):
        return
    k = 0
    for node in ast.walk(ast.parse(text)):
        row = None
        if isinstance(node, ast.Assign) and isinstance(node.value, ast.Call) and isinstance(node.targets[0], ast.Name):
            made = (_name(node.value.func) or "").rpartition(".")[2]
            if made in ROUTERS:
                row = {"kind": "router", "router": node.targets[0].id, "child": None, "prefix": _prefix(node.value)}
        elif isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute) and node.func.attr in INCLUDES and node.args:
            parent, child = _name(node.func.value), _name(node.args[-1])
            if parent and child:
                row = {"kind": "mount", "router": parent, "child": child, "prefix": _prefix(node)}
        if row:
            yield row | {"source_file": path, "ord": k}
            k += 1
