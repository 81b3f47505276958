"""Tables and operations of Alembic migrations: calls of op in upgrade(), or in the whole file without one."""

from __future__ import annotations

import ast
from collections.abc import Iterator

from .ddl import COLUMN, CONSTRAINT

MIGRATIONS = f"kind string, ord int, id string, name string, operations array<string>, columns array<{COLUMN}>, constraints array<{CONSTRAINT}>, source_file string, source_location string"
# Fixed values.
OPERATIONS = ("create_table", "drop_table", "add_column", "drop_column", "alter_column", "create_index", "drop_index", "create_foreign_key", "create_unique_constraint", "rename_table")
KINDS = {"PrimaryKeyConstraint": "primary_key", "ForeignKeyConstraint": "foreign_key", "UniqueConstraint": "unique", "CheckConstraint": "check"}


def _last(node: ast.expr) -> str:
    return node.attr if isinstance(node, ast.Attribute) else node.id if isinstance(node, ast.Name) else ""


def _texts(args) -> list[str]:
    return [a.value for a in args if isinstance(a, ast.Constant) and isinstance(a.value, str)]


def _keyword(call: ast.Call, name: str):
    return next((k.value for k in call.keywords if k.arg == name), None)


def _flag(call: ast.Call, name: str) -> bool | None:
    found = _keyword(call, name)
    return found.value if isinstance(found, ast.Constant) and isinstance(found.value, bool) else None


def column(call: ast.Call) -> dict | None:
    name = next(iter(_texts(call.args[:1])), None)
    if name is None:
        return None
    rest = call.args[1:]
    # The type is the second argument, named as the source names it.
    kind = _last(rest[0].func if isinstance(rest[0], ast.Call) else rest[0]) if rest else ""
    table, target = None, None
    for a in rest:
        if isinstance(a, ast.Call) and _last(a.func) == "ForeignKey":
            whole = next(iter(_texts(a.args)), "")
            table, target = whole.rpartition(".")[::2] if "." in whole else (whole, None)
            break
    default = _keyword(call, "server_default") or _keyword(call, "default")
    return {"name": name, "data_type": kind or None, "nullable": _flag(call, "nullable"), "primary_key": bool(_flag(call, "primary_key")), "unique": bool(_flag(call, "unique")), "default": ast.unparse(default) if default is not None else None, "references_table": table or None, "references_column": target or None}


def constraint(call: ast.Call) -> dict | None:
    kind = KINDS.get(_last(call.func))
    if not kind:
        return None
    named = _keyword(call, "name")
    out = {"kind": kind, "name": named.value if isinstance(named, ast.Constant) else None, "columns": _texts(call.args), "references_table": None, "references_columns": [], "expression": None}
    if kind == "check":
        return out | {"columns": [], "expression": next(iter(_texts(call.args)), None)}
    if kind == "foreign_key":
        lists = [_texts(a.elts) for a in call.args if isinstance(a, (ast.List, ast.Tuple))]
        own, far = (lists + [[], []])[:2]
        return out | {"columns": own, "references_table": far[0].rpartition(".")[0] if far else None, "references_columns": [f.rpartition(".")[2] for f in far]}
    return out


def fold(columns: list[dict], constraints: list[dict]) -> list[dict]:
    """Columns with what constraints over one column say of them; keys hold for all their columns."""
    for c in columns:
        for k in constraints:
            if c["name"] in k["columns"]:
                if k["kind"] == "primary_key":
                    c["primary_key"], c["nullable"] = True, False
                elif k["kind"] == "unique" and len(k["columns"]) == 1:
                    c["unique"] = True
                elif k["kind"] == "foreign_key":
                    at = k["columns"].index(c["name"])
                    c["references_table"] = k["references_table"]
                    c["references_column"] = k["references_columns"][at] if at < len(k["references_columns"]) else None
    return columns


def migrations(path: str, text: str) -> Iterator[dict]:
    if "from alembic import op" not in text:
        return
    tree = ast.parse(text)
    upgrade = next((n for n in tree.body if isinstance(n, ast.FunctionDef) and n.name == "upgrade"), tree)
    calls = [n for n in ast.walk(upgrade) if isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute) and n.func.attr in OPERATIONS and _last(n.func.value) in ("op", "batch_op")]
    calls.sort(key=lambda n: (n.lineno, n.col_offset))
    done = []
    for k, call in enumerate(calls):
        target = next(iter(_texts(call.args)), "")
        done.append(f"{call.func.attr} {target}".strip())
        if call.func.attr == "create_table" and target:
            made = [a for a in call.args[1:] if isinstance(a, ast.Call)]
            constraints = [c for c in map(constraint, made) if c]
            columns = fold([c for c in (column(a) for a in made if _last(a.func) == "Column") if c], constraints)
            yield {"kind": "table", "ord": k, "id": f"table::{path}::{target}", "name": target, "columns": columns, "constraints": constraints, "source_file": path, "source_location": f"L{call.lineno}"}
    if done:
        yield {"kind": "migration", "ord": 0, "id": f"migration::{path}", "name": path.rpartition("/")[2], "operations": done, "source_file": path}
