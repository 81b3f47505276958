"""Tables and indexes of SQL files, by a small tokenizer: CREATE TABLE and CREATE INDEX of any dialect.

Other statements and those that can't be read are passed over. Types keep their source text in capitals.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

COLUMN = "struct<name:string,data_type:string,nullable:boolean,primary_key:boolean,unique:boolean,default:string,references_table:string,references_column:string>"
CONSTRAINT = "struct<kind:string,name:string,columns:array<string>,references_table:string,references_columns:array<string>,expression:string>"
INDEX = "struct<name:string,table:string,columns:array<string>,unique:boolean,source_file:string,source_location:string>"
TABLES = f"id string, ord int, kind string, name string, schema_name string, columns array<{COLUMN}>, constraints array<{CONSTRAINT}>, indexes array<{INDEX}>, source_file string, source_location string, index {INDEX}"

_TOKEN = re.compile(r"--[^\n]*|/\*.*?\*/|('(?:[^']|'')*')|\"([^\"]*)\"|`([^`]*)`|\[([A-Za-z_]\w*)\]|([A-Za-z_][\w$]*)|(\d+(?:\.\d+)?)|(\S)", re.S)
STOPS = ("PRIMARY", "NOT", "NULL", "UNIQUE", "DEFAULT", "REFERENCES", "CHECK", "CONSTRAINT", "GENERATED", "COLLATE", "COMMENT", "AUTO_INCREMENT", "AUTOINCREMENT", "ON")


def tokens(sql: str) -> list[str]:
    """Tokens with quotes of names taken off; comments are left out; a quoted name keeps a leading NUL."""
    out = []
    for m in _TOKEN.finditer(sql):
        name = next((m[i] for i in (2, 3, 4) if m[i] is not None), None)
        if name is not None:
            out.append("\0" + name)
        elif m.lastindex:
            out.append(m[0])
    return out


def _bare(token: str) -> str:
    return token.removeprefix("\0")


def statements(sql: str) -> Iterator[list[str]]:
    held: list[str] = []
    for t in tokens(sql):
        if t == ";":
            yield held
            held = []
        else:
            held.append(t)
    yield held


def _parts(body: list[str]) -> list[list[str]]:
    """The items of a bracketed list, split at commas of its own level."""
    out, depth, held = [], 0, []
    for t in body:
        depth += (t == "(") - (t == ")")
        if t == "," and not depth:
            out.append(held)
            held = []
        else:
            held.append(t)
    return [x for x in [*out, held] if x]


def _group(ts: list[str], at: int) -> tuple[list[str], int]:
    """(content of the brackets that open at at, place behind them)."""
    depth = 0
    for k in range(at, len(ts)):
        depth += (ts[k] == "(") - (ts[k] == ")")
        if not depth:
            return ts[at + 1 : k], k + 1
    raise ValueError("brackets are left open")


def _names(ts: list[str]) -> list[str]:
    return [_bare(p[0]) for p in _parts(ts)]


def _qualified(ts: list[str], at: int) -> tuple[str | None, str, int]:
    parts = [_bare(ts[at])]
    at += 1
    while at + 1 < len(ts) and ts[at] == ".":
        parts.append(_bare(ts[at + 1]))
        at += 2
    return (parts[-2] if len(parts) > 1 else None), parts[-1], at


def _text(ts: list[str]) -> str:
    return re.sub(r" ?([(),.]) ?", r"\1", " ".join(map(_bare, ts)))


def _target(ts: list[str], at: int) -> tuple[str, list[str], int]:
    _, table, at = _qualified(ts, at)
    columns: list[str] = []
    if at < len(ts) and ts[at] == "(":
        inner, at = _group(ts, at)
        columns = _names(inner)
    return table, columns, at


def _column(ts: list[str]) -> dict:
    upper = [t.upper() for t in ts]
    end = next((k for k in range(1, len(ts)) if upper[k] in STOPS), len(ts))
    c = {"name": _bare(ts[0]), "data_type": _text(ts[1:end]).upper() or None, "nullable": None, "primary_key": False, "unique": False, "default": None, "references_table": None, "references_column": None}
    k = end
    while k < len(ts):
        two = upper[k : k + 2]
        if two == ["PRIMARY", "KEY"]:
            c["primary_key"], c["nullable"] = True, False
            k += 2
        elif two == ["NOT", "NULL"]:
            c["nullable"] = False
            k += 2
        elif upper[k] == "UNIQUE":
            c["unique"] = True
            k += 1
        elif upper[k] == "DEFAULT":
            stop = k + 2
            if stop < len(ts) and ts[stop] == "(":
                _, stop = _group(ts, stop)
            elif k + 1 < len(ts) and ts[k + 1] == "(":
                _, stop = _group(ts, k + 1)
            c["default"] = _text(ts[k + 1 : stop])
            k = stop
        elif upper[k] == "REFERENCES":
            table, columns, k = _target(ts, k + 1)
            c["references_table"], c["references_column"] = table, columns[0] if columns else None
        elif ts[k] == "(":
            _, k = _group(ts, k)
        else:
            k += 1
    return c


def _constraint(ts: list[str]) -> dict | None:
    name, upper = None, [t.upper() for t in ts]
    if upper[0] == "CONSTRAINT":
        name, ts, upper = _bare(ts[1]), ts[2:], upper[2:]
    out = {"kind": None, "name": name, "columns": [], "references_table": None, "references_columns": [], "expression": None}
    opens = ts.index("(") if "(" in ts else len(ts)
    if upper[:2] == ["PRIMARY", "KEY"]:
        return out | {"kind": "primary_key", "columns": _names(_group(ts, opens)[0])}
    if upper[:2] == ["FOREIGN", "KEY"]:
        inner, at = _group(ts, opens)
        table, columns, _ = _target(ts, upper.index("REFERENCES", at) + 1)
        return out | {"kind": "foreign_key", "columns": _names(inner), "references_table": table, "references_columns": columns}
    if upper[0] == "UNIQUE":
        return out | {"kind": "unique", "columns": _names(_group(ts, opens)[0])}
    if upper[0] == "CHECK":
        return out | {"kind": "check", "expression": _text(_group(ts, opens)[0])}
    return None


def line_of(sql: str, name: str) -> str | None:
    at = sql.lower().find(name.lower())
    return f"L{sql.count(chr(10), 0, at) + 1}" if at >= 0 else None


def tables(path: str, sql: str) -> Iterator[dict]:
    """Rows of kind table and of kind index (with the index apart, to be joined to its table)."""
    for k, ts in enumerate(statements(sql)):
        upper = [t.upper() for t in ts]
        if upper[:1] != ["CREATE"]:
            continue
        try:
            yield from _created(path, sql, k, ts, upper)
        except (ValueError, IndexError):
            continue


def _created(path: str, sql: str, k: int, ts: list[str], upper: list[str]) -> Iterator[dict]:
    row = {"ord": k, "source_file": path, "constraints": [], "indexes": [], "columns": []}
    words = upper[:5]
    if "TABLE" in words:
        at = upper.index("TABLE") + 1
        if upper[at : at + 3] == ["IF", "NOT", "EXISTS"]:
            at += 3
        schema, name, at = _qualified(ts, at)
        if at >= len(ts) or ts[at] != "(":
            return
        for part in _parts(_group(ts, at)[0]):
            head = part[0].upper()
            if head in ("CONSTRAINT", "PRIMARY", "FOREIGN", "UNIQUE", "CHECK") and not part[0].startswith("\0"):
                if found := _constraint(part):
                    row["constraints"].append(found)
            elif head not in ("KEY", "INDEX", "EXCLUDE", "LIKE") or part[0].startswith("\0"):
                row["columns"].append(_column(part))
        yield row | {"id": f"table::{path}::{name}", "kind": "table", "name": name, "schema_name": schema, "source_location": line_of(sql, name)}
    elif "INDEX" in words:
        on = upper.index("ON")
        at = upper.index("INDEX") + 1
        while upper[at] in ("IF", "NOT", "EXISTS", "CONCURRENTLY"):
            at += 1
        _, table, behind = _qualified(ts, on + 1)
        opens = ts.index("(", behind)
        own = {"name": _qualified(ts, at)[1] if at < on else None, "table": table, "columns": _names(_group(ts, opens)[0]), "unique": "UNIQUE" in words, "source_file": path, "source_location": None}
        yield row | {"id": None, "kind": "index", "name": table, "index": own}
