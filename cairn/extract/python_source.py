"""Definitions, calls and imports of Python files, by the standard library's parser."""

from __future__ import annotations

import ast
from collections.abc import Iterator

DEFINITIONS = "source_file string, ord int, name string, kind string, qualified_name string, start_line int, end_line int, start_col int, end_col int, signature string, docstring string, decorators array<string>, is_async boolean, is_static boolean, is_abstract boolean, visibility string, bases array<string>, returns string"
CALLS = "source_file string, ord int, caller string, callee string, receiver_class string, receiver_call string, is_attribute boolean, line int"
IMPORTS = "source_file string, ord int, alias string, module string, name string"

Function = ast.FunctionDef | ast.AsyncFunctionDef


def dotted(path: str) -> str:
    parts = path.removesuffix(".py").split("/")
    return ".".join(parts[:-1] if parts[-1] == "__init__" else parts)


def visibility(name: str) -> str:
    if name.startswith("__"):
        return "public" if name.endswith("__") and len(name) > 4 else "private"
    return "protected" if name.startswith("_") else "public"


def class_of(annotation: ast.expr | str | None) -> str | None:
    """The bare class that an annotation names, through Optional, unions, generics and quotes."""
    if isinstance(annotation, str):
        try:
            annotation = ast.parse(annotation, mode="eval").body
        except SyntaxError:
            return None
    match annotation:
        case ast.Constant(value=str(text)):
            return class_of(text)
        case ast.Name(id=name):
            return None if name in ("None", "Any") else name
        case ast.Attribute(attr=name):
            return name
        case ast.BinOp(op=ast.BitOr(), left=left, right=right):
            return class_of(left) or class_of(right)
        case ast.Subscript(value=outer, slice=inner):
            name = class_of(outer)
            if name in ("Optional", "Union", "Annotated", "Final", "ClassVar", "Type", "type"):
                return class_of(inner.elts[0] if isinstance(inner, ast.Tuple) else inner)
            return name
    return None


def scopes(tree: ast.Module, module: str) -> Iterator[tuple[ast.AST, str, str, str | None]]:
    """(node, kind, qualified name, enclosing class) of definitions that stand directly in a module, class or function."""

    def walk(body: list[ast.stmt], scope: str, owner: str | None):
        for node in body:
            if isinstance(node, ast.ClassDef):
                name = f"{scope}.{node.name}" if scope else node.name
                yield node, "class", name, owner
                yield from walk(node.body, name, node.name)
            elif isinstance(node, Function):
                name = f"{scope}.{node.name}" if scope else node.name
                yield node, "method" if owner else "function", name, owner
                yield from walk(node.body, name, None)

    yield from walk(tree.body, module, None)


def signature(node: ast.AST) -> str | None:
    if isinstance(node, ast.ClassDef):
        bases = ", ".join(map(ast.unparse, node.bases))
        return f"({bases})" if bases else None
    returns = f" -> {ast.unparse(node.returns)}" if node.returns else ""
    return f"({ast.unparse(node.args)}){returns}"


def definitions(path: str, text: str) -> Iterator[dict]:
    for k, (node, kind, name, _) in enumerate(scopes(ast.parse(text), dotted(path))):
        marks = [ast.unparse(d) for d in node.decorator_list]
        yield {
            "source_file": path, "ord": k, "name": node.name, "kind": kind, "qualified_name": name, "start_line": node.lineno, "end_line": node.end_lineno,
            "start_col": node.col_offset, "end_col": node.end_col_offset, "signature": signature(node), "docstring": ast.get_docstring(node), "decorators": marks,
            "is_async": isinstance(node, ast.AsyncFunctionDef), "is_static": any(m in ("staticmethod", "classmethod") for m in marks), "is_abstract": any("abstract" in m for m in marks),
            "visibility": visibility(node.name), "bases": [b for b in map(class_of, getattr(node, "bases", [])) if b], "returns": class_of(getattr(node, "returns", None)),
        }


def own_nodes(body: list[ast.stmt]) -> Iterator[ast.AST]:
    """Nodes of a body in order, without those of nested definitions."""
    stack = list(reversed(body))
    while stack:
        node = stack.pop()
        if isinstance(node, (*Function.__args__, ast.ClassDef, ast.Lambda)):
            continue
        yield node
        stack.extend(reversed(list(ast.iter_child_nodes(node))))


def value_type(value: ast.expr | None) -> tuple[str | None, str | None]:
    """(class, function) of Foo(), f() or await f(): which of both a name is, a join decides later."""
    if isinstance(value, ast.Await):
        value = value.value
    if isinstance(value, ast.Call):
        name = class_of(value.func)
        return name, name
    return None, None


def bindings(fn: Function) -> dict[str, tuple[str | None, str | None]]:
    """Local names with (class, function that returns it); the last binding wins."""
    out: dict[str, tuple[str | None, str | None]] = {}
    every = [*fn.args.posonlyargs, *fn.args.args, *fn.args.kwonlyargs]
    out.update({a.arg: (class_of(a.annotation), None) for a in every if a.annotation})
    for node in own_nodes(fn.body):
        match node:
            case ast.AnnAssign(target=ast.Name(id=name), annotation=a):
                out[name] = (class_of(a), None)
            case ast.Assign(targets=[ast.Name(id=name)], value=value) if any(found := value_type(value)):
                out[name] = found
    return out


def attributes(cls: ast.ClassDef) -> dict[str, tuple[str | None, str | None]]:
    """Types of self.x: annotations of the class, then what __init__ binds."""
    out = {n.target.id: (class_of(n.annotation), None) for n in cls.body if isinstance(n, ast.AnnAssign) and isinstance(n.target, ast.Name)}
    init = next((n for n in cls.body if isinstance(n, Function) and n.name == "__init__"), None)
    if init:
        local = bindings(init)
        for node in own_nodes(init.body):
            match node:
                case ast.AnnAssign(target=ast.Attribute(value=ast.Name(id="self"), attr=name), annotation=a):
                    out[name] = (class_of(a), None)
                case ast.Assign(targets=[ast.Attribute(value=ast.Name(id="self"), attr=name)], value=value):
                    found = local.get(value.id) if isinstance(value, ast.Name) else value_type(value)
                    if found and any(found):
                        out[name] = found
    return out


def calls(path: str, text: str) -> Iterator[dict]:
    """A row per call within a function: callee, and what is known of its receiver."""
    tree = ast.parse(text)
    found = list(scopes(tree, dotted(path)))
    of_class = {node.name: attributes(node) for node, kind, _, _ in found if kind == "class"}
    k = 0
    for node, kind, name, owner in found:
        if kind == "class":
            continue
        local = bindings(node)
        for inner in own_nodes(node.body):
            if not isinstance(inner, ast.Call):
                continue
            row = {"source_file": path, "ord": k, "caller": name, "line": inner.lineno, "is_attribute": False, "receiver_class": None, "receiver_call": None}
            match inner.func:
                case ast.Name(id=callee):
                    row["callee"] = callee
                case ast.Attribute(value=receiver, attr=callee):
                    row |= {"callee": callee, "is_attribute": True}
                    match receiver:
                        case ast.Name(id="self") | ast.Name(id="cls"):
                            row["receiver_class"] = owner
                        case ast.Name(id=variable):
                            row["receiver_class"], row["receiver_call"] = local.get(variable, (None, None))
                        case ast.Attribute(value=ast.Name(id="self"), attr=field):
                            row["receiver_class"], row["receiver_call"] = of_class.get(owner or "", {}).get(field, (None, None))
                        case ast.Call():
                            row["receiver_class"], row["receiver_call"] = value_type(receiver)
                case _:
                    continue
            yield row
            k += 1


def imports(path: str, text: str) -> Iterator[dict]:
    """A row per imported name: its alias in the file, its absolute module and the name in it (null: the module)."""
    k = 0
    for node in ast.walk(ast.parse(text)):
        if isinstance(node, ast.Import):
            for a in node.names:
                yield {"source_file": path, "ord": k, "alias": a.asname or a.name.split(".")[0], "module": a.name, "name": None}
                k += 1
        elif isinstance(node, ast.ImportFrom):
            here = path.removesuffix(".py").split("/")
            base = here[: len(here) - node.level] if node.level else []
            module = ".".join([*base, *([node.module] if node.module else [])])
            for a in node.names:
                yield {"source_file": path, "ord": k, "alias": a.asname or a.name, "module": module, "name": a.name}
                k += 1
