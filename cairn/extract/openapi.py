"""Operations of OpenAPI and Swagger documents in JSON or YAML."""

from __future__ import annotations

import json
from collections.abc import Iterator

OPERATIONS = "spec_file string, ord int, method string, path string, operation_id string, summary string, description string, tags array<string>, parameters array<string>, response_codes array<string>, request_schema string"
# The verbs of operations.
METHODS = frozenset({"get", "post", "put", "patch", "delete", "head", "options", "trace"})
HEAD = 4000


def looks_like_spec(text: str) -> bool:
    head = text[:HEAD]
    return ("openapi" in head or "swagger" in head) and "paths" in text


def load(path: str, text: str) -> dict | None:
    try:
        if path.lower().endswith(".json"):
            document = json.loads(text)
        else:
            import yaml

            document = yaml.safe_load(text)
    except Exception:  # a file that is no document of its kind holds no operations
        return None
    is_spec = isinstance(document, dict) and ("openapi" in document or "swagger" in document) and isinstance(document.get("paths"), dict)
    return document if is_spec else None


def _text(value) -> str | None:
    return None if isinstance(value, (dict, list)) or value is None else str(value).strip() or None


def schema_name(schema) -> str | None:
    if not isinstance(schema, dict):
        return None
    if isinstance(schema.get("$ref"), str):
        return schema["$ref"].rpartition("/")[2] or None
    items = schema.get("items")
    if isinstance(items, dict) and isinstance(items.get("$ref"), str):  # elements without a reference have no name
        return f"{items['$ref'].rpartition('/')[2]}[]"
    return _text(schema.get("type"))


def request_schema(body: dict) -> str | None:
    request = body.get("requestBody")
    if isinstance(request, dict):
        content = request.get("content")
        for media in content.values() if isinstance(content, dict) else ():
            if isinstance(media, dict) and (found := schema_name(media.get("schema"))):
                return found
        return request["$ref"].rpartition("/")[2] or None if isinstance(request.get("$ref"), str) else None
    for p in body.get("parameters") or []:
        if isinstance(p, dict) and p.get("in") == "body":
            return schema_name(p.get("schema"))
    return None


def names(parameters) -> list[str]:
    found = [_text(p.get("name")) or schema_name(p) for p in parameters or [] if isinstance(p, dict)]
    return [x for x in found if x]


def operations(path: str, text: str) -> Iterator[dict]:
    document = load(path, text) if looks_like_spec(text) else None
    base = str((document or {}).get("basePath") or "").rstrip("/")
    k = 0
    for route, item in (document or {"paths": {}})["paths"].items():
        if not isinstance(item, dict):
            continue
        for method, body in item.items():
            if str(method).lower() not in METHODS or not isinstance(body, dict):
                continue
            yield {
                "spec_file": path, "ord": k, "method": str(method).upper(), "path": f"{base}{route}", "operation_id": _text(body.get("operationId")), "summary": _text(body.get("summary")), "description": _text(body.get("description")),
                "tags": [t for t in map(_text, body.get("tags") or []) if t], "parameters": list(dict.fromkeys(names(item.get("parameters")) + names(body.get("parameters")))),
                "response_codes": [str(c) for c in body.get("responses") or {}], "request_schema": request_schema(body),
            }
            k += 1
