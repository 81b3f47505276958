"""Route paths, decorators and return annotations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The verbs, and the patterns of a path parameter and of a first text argument.
HTTP_METHODS = ("get", "post", "put", "patch", "delete", "head", "options", "trace")
PARAMETER = r"[{<:][^}>/]*[}>]?"
FIRST_TEXT = r"""\(\s*[rbuf]*["']([^"']*)["']"""


def normalize_path(path: Column) -> Column:
    """Parameters become {}; lower case; one leading slash and none at the end."""
    bare = F.regexp_replace(F.regexp_replace(path, PARAMETER, "{}"), "^/+|/+$", "")
    return F.concat(F.lit("/"), F.lower(bare))


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def clean_segments(path: Column) -> Column:
    return F.filter(F.transform(F.split(path, "/"), lambda s: F.lower(F.trim(s))), lambda s: s != "")


def suffix_of(full: Column, tail: Column) -> Column:
    """Whether the path tail is a run of whole segments at the end of full; the bare slash never is."""
    f, t = segments(full), segments(tail)
    return (F.size(t) > 0) & (F.size(t) <= F.size(f)) & (F.slice(f, F.greatest(F.size(f) - F.size(t), F.lit(0)) + 1, F.greatest(F.size(t), F.lit(1))) == t)


def suffixes(path: Column) -> Column:
    """All whole-segment tails of a path, each with its leading slash."""
    s = segments(path)
    return F.when(F.size(s) > 0, F.transform(F.sequence(F.lit(1), F.size(s)), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(s, i, F.size(s)), "/")))).otherwise(F.array().cast("array<string>"))


def name_prefixes(name: Column) -> Column:
    """The parts of a name before each underscore: a_b_c gives a and a_b."""
    parts = F.split(name, "_")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "_"))).otherwise(F.array().cast("array<string>"))


def decorator_verb(decorator: Column) -> Column:
    low = F.lower(decorator)
    verbs = "|".join(HTTP_METHODS)
    call, mapping = F.regexp_extract(low, rf"\.({verbs})\s*\(", 1), F.regexp_extract(low, rf"({verbs})mapping", 1)
    return F.upper(F.when(call != "", call).otherwise(mapping))


def decorator_path(decorator: Column) -> Column:
    """The route of a decorator: its first positional text; with a verb and none, a slash; else null."""
    found = F.regexp_extract(decorator, FIRST_TEXT, 1)
    verb = decorator_verb(decorator)
    is_route = (verb != "") | F.lower(decorator).rlike(r"route\s*\(|requestmapping|\.path\s*\(")
    path = F.when(found != "", F.when(found.startswith("/"), found)).when(verb != "", F.lit("/"))
    return F.when(is_route, path)


def receiver(decorator: Column) -> Column:
    return F.regexp_extract(decorator, r"^@?([A-Za-z_]\w*)\s*\.", 1)


def derived_name(method: Column, path: Column) -> Column:
    """GET /documents/{id} gives get_documents_id."""
    parts = F.transform(segments(path), lambda s: F.regexp_replace(F.regexp_replace(F.lower(s), r"[{}<>:]", ""), r"\W+", "_"))
    return F.concat_ws("_", F.lower(method), F.filter(parts, lambda s: s != ""))


def wanted_segments(path: Column) -> Column:
    """The segments of a normalized path that aren't parameters."""
    return F.array_distinct(F.filter(segments(path), lambda s: ~s.contains("{}")))


def return_type(signature: Column) -> Column:
    """The bare class of a return annotation, through three generic layers and the left of a union."""
    out = F.trim(F.regexp_extract(signature, r"->\s*(.+)$", 1))
    for _ in range(3):
        inner = F.regexp_extract(out, r"^[\w.]+\[(.*)\]$", 1)
        out = F.when(inner != "", F.trim(F.substring_index(inner, ",", 1))).otherwise(out)
    out = F.trim(F.substring_index(out, "|", 1))
    out = F.regexp_replace(out, "^[\"']|[\"']$", "")
    return F.when(out.rlike(r"^[A-Za-z_]\w*$") & (out != "None"), out)
