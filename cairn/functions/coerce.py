"""Coercions of loosely typed input, identity strings and small text rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the vocabularies.
FILE_TYPES = ("code", "document", "paper", "image", "rationale", "concept")
CONFIDENCES = ("EXTRACTED", "INFERRED", "AMBIGUOUS")
HYPEREDGES = ("participate_in", "implement", "form")
CALLS = ("calls", "indirect_call")
IMPORTS = ("imports", "imports_from", "re_exports")
REFERENCES = ("references", "uses")
SEMANTIC = ("conceptually_related_to", "semantically_similar_to", "rationale_for", "references", "cites")


def opt(value: Column) -> Column:
    """Null for empty text."""
    return F.nullif(value.cast("string"), F.lit(""))


def opt_trim(value: Column) -> Column:
    return F.nullif(F.trim(value.cast("string")), F.lit(""))


def first_text(*values: Column) -> Column:
    return F.coalesce(*[opt(v) for v in values])


def number_or(value: Column, default: float | None) -> Column:
    got = value.cast("string").try_cast("double")
    return got if default is None else F.coalesce(got, F.lit(float(default)))


def file_type(value: Column) -> Column:
    """Missing is code; an unknown value is an error."""
    v = F.coalesce(opt(value), F.lit("code"))
    return F.when(v.isin(*FILE_TYPES), v).otherwise(F.raise_error(F.concat(F.lit("unknown file type: "), v)).cast("string"))


def confidence(value: Column) -> Column:
    return F.when(value.isin(*CONFIDENCES), value).otherwise("EXTRACTED")


def hyperedge_relation(value: Column) -> Column:
    return F.when(value.isin(*HYPEREDGES), value).otherwise("participate_in")


def relation_kind(relation: Column) -> Column:
    return F.when(relation.isin(*IMPORTS), "import").when(relation.isin(*REFERENCES), "reference")


def edge_id(source: Column, relation: Column, target: Column) -> Column:
    return F.concat(source, F.lit("--"), relation, F.lit("-->"), target)


def visibility(name: Column) -> Column:
    return F.when(name.rlike("^__.*__$"), "public").when(name.startswith("__"), "private").when(name.startswith("_"), "protected").otherwise("public")


def ref_name(ref: Column) -> Column:
    return opt(F.substring_index(ref, "/", -1))


def base_path(path: Column) -> Column:
    return F.regexp_replace(F.coalesce(path, F.lit("")), "/+$", "")


def locate_line(sql: Column, name: Column) -> Column:
    """L and the 1-based line of the first occurrence in any case; null if there is none."""
    at = F.instr(F.lower(sql), F.lower(name))
    before = F.substring(sql, F.lit(1), at - 1)
    return F.when(at > 0, F.concat(F.lit("L"), F.length(before) - F.length(F.translate(before, "\n", "")) + 1))


def as_json(*columns: str) -> Column:
    return F.to_json(F.struct(*columns) if columns else F.struct("*"), {"ignoreNullFields": "false"})
