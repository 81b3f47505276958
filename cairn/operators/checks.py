"""Integrity checks: each gives a DataFrame of (level, code, message)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.paths import REFERENCE_KINDS
from cairn.functions.text import normalized_label

from .joins import dangling_edges


def _issue(rows: DataFrame, level: str, code: str, message: Column) -> DataFrame:
    return rows.select(F.lit(level).alias("level"), F.lit(code).alias("code"), message.alias("message"))


def union(found: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, found)


def _defined(symbols: DataFrame) -> DataFrame:
    return symbols.where(~F.coalesce("kind", F.lit("")).isin(*REFERENCE_KINDS))


def metadata(meta: DataFrame, nodes: DataFrame, schema_version: int) -> DataFrame:
    n = nodes.agg(F.count("*").alias("_n"))
    return union([
        _issue(meta.where("coalesce(repo_name, '') = ''"), "error", "META_REPO_NAME", F.lit("the repository has no name")),
        _issue(meta.where(~F.col("schema_version").eqNullSafe(F.lit(schema_version))), "error", "META_SCHEMA", F.concat(F.lit("schema version "), F.coalesce(F.col("schema_version").cast("string"), F.lit("none")))),
        _issue(meta.crossJoin(n).where("node_count <> _n"), "warning", "META_NODE_COUNT", F.concat(F.lit("metadata count "), "node_count", F.lit(", found "), "_n")),
    ])


def no_modules(symbols: DataFrame, modules: DataFrame) -> DataFrame:
    both = symbols.agg(F.count("*").alias("s")).crossJoin(modules.agg(F.count("*").alias("m")))
    return _issue(both.where("s > 0 AND m = 0"), "error", "NO_MODULES", F.lit("there are symbols, but no modules"))


def references(kind: str, owners: DataFrame, ids: str, valid: DataFrame, key: str = "id") -> DataFrame:
    """A row per member of the array ids that isn't in valid."""
    rows = owners.select(F.col(key).alias("_o"), F.explode(ids).alias("_m"))
    lost = rows.join(valid.select(F.col("id").alias("_m")).distinct(), "_m", "left_anti")
    return _issue(lost, "error", f"{kind}_REF", F.concat("_o", F.lit(f" refers to {kind.lower()} "), "_m"))


def bad_summaries(modules: DataFrame, summaries: DataFrame) -> DataFrame:
    rows = modules.where("summary_id IS NOT NULL").join(summaries.select(F.col("id").alias("summary_id")), "summary_id", "left_anti")
    return _issue(rows, "error", "MODULE_BAD_SUMMARY", F.concat("id", F.lit(" refers to summary "), "summary_id"))


def symbols_known(symbols: DataFrame, nodes: DataFrame) -> DataFrame:
    return _issue(symbols.join(nodes.select("id"), "id", "left_anti"), "error", "SYMBOL_NOT_NODE", F.concat("id", F.lit(" is no graph node")))


def symbols_named(symbols: DataFrame) -> DataFrame:
    return _issue(symbols.where("coalesce(name, '') = ''"), "warning", "SYMBOL_NO_NAME", F.concat("id", F.lit(" has no name")))


def symbols_placed(symbols: DataFrame) -> DataFrame:
    return _issue(_defined(symbols).where("start_line IS NULL"), "warning", "SYMBOL_NO_START_LINE", F.concat("id", F.lit(" has no start line")))


def symbols_in_modules(symbols: DataFrame, modules: DataFrame) -> DataFrame:
    lost = symbols.where("module_id IS NOT NULL").join(modules.select(F.col("id").alias("module_id")), "module_id", "left_anti")
    return union([
        _issue(_defined(symbols).where("module_id IS NULL"), "warning", "SYMBOL_NO_MODULE", F.concat("id", F.lit(" is in no module"))),
        _issue(lost, "error", "SYMBOL_BAD_MODULE", F.concat("id", F.lit(" refers to module "), "module_id")),
    ])


def repeated_definitions(symbols: DataFrame) -> DataFrame:
    rows = _defined(symbols).where("start_line IS NOT NULL").groupBy("name", "source_file", "start_line").agg(F.count("*").alias("n")).where("n > 1")
    return _issue(rows, "error", "DUP_SYMBOL_DEF", F.concat_ws(" ", "name", "source_file", "start_line"))


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return _issue(dangling_edges(edges, nodes), "error", "GRAPH_DANGLING_EDGE", F.col("id"))


def orphan_concepts(concepts: DataFrame, referenced: DataFrame) -> DataFrame:
    """Concepts without related ids that no row of referenced (id) names."""
    return _issue(concepts.where("size(related_ids) = 0").join(referenced.select("id"), "id", "left_anti"), "warning", "ORPHAN_CONCEPT", F.col("id"))


def database(tables: DataFrame) -> DataFrame:
    twice = tables.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")
    return union([_issue(twice, "error", "DUP_DB_TABLE", F.col("id")), _issue(tables.where("size(columns) = 0"), "warning", "DB_TABLE_NO_COLUMNS", F.col("id"))])


def repeated_summaries(summaries: DataFrame) -> DataFrame:
    return _issue(summaries.groupBy("module_id").agg(F.count("*").alias("n")).where("n > 1"), "error", "DUP_SUMMARY", F.col("module_id"))


def repeated_concepts(concepts: DataFrame) -> DataFrame:
    return _issue(concepts.groupBy(normalized_label(F.col("label")).alias("label")).agg(F.count("*").alias("n")).where("n > 1"), "error", "DUP_CONCEPT", F.col("label"))


def validate(catalog: dict[str, DataFrame], schema_version: int) -> DataFrame:
    """All checks over a catalog."""
    c = catalog
    m = c["modules"]
    named = m.select(F.explode("concept_ids").alias("id")).distinct()
    arrays = [("SYMBOL", "symbol_ids", "symbols"), ("CONCEPT", "concept_ids", "concepts"), ("SERVICE", "service_ids", "services"), ("CONTROLLER", "controller_ids", "controllers"), ("API", "api_ids", "apis"), ("WORKFLOW", "workflow_ids", "workflows"), ("MODULE", "related_module_ids", "modules")]
    return union([
        metadata(c["metadata"], c["graph_nodes"], schema_version), no_modules(c["symbols"], m), *[references(k, m, a, c[v]) for k, a, v in arrays], bad_summaries(m, c["summaries"]),
        symbols_known(c["symbols"], c["graph_nodes"]), symbols_named(c["symbols"]), symbols_placed(c["symbols"]), symbols_in_modules(c["symbols"], m), repeated_definitions(c["symbols"]),
        dangling(c["relationships"], c["graph_nodes"]), orphan_concepts(c["concepts"], named), database(c["db_tables"]), repeated_summaries(c["summaries"]), repeated_concepts(c["concepts"]),
    ])
