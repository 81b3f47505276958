"""Columns of the entity relations, and the schema version of a stored catalog."""

from __future__ import annotations

from pyspark.sql.types import StructType

from cairn.extract.ddl import COLUMN, CONSTRAINT, INDEX

SCHEMA_VERSION = 4

RELATIONS: dict[str, str] = {
    "graph_nodes": "id string, label string, file_type string, source_file string, source_location string, source_url string, captured_at string, author string, contributor string, rationale string, community_id string",
    "relationships": "id string, source_id string, target_id string, relation string, confidence string, confidence_score double, weight double, source_file string",
    "symbols": "id string, label string, name string, kind string, qualified_name string, source_file string, source_location string, start_line int, end_line int, start_col int, end_col int, language string, signature string, docstring string, decorators array<string>, is_async boolean, is_static boolean, is_abstract boolean, visibility string, module_id string, rationale string",
    "modules": "id string, name string, origin string, community_id string, cohesion double, symbol_ids array<string>, source_paths array<string>, related_module_ids array<string>, concept_ids array<string>, service_ids array<string>, controller_ids array<string>, api_ids array<string>, workflow_ids array<string>, summary_id string",
    "services": "id string, name string, symbol_ids array<string>, source_files array<string>, module_id string",
    "controllers": "id string, name string, symbol_ids array<string>, source_files array<string>, api_ids array<string>, module_id string",
    "apis": "id string, name string, method string, path string, origin string, operation_id string, summary string, description string, tags array<string>, parameters array<string>, response_codes array<string>, request_schema string, spec_file string, also_declared_in array<string>, spec_conflict boolean, handler_symbol_id string, controller_id string, module_id string, source_file string, confidence string",
    "workflows": "id string, name string, participant_ids array<string>, relation string, confidence string, confidence_score double, source_file string",
    "concepts": "id string, label string, file_type string, rationale string, source_file string, source_location string, confidence string, related_ids array<string>",
    "dependencies": "id string, source_id string, target_id string, target_name string, kind string, external boolean",
    "summaries": "id string, module_id string, purpose string, responsibilities array<string>, business_rules array<string>, dependencies array<string>, public_apis array<string>, workflows array<string>, constraints array<string>, concepts array<string>, god_nodes array<string>",
    "db_technologies": "id string, name string, category string, confidence string, evidence array<string>",
    "db_tables": f"id string, name string, schema_name string, columns array<{COLUMN}>, constraints array<{CONSTRAINT}>, indexes array<{INDEX}>, technology string, source_file string, source_location string, confidence string, evidence array<string>",
    "db_migrations": "id string, name string, technology string, operations array<string>, source_file string, confidence string",
    "metadata": "repo_path string, repo_name string, schema_version int, generated_by string, builder_version string, graph_version string, directed boolean, multigraph boolean, node_count long, edge_count long, community_count long, source_graph_hash string",
    "file_hashes": "source_file string, hash string",
}
ENTITIES = [k for k in RELATIONS if k not in ("metadata", "file_hashes")]


def schema(relation: str) -> StructType:
    return StructType.fromDDL(RELATIONS[relation])
