"""The search index and ranked keyword retrieval."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.paths import NON_COMPONENT_KINDS
from cairn.functions.text import asks_for_tests, is_test, question_stems, token_set

TEST_PENALTY = 0.4
#: A question for the database looks into these kinds.
DATABASE_KINDS = ("db_technology", "db_table", "db_migration")


def entities(rows: DataFrame, kind: str, id_: str, name: Column, body: Sequence[Column] = (), origin: Column | None = None) -> DataFrame:
    """rows as (kind, id, name, body, place): the body holds the name too, the place says whether it is a test."""
    return rows.select(F.lit(kind).alias("kind"), F.col(id_).cast("string").alias("id"), name.alias("name"), F.concat_ws(" ", name, *body).alias("body"), F.concat_ws(" ", origin if origin is not None else F.lit(""), name).alias("place"))


def tokenized(found: DataFrame) -> DataFrame:
    """entities with the stems of their names and bodies; over the union of all kinds, so that stems are planned once."""
    return found.select("kind", "id", "name", token_set(F.coalesce("name", F.lit(""))).alias("name_tokens"), token_set(F.col("body")).alias("body_tokens"), is_test(F.col("place")).alias("is_test"))


def searchable(rows: DataFrame, kind: str, id_: str, name: Column, body: Sequence[Column] = (), origin: Column | None = None) -> DataFrame:
    """rows as (kind, id, name, name_tokens, body_tokens, is_test)."""
    return tokenized(entities(rows, kind, id_, name, body, origin))


def build_index(catalog: dict[str, DataFrame]) -> DataFrame:
    """The union over ten kinds of entity of a catalog."""
    c = catalog
    summary = c["summaries"].select(F.col("module_id").alias("_m"), "purpose", "responsibilities", F.col("concepts").alias("_concepts"), F.col("workflows").alias("_workflows"), "public_apis")
    modules = c["modules"].join(summary, F.col("id") == F.col("_m"), "left")
    columns = F.transform("columns", lambda x: x["name"])
    parts = [
        entities(modules, "module", "id", F.col("name"), [F.col(x) for x in ("purpose", "responsibilities", "_concepts", "_workflows", "public_apis")], F.concat_ws(" ", "source_paths")),
        *[entities(c[f"{k}s"], k, "id", F.col("name")) for k in ("service", "controller", "workflow")],
        entities(c["apis"], "api", "id", F.col("name"), [F.col("method"), F.col("path")]),
        entities(c["concepts"], "concept", "id", F.col("label"), [F.col("rationale")]),
        entities(c["symbols"].where(~F.coalesce("kind", F.lit("")).isin(*NON_COMPONENT_KINDS)), "symbol", "id", F.coalesce(F.nullif("name", F.lit("")), "label"), [F.col(x) for x in ("qualified_name", "signature", "docstring")], F.col("source_file")),
        entities(c["db_tables"], "db_table", "id", F.col("name"), [F.col("technology"), columns]),
        entities(c["db_migrations"], "db_migration", "id", F.col("name"), [F.col("technology"), F.col("operations")]),
        entities(c["db_technologies"], "db_technology", "id", F.col("name"), [F.col("category")]),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return tokenized(out)


def inverted(index: DataFrame) -> DataFrame:
    """(token, kind, id, in_name): a row per token of an entity."""
    rows = index.select("kind", "id", "name_tokens", F.explode("body_tokens").alias("token"))
    return rows.select("token", "kind", "id", F.array_contains("name_tokens", F.col("token")).alias("in_name"))


def score(index: DataFrame, question: str, kinds: Sequence[str] | None = None) -> DataFrame:
    """Entities with score above 0: 2 per word of the question in the name, 1 elsewhere in the body; tests times 0.4."""
    stems = question_stems(index.sparkSession, question)
    if kinds:
        index = index.where(F.col("kind").isin(*kinds))
    if not stems:
        return index.withColumn("score", F.lit(0.0)).limit(0)
    q = F.array(*map(F.lit, stems))
    in_name, in_body = F.array_intersect("name_tokens", q), F.array_intersect("body_tokens", q)
    points = F.size(in_name) * 2 + F.size(F.array_except(in_body, in_name))
    weight = F.lit(1.0) if asks_for_tests(stems) else F.when(F.col("is_test"), TEST_PENALTY).otherwise(1.0)
    # The term of zero isn't deterministic for the optimizer: the filter stays above, and tokens are made once.
    return index.withColumn("score", points * weight + F.spark_partition_id() * 0).where("score > 0")


def ranked(index: DataFrame, question: str, limit: int = 10, kinds: Sequence[str] | None = None) -> DataFrame:
    """The best entities: score, then code before tests, migrations last, kind, name, id."""
    found = score(index, question, kinds)
    late = F.when(F.col("kind") == "db_migration", 2).otherwise(1)
    return found.orderBy(F.desc("score"), "is_test", late, "kind", "name", "id").limit(limit)


def expand_kinds(kind: str | None) -> tuple[str, ...] | None:
    return None if not kind else DATABASE_KINDS if kind == "database" else (kind,)
