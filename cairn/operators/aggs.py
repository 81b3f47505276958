"""Aggregations: degrees, components, modules, concepts, fingerprints, coverage."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import paths
from cairn.functions.coerce import CALLS, SEMANTIC
from cairn.functions.text import normalized_label

from .joins import sorted_set

MIN_COHESION = 0.15
MAX_MODULE = 60


def call_degree(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """id, fan_in and fan_out over call edges, for symbols that have any; parallel edges count."""
    calls = edges.where(F.col("relation").isin(*CALLS))
    s = symbols.select("id")
    into = calls.groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("fan_in")).join(s, "id", "left_semi")
    out = calls.groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("fan_out")).join(s, "id", "left_semi")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return into.join(out, "id", "full_outer").select("id", zero("fan_in"), zero("fan_out"))


def call_stats(added: DataFrame) -> DataFrame:
    """One row: added, the number of edges, and callers, that of their distinct sources."""
    return added.agg(F.count("*").alias("added"), F.count_distinct("source_id").alias("callers"))


def god_symbols(modules: DataFrame, symbols: DataFrame, gods: DataFrame) -> DataFrame:
    """(id, god_nodes): the sorted labels, repeats too, of a module's symbols that gods (id) has."""
    rows = modules.select(F.col("id").alias("_m"), F.explode("symbol_ids").alias("id")).join(gods.select("id").distinct(), "id", "left_semi").join(symbols.select("id", "label"), "id")
    return rows.groupBy(F.col("_m").alias("id")).agg(F.array_sort(F.collect_list("label")).alias("god_nodes"))


def components(symbols: DataFrame) -> DataFrame:
    """A row per role and file of role symbols: role, source_file, name, symbol_ids."""
    r = symbols.withColumn("role", paths.role(F.col("source_file"), F.col("label"), F.col("kind"))).where("role IS NOT NULL AND role <> 'api'")
    file = F.coalesce(F.nullif("source_file", F.lit("")), F.lit("<root>"))
    name = F.when(F.col("role") == "service", paths.component_name(F.col("source_file"), "Service")).otherwise(paths.component_name(F.col("source_file"), "Controller"))
    return r.groupBy("role", file.alias("source_file")).agg(F.min(name).alias("name"), F.array_sort(F.collect_list("id")).alias("symbol_ids"))


def richest(rows: DataFrame, keys: Sequence[str], details: Sequence[str], tie: str) -> DataFrame:
    """Per key the row with most details filled (text, array or other), the least tie among equals."""
    kinds = dict(rows.dtypes)

    def filled(c: str) -> Column:
        full = F.size(c) > 0 if kinds[c].startswith("array") else F.coalesce(F.col(c).cast("string"), F.lit("")) != ""
        return F.coalesce(full, F.lit(False)).cast("int")

    score = reduce(lambda a, b: a + b, [filled(c) for c in details])
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in rows.columns if c not in keys]), F.struct(-score, F.coalesce(tie, F.lit("")))).alias("best")).select(*keys, "best.*")


def route_conflicts(rows: DataFrame, keys: Sequence[str], contract: Sequence[str]) -> DataFrame:
    """Keys with conflict (more than one distinct contract, nulls being values) and the declaring specs."""
    return rows.groupBy(*keys).agg((F.count_distinct(F.struct(*contract)) > 1).alias("conflict"), sorted_set(F.col("spec_file")).alias("specs"))


def partition_modules(members: DataFrame, communities: DataFrame, min_cohesion: float = MIN_COHESION, max_size: int = MAX_MODULE) -> DataFrame:
    """(id, module, origin) from members (id, source_file, community_id) and communities (community_id, cohesion).

    A community of low cohesion or large size is split by package; members without one go by package, and
    a package with a single such member makes a standalone module.
    """
    size = members.groupBy("community_id").agg(F.count("*").alias("_n"))
    m = members.join(size, "community_id", "left").join(communities.select("community_id", "cohesion"), "community_id", "left")
    package = paths.package_key(F.col("source_file"))
    split = F.coalesce(F.col("cohesion") < min_cohesion, F.lit(False)) | (F.col("_n") > max_size)
    own = F.concat(F.lit("module::community::"), "community_id")
    within = m.where("community_id IS NOT NULL").select("id", F.when(split, F.concat(own, F.lit("::"), paths.slug(package))).otherwise(own).alias("module"), F.when(split, "package").otherwise("community").alias("origin"))
    loose = members.where("community_id IS NULL").withColumn("_pkg", package)
    alone = loose.groupBy("_pkg").agg(F.count("*").alias("_n"))
    single = F.col("_n") == 1
    left = loose.join(alone, "_pkg").select("id", F.when(single, F.concat(F.lit("module::symbol::"), "id")).otherwise(F.concat(F.lit("module::package::"), paths.slug(F.col("_pkg")))).alias("module"), F.when(single, "standalone").otherwise("package").alias("origin"))
    return within.unionByName(left)


def modal_first(rows: DataFrame, group: str, value: str, order: str) -> DataFrame:
    """(group, value): the most frequent value, the first seen by order among equals."""
    counted = rows.groupBy(group, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return counted.groupBy(group).agg(F.min_by(value, F.struct(-F.col("n"), "first")).alias(value))


def common_prefix(rows: DataFrame, group: str, text: str) -> DataFrame:
    """(group, prefix): the longest common prefix of a group, that of its least and greatest text."""
    ends = rows.groupBy(group).agg(F.min(text).alias("lo"), F.max(text).alias("hi"))
    equal = F.filter(F.sequence(F.lit(0), F.length("lo")), lambda i: F.substring(F.col("lo"), F.lit(1), i) == F.substring(F.col("hi"), F.lit(1), i))
    return ends.select(group, F.regexp_replace(F.substring(F.col("lo"), F.lit(1), F.array_max(equal)), r"[_\-.]+$", "").alias("prefix"))


def concept_links(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Concept and rationale nodes with the sorted other ends of their semantic edges."""
    c = nodes.where(F.col("file_type").isin("concept", "rationale"))
    e = edges.where(F.col("relation").isin(*SEMANTIC))
    ends = e.select(F.col("source_id").alias("id"), F.col("target_id").alias("other")).unionByName(e.select(F.col("target_id").alias("id"), F.col("source_id").alias("other")))
    found = ends.join(c.select("id"), "id", "left_semi").groupBy("id").agg(sorted_set(F.col("other")).alias("related_ids"))
    return c.join(found, "id", "left").withColumn("related_ids", F.coalesce("related_ids", F.array().cast("array<string>")))


def dedup_concepts(concepts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, canonical): one concept per normalized label, and (id, keeper) for all.

    The keeper has a rationale if any has, then the least id; its related ids are the union of the group's,
    without itself, those of dropped copies renamed to their keepers.
    """
    label = normalized_label(F.col("label"))
    w = Window.partitionBy("_key").orderBy(F.coalesce("rationale", F.lit("")) == "", "id")
    ranked = concepts.withColumn("_key", label).withColumns({"_rank": F.row_number().over(w), "_keeper": F.first("id").over(w)})
    canonical = ranked.select("id", F.col("_keeper").alias("keeper"))
    related = ranked.select("_keeper", F.explode("related_ids").alias("_r")).join(canonical.select(F.col("id").alias("_r"), F.col("keeper").alias("_k")), "_r", "left")
    merged = related.select("_keeper", F.coalesce("_k", "_r").alias("_r")).where("_r <> _keeper").groupBy("_keeper").agg(sorted_set(F.col("_r")).alias("_all"))
    kept = ranked.where("_rank = 1").drop("_rank", "_key", "_keeper").join(merged, F.col("id") == F.col("_keeper"), "left")
    return kept.withColumn("related_ids", F.coalesce("_all", F.array().cast("array<string>"))).drop("_all", "_keeper"), canonical


def roll_up(modules: DataFrame, parts: dict[str, tuple[str, DataFrame]]) -> DataFrame:
    """modules (id, arrays of ids) with a names column per part: {column: (ids column, names DataFrame)}."""
    from .joins import resolve_names

    out = modules.select("id")
    for column, (ids, names) in parts.items():
        got = resolve_names(modules, "id", ids, names).withColumnRenamed("names", column)
        out = out.join(got, "id", "left").withColumn(column, F.coalesce(column, F.array().cast("array<string>")))
    return out


def drop_empty(summaries: DataFrame, texts: Sequence[str], arrays: Sequence[str]) -> DataFrame:
    """Summaries with some content."""
    some = [F.coalesce(F.col(t), F.lit("")) != "" for t in texts] + [F.coalesce(F.size(a), F.lit(0)) > 0 for a in arrays]
    return summaries.where(reduce(lambda a, b: a | b, some))


def unique_or_none(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) of keys with one distinct value that isn't null."""
    return rows.groupBy(key).agg(F.count_distinct(value).alias("_n"), F.min(value).alias(value)).where("_n = 1").drop("_n")


def unrepeated(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) of keys that stand on one row only."""
    return rows.groupBy(key).agg(F.count("*").alias("_n"), F.min(value).alias(value)).where("_n = 1").drop("_n")


def counts(relations: dict[str, DataFrame]) -> DataFrame:
    """(relation, n): the number of rows of each."""
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("relation"), "n") for k, df in relations.items()])


def coverage(rows: DataFrame, group: str, fields: Sequence[str]) -> DataFrame:
    """Per group the total, and per field the filled rows and their rounded share in percent (half to even)."""
    kinds = dict(rows.dtypes)

    def full(c: str) -> Column:
        if kinds[c].startswith("array"):
            return F.coalesce(F.size(c) > 0, F.lit(False))
        return F.coalesce(F.col(c).cast("string") != "", F.lit(False))

    out = rows.groupBy(F.coalesce(group, F.lit("unknown")).alias(group)).agg(F.count("*").alias("total"), *[F.count_if(full(c)).alias(f"{c}_filled") for c in fields])
    return out.select(group, "total", *[x for c in fields for x in (f"{c}_filled", F.bround(F.col(f"{c}_filled") * 100 / F.col("total")).cast("long").alias(f"{c}_percent"))])


def fingerprints(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Technologies whose rules match a file; files: ord, path, text; rules: id, rule_ord, phase, scope, pattern.

    The rules are a fixed registry of some dozens of rows, so the pairing runs as a broadcast nested loop
    over files. phase: 0 path, 1 manifest, 2 content (its first file only counts as evidence).
    """
    name = paths.base_name(F.col("path"))
    path_hit = (F.col("phase") == 0) & (F.rlike(F.col("path"), F.col("pattern")) | F.rlike(name, F.col("pattern")))
    in_scope = F.col("scope").isNull() | F.rlike(name, F.col("scope"))
    text_hit = (F.col("phase") > 0) & in_scope & F.rlike(F.col("text"), F.col("pattern"))
    hits = files.join(F.broadcast(rules), path_hit | text_hit).groupBy("id", "rule_ord", "phase", "ord", "path").agg(F.lit(1))
    of_content = F.row_number().over(Window.partitionBy("id", "phase").orderBy("ord"))
    kept = hits.withColumn("_c", of_content).where("phase < 2 OR _c = 1").groupBy("id", "rule_ord", "path").agg(F.min("phase").alias("phase"), F.min(F.struct("phase", "ord")).alias("_o"), F.min("ord").alias("ord"))
    ranked = kept.withColumn("_rank", F.row_number().over(Window.partitionBy("id").orderBy("_o")))
    sure = F.when(F.bool_or(F.col("phase") < 2), "EXTRACTED").otherwise("INFERRED")
    out = ranked.groupBy("id", "rule_ord").agg(sure.alias("confidence"), F.array_sort(F.collect_list(F.when(F.col("_rank") <= 5, F.struct("_rank", "path")))).alias("_e"))
    return out.select("id", "rule_ord", "confidence", F.transform(F.filter("_e", lambda e: e.isNotNull()), lambda e: e["path"]).alias("evidence"))
