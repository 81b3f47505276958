"""The build: from files and a graph to a catalog of entity relations. A pass is a function catalog -> catalog."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn import catalog as store
from cairn.extract import alembic, block_source, ddl, mounts, openapi, python_source
from cairn.extract.run import extract
from cairn.functions import coerce, paths, routes
from cairn.operators import aggs, checks, graph, joins, windows
from cairn.schemas import SCHEMA_VERSION
from cairn.session import cut_lineage
from cairn.sources import files as file_source
from cairn.sinks import agents_doc as agents_doc_sink
from cairn.sources import graph_build, graph_json

from .config import BuildError, Config, Diagnostics, ValidationError
from . import registry

#: Issues of a code that the diagnostics list; the table of issues has all.
SHOWN = 100

Pass = Callable[[store.Catalog, SparkSession, Config], store.Catalog]


# Loading.


def synthesize(c: store.Catalog) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of source files where no graph is given: files, definitions, contains, and for Python inherits and imports."""
    d = c["_definitions"]
    files = c["_files"].where(is_source()).select(F.col("path").alias("id"), F.col("path").alias("label"), F.lit("code").alias("file_type"), F.col("path").alias("source_file"), F.lit(None).cast("string").alias("source_location"))
    ident = F.concat("source_file", F.lit("::"), "qualified_name")
    defs = d.select(ident.alias("id"), F.when(F.col("kind") == "class", F.col("name")).otherwise(F.concat("name", F.lit("()"))).alias("label"), F.lit("code").alias("file_type"), "source_file", F.concat(F.lit("L"), "start_line").alias("source_location")).dropDuplicates(["id"])
    contains = d.select(F.col("source_file").alias("source_id"), ident.alias("target_id"), F.lit("contains").alias("relation"))
    classes = aggs.unrepeated(d.where("kind = 'class'").withColumn("_id", ident), "name", "_id")
    inherits = d.where("kind = 'class'").select(ident.alias("source_id"), F.explode("bases").alias("name")).join(classes, "name").select("source_id", F.col("_id").alias("target_id"), F.lit("inherits").alias("relation"))
    names = c["_imports"].select("source_file", F.explode(F.array("module", F.concat_ws(".", "module", "name"))).alias("module"))
    found = joins.module_files(names, c["_files"])
    imported = names.join(found, "module").where("source_file <> path").select(F.col("source_file").alias("source_id"), F.col("path").alias("target_id"), F.lit("imports_from").alias("relation")).distinct()
    e = contains.unionByName(inherits).unionByName(imported).distinct()
    e = e.withColumns({"id": coerce.edge_id(F.col("source_id"), F.col("relation"), F.col("target_id")), "confidence": F.lit("EXTRACTED"), "confidence_score": F.lit(1.0), "weight": F.lit(1.0), "source_file": F.lit(None).cast("string")})
    return files.unionByName(defs), e


def is_source(suffixes: tuple[str, ...] = (".py", *block_source.SUFFIXES)) -> Column:
    return F.lower("path").rlike("(" + "|".join(x.replace(".", r"\.") for x in suffixes) + ")$")


def load(c: store.Catalog, spark: SparkSession, config: Config) -> store.Catalog:
    files = cut_lineage(file_source.repo_files(spark, config.repo, config.max_files, config.max_bytes))
    python = files.where(F.col("path").endswith(".py"))
    definitions = extract(python, python_source.definitions, python_source.DEFINITIONS).unionByName(extract(files.where(is_source(block_source.SUFFIXES)), block_source.definitions, block_source.DEFINITIONS))
    c = c | {"_files": files, "_definitions": cut_lineage(definitions), "_imports": cut_lineage(extract(python, python_source.imports, python_source.IMPORTS))}
    if config.graph:
        g = graph_json.read_graph(spark, config.graph)
        nodes = graph_json.nodes(g)
        groups, members = graph_json.communities(spark, config.graph, nodes)
        nodes = graph_json.nodes(g, windows.first_claim(members, "id", "community_id", ["ord", "pos"]))
        edges, flows = graph_json.edges(g), graph_json.hyperedges(g)
        flags = g.select(F.coalesce("directed", F.lit(True)).alias("directed"), F.coalesce("multigraph", F.lit(False)).alias("multigraph"))
        raw = spark.read.format("binaryFile").load(f"{config.graph}/graph.json").select(F.sha2("content", 256).alias("source_graph_hash"))
        insights = cut_lineage(graph_json.insights(spark, config.graph))
    else:
        nodes, edges = synthesize(c)
        flows = store.empty(spark, "workflows")
        groups, members = spark.createDataFrame([], "ord int, community_id string, label string, cohesion double"), spark.createDataFrame([], "ord int, community_id string, pos int, id string")
        flags = spark.sql("SELECT true AS directed, false AS multigraph")
        raw = spark.sql("SELECT CAST(NULL AS STRING) AS source_graph_hash")
        insights = spark.createDataFrame([], "kind string, text string")
    nodes, edges = cut_lineage(nodes), cut_lineage(edges)
    name = config.repo.rstrip("/").rpartition("/")[2]
    size = lambda df, n: df.agg(F.count("*").alias(n))
    meta = flags.crossJoin(raw).crossJoin(size(nodes, "node_count")).crossJoin(size(edges, "edge_count")).crossJoin(size(groups, "community_count"))
    meta = meta.withColumns({"repo_path": F.lit(config.repo), "repo_name": F.lit(name), "schema_version": F.lit(SCHEMA_VERSION), "generated_by": F.lit("cairn"), "builder_version": F.lit(config.builder_version)})
    hashes, lost = file_source.source_hashes(nodes, files)
    return c | {"graph_nodes": nodes, "relationships": edges, "workflows": flows, "_communities": groups, "_members": members, "metadata": meta, "file_hashes": hashes, "_lost_files": lost, "_insights": insights}


# Symbols and calls.


def symbols(c: store.Catalog, spark: SparkSession, config: Config) -> store.Catalog:
    lo, hi = paths.line_range(F.col("source_location"))
    label, file = F.col("label"), F.col("source_file")
    s = c["graph_nodes"].where("file_type = 'code'")
    s = s.select("id", "label", paths.clean_name(label).alias("name"), paths.baseline_kind(label).alias("kind"), "source_file", "source_location", lo.alias("start_line"), hi.alias("end_line"), paths.language(file).alias("language"), *([F.col("rationale")] if "rationale" in s.columns else []))
    return c | {"symbols": store.conform(s, "symbols")}


def enrich(c: store.Catalog, spark: SparkSession, config: Config) -> store.Catalog:
    """Symbols take what their definition in source says; those without one or a line are imports."""
    s, d = c["symbols"], c["_definitions"]
    found = joins.match_definitions(s.where("coalesce(kind, '') <> 'file'"), d)
    fields = ["kind", "qualified_name", "start_line", "end_line", "start_col", "end_col", "signature", "docstring", "decorators", "is_async", "is_static", "is_abstract", "visibility"]
    u = found.join(s.select("id", "source_file"), "id").join(d, ["source_file", "ord"]).select(F.col("id").alias("_id"), F.col("name").alias("_name"), *[F.col(x).alias(f"_{x}") for x in fields])
    both = s.join(u, F.col("id") == F.col("_id"), "left")
    hit = F.col("_id").isNotNull()
    kind = F.when(hit, F.col("_kind")).when(F.col("start_line").isNull() & (F.coalesce("kind", F.lit("")) != "file"), "import").otherwise(F.col("kind"))
    new = {x: F.when(hit, F.col(f"_{x}")).otherwise(F.col(x)) for x in fields if x != "kind"} | {"kind": kind, "name": F.when(hit, F.col("_name")).otherwise(F.col("name"))}
    return c | {"symbols": cut_lineage(store.conform(both.select(*[new.get(x, F.col(x)).alias(x) for x in s.columns]), "symbols"))}


def calls(c: store.Catalog, spark: SparkSession, config: Config) -> store.Catalog:
    """Calls of source as inferred edges: by the class of the receiver and its ancestors, else by a name of the file alone."""
    s, d = c["symbols"], c["_definitions"]
    sites = extract(c["_files"].where(F.col("path").endswith(".py")), python_source.calls, python_source.CALLS)
    by_name = aggs.unrepeated(s.where("qualified_name IS NOT NULL"), "qualified_name", "id")
    classes = aggs.unrepeated(s.where("kind = 'class' AND qualified_name IS NOT NULL"), "name", "qualified_name")
    returns = aggs.unique_or_none(d.where("kind <> 'class' AND returns IS NOT NULL"), "name", "returns")
    parents = d.where("kind = 'class'").select(F.col("qualified_name").alias("id"), F.posexplode("bases").alias("ord", "name")).join(classes, "name").select("id", F.col("qualified_name").alias("parent"), "ord")
    line = graph.ancestors(cut_lineage(parents)).unionByName(classes.select(F.col("qualified_name").alias("id"), F.col("qualified_name").alias("ancestor"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("ord")))
    known = sites.join(returns.select(F.col("name").alias("receiver_call"), "returns"), "receiver_call", "left")
    # A name that is a class is that class; else the class that the function of that name returns.
    known = known.join(classes.select(F.col("name").alias("receiver_class"), F.col("qualified_name").alias("_direct")), "receiver_class", "left").join(classes.select(F.col("name").alias("returns"), F.col("qualified_name").alias("_returned")), "returns", "left")
    known = known.withColumn("_class", F.coalesce("_direct", "_returned"))
    methods = known.where("_class IS NOT NULL").join(line.select(F.col("id").alias("_class"), "ancestor", "depth", F.col("ord").alias("_o")), "_class").withColumn("_qn", F.concat_ws(".", "ancestor", "callee"))
    methods = methods.join(by_name.select(F.col("qualified_name").alias("_qn"), F.col("id").alias("target_id")), "_qn").groupBy("source_file", "ord", "caller").agg(F.min_by("target_id", F.struct("depth", "_o")).alias("target_id"))
    local = aggs.unrepeated(s.where("kind IN ('function', 'class')").withColumn("_k", F.concat_ws("|", "source_file", "name")), "_k", "id").select("_k", F.col("id").alias("target_id"))
    # A receiver without a type is no receiver: the name is then looked for in the file, as that of a bare call.
    untyped = F.col("_class").isNull() & F.col("returns").isNull() & (F.col("receiver_class").isNull() | F.col("receiver_call").isNotNull())
    bare = known.where(~F.col("is_attribute") | untyped).withColumn("_k", F.concat_ws("|", "source_file", "callee")).join(local, "_k").select("source_file", "ord", "caller", "target_id")
    made = methods.unionByName(bare).join(by_name.select(F.col("qualified_name").alias("caller"), F.col("id").alias("source_id")), "caller").where("source_id <> target_id")
    e = made.select("source_id", "target_id", F.lit("calls").alias("relation"), "source_file").dropDuplicates(["source_id", "target_id"])
    e = e.withColumns({"id": coerce.edge_id(F.col("source_id"), F.col("relation"), F.col("target_id")), "confidence": F.lit("INFERRED"), "confidence_score": F.lit(1.0), "weight": F.lit(1.0)})
    old = store.conform(c["relationships"], "relationships")
    new = store.conform(e.join(old.select("id"), "id", "left_anti"), "relationships")
    every = cut_lineage(old.unionByName(new))
    return c | {"relationships": every, "_call_stats": aggs.call_stats(new), "_call_degree": aggs.call_degree(every, s), "dependencies": joins.dependencies(every, c["graph_nodes"])}


# Components and contracts.


def components(c: store.Catalog, spark: SparkSession, config: Config) -> store.Catalog:
    found = cut_lineage(aggs.components(c["symbols"]))
    row = lambda r: found.where(F.col("role") == r).select(F.concat(F.lit(f"{r}::"), "source_file").alias("id"), "name", "symbol_ids", F.array("source_file").alias("source_files"))
    controllers = row("controller")
    owner = joins.last_owner(controllers.select(F.col("id").alias("controller_id"), "symbol_ids"), "controller_id", "symbol_ids", "controller_id").withColumnRenamed("id", "_s")
    api = c["symbols"].where(paths.role(F.col("source_file"), F.col("label"), F.col("kind")) == "api")
    verb = r"(?i)^(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\s+(/\S*)"
    part = lambda g: F.nullif(F.regexp_extract("label", verb, g), F.lit(""))
    api = api.join(owner, F.col("id") == F.col("_s"), "left").select(F.concat(F.lit("api::"), "id").alias("id"), F.col("label").alias("name"), F.upper(part(1)).alias("method"), part(2).alias("path"), F.lit("heuristic").alias("origin"), F.col("id").alias("handler_symbol_id"), "controller_id", "source_file", F.lit("INFERRED").alias("confidence"))
    return c | {"services": store.conform(row("service"), "services"), "controllers": store.conform(controllers, "controllers"), "apis": store.conform(api, "apis")}


def bind(ops: DataFrame, c: store.Catalog) -> DataFrame:
    """(method, path, handler): the strategies from strong to weak; each counts only where one symbol qualifies."""
    s = c["symbols"]
    deco = s.select("id", "name", "source_file", F.explode("decorators").alias("d"))
    declared = deco.withColumns({"verb": routes.decorator_verb(F.col("d")), "route": routes.decorator_path(F.col("d")), "router": routes.receiver(F.col("d"))}).where("route IS NOT NULL")
    declared = cut_lineage(declared.withColumn("norm", routes.normalize_path(F.col("route"))).select("id", "source_file", "verb", "norm", "router"))
    o = ops.select("method", "path", "operation_id").distinct().withColumns({"norm": routes.normalize_path(F.col("path")), "op": F.concat_ws(" ", "method", "path")})
    exact = joins.unique_match(o.join(declared.withColumnRenamed("norm", "_n"), (F.col("norm") == F.col("_n")) & (F.col("verb") == F.col("method"))), "op", "id").select("op", F.col("id").alias("h1"))
    loose = joins.unique_match(o.join(declared.withColumnRenamed("norm", "_n"), (F.col("norm") == F.col("_n")) & (F.col("verb") == "")), "op", "id").select("op", F.col("id").alias("h2"))
    tails = joins.suffix_join(o.select("op", "method", "norm"), declared.withColumnRenamed("norm", "tail"), "norm", "tail").where("verb = method OR verb = ''")
    by_tail = joins.unique_match(tails, "op", "id").select("op", F.col("id").alias("_u"))
    wanted = tails.select("op", "id", routes.wanted_segments(F.col("norm")).alias("wanted"), paths.file_tokens(F.col("source_file")).alias("tokens"))
    near = joins.best_affinity(wanted, "op", "id", "wanted", "tokens").select("op", F.col("id").alias("_a"))
    tail = by_tail.join(near, "op", "full_outer").select("op", F.coalesce("_u", "_a").alias("h3"))
    names = s.select(F.explode(F.array_compact(F.array(F.lower("name"), F.lower("qualified_name")))).alias("n"), "id").groupBy("n").agg(F.min("id").alias("id"))
    by_id = o.join(names, F.lower("operation_id") == F.col("n")).select("op", F.col("id").alias("h4"))
    starts = joins.unique_match(joins.prefix_join(o.select("op", F.lower("operation_id").alias("o")).where("o IS NOT NULL"), names, "o", "n"), "op", "id").select("op", F.col("id").alias("h5"))
    derived = o.join(names, routes.derived_name(F.col("method"), F.col("path")) == F.col("n")).select("op", F.col("id").alias("h6"))
    out = o
    for x in (exact, loose, tail, by_id, starts, derived):
        out = out.join(x, "op", "left")
    bound = cut_lineage(out.select("method", "path", "norm", "op", F.coalesce("h1", "h2", "h3", "h4", "h5", "h6").alias("handler")))
    # Routers show their mount prefix where an operation is bound; mounts in source give more. Each is a candidate.
    seen = bound.where("handler IS NOT NULL").join(declared.withColumnRenamed("norm", "own"), (F.col("handler") == F.col("id")) & F.col("norm").endswith(F.col("own"))).select("source_file", "router", F.expr("left(norm, length(norm) - length(own))").alias("prefix")).distinct()
    seen = seen.groupBy("source_file", "router").agg(F.count("*").alias("n"), F.min("prefix").alias("prefix")).where("n = 1").drop("n")
    m = extract(c["_files"].where(F.col("path").endswith(".py")), mounts.mounts, mounts.MOUNTS)
    key = lambda f, r: F.concat_ws("|", f, r)
    routers = m.where("kind = 'router'").select(key("source_file", "router").alias("id"), F.coalesce("prefix", F.lit("")).alias("own")).dropDuplicates(["id"])
    alias = c["_imports"].select("source_file", F.col("alias").alias("_a"), "module", "name")
    rows = m.where("kind = 'mount'").withColumn("_a", F.substring_index("child", ".", 1)).join(alias, ["source_file", "_a"], "left")
    files = joins.module_files(alias.select(F.explode(F.array("module", F.concat_ws(".", "module", "name"))).alias("module")), c["_files"])
    whole = files.select(F.col("module").alias("_w"), F.col("path").alias("_wp"))
    rows = rows.join(files, "module", "left").join(whole, F.concat_ws(".", "module", "name") == F.col("_w"), "left")
    child = F.when(F.col("_wp").isNotNull() & F.col("child").contains("."), key("_wp", F.substring_index("child", ".", -1))).when(F.col("path").isNotNull(), key("path", F.coalesce("name", "child"))).otherwise(key("source_file", "child"))
    tree = rows.select(key("source_file", "router").alias("parent"), child.alias("child"), F.coalesce("prefix", F.lit("")).alias("prefix"), "ord")
    full = graph.mount_prefixes(cut_lineage(routers), cut_lineage(tree)).select(F.element_at(F.split("id", r"\|"), 1).alias("source_file"), F.element_at(F.split("id", r"\|"), 2).alias("router"), "prefix")
    both = seen.unionByName(full).distinct()
    composed = declared.join(both, ["source_file", "router"]).withColumn("_full", routes.normalize_path(F.concat("prefix", "norm")))
    rest = bound.where("handler IS NULL").join(composed.select("id", "verb", "_full"), (F.col("norm") == F.col("_full")) & ((F.col("verb") == F.col("method")) | (F.col("verb") == "")))
    late = joins.unique_match(rest, "op", "id").select("op", F.col("id").alias("_h"))
    return bound.join(late, "op", "left").select("method", "path", F.coalesce("handler", "_h").alias("handler"))


def contracts(c: store.Catalog, spark: SparkSession, config: Config) -> store.Catalog:
    """One api per method and path of all specs; heuristic ones stay where no spec covers their route."""
    specs = c["_files"].where(F.lower("path").rlike(r"\.(json|ya?ml)$") & F.substring("text", 1, openapi.HEAD).rlike("openapi|swagger") & F.contains("text", F.lit("paths")))
    ops = cut_lineage(extract(specs, openapi.operations, openapi.OPERATIONS))
    details = ["operation_id", "summary", "description", "parameters", "response_codes", "request_schema"]
    best = aggs.richest(ops, ["method", "path"], details, "spec_file")
    clash = aggs.route_conflicts(ops.withColumns({"_p": F.array_sort("parameters"), "_c": F.array_sort("response_codes")}), ["method", "path"], ["operation_id", "_p", "_c"])
    api = best.join(clash, ["method", "path"]).join(bind(ops, c), ["method", "path"], "left")
    owner = joins.last_owner(c["controllers"].select(F.col("id").alias("controller_id"), "symbol_ids"), "controller_id", "symbol_ids", "controller_id").withColumnRenamed("id", "handler")
    api = api.join(owner, "handler", "left")
    api = api.withColumns({"id": F.concat(F.lit("api::"), "method", F.lit("::"), "path"), "name": F.concat_ws(" ", "method", "path"), "origin": F.lit("openapi"), "also_declared_in": F.array_sort(F.array_except("specs", F.array("spec_file"))), "spec_conflict": F.col("conflict"), "handler_symbol_id": F.col("handler"), "confidence": F.lit("EXTRACTED")})
    covered = ops.select(F.col("method"), routes.normalize_path(F.col("path")).alias("_n")).distinct()
    kept = c["apis"].where("method IS NOT NULL AND path IS NOT NULL").withColumn("_n", routes.normalize_path(F.col("path"))).join(covered, ["method", "_n"], "left_anti")
    if ops.isEmpty():
        return c
    return c | {"apis": cut_lineage(store.conform(api, "apis").unionByName(store.conform(kept, "apis")))}


def database(c: store.Catalog, spark: SparkSession, config: Config) -> store.Catalog:
    """Technologies by fingerprint, tables and migrations of SQL and Alembic files. Files that can't be read give nothing."""
    files = c["_files"].withColumn("ord", F.col("path"))
    names = registry.technologies(spark).select("id", "name", "category")
    found = aggs.fingerprints(files.select("ord", "path", "text"), registry.rules(spark)).join(names, "id")
    sql = extract(files.where("path LIKE '%.sql'"), ddl.tables, ddl.TABLES)
    tables = windows.first_per_key(sql.where("kind = 'table'").withColumn("_o", -F.col("ord")), ["id"], ["_o"]).drop("index", "_o")
    tables = joins.attach_indexes(tables, sql.where("kind = 'index'").select("ord", F.col("index.table").alias("table"), "source_file", "index")).withColumn("technology", paths.sql_technology(F.col("source_file")))
    steps = tables.groupBy("source_file").agg(F.array_sort(F.collect_list(F.struct("ord", F.concat(F.lit("create_table "), "name").alias("op")))).alias("_ops"))
    files_done = steps.select(F.concat(F.lit("migration::"), "source_file").alias("id"), paths.base_name(F.col("source_file")).alias("name"), paths.sql_technology(F.col("source_file")).alias("technology"), F.transform("_ops", lambda x: x["op"]).alias("operations"), "source_file", F.lit("EXTRACTED").alias("confidence"))
    py = extract(files.where("path LIKE '%.py'").where(F.contains("text", F.lit("from alembic import op"))), alembic.migrations, alembic.MIGRATIONS).withColumns({"technology": F.lit("alembic"), "confidence": F.lit("EXTRACTED")})
    own = tables.withColumn("confidence", F.lit("EXTRACTED"))
    every = store.conform(own, "db_tables").unionByName(store.conform(py.where("kind = 'table'"), "db_tables")).withColumn("evidence", F.array("source_file"))
    every = windows.first_per_key(every, ["id"], ["source_file", "source_location"])
    migrations = store.conform(files_done, "db_migrations").unionByName(store.conform(py.where("kind = 'migration'"), "db_migrations"))
    return c | {"db_technologies": cut_lineage(store.conform(found, "db_technologies")), "db_tables": cut_lineage(every), "db_migrations": cut_lineage(migrations)}


# Modules, concepts, summaries.


def module_names(rows: DataFrame) -> DataFrame:
    """(module, name, candidates) from symbols with a module: capability of the modal package, else prefix, stem, identifier."""
    r = rows.withColumns({"_def": ~F.coalesce("kind", F.lit("")).isin(*paths.REFERENCE_KINDS), "_pkg": paths.package_key(F.col("source_file"))})
    defined = r.withColumn("_any", F.bool_or("_def").over(Window.partitionBy("module"))).where("_def OR NOT _any")
    modal = aggs.modal_first(defined.where("_pkg <> '<root>'"), "module", "_pkg", "id").select("module", paths.title_case(paths.capability(F.concat("_pkg", F.lit("/x.py")))).alias("_by_pkg"))
    prefix = aggs.common_prefix(defined, "module", "label").select("module", F.when(F.length("prefix") > 2, paths.title_case(F.col("prefix"))).alias("_by_prefix"))
    stem = defined.where("coalesce(source_file, '') <> ''").groupBy("module").agg(F.min("source_file").alias("_f")).select("module", paths.title_case(paths.file_stem(F.col("_f"))).alias("_by_stem"))
    label = defined.groupBy("module").agg(F.min("name").alias("_first"), F.array_sort(F.collect_set(F.when(F.col("_def"), F.col("name")))).alias("candidates"))
    out = label.join(modal, "module", "left").join(prefix, "module", "left").join(stem, "module", "left")
    full = lambda x: F.nullif(F.col(x), F.lit(""))
    return out.select("module", F.coalesce(full("_by_pkg"), full("_by_prefix"), full("_by_stem"), full("_first"), F.lit("Module")).alias("name"), "candidates")


def modules(c: store.Catalog, spark: SparkSession, config: Config) -> store.Catalog:
    s = c["symbols"]
    members = s.select("id", "source_file").join(c["_members"].select("id", "community_id").distinct(), "id", "left")
    part = cut_lineage(aggs.partition_modules(members, c["_communities"], config.min_cohesion, config.max_module_size))
    rows = part.join(s.select("id", "label", "name", "kind", "source_file"), "id")
    real = rows.groupBy("module").agg(F.bool_or(~F.coalesce("kind", F.lit("")).isin(*paths.REFERENCE_KINDS)).alias("_d"), F.count("source_file").alias("_f")).where("_d OR _f > 0").select("module")
    rows = cut_lineage(rows.join(real, "module"))
    m = rows.groupBy("module").agg(F.min("origin").alias("origin"), F.array_sort(F.collect_set("id")).alias("symbol_ids"), F.array_sort(F.collect_set("source_file")).alias("source_paths"), F.collect_set(F.when(F.coalesce("kind", F.lit("")).isin(*paths.REFERENCE_KINDS), F.col("name"))).alias("_imported"))
    m = m.withColumn("community_id", F.nullif(F.regexp_extract("module", "^module::community::([^:]+)", 1), F.lit("")))
    groups = c["_communities"].select("community_id", F.col("label").alias("_label"), "cohesion")
    weak = F.col("_label").rlike(r"^[^\p{L}\p{N}]|/|(?i)^community\s+\S+$") | F.array_contains("_imported", F.col("_label"))
    m = m.join(groups, "community_id", "left").join(module_names(rows), "module", "left")
    alone = F.trim(F.get("candidates", F.lit(0)))  # of a module with one symbol its public definition
    own = F.when((F.col("origin") == "standalone") & (alone != "") & ~alone.startswith("_"), F.coalesce(F.nullif(paths.title_case(alone), F.lit("")), alone))
    m = m.withColumn("name", F.when((F.col("origin") == "community") & F.col("_label").isNotNull() & ~weak, F.col("_label")).otherwise(F.coalesce(own, F.col("name")))).withColumnRenamed("module", "id")
    m = cut_lineage(windows.widen_names(cut_lineage(m.drop("_imported", "_label"))))
    owner = rows.groupBy("id").agg(F.max("module").alias("module"))
    related = joins.module_adjacency(c["relationships"], owner).groupBy(F.col("module").alias("id")).agg(joins.sorted_set(F.col("related")).alias("related_module_ids"))
    m = m.join(related, "id", "left")
    for kind in ("services", "controllers"):
        first = joins.first_member_module(c[kind], owner, "id", "symbol_ids")
        m = m.join(first.groupBy("module").agg(joins.sorted_set(F.col("id")).alias(f"{kind[:-1]}_ids")).withColumnRenamed("module", "id"), "id", "left")
    api = c["apis"].select(F.col("id").alias("api"), F.col("handler_symbol_id").alias("id")).join(owner, "id").groupBy(F.col("module").alias("id")).agg(joins.sorted_set(F.col("api")).alias("api_ids"))
    m = m.join(api, "id", "left")
    return c | {"_module_origins": m.groupBy("origin").agg(F.count("*").alias("n")), "modules": cut_lineage(store.conform(m, "modules")), "symbols": cut_lineage(store.conform(s.drop("module_id").join(owner.withColumnRenamed("module", "module_id"), "id", "left"), "symbols")), "_owner": owner}


def concepts(c: store.Catalog, spark: SparkSession, config: Config) -> store.Catalog:
    found = store.conform(aggs.concept_links(c["graph_nodes"], c["relationships"]).withColumn("confidence", F.lit("EXTRACTED")), "concepts")
    owner = c["symbols"].where("module_id IS NOT NULL").select("id", F.col("module_id").alias("module"))
    m = joins.attach_to_modules(c["modules"], found.withColumnRenamed("id", "_k"), "_k", "related_ids", owner, "concept_ids")
    m = joins.attach_to_modules(m, c["workflows"].withColumnRenamed("id", "_k"), "_k", "participant_ids", owner, "workflow_ids")
    return c | {"concepts": cut_lineage(found), "modules": cut_lineage(m)}


def summaries(c: store.Catalog, spark: SparkSession, config: Config) -> store.Catalog:
    m = c["modules"].withColumnRenamed("id", "_module").withColumn("id", F.col("_module"))
    names = lambda k, n="name": c[k].select("id", F.col(n).alias("name"))
    got = aggs.roll_up(m, {"_services": ("service_ids", names("services")), "_controllers": ("controller_ids", names("controllers")), "dependencies": ("related_module_ids", names("modules")), "public_apis": ("api_ids", names("apis")), "workflows": ("workflow_ids", names("workflows")), "concepts": ("concept_ids", names("concepts", "label"))})
    got = got.join(aggs.god_symbols(c["modules"], c["symbols"], c["_insights"].where("kind = 'god'").select(F.col("text").alias("id"))), "id", "left")
    s = got.select(F.concat(F.lit("summary::"), "id").alias("id"), F.col("id").alias("module_id"), F.array_sort(F.concat("_services", "_controllers")).alias("responsibilities"), F.coalesce("god_nodes", F.array().cast("array<string>")).alias("god_nodes"), "dependencies", "public_apis", "workflows", "concepts")
    return c | {"summaries": cut_lineage(store.conform(s, "summaries")), "modules": c["modules"].withColumn("summary_id", F.concat(F.lit("summary::"), "id"))}


def optimize(c: store.Catalog, spark: SparkSession, config: Config) -> store.Catalog:
    """Concepts without copies, then references without dangling ends, then summaries without empty ones."""
    kept, canonical = aggs.dedup_concepts(c["concepts"])
    named = canonical.select("id", F.col("keeper").alias("name"))
    m = c["modules"].drop("concept_ids").join(joins.resolve_names(c["modules"].select("id", "concept_ids"), "id", "concept_ids", named).withColumnRenamed("names", "concept_ids"), "id", "left")
    kept = cut_lineage(store.conform(joins.keep_valid(kept, "id", "related_ids", c["graph_nodes"].select("id"), drop_self=True), "concepts"))
    m = store.conform(m, "modules")
    for column, relation in (("symbol_ids", "symbols"), ("related_module_ids", "modules"), ("service_ids", "services"), ("controller_ids", "controllers"), ("api_ids", "apis"), ("workflow_ids", "workflows")):
        m = joins.keep_valid(m, "id", column, c[relation].select("id"), drop_self=relation == "modules")
    m = joins.keep_valid(cut_lineage(m), "id", "concept_ids", kept.select("id"))
    edges = joins.connected_edges(c["relationships"], c["graph_nodes"])
    deps = c["dependencies"].join(c["graph_nodes"].select(F.col("id").alias("source_id")), "source_id", "left_semi")
    s = aggs.drop_empty(c["summaries"], ["purpose"], ["responsibilities", "business_rules", "dependencies", "public_apis", "workflows", "constraints", "concepts", "god_nodes"])
    m = joins.keep_foreign(m, "summary_id", s.select("id"))
    return c | {"concepts": kept, "modules": cut_lineage(store.conform(m, "modules")), "relationships": cut_lineage(store.conform(edges, "relationships")), "dependencies": store.conform(deps, "dependencies"), "summaries": cut_lineage(store.conform(s, "summaries"))}


PASSES: list[tuple[str, Pass]] = [
    ("load", load), ("symbols", symbols), ("enrich", enrich), ("calls", calls), ("components", components), ("contracts", contracts), ("database", database),
    ("modules", modules), ("concepts", concepts), ("summaries", summaries), ("optimize", optimize),
]


def agents_doc(c: store.Catalog, spark: SparkSession, config: Config) -> store.Catalog:
    """Writes the managed block into Markdown files of the repository, if the build asks for it."""
    if config.agents_doc and config.output:
        agents_doc_sink.write(config.repo, config.output)
    return c


PASSES.append(("agents-doc", agents_doc))

#: Passes whose failure is a warning, and the relations that are then empty.
BEST_EFFORT = {"database": ("db_technologies", "db_tables", "db_migrations"), "agents-doc": ()}


def _stats(c: store.Catalog) -> dict[str, dict]:
    """Small figures of the passes: calls that were added and their callers, modules by origin."""
    out: dict[str, dict] = {}
    if "_call_stats" in c:
        out["calls"] = c["_call_stats"].first().asDict()
    if "_module_origins" in c:
        out["modules"] = {r["origin"]: r["n"] for r in c["_module_origins"].collect()}
    return out


def build(spark: SparkSession, config: Config, progress: Callable[[str], None] | None = None, passes: list[tuple[str, Pass]] | None = None) -> tuple[store.Catalog, Diagnostics]:
    """Runs the passes, writes the catalog if config names an output, then validates it."""
    c: store.Catalog = {}
    said = Diagnostics()
    if config.workspace:
        source = config.graph or f"{config.workspace}/graph-source"
        try:
            said.stats["graph"] = graph_build.ensure_graph(config.repo, config.workspace, source, config.graph_command, config.rebuild, keep_source=config.graph is not None)
        except graph_json.LoadError as e:
            raise BuildError(f"graph: {e}") from e
        config = replace(config, graph=config.workspace)
    for name, run in passes or PASSES:
        if progress:
            progress(name)
        began = time.time()
        try:
            c = run(c, spark, config)
        except Exception as e:
            if name not in BEST_EFFORT:
                raise BuildError(f"pass {name}: {e}") from e
            said.add("warning", name, f"left out: {e}")
            c = c | {k: store.empty(spark, k) for k in BEST_EFFORT[name]}
        said.seconds[name] = time.time() - began
    said.stats |= _stats(c)
    out = {k: store.conform(v, k) for k, v in c.items() if not k.startswith("_")}
    if config.output:
        store.write(out, config.output)
        out = store.read(spark, config.output)
    if config.output and "_insights" in c:
        c["_insights"].write.mode("overwrite").parquet(f"{config.output}/insights")
    lost = c["_lost_files"]
    lost = lost.select(F.lit("warning").alias("level"), F.lit("LOST_SOURCE_FILE").alias("code"), F.concat(lost.columns[0], F.lit(" is named by the graph, but isn't there")).alias("message"))
    issues = checks.validate(out, SCHEMA_VERSION).unionByName(lost)
    if config.output:
        issues.write.mode("overwrite").parquet(f"{config.output}/issues")
        said.issues = spark.read.schema(issues.schema).parquet(f"{config.output}/issues")
    else:
        said.issues = cut_lineage(issues)
    for r in said.issues.groupBy("level", "code").count().orderBy("level", "code").collect():
        level, code, n = r
        said.counts[level, code] = n
        name, head = ("load", "") if code == "LOST_SOURCE_FILE" else ("validate", f"{code}: ")
        first = said.issues.where((F.col("level") == level) & (F.col("code") == code)).orderBy("message").limit(SHOWN).collect()
        for x in first:
            said.add(level, name, f"{head}{x['message']}")
        if n > len(first):
            said.add(level, name, f"{code}: {n - len(first)} more of {n}, see the table of issues")
    errors = [m for level, name, m in said.rows if level == "error" and name == "validate"]
    if config.strict and errors:
        raise ValidationError("; ".join(errors[:5]))
    return out, said
