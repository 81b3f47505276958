"""Queries of operators that the other modules don't reach: names, routes, coercions, checks, files, tokens."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cairn import catalog as store
from cairn.functions import coerce, paths, routes, text
from cairn.operators import aggs, checks, graph, joins, windows
from cairn.plans import registry
from cairn.schemas import RELATIONS
from cairn.search import hybrid, index, render, tokens
from cairn.session import cut_lineage
from cairn.sources import files

from .queries import joined, query
from .views import EDGES, NODES, edges, nodes, table


def _part(spark, d):
    return table(spark, d, "part")


NO_TEXT = "CAST(NULL AS VARCHAR)"
BRAND = "lower(replace(p_brand, '#', ''))"


def _brand():
    return F.lower(F.replace("p_brand", F.lit("#"), F.lit("")))


# Names and paths.


@query("""SELECT p_partkey, p_name AS file, 'run' AS method, 'hidden' AS dotted, CASE WHEN p_size > 25 THEN p_type ELSE 'x' END AS plain FROM part""")
def symbol_names(spark, d):
    name = F.col("p_name")
    of = lambda *x: paths.clean_name(F.concat(*x))
    return _part(spark, d).select("p_partkey", of(F.lit("lib/"), name, F.lit(".py")).alias("file"), of(F.col("p_type"), F.lit(".run(x, y)")).alias("method"), of(F.lit("."), F.lit("hidden()")).alias("dotted"), paths.clean_name(F.when(F.col("p_size") > 25, F.col("p_type")).otherwise("x")).alias("plain"))


@query(f"""SELECT p_partkey, 'm' || p_partkey || '.py' AS base, 'm' || p_partkey AS stem, 'app/' || {BRAND} AS dir, 'app.' || {BRAND} || '.m' || p_partkey AS dotted, 'app|' || {BRAND} || '|m' || p_partkey AS tokens,
  p_size > 40 AS is_test, CASE WHEN p_size > 30 THEN 'flyway' WHEN p_size > 20 THEN 'liquibase' ELSE 'raw-sql' END AS technology, 'App ' || upper(left({BRAND}, 1)) || substr({BRAND}, 2) AS joined FROM part""")
def path_parts(spark, d):
    path = F.concat(F.lit("app/"), _brand(), F.lit("/m"), "p_partkey", F.lit(".py"))
    test = F.when(F.col("p_size") > 40, F.concat(F.lit("tests/"), path)).otherwise(path)
    sql = F.when(F.col("p_size") > 30, "db/V1__a.sql").when(F.col("p_size") > 20, "db/Changelog/a.sql").otherwise("a.sql")
    return _part(spark, d).select("p_partkey", paths.base_name(path).alias("base"), paths.file_stem(path).alias("stem"), paths.directory(path).alias("dir"), paths.module_dotted(path).alias("dotted"), joined(paths.file_tokens(path)).alias("tokens"), paths.is_test_file(test).alias("is_test"), paths.sql_technology(sql).alias("technology"), paths.join_parts(F.array(F.lit("app"), F.lit("app"), _brand())).alias("joined"))


@query("""WITH m AS (SELECT p_partkey AS k, CASE WHEN p_size <= 5 THEN 'N' || p_partkey // 20 ELSE 'U' || p_partkey END AS name FROM part)
SELECT 'm' || k AS id, CASE WHEN count(*) OVER (PARTITION BY name) > 1 THEN 'Lib A' || k ELSE name END AS name FROM m""")
def widen_names(spark, d):
    k = F.col("p_partkey")
    name = F.when(F.col("p_size") <= 5, F.concat(F.lit("N"), F.floor(k / 20).cast("string"))).otherwise(F.concat(F.lit("U"), k))
    m = _part(spark, d).select(F.concat(F.lit("m"), k).alias("id"), name.alias("name"), F.array(F.concat(F.lit("lib/a"), k, F.lit("/x.py"))).alias("source_paths"), F.array(F.lit("Run")).alias("candidates"))
    return windows.widen_names(m).select("id", "name")


@query(f"WITH {NODES} SELECT id, trim(regexp_replace(lower('  ' || label || ' '), '\\s+', ' ', 'g')) AS key, lower(label) AS folded FROM v_nodes")
def label_keys(spark, d):
    label = F.col("label")
    return nodes(spark, d).select("id", text.normalized_label(F.concat(F.lit("  "), label, F.lit(" "))).alias("key"), paths.ascii_lower(label).alias("folded"))


# Routes and signatures.


@query("""SELECT p_partkey, '/v1/' || lower(replace(p_name, ' ', '/')) || '|/' || lower(replace(p_name, ' ', '/')) || '|/' || lower(string_split(p_name, ' ')[2]) AS suffixes, 'v1|' || lower(replace(p_name, ' ', '|')) AS wanted, p_type AS returns, string_split(p_name, ' ')[1] AS prefix FROM part""")
def route_parts(spark, d):
    path = routes.normalize_path(F.concat(F.lit("V1/"), F.replace("p_name", F.lit(" "), F.lit("/")), F.lit("/")))
    with_parameter = F.concat(path, F.lit("/{}"))
    signature = F.concat(F.lit("(a: int) -> Optional[list["), "p_type", F.lit(" | None]]"))
    return _part(spark, d).select("p_partkey", joined(routes.suffixes(path)).alias("suffixes"), joined(routes.wanted_segments(with_parameter)).alias("wanted"), routes.return_type(signature).alias("returns"), joined(routes.name_prefixes(F.replace("p_name", F.lit(" "), F.lit("_")))).alias("prefix"))


# Coercions.


@query("""SELECT event_id, 'e' || event_id || '--' || event_type || '-->' || user_id AS id, CASE WHEN event_type = 'view' THEN 'document' ELSE 'code' END AS file_type, 'participate_in' AS hyper, CASE WHEN event_type = 'view' THEN 'import' WHEN event_type = 'purchase' THEN 'reference' END AS kind,
  event_type AS first, 'T' || user_id AS ref, '/v' || user_id AS base, 'L' || CASE WHEN event_type = 'view' THEN 3 ELSE 1 END AS line FROM events""")
def coerce_graph(spark, d):
    e = table(spark, d, "events")
    kind = F.col("event_type")
    relation = F.when(kind == "view", "imports_from").when(kind == "purchase", "uses").otherwise(kind)
    sql = F.when(kind == "view", "-- a\n\ncreate TABLE t").otherwise("create table T")
    return e.select(
        "event_id", coerce.edge_id(F.concat(F.lit("e"), "event_id"), kind, F.col("user_id").cast("string")).alias("id"), coerce.file_type(F.when(kind == "view", "document").otherwise("")).alias("file_type"), coerce.hyperedge_relation(kind).alias("hyper"),
        coerce.relation_kind(relation).alias("kind"), coerce.first_text(F.lit(""), F.lit(None), kind).alias("first"), coerce.ref_name(F.concat(F.lit("#/definitions/T"), "user_id")).alias("ref"), coerce.base_path(F.concat(F.lit("/v"), "user_id", F.lit("//"))).alias("base"), coerce.locate_line(sql, F.lit("Create table T")).alias("line"),
    )


@query(r"SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]{1,4}|[^\s\p{L}\p{N}_]'))::BIGINT AS tokens FROM documents")
def approximate_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", tokens.approximate_tokens(F.col("text")).alias("tokens"))


# Lookups.


@query("""SELECT 's' || s_suppkey AS id, coalesce((SELECT string_agg('p' || p_partkey, '|' ORDER BY p_partkey) FROM part WHERE p_partkey // 20 = s_suppkey AND p_size > 40), '') AS indexes FROM supplier""")
def attach_indexes(spark, d):
    s = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.upper(F.concat(F.lit("t"), "s_suppkey")).alias("name"), F.lit("a.sql").alias("source_file"), F.array().cast("array<struct<name:string>>").alias("indexes"))
    i = _part(spark, d).where("p_size > 40").select(F.col("p_partkey").alias("ord"), F.concat(F.lit("t"), F.floor(F.col("p_partkey") / 20).cast("string")).alias("table"), F.lit("a.sql").alias("source_file"), F.struct(F.concat(F.lit("p"), "p_partkey").alias("name")).alias("index"))
    return joins.attach_indexes(s, i).select("id", joined(F.transform("indexes", lambda x: x["name"])).alias("indexes"))


@query("SELECT 's' || l_suppkey AS id, string_agg('p' || l_partkey, '|' ORDER BY l_orderkey, l_linenumber, l_partkey) AS bases FROM lineitem GROUP BY 1")
def base_classes(spark, d):
    e = table(spark, d, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("source_id"), F.concat(F.lit("p"), "l_partkey").alias("target_id"), F.lit("inherits").alias("relation"), F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("ord"))
    return joins.base_classes(e).select("id", joined(F.col("bases")).alias("bases"))


@query("SELECT p_partkey, CASE WHEN p_partkey // 3 IN (SELECT p_partkey FROM part WHERE p_size > 10) THEN 's' || p_partkey // 3 END AS summary FROM part")
def keep_foreign(spark, d):
    p = _part(spark, d)
    valid = p.where("p_size > 10").select(F.concat(F.lit("s"), "p_partkey").alias("id"))
    return joins.keep_foreign(p.select("p_partkey", F.concat(F.lit("s"), F.floor(F.col("p_partkey") / 3).cast("string")).alias("summary")), "summary", valid)


# Aggregations.


@query(f"WITH {EDGES} SELECT count(*)::BIGINT AS added, count(DISTINCT source_id)::BIGINT AS callers FROM v_edges WHERE relation = 'calls'")
def call_stats(spark, d):
    return aggs.call_stats(edges(spark, d).where("relation = 'calls'"))


@query("""SELECT 'm' || p_partkey // 10 AS id, string_agg(p_name, '|' ORDER BY p_name) AS gods FROM part WHERE p_size > 35 GROUP BY 1""")
def god_symbols(spark, d):
    p = _part(spark, d).withColumns({"id": F.concat(F.lit("p"), "p_partkey"), "m": F.concat(F.lit("m"), F.floor(F.col("p_partkey") / 10).cast("string"))})
    modules = p.groupBy("m").agg(F.collect_list("id").alias("symbol_ids")).withColumnRenamed("m", "id")
    return aggs.god_symbols(modules, p.select("id", F.col("p_name").alias("label")), p.where("p_size > 35").select("id")).select("id", joined(F.col("god_nodes")).alias("gods"))


@query("SELECT p_name, p_type, count(*)::BIGINT AS n, 1::BIGINT AS keys FROM part GROUP BY ALL")
def content_keys(spark, d):
    p = _part(spark, d).select(F.col("p_partkey").cast("string").alias("id"), "p_name", "p_type")
    return p.withColumn("key", store.content_key(p)).groupBy("p_name", "p_type").agg(F.count("*").alias("n"), F.count_distinct("key").alias("keys"))


@query("SELECT 'mysql' AS dialect")
def sql_dialect(spark, d):
    found = table(spark, d, "nation").select(F.element_at(F.array(*[F.lit(x) for x in ("sqlite", "mysql", "alembic", "oracle", "mssql")]), (F.col("n_nationkey") % 5 + 1).cast("int")).alias("id"), F.when(F.col("n_nationkey") % 5 == 0, "INFERRED").otherwise("EXTRACTED").alias("confidence"))
    return registry.dialect(found)


# Checks.


@query(f"""WITH {NODES} SELECT r_name AS name, v.code, v.level FROM region, (VALUES ('META_REPO_NAME', 'error'), ('META_SCHEMA', 'error'), ('META_NODE_COUNT', 'warning'), ('NO_MODULES', 'error')) v(code, level)
WHERE (code = 'META_REPO_NAME' AND r_regionkey = 0) OR (code = 'META_SCHEMA' AND r_regionkey > 2) OR (code = 'META_NODE_COUNT' AND r_regionkey <> (SELECT count(*) FROM v_nodes)) OR (code = 'NO_MODULES' AND r_regionkey = 4)""")
def check_metadata(spark, d):
    r, n = table(spark, d, "region"), nodes(spark, d)
    out = []
    for key, name in ((x["r_regionkey"], x["r_name"]) for x in r.collect()):  # the five regions, as five catalogs
        meta = spark.createDataFrame([("" if key == 0 else name, 3 if key > 2 else 4, key)], "repo_name string, schema_version int, node_count long")
        found = checks.metadata(meta, n, 4)
        if key == 4:
            found = found.unionByName(checks.no_modules(n, n.limit(0)))
        out.append(found.select(F.lit(name).alias("name"), "code", "level"))
    return checks.union(out)


@query("""SELECT 'DUP_DB_TABLE' AS code, count(*)::BIGINT AS n FROM (SELECT p_name, p_type, p_size FROM part GROUP BY ALL HAVING count(*) > 1) UNION ALL SELECT 'DB_TABLE_NO_COLUMNS', count(*) FROM part WHERE p_size < 4""")
def check_database(spark, d):
    t = _part(spark, d).select(F.concat_ws("|", "p_name", "p_type", "p_size").alias("id"), F.when(F.col("p_size") >= 4, F.array("p_name")).otherwise(F.array().cast("array<string>")).alias("columns"))
    return checks.database(t).groupBy("code").agg(F.count("*").alias("n"))


# Files and retrieval.


@query("""WITH f AS (SELECT 'p' || page_id AS path, sha256(coalesce(html, '')) AS h FROM pages), n AS (SELECT 'p' || doc_id AS path, doc_id AS k FROM documents)
SELECT n.path, h AS hash, CASE WHEN h IS NULL THEN 'lost' WHEN k % 2 = 0 THEN 'same' ELSE 'changed' END AS state FROM n LEFT JOIN f USING (path)""")
def file_states(spark, d):
    f = files.hashed(table(spark, d, "pages").select(F.concat(F.lit("p"), "page_id").alias("path"), "html"), "html")
    named = table(spark, d, "documents").select(F.concat(F.lit("p"), "doc_id").alias("source_file"), "doc_id")
    have, lost = files.source_hashes(named, f)
    old = have.join(named, "source_file").select("source_file", F.when(F.col("doc_id") % 2 == 0, F.col("hash")).otherwise("old").alias("hash"))
    changed = files.changed_files(f.join(have.select(F.col("source_file").alias("path")), "path", "left_semi"), old).select("path", F.lit("changed").alias("state"))
    known = have.withColumnRenamed("source_file", "path").join(changed, "path", "left").select("path", "hash", F.coalesce("state", F.lit("same")).alias("state"))
    return known.unionByName(lost.select(F.col("source_file").alias("path"), F.lit(None).cast("string").alias("hash"), F.lit("lost").alias("state")))


QUESTION = "which ring parts and customers are building"


@query(f"""WITH {NODES}, x AS (SELECT id, {text.token_set_sql("concat_ws(' ', label, source_file, CASE WHEN kind = 'class' THEN 'Building.' || id END)")} AS t, {text.is_test_sql("concat_ws(' ', source_file, label)")} AS is_test FROM v_nodes)
SELECT id, round(len(list_intersect(t, {text.question_stems_sql(QUESTION)})) * CASE WHEN is_test THEN 0.4 ELSE 1.0 END, 6)::DOUBLE AS score FROM x WHERE len(list_intersect(t, {text.question_stems_sql(QUESTION)})) > 0""")
def node_seeds(spark, d):
    n = nodes(spark, d)
    symbols = n.where("kind = 'class'").select("id", F.lit("Building").alias("name"), F.col("id").alias("qualified_name"), F.lit(None).cast("string").alias("docstring"), F.lit(None).cast("string").alias("signature"))
    return hybrid.seeds(hybrid.node_tokens(n, symbols), QUESTION).select("id", F.round("score", 6).alias("score"))


# The catalog and what is retrieved from it.


def _catalog(spark, d):
    """A catalog of suppliers as modules, parts as concepts and nodes as symbols; all else is empty."""
    p, s, n = _part(spark, d), table(spark, d, "supplier"), nodes(spark, d)
    c = {k: store.empty(spark, k) for k in RELATIONS}
    c["modules"] = store.conform(s.select(F.concat(F.lit("m"), "s_suppkey").alias("id"), F.col("s_name").alias("name"), F.array(F.lit("src/m.py")).alias("source_paths")), "modules")
    c["summaries"] = store.conform(s.where("s_acctbal > 0").select(F.concat(F.lit("m"), "s_suppkey").alias("module_id"), F.lit("Handles rings").alias("purpose"), F.array(F.lit("keeping"), F.lit("bolts")).alias("responsibilities")), "summaries")
    c["concepts"] = store.conform(p.select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.col("p_name").alias("label"), F.when(F.col("p_size") > 25, F.col("p_type")).alias("rationale")), "concepts")
    c["symbols"] = store.conform(n.select("id", "label", F.when(F.col("kind") == "class", "").otherwise(F.col("label")).alias("name"), F.when(F.col("file_type") == "document", "file").otherwise(F.col("kind")).alias("kind"), "source_file", F.lit("(a ring)").alias("signature")), "symbols")
    return c


CATALOG = f"""{NODES}, x AS (
  SELECT 'module' AS kind, 'm' || s_suppkey AS id, s_name AS name, concat_ws(' ', s_name, CASE WHEN s_acctbal > 0 THEN 'Handles rings keeping bolts' END) AS body, 'src/m.py ' || s_name AS place FROM supplier
  UNION ALL SELECT 'concept', 'p' || p_partkey, p_name, concat_ws(' ', p_name, CASE WHEN p_size > 25 THEN p_type END), p_name FROM part
  UNION ALL SELECT 'symbol', id, label, concat_ws(' ', label, '(a ring)'), concat_ws(' ', source_file, label) FROM v_nodes WHERE file_type <> 'document'),
  ix AS (SELECT kind, id, name, {text.token_set_sql("coalesce(name, '')")} AS nt, {text.token_set_sql('body')} AS bt, {text.is_test_sql('place')} AS is_test FROM x)"""


@query(f"WITH {CATALOG} SELECT kind, id, array_to_string(list_sort(nt), '|') AS named, array_to_string(list_sort(bt), '|') AS body, is_test FROM ix")
def catalog_index(spark, d):
    return index.build_index(_catalog(spark, d)).select("kind", "id", joined(F.array_sort("name_tokens")).alias("named"), joined(F.array_sort("body_tokens")).alias("body"), "is_test")


ASKED = "which modules are keeping rings"


@query(f"""WITH {CATALOG}, s AS (SELECT *, list_sum(list_transform({text.question_stems_sql(ASKED)}, lambda q: CASE WHEN list_contains(nt, q) THEN 2 WHEN list_contains(bt, q) THEN 1 ELSE 0 END)) * CASE WHEN is_test THEN 0.4 ELSE 1.0 END AS score FROM ix),
b AS (SELECT *, row_number() OVER (ORDER BY score DESC, is_test, kind, name, id) AS r FROM s WHERE score > 0 QUALIFY r <= 8)
SELECT '# Question: {ASKED}' || chr(10) || chr(10) || '## Relevant repository knowledge' || chr(10) || chr(10) || string_agg('### ' || upper(left(kind, 1)) || substr(kind, 2) || ': ' || b.name
  || CASE WHEN kind = 'module' THEN CASE WHEN EXISTS (SELECT 1 FROM supplier WHERE 'm' || s_suppkey = b.id AND s_acctbal > 0) THEN chr(10) || '- Purpose: Handles rings' || chr(10) || '- Responsibilities: keeping, bolts' ELSE '' END
     WHEN kind = 'concept' THEN coalesce((SELECT chr(10) || '- Rationale: ' || p_type FROM part WHERE 'p' || p_partkey = b.id AND p_size > 25), '')
     ELSE chr(10) || '- Signature: (a ring)' || (SELECT coalesce(chr(10) || '- Location: ' || source_file, '') FROM v_nodes v WHERE v.id = b.id) END, chr(10) || chr(10) ORDER BY r) AS text FROM b""")
def context_document(spark, d):
    c = _catalog(spark, d)
    hits = cut_lineage(index.ranked(index.build_index(c), ASKED, 8))
    ranked = hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "is_test", "kind", "name", "id")))  # eight rows
    return render.context_text(ASKED, render.blocks(ranked, c))


@query("""SELECT 's' || p_partkey || '/' || f AS id, 'f' || p_partkey AS source_file, f AS start, CASE WHEN f = 1 THEN 3 ELSE 5 + p_size % 2 END AS end, CASE WHEN f = 1 THEN 'def a():' || chr(10) || '    ' || p_name || chr(10) || '' ELSE 'def b():' || chr(10) || '    pass' || CASE WHEN p_size % 2 = 1 THEN chr(10) || 'x = 1' ELSE '' END END AS code
FROM part, (VALUES (1), (4)) v(f)""")
def code_slices(spark, d):
    p = _part(spark, d).withColumn("f", F.explode(F.array(F.lit(1), F.lit(4))))
    file = F.concat(F.lit("f"), "p_partkey")
    symbols = p.select(F.concat(F.lit("s"), "p_partkey", F.lit("/"), "f").alias("id"), file.alias("source_file"), F.concat(F.lit("L"), "f").alias("source_location"), F.col("f").alias("start_line"), F.lit(None).cast("int").alias("end_line"), F.lit("function").alias("kind"))
    body = F.concat(F.lit("def a():\n    "), "p_name", F.lit("\n\ndef b():\n    pass\n"), F.when(F.col("p_size") % 2 == 1, "x = 1\n").otherwise(""))
    return hybrid.slices(symbols, symbols, _part(spark, d).select(file.alias("path"), body.alias("text"))).select("id", "source_file", "start", "end", "code")


@query(f"""WITH {NODES}, {EDGES}, x AS (SELECT id, source_file, kind, {text.token_set_sql("concat_ws(' ', label, source_file)")} AS t, {text.is_test_sql("concat_ws(' ', source_file, label)")} AS is_test FROM v_nodes),
seed AS (SELECT id, len(list_intersect(t, {text.question_stems_sql(QUESTION)})) * CASE WHEN is_test THEN 0.4 ELSE 1.0 END AS score FROM x WHERE len(list_intersect(t, {text.question_stems_sql(QUESTION)})) > 0),
adj AS (SELECT source_id AS a, target_id AS b FROM v_edges UNION SELECT target_id, source_id FROM v_edges), f0 AS (SELECT id, score FROM seed ORDER BY score DESC, id LIMIT 40),
tot AS (SELECT id, sum(s) AS score FROM (SELECT id, score AS s FROM seed UNION ALL SELECT b, sum(score * 0.5) FROM f0 JOIN adj ON id = a WHERE score * 0.5 >= 0.15 GROUP BY b) GROUP BY id)
SELECT id, round(score, 6)::DOUBLE AS score FROM tot JOIN x USING (id) WHERE coalesce(source_file, '') <> '' AND coalesce(kind, '') NOT IN ('file', 'module', 'import', 'variable') ORDER BY tot.score DESC, id LIMIT 40""")
def retrieve_symbols(spark, d):
    n = nodes(spark, d)
    no = lambda c: F.lit(None).cast("string").alias(c)
    symbols = n.select("id", "kind", "source_file", F.lit("L1").alias("source_location"), no("name"), no("qualified_name"), no("docstring"), no("signature"))
    return hybrid.retrieve(hybrid.node_tokens(n, symbols), graph.both_ways(edges(spark, d)), symbols, QUESTION).select("id", F.round("score", 6).alias("score"))
