"""The registered queries of the engine's own operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn import catalog as store
from cairn.functions import coerce, paths, routes, text
from cairn.operators import aggs, checks, graph, joins, windows
from cairn.schemas import RELATIONS
from cairn.search import hybrid, index, render
from cairn.sources import files

from .views import EDGES, HYPER, MEMBERSHIP, NODES, edges, hyper, membership, nodes, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def _half(column: str):
    return F.floor(F.col(column) / 2).cast("long")


def joined(c):
    return F.array_join(c, "|")


QUESTION = "how does the heating tion handle testing of ereating"
STEM_LIST = text.question_stems_sql(QUESTION)
ASKS_FOR_TESTS = f"list_has_any({STEM_LIST}, [{', '.join(f"'{w}'" for w in text.TEST_WORDS)}])"


# Tokens and search.


@query(f"""SELECT doc_id, array_to_string(list_sort({text.token_set_sql('text')}), '|') AS tokens FROM documents""")
def tokenize_stem_documents(spark, d):
    return table(spark, d, "documents").select("doc_id", joined(F.array_sort(text.token_set(F.col("text")))).alias("tokens"))


@query(f"""SELECT item_id, array_to_string({text.keywords_sql('text')}, '|') AS words,
  array_to_string(list_sort(list_distinct(list_transform({text.keywords_sql('text')}, lambda t: {text.stem_sql('t')}))), '|') AS stems FROM benchmark""")
def keywords_benchmark(spark, d):
    t = F.col("text")
    return table(spark, d, "benchmark").select("item_id", joined(text.keywords(t)).alias("words"), joined(F.array_sort(text.query_stems(t))).alias("stems"))


def _document_index(spark, d):
    return index.searchable(table(spark, d, "documents"), "document", "doc_id", F.col("source"), [F.col("text")])


SCORED = f"""d AS (SELECT doc_id::VARCHAR AS id, source AS name, {text.token_set_sql("coalesce(source, '')")} AS nt, {text.token_set_sql("concat_ws(' ', source, text)")} AS bt,
    {text.is_test_sql("concat_ws(' ', '', source)")} AS is_test FROM documents),
  s AS (SELECT *, list_sum(list_transform({STEM_LIST}, lambda q: CASE WHEN list_contains(nt, q) THEN 2 WHEN list_contains(bt, q) THEN 1 ELSE 0 END)) * CASE WHEN is_test AND NOT {ASKS_FOR_TESTS} THEN 0.4 ELSE 1.0 END AS score FROM d)"""


@query(f"WITH {SCORED} SELECT id, name, round(score, 6)::DOUBLE AS score FROM s WHERE score > 0 ORDER BY score DESC, is_test, name, id LIMIT 10")
def keyword_search_documents(spark, d):
    return index.ranked(_document_index(spark, d), QUESTION).select("id", "name", F.round("score", 6).alias("score"))


@query(f"WITH {SCORED} SELECT id, round(score, 6)::DOUBLE AS score FROM s WHERE score > 0")
def score_all_documents(spark, d):
    return index.score(_document_index(spark, d), QUESTION).select("id", F.round("score", 6).alias("score"))


def _union_index(spark, d):
    t = lambda n: table(spark, d, n)
    parts = [
        index.entities(t("part"), "part", "p_partkey", F.col("p_name"), [F.col("p_type"), F.col("p_brand")]),
        index.entities(t("customer"), "customer", "c_custkey", F.col("c_name"), [F.col("c_mktsegment")]),
        index.entities(t("supplier"), "supplier", "s_suppkey", F.col("s_name")),
        index.entities(t("nation"), "nation", "n_nationkey", F.col("n_name")),
        index.entities(t("pages"), "page", "page_id", F.col("url"), origin=F.col("url")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return index.tokenized(out)


UNION = f"""u AS (
  SELECT 'part' AS kind, p_partkey::VARCHAR AS id, p_name AS name, concat_ws(' ', p_name, p_type, p_brand) AS body, p_name AS place FROM part
  UNION ALL SELECT 'customer', c_custkey::VARCHAR, c_name, concat_ws(' ', c_name, c_mktsegment), c_name FROM customer
  UNION ALL SELECT 'supplier', s_suppkey::VARCHAR, s_name, s_name, s_name FROM supplier
  UNION ALL SELECT 'nation', n_nationkey::VARCHAR, n_name, n_name, n_name FROM nation
  UNION ALL SELECT 'page', page_id::VARCHAR, url, url, url || ' ' || url FROM pages),
  ui AS (SELECT kind, id, name, {text.token_set_sql("coalesce(name, '')")} AS nt, {text.token_set_sql('body')} AS bt, {text.is_test_sql('place')} AS is_test FROM u)"""


@query(f"WITH {UNION} SELECT kind, count(*)::BIGINT AS n, sum(len(nt))::BIGINT AS name_tokens, sum(len(bt))::BIGINT AS body_tokens, count(*) FILTER (is_test)::BIGINT AS tests FROM ui GROUP BY kind")
def search_index_union(spark, d):
    return _union_index(spark, d).groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.size("name_tokens")).alias("name_tokens"), F.sum(F.size("body_tokens")).alias("body_tokens"), F.count_if("is_test").alias("tests"))


@query(f"WITH {UNION} SELECT token, count(*)::BIGINT AS n, count(*) FILTER (in_name)::BIGINT AS named FROM (SELECT unnest(bt) AS token, unnest(list_transform(bt, lambda b: list_contains(nt, b))) AS in_name FROM ui) GROUP BY token")
def inverted_index(spark, d):
    return index.inverted(_union_index(spark, d)).groupBy("token").agg(F.count("*").alias("n"), F.count_if("in_name").alias("named"))


@query(f"""WITH {UNION} SELECT kind, id, round(score, 6)::DOUBLE AS score FROM (SELECT *, list_sum(list_transform({text.question_stems_sql('small ring building')}, lambda q: CASE WHEN list_contains(nt, q) THEN 2 WHEN list_contains(bt, q) THEN 1 ELSE 0 END)) * CASE WHEN is_test THEN 0.4 ELSE 1.0 END AS score FROM ui WHERE kind IN ('part', 'customer'))
WHERE score > 0 ORDER BY score DESC, is_test, kind, name, id LIMIT 25""")
def kind_filtered_search(spark, d):
    return index.ranked(_union_index(spark, d), "small ring building", 25, ("part", "customer")).select("kind", "id", F.round("score", 6).alias("score"))


@query(f"""WITH p AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'src/tests/' || url ELSE url END AS u FROM pages),
  i AS (SELECT page_id::VARCHAR AS id, {text.token_set_sql('u')} AS nt, {text.is_test_sql("u || ' ' || u")} AS is_test FROM p)
SELECT id, round((2 * len(list_filter({text.question_stems_sql('example com')}, lambda q: list_contains(nt, q)))) * CASE WHEN is_test THEN 0.4 ELSE 1.0 END, 6)::DOUBLE AS score FROM i
WHERE len(list_filter({text.question_stems_sql('example com')}, lambda q: list_contains(nt, q))) > 0""")
def test_penalty_search(spark, d):
    u = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("src/tests/"), "url")).otherwise(F.col("url"))
    p = table(spark, d, "pages").withColumn("u", u)
    return index.score(index.searchable(p, "page", "page_id", F.col("u"), origin=F.col("u")), "example com").select("id", F.round("score", 6).alias("score"))


# Scalars over node labels, paths and URLs.


@query(f"""WITH {NODES} SELECT id, label, CASE WHEN contains(label, '/') THEN 'file' WHEN contains(label, '(') THEN 'function' WHEN regexp_matches(label, '^\\p{{Lu}}[\\p{{L}}\\p{{N}}_]*$') THEN 'class' END AS kind,
  CASE WHEN ends_with(source_file, '.py') THEN 'python' END AS language, CASE WHEN source_file IS NULL THEN '<root>' ELSE regexp_replace(source_file, '/[^/]*$', '') END AS package
FROM v_nodes WHERE file_type = 'code'""")
def project_code_symbols(spark, d):
    n = nodes(spark, d).where("file_type = 'code'")
    f = F.col("source_file")
    return n.select("id", "label", paths.baseline_kind(F.col("label")).alias("kind"), paths.language(f).alias("language"), paths.package_key(f).alias("package"))


@query(f"""WITH {NODES}, x AS (SELECT id, string_split(lower(coalesce(source_file, '')), '/') AS parts, lower(label) AS name, kind FROM v_nodes),
y AS (SELECT *, regexp_replace(parts[len(parts)], '\\.[^.]+$', '') AS stem FROM x)
SELECT id, CASE WHEN coalesce(kind, '') IN ('file', 'module', 'import', 'variable') OR list_has_any(parts, ['tests', 'test', 'testing', '__tests__']) OR starts_with(stem, 'test_') OR ends_with(stem, '_test') THEN NULL
  WHEN list_contains(parts, 'controllers') OR contains(stem, 'controller') OR ends_with(name, 'controller') OR ends_with(name, 'handler') THEN 'controller'
  WHEN list_has_any(parts, ['routes', 'route', 'urls', 'endpoints', 'api', 'apis']) OR stem IN ('routes', 'urls', 'endpoints', 'route') OR contains(name, 'route') OR contains(name, 'endpoint') THEN 'api'
  WHEN list_has_any(parts, ['services', 'service']) OR ends_with(stem, 'service') OR contains(stem, '_service') OR ends_with(name, 'service') THEN 'service' END AS role FROM y""")
def classify_roles(spark, d):
    return nodes(spark, d).select("id", paths.role(F.col("source_file"), F.col("label"), F.col("kind")).alias("role"))


@query(f"""WITH {NODES} SELECT source_file, upper(left(p, 1)) || substr(p, 2) || 'Service' AS name, count(*)::BIGINT AS n, string_agg(id, '|' ORDER BY id) AS ids
FROM (SELECT *, string_split(source_file, '/')[2] AS p FROM v_nodes WHERE source_file LIKE 'app/%/service.py') GROUP BY ALL""")
def components_by_file(spark, d):
    return aggs.components(nodes(spark, d)).where("role = 'service'").select("source_file", "name", F.size("symbol_ids").cast("long").alias("n"), joined(F.col("symbol_ids")).alias("ids"))


@query("""SELECT p_partkey, upper(left(b, 1)) || substr(b, 2) AS capability, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(left(w, 1)) || substr(w, 2)), '') AS title, regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', '_', 'g') AS slug
FROM (SELECT *, replace(p_brand, '#', '') AS b FROM part)""")
def capability_title_slug(spark, d):
    file = F.concat(F.lit("src/services/"), F.replace("p_brand", F.lit("#"), F.lit("")), F.lit("/part.py"))
    return table(spark, d, "part").select("p_partkey", paths.title_case(paths.capability(file)).alias("capability"), paths.title_case(F.col("p_name")).alias("title"), paths.slug(F.concat_ws(" ", "p_name", "p_brand")).alias("slug"))


@query("""SELECT page_id, '/' || lower(regexp_replace(regexp_replace(url, '[{<:][^}>/]*[}>]?', '{}', 'g'), '^/+|/+$', '', 'g')) AS path,
  len(list_filter(string_split('/' || lower(regexp_replace(regexp_replace(url, '[{<:][^}>/]*[}>]?', '{}', 'g'), '^/+|/+$', '', 'g')), '/'), lambda s: s <> ''))::BIGINT AS n FROM pages""")
def url_normalize_paths(spark, d):
    p = routes.normalize_path(F.col("url"))
    return table(spark, d, "pages").select("page_id", p.alias("path"), F.size(routes.segments(p)).cast("long").alias("n"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey::INTEGER AS lo, CASE WHEN l_linenumber % 2 = 0 THEN (l_partkey + l_linenumber)::INTEGER END AS hi FROM lineitem""")
def parse_locations(spark, d):
    l = table(spark, d, "lineitem")  # noqa: E741
    place = F.concat(F.lit("L"), "l_partkey", F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit(" - L"), F.col("l_partkey") + F.col("l_linenumber"))).otherwise(""))
    lo, hi = paths.line_range(place)
    return l.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", lo.alias("lo"), hi.alias("hi"))


@query("""SELECT event_id, CASE WHEN event_type IN ('EXTRACTED', 'INFERRED', 'AMBIGUOUS') THEN event_type ELSE 'EXTRACTED' END AS confidence, coalesce(try_cast(json_extract_string(props, '$.k') AS DOUBLE), 1.0) AS weight,
  nullif(trim(event_type), '') AS opt, CASE WHEN starts_with('_' || event_type, '__') THEN 'private' ELSE 'protected' END AS visibility FROM events""")
def coerce_events(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", coerce.confidence(F.col("event_type")).alias("confidence"), coerce.number_or(F.get_json_object("props", "$.k"), 1.0).alias("weight"), coerce.opt_trim(F.col("event_type")).alias("opt"), coerce.visibility(F.concat(F.lit("_"), "event_type")).alias("visibility"))


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k, '{"event_id":' || event_id || ',"event_type":"' || event_type || '","none":null}' AS data FROM events""")
def json_roundtrip(spark, d):
    e = table(spark, d, "events").withColumn("none", F.lit(None).cast("string"))
    data = coerce.as_json("event_id", "event_type", "none")
    return e.select("event_id", F.get_json_object("props", "$.k").alias("k"), data.alias("data"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS hash FROM documents")
def hash_sources(spark, d):
    return files.hashed(table(spark, d, "documents"), "text").select("doc_id", "hash")


@query("""SELECT o_orderkey, lower(o_orderpriority) || '_' || 'order' AS derived, CASE WHEN o_orderkey % 3 = 0 THEN 'GET' WHEN o_orderkey % 3 = 1 THEN 'POST' ELSE '' END AS verb,
  CASE WHEN o_orderkey % 3 = 0 THEN '/o/' || o_custkey WHEN o_orderkey % 3 = 1 THEN '/' END AS path, CASE WHEN o_orderkey % 3 = 2 THEN '' ELSE 'router' END AS receiver FROM orders""")
def route_decorators(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey") % 3
    deco = F.when(k == 0, F.concat(F.lit('@router.get("/o/'), "o_custkey", F.lit('", summary="x")'))).when(k == 1, F.lit("router.post()")).otherwise(F.lit("@cached(ttl=1)"))
    return o.select("o_orderkey", routes.derived_name(F.col("o_orderpriority"), F.lit("/order")).alias("derived"), routes.decorator_verb(deco).alias("verb"), routes.decorator_path(deco).alias("path"), routes.receiver(deco).alias("receiver"))


# Joins.

BOTH = f"WITH {NODES}, {EDGES}"


@query(f"""{BOTH} SELECT 'dep::' || e.id AS id, source_id, n.id AS target_id, coalesce(n.label, e.target_id) AS target_name, CASE WHEN relation = 'imports' THEN 'import' ELSE 'reference' END AS kind, n.id IS NULL AS external
FROM v_edges e LEFT JOIN v_nodes n ON e.target_id = n.id WHERE relation IN ('imports', 'references', 'uses')""")
def dependencies_external(spark, d):
    return joins.dependencies(edges(spark, d), nodes(spark, d))


@query(f"{BOTH} SELECT e.* FROM v_edges e WHERE EXISTS (SELECT 1 FROM v_nodes WHERE id = source_id) AND EXISTS (SELECT 1 FROM v_nodes WHERE id = target_id)")
def drop_danglers_semi(spark, d):
    return joins.connected_edges(edges(spark, d), nodes(spark, d))


@query(f"{BOTH} SELECT e.* FROM v_edges e WHERE NOT EXISTS (SELECT 1 FROM v_nodes WHERE id = source_id) OR NOT EXISTS (SELECT 1 FROM v_nodes WHERE id = target_id)")
def dangling_anti(spark, d):
    return joins.dangling_edges(edges(spark, d), nodes(spark, d))


@query(f"WITH {NODES}, {HYPER} SELECT h.id, coalesce(string_agg(DISTINCT n.id, '|' ORDER BY n.id), '') AS ids FROM v_hyper h LEFT JOIN v_nodes n ON h.member = n.id GROUP BY h.id")
def keep_valid_members(spark, d):
    kept = joins.keep_valid(hyper(spark, d), "id", "participant_ids", nodes(spark, d).select("id"))
    return kept.select("id", joined(F.col("participant_ids")).alias("ids"))


@query("""WITH p AS (SELECT event_id, user_id, epoch_us(ts) AS t FROM events WHERE event_type = 'purchase'), v AS (SELECT event_id AS view_id, user_id, epoch_us(ts) AS t FROM events WHERE event_type = 'view')
SELECT event_id, view_id, distance FROM (SELECT p.event_id, view_id, abs(p.t - v.t) AS distance, row_number() OVER (PARTITION BY p.event_id ORDER BY abs(p.t - v.t), v.t, view_id) AS r FROM p JOIN v USING (user_id)) WHERE r = 1""")
def nearest_event_match(spark, d):
    e = table(spark, d, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    views = e.where("event_type = 'view'").select(F.col("event_id").alias("view_id"), "user_id", "t")
    return joins.nearest(e.where("event_type = 'purchase'").select("event_id", "user_id", "t"), views, ["user_id"], "t", "event_id", "view_id")


@query(f"""WITH s AS (SELECT p_partkey AS id, p_partkey // 100 AS f, p_name AS n, p_size AS l FROM part), dd AS (SELECT p_partkey AS o, p_partkey // 100 AS f, p_name AS n, p_size + length(p_brand) % 3 AS l FROM part WHERE p_type <> 'SMALL'),
c AS (SELECT id, count(*) AS n, arg_min(o, {{'a': abs(dd.l - s.l), 'b': o}}) AS o FROM s JOIN dd ON s.f = dd.f AND s.n = dd.n GROUP BY id)
SELECT id, o AS ord FROM c UNION ALL SELECT s.id, min(dd.o) FROM s JOIN dd ON s.f = dd.f AND s.l = dd.l WHERE s.id NOT IN (SELECT id FROM c) GROUP BY s.id""")
def match_definitions(spark, d):
    part = table(spark, d, "part").withColumn("source_file", F.floor(F.col("p_partkey") / 100).cast("string"))
    s = part.select(F.col("p_partkey").alias("id"), "source_file", F.col("p_name").alias("name"), F.col("p_size").alias("start_line"))
    defs = part.where("p_type <> 'SMALL'").select(F.col("p_partkey").alias("ord"), "source_file", F.col("p_name").alias("name"), (F.col("p_size") + F.length("p_brand") % 3).alias("start_line"))
    return joins.match_definitions(s, defs)


@query("""SELECT event_id, t, min(t) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next FROM (SELECT event_id, user_id, epoch_us(ts) AS t FROM events)""")
def next_greater_start(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return joins.next_greater(e, "user_id", "t").select("event_id", "t", "next")


ROUTES = """op AS (SELECT DISTINCT '/api/' || lower(replace(p_brand, '#', '')) || '/' || replace(p_name, ' ', '/') AS path FROM part),
  tail AS (SELECT DISTINCT '/' || replace(p_name, ' ', '/') AS tail FROM part UNION SELECT DISTINCT '/' || string_split(p_name, ' ')[-1] FROM part)"""


def _routes(spark, d):
    p = table(spark, d, "part")
    words = F.replace("p_name", F.lit(" "), F.lit("/"))
    ops = p.select(F.concat(F.lit("/api/"), F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), F.lit("/"), words).alias("path")).distinct()
    tails = p.select(F.concat(F.lit("/"), words).alias("tail")).union(p.select(F.concat(F.lit("/"), F.element_at(F.split("p_name", " "), -1)))).distinct()
    return ops, tails


@query(f"WITH {ROUTES} SELECT path, tail, length FROM (SELECT path, tail, (len(string_split(tail, '/')) - 1)::INTEGER AS length, max(len(string_split(tail, '/')) - 1) OVER (PARTITION BY path) AS most FROM op JOIN tail ON ends_with(path, tail)) WHERE length = most")
def suffix_route_join(spark, d):
    ops, tails = _routes(spark, d)
    return joins.suffix_join(ops, tails, "path", "tail").select("path", "tail", "length")


@query("""WITH o AS (SELECT DISTINCT replace(p_name, ' ', '_') || '_' || lower(p_type) AS op FROM part), n AS (SELECT DISTINCT replace(p_name, ' ', '_') AS name FROM part UNION SELECT DISTINCT string_split(p_name, ' ')[1] FROM part)
SELECT op, name FROM o JOIN n ON starts_with(op, name || '_')""")
def prefix_name_join(spark, d):
    p = table(spark, d, "part")
    snake = F.replace("p_name", F.lit(" "), F.lit("_"))
    ops = p.select(F.concat(snake, F.lit("_"), F.lower("p_type")).alias("op")).distinct()
    names = p.select(snake.alias("name")).union(p.select(F.element_at(F.split("p_name", " "), 1))).distinct()
    return joins.prefix_join(ops, names, "op", "name").select("op", "name")


@query("""WITH w AS (SELECT DISTINCT p_name || ' ' || p_brand AS op, p_brand || '/' || p_type AS file, list_append(string_split(p_name, ' '), p_brand) AS words FROM part),
x AS (SELECT DISTINCT o.op, f.file, len(list_intersect(o.words, f.words))::INTEGER AS score FROM (SELECT DISTINCT op, words FROM w) o, w f), y AS (SELECT *, max(score) OVER (PARTITION BY op) AS top FROM x WHERE score > 0)
SELECT op, min(file) AS file, max(score) AS score FROM y WHERE score = top GROUP BY op HAVING count(*) = 1""")
def path_affinity_tiebreak(spark, d):
    words = F.concat(F.split("p_name", " "), F.array("p_brand"))
    p = table(spark, d, "part").select(F.concat_ws(" ", "p_name", "p_brand").alias("op"), F.concat_ws("/", "p_brand", "p_type").alias("file"), words.alias("wanted"), words.alias("tokens")).distinct()
    # Candidates share a word; the pairing is an equality join on words.
    pairs = p.select("op", "wanted").distinct().withColumn("w", F.explode("wanted")).join(p.select("file", "tokens").withColumn("w", F.explode("tokens")), "w").drop("w").distinct()
    return joins.best_affinity(pairs, "op", "file", "wanted", "tokens").select("op", "file", "score")


@query("WITH x AS (SELECT p_partkey // 2 AS k, p_brand AS v FROM part) SELECT k, min(v) AS v FROM x GROUP BY k HAVING count(DISTINCT v) = 1")
def unique_match(spark, d):
    return joins.unique_match(table(spark, d, "part").select(_half("p_partkey").alias("k"), F.col("p_brand").alias("v")), "k", "v")


@query(f"""{BOTH}, {MEMBERSHIP}, e AS (SELECT source_id, target_id FROM v_edges UNION ALL SELECT 'c' || c_custkey, 's' || s_suppkey FROM customer JOIN supplier ON c_custkey // 15 = s_suppkey),
x AS (SELECT DISTINCT a.module AS m, b.module AS r FROM e JOIN v_member a ON a.id = source_id JOIN v_member b ON b.id = target_id WHERE a.module <> b.module) SELECT m AS module, r AS related FROM x UNION SELECT r, m FROM x""")
def module_adjacency(spark, d):
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    more = c.join(s, F.floor(F.col("c_custkey") / 15) == F.col("s_suppkey")).select(F.concat(F.lit("c"), "c_custkey").alias("source_id"), F.concat(F.lit("s"), "s_suppkey").alias("target_id"))
    e = edges(spark, d).select("source_id", "target_id").unionByName(more)
    return joins.module_adjacency(e, membership(spark, d))


PART_MODULE = "pm AS (SELECT 'p' || p_partkey AS id, p_brand AS module FROM part WHERE p_size <= 45)"


def _part_module(spark, d):
    return table(spark, d, "part").where("p_size <= 45").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.col("p_brand").alias("module"))


@query(f"WITH {HYPER}, {PART_MODULE} SELECT h.id, arg_min(module, pos) AS module FROM v_hyper h JOIN pm ON h.member = pm.id GROUP BY h.id")
def component_first_module(spark, d):
    return joins.first_member_module(hyper(spark, d), _part_module(spark, d), "id", "participant_ids")


@query(f"WITH {HYPER} SELECT h.id, string_agg(DISTINCT p_name, '|' ORDER BY p_name) AS names FROM v_hyper h JOIN part ON h.member = 'p' || p_partkey GROUP BY h.id")
def resolve_names_sorted(spark, d):
    names = table(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.col("p_name").alias("name"))
    return joins.resolve_names(hyper(spark, d).withColumnRenamed("id", "w"), "w", "participant_ids", names).select(F.col("w").alias("id"), joined(F.col("names")).alias("names"))


@query(f"WITH {HYPER}, {PART_MODULE} SELECT module AS id, count(DISTINCT h.id)::BIGINT AS n, min(h.id) AS first FROM v_hyper h JOIN pm ON h.member = pm.id GROUP BY module")
def workflow_modules(spark, d):
    m = _part_module(spark, d)
    modules = m.select(F.col("module").alias("id")).distinct().withColumn("workflow_ids", F.array().cast("array<string>"))
    out = joins.attach_to_modules(modules, hyper(spark, d).withColumnRenamed("id", "w"), "w", "participant_ids", m, "workflow_ids")
    return out.select("id", F.size("workflow_ids").cast("long").alias("n"), F.array_min("workflow_ids").alias("first"))


@query(f"WITH {HYPER} SELECT member AS id, arg_max(v.id, (v.id, pos)) AS owner FROM v_hyper v GROUP BY member")
def last_owner(spark, d):
    h = hyper(spark, d).select(F.col("id").alias("owner"), "participant_ids").withColumn("ord", F.col("owner"))
    return joins.last_owner(h, "owner", "participant_ids", "ord")


@query("SELECT DISTINCT 'brand' || p_size AS module, CASE WHEN p_size % 3 = 0 THEN 'brand' || p_size || '.py' ELSE 'brand' || p_size || '/__init__.py' END AS path FROM part WHERE p_size % 3 < 2")
def module_files(spark, d):
    p = table(spark, d, "part").select(F.col("p_size").alias("n")).distinct()
    files = p.where("n % 3 = 0").select(F.concat(F.lit("brand"), "n", F.lit(".py")).alias("path")).union(p.where("n % 3 < 2").select(F.concat(F.lit("brand"), "n", F.lit("/__init__.py"))))
    return joins.module_files(p.select(F.concat(F.lit("brand"), "n").alias("module")), files)


# Aggregations.


@query(f"""{BOTH}, i AS (SELECT target_id AS id, count(*) AS n FROM v_edges WHERE relation = 'calls' AND target_id IN (SELECT id FROM v_nodes) GROUP BY 1), o AS (SELECT source_id AS id, count(*) AS n FROM v_edges WHERE relation = 'calls' AND source_id IN (SELECT id FROM v_nodes) GROUP BY 1)
SELECT coalesce(i.id, o.id) AS id, coalesce(i.n, 0)::BIGINT AS fan_in, coalesce(o.n, 0)::BIGINT AS fan_out FROM i FULL OUTER JOIN o ON i.id = o.id""")
def callgraph_degree(spark, d):
    return aggs.call_degree(edges(spark, d), nodes(spark, d))


CONCEPT_EDGES = "ce AS (SELECT 'p' || l_partkey AS source_id, 's' || l_suppkey AS target_id, 'cites' AS relation FROM lineitem)"


def _concept_edges(spark, d):
    return table(spark, d, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("source_id"), F.concat(F.lit("s"), "l_suppkey").alias("target_id"), F.lit("cites").alias("relation"))


@query(f"WITH {NODES}, {CONCEPT_EDGES}, r AS (SELECT source_id AS id, target_id AS o FROM ce UNION SELECT target_id, source_id FROM ce) SELECT n.id, coalesce(string_agg(o, '|' ORDER BY o), '') AS related FROM v_nodes n LEFT JOIN r ON n.id = r.id WHERE file_type = 'concept' GROUP BY n.id")
def concepts_related(spark, d):
    return aggs.concept_links(nodes(spark, d), _concept_edges(spark, d)).select("id", joined(F.col("related_ids")).alias("related"))


@query("""WITH c AS (SELECT 'p' || p_partkey AS id, upper(p_name) || '  ' AS label, CASE WHEN p_size % 4 = 0 THEN p_type END AS rationale FROM part),
k AS (SELECT *, trim(lower(label)) AS key, first_value(id) OVER (PARTITION BY trim(lower(label)) ORDER BY coalesce(rationale, '') = '', id) AS keeper FROM c),
r AS (SELECT k.keeper, coalesce(k2.keeper, x.o) AS o FROM k JOIN (SELECT 'p' || p_partkey AS id, 'p' || (p_partkey // 2) AS o FROM part UNION ALL SELECT 'p' || p_partkey, 's' || p_size FROM part) x ON x.id = k.id LEFT JOIN k k2 ON x.o = k2.id)
SELECT keeper AS id, (SELECT coalesce(string_agg(DISTINCT o, '|' ORDER BY o), '') FROM r WHERE r.keeper = g.keeper AND o <> g.keeper) AS related FROM (SELECT DISTINCT keeper FROM k) g""")
def concept_dedup(spark, d):
    p = table(spark, d, "part")
    c = p.select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.concat(F.upper("p_name"), F.lit("  ")).alias("label"), F.when(F.col("p_size") % 4 == 0, F.col("p_type")).alias("rationale"), F.array(F.concat(F.lit("p"), F.floor(F.col("p_partkey") / 2).cast("long")), F.concat(F.lit("s"), "p_size")).alias("related_ids"))
    return aggs.dedup_concepts(c)[0].select("id", joined(F.col("related_ids")).alias("related"))


COHESION = "co AS (SELECT c_nationkey::VARCHAR AS community_id, round(avg(c_acctbal) / 10000, 4) AS cohesion FROM customer GROUP BY 1)"


@query(f"""WITH {NODES}, {COHESION}, m AS (SELECT n.*, count(*) OVER (PARTITION BY community_id) AS size, CASE WHEN source_file IS NULL THEN '<root>' ELSE regexp_replace(source_file, '/[^/]*$', '') END AS pkg FROM v_nodes n),
x AS (SELECT m.*, coalesce(cohesion < 0.45, false) OR size > 60 AS split, trim(regexp_replace(lower(pkg), '[^a-z0-9]+', '_', 'g'), '_') AS slug, count(*) FILTER (m.community_id IS NULL) OVER (PARTITION BY pkg) AS alone FROM m LEFT JOIN co ON m.community_id = co.community_id)
SELECT id, CASE WHEN community_id IS NOT NULL THEN 'module::community::' || community_id || CASE WHEN split THEN '::' || slug ELSE '' END WHEN alone = 1 THEN 'module::symbol::' || id ELSE 'module::package::' || slug END AS module,
  CASE WHEN community_id IS NOT NULL THEN CASE WHEN split THEN 'package' ELSE 'community' END WHEN alone = 1 THEN 'standalone' ELSE 'package' END AS origin FROM x""")
def module_partition_split(spark, d):
    co = table(spark, d, "customer").groupBy(F.col("c_nationkey").cast("string").alias("community_id")).agg(F.round(F.avg("c_acctbal") / 10000, 4).alias("cohesion"))
    return aggs.partition_modules(nodes(spark, d), co, 0.45)


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY ALL) SELECT user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) AS r FROM c) WHERE r = 1""")
def modal_package(spark, d):
    return aggs.modal_first(table(spark, d, "events"), "user_id", "event_type", "event_id")


@query("""WITH e AS (SELECT c_mktsegment, min(c_name) AS lo, max(c_name) AS hi FROM customer GROUP BY 1) SELECT c_mktsegment, regexp_replace(left(lo, list_max(list_filter(range(0, length(lo) + 1), lambda i: left(lo, i) = left(hi, i)))::BIGINT), '[_\\-.]+$', '') AS prefix FROM e""")
def common_prefix(spark, d):
    return aggs.common_prefix(table(spark, d, "customer"), "c_mktsegment", "c_name")


def _declarations(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderpriority").alias("method"), F.col("o_orderstatus").alias("path"), F.concat(F.lit("spec"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).alias("spec_file"), F.when(F.col("o_custkey") % 3 == 0, F.concat(F.lit("op"), F.col("o_custkey") % 9)).alias("operation_id"), F.when(F.col("o_orderkey") % 7 == 0, F.lit("text")).alias("summary"))


DECLARATIONS = "dc AS (SELECT o_orderpriority AS method, o_orderstatus AS path, 'spec' || lpad(o_orderkey::VARCHAR, 9, '0') AS spec_file, CASE WHEN o_custkey % 3 = 0 THEN 'op' || o_custkey % 9 END AS operation_id, CASE WHEN o_orderkey % 7 = 0 THEN 'text' END AS summary FROM orders)"


@query(f"WITH {DECLARATIONS} SELECT method, path, spec_file, operation_id, summary FROM (SELECT *, row_number() OVER (PARTITION BY method, path ORDER BY (operation_id IS NOT NULL)::INT + (summary IS NOT NULL)::INT DESC, spec_file) AS r FROM dc) WHERE r = 1")
def richest_declaration(spark, d):
    return aggs.richest(_declarations(spark, d), ["method", "path"], ["operation_id", "summary"], "spec_file")


@query(f"WITH {DECLARATIONS} SELECT method, path, count(DISTINCT coalesce(operation_id, '<none>')) > 1 AS conflict, count(DISTINCT spec_file)::BIGINT AS specs FROM dc GROUP BY ALL")
def route_conflict(spark, d):
    return aggs.route_conflicts(_declarations(spark, d), ["method", "path"], ["operation_id"]).withColumn("specs", F.size("specs").cast("long"))


@query("SELECT p_partkey // 2 AS k, min(p_brand) AS p_brand FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) = 1")
def unique_or_null_map(spark, d):
    return aggs.unique_or_none(table(spark, d, "part").withColumn("k", _half("p_partkey")), "k", "p_brand")


@query("SELECT p_partkey // 3 || p_type AS k, min(p_partkey) AS p_partkey FROM part GROUP BY 1 HAVING count(*) = 1")
def unrepeated_names(spark, d):
    return aggs.unrepeated(table(spark, d, "part").withColumn("k", F.concat(F.floor(F.col("p_partkey") / 3).cast("long"), "p_type")), "k", "p_partkey")


@query(" UNION ALL ".join(f"SELECT '{t}' AS relation, count(*) AS n FROM {t}" for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")))
def entity_counts(spark, d):
    return aggs.counts({t: table(spark, d, t) for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")})


@query("""SELECT c_mktsegment, count(*)::BIGINT AS total, count(*) FILTER (c_custkey % 3 = 0)::BIGINT AS a_filled, round_even(count(*) FILTER (c_custkey % 3 = 0) * 100.0 / count(*), 0)::BIGINT AS a_percent, count(c_name)::BIGINT AS c_name_filled, round_even(count(c_name) * 100.0 / count(*), 0)::BIGINT AS c_name_percent FROM customer GROUP BY 1""")
def coverage_report(spark, d):
    return aggs.coverage(table(spark, d, "customer").withColumn("a", F.when(F.col("c_custkey") % 3 == 0, "x")), "c_mktsegment", ["a", "c_name"])


RULES = [("license", 0, 2, None, "Licensed? under"), ("license", 0, 0, None, r"^doc/7"), ("table", 1, 2, None, r"\| "), ("mail", 2, 1, r"1$", "@"), ("rare", 3, 2, None, "zzzzzz")]


@query("""WITH f AS (SELECT doc_id AS ord, 'doc/' || doc_id AS path, text FROM documents), r(id, rule_ord, phase, scope, pattern) AS (VALUES ('license', 0, 2, NULL, 'Licensed? under'), ('license', 0, 0, NULL, '^doc/7'), ('table', 1, 2, NULL, '\\| '), ('mail', 2, 1, '1$', '@'), ('rare', 3, 2, NULL, 'zzzzzz')),
h AS (SELECT DISTINCT id, rule_ord, phase, ord, path FROM f JOIN r ON (phase = 0 AND regexp_matches(path, pattern)) OR (phase > 0 AND (scope IS NULL OR regexp_matches(path, scope)) AND regexp_matches(coalesce(text, ''), pattern))),
k AS (SELECT id, rule_ord, path, min(phase) AS phase, min((phase, ord)) AS o FROM (SELECT *, row_number() OVER (PARTITION BY id, phase ORDER BY ord) AS c FROM h) WHERE phase < 2 OR c = 1 GROUP BY id, rule_ord, path),
e AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY o) AS rk FROM k)
SELECT id, rule_ord, CASE WHEN bool_or(phase < 2) THEN 'EXTRACTED' ELSE 'INFERRED' END AS confidence, string_agg(path, '|' ORDER BY rk) FILTER (rk <= 5) AS evidence FROM e GROUP BY id, rule_ord""")
def fingerprint_detect(spark, d):
    files = table(spark, d, "documents").select(F.col("doc_id").alias("ord"), F.concat(F.lit("doc/"), "doc_id").alias("path"), "text")
    rules = spark.createDataFrame(RULES, "id string, rule_ord int, phase int, scope string, pattern string")
    return aggs.fingerprints(files, rules).withColumn("evidence", joined(F.col("evidence")))


@query("""SELECT p_brand AS id, string_agg(DISTINCT p_name, '|' ORDER BY p_name) AS names, coalesce(string_agg(DISTINCT p_type, '|' ORDER BY p_type) FILTER (p_size > 48), '') AS types FROM part GROUP BY 1""")
def summary_rollup(spark, d):
    p = table(spark, d, "part").withColumn("k", F.col("p_partkey").cast("string"))
    m = p.groupBy(F.col("p_brand").alias("id")).agg(F.collect_list("k").alias("ids"), F.collect_list(F.when(F.col("p_size") > 48, F.col("k"))).alias("big"))
    names = lambda c: p.select(F.col("k").alias("id"), F.col(c).alias("name"))
    out = aggs.roll_up(m, {"names": ("ids", names("p_name")), "types": ("big", names("p_type"))})
    return out.select("id", joined(F.col("names")).alias("names"), joined(F.col("types")).alias("types"))


@query("SELECT p_partkey FROM part WHERE p_size % 5 = 0 OR p_size % 7 = 0")
def drop_empty_summaries(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 5 == 0, "x").alias("purpose"), F.when(F.col("p_size") % 7 == 0, F.array(F.lit("y"))).alias("concepts"))
    return aggs.drop_empty(p, ["purpose"], ["concepts"]).select("p_partkey")


# Windows, sorts and sets.


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS r FROM lineitem) WHERE r = 1")
def first_per_key(spark, d):
    return windows.first_per_key(table(spark, d, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"]).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


@query("SELECT l_partkey, arg_min(l_orderkey, (l_orderkey, l_linenumber)) AS l_orderkey FROM lineitem GROUP BY 1")
def first_claim(spark, d):
    return windows.first_claim(table(spark, d, "lineitem"), "l_partkey", "l_orderkey", ["l_orderkey", "l_linenumber"])


@query("SELECT source, doc_id, running FROM (SELECT source, doc_id, sum(n_chars) OVER w AS running, row_number() OVER w AS r FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)) WHERE r = 1 OR running <= 20000")
def budget_cut(spark, d):
    return windows.budget_cut(table(spark, d, "documents"), "n_chars", ["doc_id"], 20000, ["source"]).select("source", "doc_id", "running")


@query("SELECT p_partkey, p_name, n FROM (SELECT p_partkey, p_name, count(*) OVER (PARTITION BY p_name) AS n FROM part) WHERE n > 1")
def collision_names(spark, d):
    return windows.collisions(table(spark, d, "part").select("p_partkey", "p_name"), "p_name")


@query(f"WITH {NODES} SELECT id, length(label)::DOUBLE AS score FROM v_nodes ORDER BY score DESC, id LIMIT 40")
def topk_seeds(spark, d):
    return graph.frontier(nodes(spark, d).select("id", F.length("label").cast("double").alias("score")))


@query(f"{BOTH} SELECT source_id AS a, target_id AS b FROM v_edges UNION SELECT target_id, source_id FROM v_edges")
def adjacency_undirected(spark, d):
    return graph.adjacency(edges(spark, d))


@query(f"{BOTH} SELECT id FROM v_nodes WHERE community_id IS NULL")
def nodes_without_community(spark, d):
    n = nodes(spark, d)
    return joins.without(n, "id", n.where("community_id IS NOT NULL").select("id")).select("id")


@query("""WITH x AS (SELECT p_partkey, [p_type, p_brand, p_name] AS a, [p_name, p_type, p_size::VARCHAR] AS b FROM part),
  y AS (SELECT p_partkey, unnest(list_concat(a, b)) AS v, unnest(range(6)) AS i FROM x), z AS (SELECT p_partkey, v, min(i) AS i FROM y GROUP BY ALL) SELECT p_partkey, string_agg(v, '|' ORDER BY i) AS u FROM z GROUP BY 1""")
def ordered_union(spark, d):
    return table(spark, d, "part").select("p_partkey", joined(text.ordered_union(F.array("p_type", "p_brand", "p_name"), F.array("p_name", "p_type", F.col("p_size").cast("string")))).alias("u"))


# Graph.

SEED = "seed AS (SELECT id, (2 * contains(label, 'ring')::INT + ends_with(label, '7')::INT + contains(label, '1')::INT)::DOUBLE AS score FROM v_nodes WHERE contains(label, 'ring') OR ends_with(label, '7') OR contains(label, '1'))"


def _seeds(spark, d):
    c = lambda x: x.cast("int")
    label = F.col("label")
    s = nodes(spark, d).select("id", (2 * c(label.contains("ring")) + c(label.endswith("7")) + c(label.contains("1"))).cast("double").alias("score"))
    return s.where("score > 0")


HOP0 = f"{BOTH}, adj AS (SELECT source_id AS a, target_id AS b FROM v_edges UNION SELECT target_id, source_id FROM v_edges), {SEED}, f0 AS (SELECT id, score FROM seed ORDER BY score DESC, id LIMIT 40), h0 AS (SELECT b AS id, sum(score * 0.5) AS c, max(score) AS score FROM f0 JOIN adj ON id = a WHERE score * 0.5 >= 0.15 GROUP BY b)"


@query(f"{HOP0} SELECT id, round(sum(s), 6) AS score FROM (SELECT id, score AS s FROM seed UNION ALL SELECT id, c FROM h0) GROUP BY id")
def khop_expand_1(spark, d):
    return graph.expand(_seeds(spark, d), graph.both_ways(edges(spark, d)), 1).withColumn("score", F.round("score", 6))


@query(f"{HOP0}, h1 AS (SELECT b AS id, sum(score * 0.25) AS c FROM h0 JOIN adj ON id = a WHERE score * 0.25 >= 0.15 GROUP BY b) SELECT id, round(sum(s), 6) AS score FROM (SELECT id, score AS s FROM seed UNION ALL SELECT id, c FROM h0 UNION ALL SELECT id, c FROM h1) GROUP BY id")
def khop_expand_2(spark, d):
    return graph.expand(_seeds(spark, d), graph.both_ways(edges(spark, d)), 2).withColumn("score", F.round("score", 6))


@query("""WITH RECURSIVE a(id, ancestor, depth) AS (SELECT p_partkey, p_partkey // 2, 1 FROM part WHERE p_partkey > 0 UNION ALL SELECT id, ancestor // 2, depth + 1 FROM a WHERE ancestor > 0) SELECT id, ancestor, depth FROM a""")
def bfs_ancestors(spark, d):
    p = table(spark, d, "part").where("p_partkey > 0").select(F.col("p_partkey").alias("id"), F.floor(F.col("p_partkey") / 2).cast("long").alias("parent"), F.lit(0).alias("ord"))
    return graph.ancestors(p).select("id", "ancestor", "depth")


@query("""SELECT 'r' || r_regionkey AS id, '/' || lower(r_name) AS prefix FROM region UNION ALL SELECT 'n' || n_nationkey, '/' || lower(r_name) || '/at' || n_nationkey || '/' || lower(n_name) FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'c' || c_custkey, '/' || lower(r_name) || '/at' || n_nationkey || '/' || lower(n_name) || '/c' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def mount_prefixes(spark, d):
    r, n, c = (table(spark, d, t) for t in ("region", "nation", "customer"))
    slash = lambda x: F.concat(F.lit("/"), F.lower(x))
    routers = r.select(F.concat(F.lit("r"), "r_regionkey").alias("id"), slash(F.col("r_name")).alias("own")).union(n.select(F.concat(F.lit("n"), "n_nationkey"), slash(F.col("n_name")))).union(c.select(F.concat(F.lit("c"), "c_custkey"), F.lit("")))
    mounts = n.select(F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.concat(F.lit("n"), "n_nationkey").alias("child"), F.concat(F.lit("/at"), "n_nationkey").alias("prefix"), F.lit(1).alias("ord")).union(c.select(F.concat(F.lit("n"), "c_nationkey"), F.concat(F.lit("c"), "c_custkey"), F.concat(F.lit("/c"), "c_custkey"), F.lit(2)))
    return graph.mount_prefixes(routers, mounts, 4)


# Integrity checks.


def _defects(spark, d):
    """Entity relations with defects that follow from keys: dangling ids, empty names, repeats."""
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    sid = F.concat(F.lit("p"), k)
    symbols = p.select(sid.alias("id"), F.when(k % 11 == 0, "").otherwise(F.col("p_name")).alias("name"), F.when(k % 6 == 0, "import").otherwise("function").alias("kind"), F.concat(F.lit("f"), k % 40).alias("source_file"), F.when(k % 13 > 0, (k % 5).cast("int")).alias("start_line"), F.when(k % 7 > 0, F.concat(F.lit("m"), F.when(F.col("p_size") > 45, -k).otherwise(k))).alias("module_id"))
    modules = p.select(F.concat(F.lit("m"), k).alias("id"), F.array(sid, F.concat(F.lit("p"), k * 1000)).alias("symbol_ids"), F.when(k % 2 == 0, F.concat(F.lit("y"), k)).alias("summary_id"))
    summaries = p.where("p_size <= 30").select(F.concat(F.lit("y"), k).alias("id"), F.concat(F.lit("m"), _half("p_partkey")).alias("module_id"))
    concepts = p.where("p_size > 25").select(sid.alias("id"), F.col("p_name").alias("label"), F.when(k % 2 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("related_ids"))
    return nodes(spark, d), edges(spark, d), symbols, modules, summaries, concepts


@query(f"""WITH {NODES}, {EDGES}, sy AS (SELECT p_partkey AS k, 'p' || p_partkey AS id, CASE WHEN p_partkey % 11 = 0 THEN '' ELSE p_name END AS name, CASE WHEN p_partkey % 6 = 0 THEN 'import' ELSE 'function' END AS kind, 'f' || p_partkey % 40 AS f, CASE WHEN p_partkey % 13 > 0 THEN p_partkey % 5 END AS l, CASE WHEN p_partkey % 7 > 0 THEN 'm' || CASE WHEN p_size > 45 THEN -p_partkey ELSE p_partkey END END AS m FROM part),
mo AS (SELECT p_partkey AS k, 'm' || p_partkey AS id FROM part), su AS (SELECT 'y' || p_partkey AS id, 'm' || p_partkey // 2 AS m FROM part WHERE p_size <= 30), ms AS (SELECT 'p' || k AS s FROM mo UNION ALL SELECT 'p' || k * 1000 FROM mo),
co AS (SELECT p_partkey AS k, 'p' || p_partkey AS id, p_name AS label FROM part WHERE p_size > 25)
SELECT code, level, count(*)::BIGINT AS n FROM (
  SELECT 'GRAPH_DANGLING_EDGE' AS code, 'error' AS level FROM v_edges WHERE source_id NOT IN (SELECT id FROM v_nodes) OR target_id NOT IN (SELECT id FROM v_nodes)
  UNION ALL SELECT 'SYMBOL_NOT_NODE', 'error' FROM sy WHERE id NOT IN (SELECT id FROM v_nodes)
  UNION ALL SELECT 'SYMBOL_NO_NAME', 'warning' FROM sy WHERE name = ''
  UNION ALL SELECT 'SYMBOL_NO_START_LINE', 'warning' FROM sy WHERE kind = 'function' AND l IS NULL
  UNION ALL SELECT 'SYMBOL_NO_MODULE', 'warning' FROM sy WHERE kind = 'function' AND m IS NULL
  UNION ALL SELECT 'SYMBOL_BAD_MODULE', 'error' FROM sy WHERE m IS NOT NULL AND m NOT IN (SELECT id FROM mo)
  UNION ALL SELECT 'DUP_SYMBOL_DEF', 'error' FROM sy WHERE kind = 'function' AND l IS NOT NULL GROUP BY name, f, l HAVING count(*) > 1
  UNION ALL SELECT 'SYMBOL_REF', 'error' FROM ms WHERE s NOT IN (SELECT id FROM sy)
  UNION ALL SELECT 'MODULE_BAD_SUMMARY', 'error' FROM mo WHERE k % 2 = 0 AND 'y' || k NOT IN (SELECT id FROM su)
  UNION ALL SELECT 'DUP_SUMMARY', 'error' FROM su GROUP BY m HAVING count(*) > 1
  UNION ALL SELECT 'DUP_CONCEPT', 'error' FROM co GROUP BY lower(label) HAVING count(*) > 1
  UNION ALL SELECT 'ORPHAN_CONCEPT', 'warning' FROM co WHERE k % 2 = 1) GROUP BY ALL""")
def validate_counts(spark, d):
    n, e, symbols, modules, summaries, concepts = _defects(spark, d)
    none = spark.createDataFrame([], "id string")
    found = [
        checks.dangling(e, n), checks.symbols_known(symbols, n), checks.symbols_named(symbols), checks.symbols_placed(symbols), checks.symbols_in_modules(symbols, modules), checks.repeated_definitions(symbols),
        checks.references("SYMBOL", modules, "symbol_ids", symbols), checks.bad_summaries(modules, summaries), checks.repeated_summaries(summaries), checks.repeated_concepts(concepts), checks.orphan_concepts(concepts, none),
    ]
    return checks.union(found).groupBy("code", "level").agg(F.count("*").alias("n"))


# Source text.


@query("""WITH d AS (SELECT doc_id, regexp_replace(text, chr(10) || '$', '') AS t FROM documents WHERE text <> '') SELECT doc_id, (unnest(range(len(string_split(t, chr(10))))) + 1)::INTEGER AS line, unnest(string_split(t, chr(10))) AS text FROM d""")
def snippet_lines(spark, d):
    f = table(spark, d, "documents").select(F.col("doc_id").alias("path"), "text")
    return hybrid.file_lines(f).withColumnRenamed("path", "doc_id")


@query("""SELECT 'm' || s_suppkey AS id, '### Module: ' || s_name || CASE WHEN s_acctbal > 0 THEN chr(10) || '- Purpose: ' || s_name ELSE '' END || chr(10) || '- Responsibilities: a, ' || s_nationkey || chr(10) || '- Key symbols: g' AS block FROM supplier
UNION ALL SELECT 'p' || p_partkey, '### Concept: ' || p_name || CASE WHEN p_size > 25 THEN chr(10) || '- Rationale: ' || p_type ELSE '' END || chr(10) || '- Source: x.md' FROM part
UNION ALL SELECT 'c' || c_custkey, '### Symbol: ' || c_name || chr(10) || '- Signature: (a) -> b' || chr(10) || '- Location: ' || c_mktsegment || '.py:L' || c_nationkey || chr(10) || '- Doc: One.' FROM customer
UNION ALL SELECT 'n' || n_nationkey, '### Service: ' || n_name FROM nation""")
def render_blocks(spark, d):
    c, s, p = table(spark, d, "customer"), table(spark, d, "supplier"), table(spark, d, "part")
    catalog = {k: store.empty(spark, k) for k in RELATIONS}
    catalog["summaries"] = store.conform(s.select(F.concat(F.lit("m"), "s_suppkey").alias("module_id"), F.when(F.col("s_acctbal") > 0, F.col("s_name")).alias("purpose"), F.array(F.lit("a"), F.col("s_nationkey").cast("string")).alias("responsibilities"), F.array(F.lit("g")).alias("god_nodes")), "summaries")
    catalog["concepts"] = store.conform(p.select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.when(F.col("p_size") > 25, F.col("p_type")).alias("rationale"), F.lit("x.md").alias("source_file")), "concepts")
    catalog["symbols"] = store.conform(c.select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.lit("(a) -> b").alias("signature"), F.concat("c_mktsegment", F.lit(".py")).alias("source_file"), F.concat(F.lit("L"), "c_nationkey").alias("source_location"), F.lit("One.\nTwo.").alias("docstring")), "symbols")
    hit = lambda df, kind, letter, key, name: df.select(F.lit(kind).alias("kind"), F.concat(F.lit(letter), key).alias("id"), F.col(name).alias("name"))
    hits = hit(s, "module", "m", "s_suppkey", "s_name").unionByName(hit(p, "concept", "p", "p_partkey", "p_name")).unionByName(hit(c, "symbol", "c", "c_custkey", "c_name")).unionByName(hit(table(spark, d, "nation"), "service", "n", "n_nationkey", "n_name"))
    return render.blocks(hits, catalog).select("id", "block")


from . import more, sources  # noqa: E402,F401  they register their queries
