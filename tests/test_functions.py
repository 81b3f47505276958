"""Scalar functions and operators on small, odd inputs."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairn.functions import coerce, paths, routes, text
from cairn.operators import aggs, graph, joins, windows
from cairn.plans import registry
from cairn.search.hybrid import file_lines
from cairn.sources import graph_json


def column(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[1] for r in rows.select("i", f(F.col("v"))).orderBy("i").collect()]


def test_stems(spark):
    words = {"chunked": "chunk", "chunking": "chunk", "embedded": "embed", "embedding": "embed", "embed": "embed", "class": "class", "status": "status", "queries": "query", "process": "process", "works": "work", "runs": "runs", "installing": "install", "passed": "pass", "ions": "ions", "sections": "sect", "": ""}
    assert column(spark, list(words), text.stem) == list(words.values())


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="abcdeinosy", min_size=1, max_size=12), min_size=40, max_size=40))
def test_stems_keep_a_root(spark, words):
    for word, root in zip(words, column(spark, words, text.stem)):
        assert 1 <= len(root) <= len(word) and (len(word) > 4 or root == word)


def test_question_words(spark):
    assert text.question_stems(spark, "How does the Chunking of files work?") == ["chunk", "file"]
    assert text.question_stems(spark, "what is it") == [] and text.asks_for_tests(text.question_stems(spark, "show the test fixture"))


def test_nearest_equals_all_pairs(spark):
    import random

    rng = random.Random(5)
    left = [(i, rng.choice("ab"), rng.choice([None, *range(30)])) for i in range(60)] + [(60, "only", 1)]
    right = [(i, rng.choice("abc"), rng.choice([None, *range(0, 30, 3)])) for i in range(40)]
    df = lambda rows: spark.createDataFrame(rows, "i int, k string, t int")
    got = {r["i"]: (r["j"], r["distance"]) for r in joins.nearest(df(left), df(right).withColumnRenamed("i", "j"), ["k"], "t", "i", "j").collect()}
    want = {}
    for i, k, t in left:
        near = [(abs(u - t), u, j) for j, m, u in right if m == k and u is not None and t is not None]
        if near:
            want[i] = (min(near)[2], min(near)[0])
    assert got == want and len(want) > 40


@pytest.mark.parametrize(
    ("f", "cases"),
    [
        (paths.package_key, {"a/b/c.py": "a/b", "c.py": "<root>", None: "<root>", "": "<root>"}),
        (paths.capability, {"app/services/billing/x.py": "billing", "src/user_service.py": "user", "routes.py": "routes", None: None, "app/api/service.py": "service"}),
        (paths.title_case, {"user_profile-v2.x": "UserProfileV2X", "": "", "aB": "AB"}),
        (paths.language, {"a.py": "python", "a.TSX": "typescript", "Makefile": None, "a.b.rs": "rust", ".py": None}),
        (paths.clean_name, {"Foo.bar(x)": "bar", ".hidden()": "hidden", "a/b/c.py": "c", "Plain": "Plain"}),
        (paths.baseline_kind, {"a/b.py": "file", "run()": "function", "Invoice": "class", "thing": None}),
        (paths.is_test_file, {"a/tests/x.py": True, "a/test_x.py": True, "a/x_test.py": True, "a/contest.py": False}),
        (paths.module_dotted, {"a/b.py": "a.b", "a/__init__.py": "a"}),
        (paths.slug, {"App/Core!": "app_core", "--": "root"}),
        (routes.normalize_path, {"/A/{id}/": "/a/{}", "a/<int:x>/b": "/a/{}/b", "/:id": "/{}", "": "/"}),
        (routes.decorator_path, {'@r.get("/x", summary="y")': "/x", "r.post()": "/", '@r.get(summary="/y")': "/", "@cached": None}),
        (routes.return_type, {"(x) -> Optional[Foo]": "Foo", "() -> list[Foo | Bar]": "Foo", "()": None, "() -> 'Foo'": "Foo", "() -> None": None}),
        (coerce.visibility, {"__init__": "public", "__x": "private", "_x": "protected", "x": "public"}),
    ],
)
def test_scalars(spark, f, cases):
    assert column(spark, list(cases), f) == list(cases.values())


def test_line_ranges(spark):
    lo, hi = paths.line_range(F.col("v"))
    rows = spark.createDataFrame([("L3-L9",), ("12",), ("at L4 - 6",), ("none",), (None,)], "v string").select(lo, hi).collect()
    assert [tuple(r) for r in rows] == [(3, 9), (12, None), (4, 6), (None, None), (None, None)]


def test_file_type_of_unknown_value_is_an_error(spark):
    with pytest.raises(Exception, match="unknown file type"):
        column(spark, ["nonsense"], coerce.file_type)


def test_definitions_match_by_name_then_line(spark):
    s = spark.createDataFrame([("a", "f", "x", 5), ("b", "f", "x", None), ("c", "f", "y", 1), ("d", "f", "z", 7), ("e", "f", "x", 6)], "id string, source_file string, name string, start_line int")
    d = spark.createDataFrame([(0, "f", "x", 4), (1, "f", "x", 8), (2, "f", "y", 99), (3, "f", "q", 7)], "ord int, source_file string, name string, start_line int")
    assert {(r[0], r[1]) for r in joins.match_definitions(s, d).collect()} == {("a", 0), ("c", 2), ("d", 3), ("e", 0)}


def test_ancestors_end_on_cycles(spark):
    p = spark.createDataFrame([("a", "b", 0), ("b", "c", 0), ("c", "a", 0), ("a", "d", 1)], "id string, parent string, ord int")
    got = {(r["id"], r["ancestor"]): r["depth"] for r in graph.ancestors(p).collect()}
    assert got[("a", "b")] == 1 and got[("a", "c")] == 2 and got[("b", "d")] == 3


def test_mounts_of_cycles_keep_their_own_prefix(spark):
    r = spark.createDataFrame([("root", ""), ("a", "/a"), ("x", "/x"), ("y", "/y")], "id string, own string")
    m = spark.createDataFrame([("root", "a", "/old", 0), ("root", "a", "/v1", 1), ("x", "y", "/1", 2), ("y", "x", "/2", 3)], "parent string, child string, prefix string, ord int")
    assert {x["id"]: x["prefix"] for x in graph.mount_prefixes(r, m).collect()} == {"root": "", "a": "/v1/a", "x": "/x", "y": "/y"}


def test_names_are_widened_until_distinct(spark):
    m = spark.createDataFrame([("1", "Core", ["app/core/x.py"], ["Run"]), ("2", "Core", ["app/core/y.py"], ["Stop"]), ("3", "Core", None, None), ("4", "Free", [], [])], "id string, name string, source_paths array<string>, candidates array<string>")
    names = [r["name"] for r in windows.widen_names(m).collect()]
    assert len(set(names)) == 4 and "Free" in names and "App Core" in names


def test_budget_keeps_the_first(spark):
    rows = spark.createDataFrame([(1, 50), (2, 10), (3, 10)], "i int, cost int")
    assert [r["i"] for r in windows.budget_cut(rows, "cost", ["i"], 20).collect()] == [1]


def test_concepts_merge_by_label(spark):
    c = spark.createDataFrame([("b", " Big  Idea", None, ["x", "a"]), ("a", "big idea", "why", ["y", "b"]), ("c", "other", None, [])], "id string, label string, rationale string, related_ids array<string>")
    kept, canonical = aggs.dedup_concepts(c)
    assert {r["id"]: r["related_ids"] for r in kept.collect()} == {"a": ["x", "y"], "c": []}
    assert {r["id"]: r["keeper"] for r in canonical.collect()} == {"a": "a", "b": "a", "c": "c"}


def test_lines_of_files(spark):
    f = spark.createDataFrame([("a", "1\r\n2\n\n4\n"), ("b", ""), ("c", "x")], "path string, text string")
    assert sorted((r["path"], r["line"], r["text"]) for r in file_lines(f).collect()) == [("a", 1, "1"), ("a", 2, "2"), ("a", 3, ""), ("a", 4, "4"), ("c", 1, "x")]


def test_dialects(spark):
    of = lambda *rows: [r[0] for r in registry.dialect(spark.createDataFrame(rows, "id string, confidence string")).collect()]
    assert of(("mysql", "INFERRED"), ("sqlite", "EXTRACTED"), ("postgres", "EXTRACTED")) == ["postgres"] and of(("alembic", "EXTRACTED")) == []


def test_broken_sources_of_other_languages_never_raise():
    from cairn.extract.block_source import LANGUAGES, definitions

    for language in LANGUAGES:
        for odd in ("", "{", "}", "((((", "/*", '"', "class", "class {{{ broken", "function f(", "def", "end end", "\n" * 500, "}{" * 500, "class A {" * 300, "é" * 50 + "{"):
            assert isinstance(list(definitions(f"a{language.suffixes[0]}", odd)), list)
    assert list(definitions("a.unknown", "class A {}")) == []


def test_graph_files(spark, tmp_path):
    import json

    graph = {
        "nodes": [{"id": "a", "label": "", "community": 1}, {"id": "b", "file_type": "concept", "source_file": "x.py"}, {"label": "no id"}, "odd", {"id": 4, "label": ["x"]}],
        "links": [{"source": "a", "target": "b", "relation": "uses", "weight": "n/a", "confidence": "odd"}, {"source": "a", "relation": "uses"}, {"source": "a", "target": "b", "relation": "uses"}, 7, ["x"], None],
        "graph": {"hyperedges": [{"nodes": []}, {"nodes": ["a", "b"]}, {"id": "h", "members": ["b"], "relation": "form"}]},
    }
    (tmp_path / "graph.json").write_text(json.dumps(graph))
    g = graph_json.read_graph(spark, str(tmp_path))
    n = graph_json.nodes(g)
    assert {(r["id"], r["label"], r["file_type"], r["community_id"]) for r in n.collect()} == {("a", "a", "code", "1"), ("b", "b", "concept", None), ("4", '["x"]', "code", None)}
    e = graph_json.edges(g).collect()
    assert [(r["id"], r["weight"], r["confidence"]) for r in e] == [("a--uses-->b", 1.0, "EXTRACTED")]
    assert [(r["id"], r["relation"]) for r in graph_json.hyperedges(g).orderBy("id").collect()] == [("h", "form"), ("hyperedge_0", "participate_in")]
    rows, members = graph_json.communities(spark, str(tmp_path), n)
    assert [(r["community_id"], r["label"]) for r in rows.collect()] == [("1", "Community 1")] and members.count() == 1
    (tmp_path / ".x_analysis.json").write_text(json.dumps({"communities": {"7": ["b", "a"]}, "cohesion": {"7": 0.1}, "gods": ["a"], "questions": ["why?"]}))
    rows, members = graph_json.communities(spark, str(tmp_path), n)
    assert rows.first()["cohesion"] == 0.1 and [r["id"] for r in members.orderBy("pos").collect()] == ["b", "a"]
    assert {tuple(r) for r in graph_json.insights(spark, str(tmp_path)).collect()} == {("question", "why?"), ("god", "a")}
