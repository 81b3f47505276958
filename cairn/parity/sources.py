"""Queries of the extractors, over source text that follows from part rows: each part has one of several shapes of a file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.extract import alembic, block_source, ddl, mounts, openapi, python_source
from cairn.extract.run import extract

from .queries import joined, query
from .views import table

#: (text of the file, rows that it gives); {k} stands for the key of the part.
Shapes = Sequence[tuple[str, Sequence[tuple]]]


def _files(spark, d, ending: str, shapes: Shapes) -> DataFrame:
    k = F.col("p_partkey")
    text = F.element_at(F.array(*[F.lit(t) for t, _ in shapes]), (k % len(shapes) + 1).cast("int"))
    return table(spark, d, "part").select(F.concat(F.lit("src/m"), k, F.lit(ending)).alias("path"), F.replace(text, F.lit("{k}"), k.cast("string")).alias("text"))


def _rows(columns: str, shapes: Shapes, ending: str, path: str | None = "source_file") -> str:
    """SQL of the rows of all files; text columns have {k} replaced."""

    def value(v) -> str:
        if isinstance(v, str):
            return "replace('" + v.replace("'", "''") + "', '{k}', p_partkey::VARCHAR)"
        return "NULL" if v is None else str(v)

    names = columns.split(", ")
    own = f"'src/m' || p_partkey || '{ending}' AS {path}, " if path else ""
    arms = [f"SELECT {own}{', '.join(f'{value(v)} AS {n}' for n, v in zip(names, row))} FROM part WHERE p_partkey % {len(shapes)} = {i}" for i, (_, rows) in enumerate(shapes) for row in rows]
    return " UNION ALL ".join(arms)


PY: Shapes = [
    ("class C(Base):\n    def _m(self, a: int) -> str:\n        return a\nasync def f():\n    return C()\n", [("class", "src.m{k}.C", 1, "(Base)", "public", None, False), ("method", "src.m{k}.C._m", 2, "(self, a: int) -> str", "protected", None, False), ("function", "src.m{k}.f", 4, "()", "public", None, True)]),
    ('def outer{k}(x, *, y=1):\n    """Says so."""\n    def inner():\n        pass\n    return inner\n', [("function", "src.m{k}.outer{k}", 1, "(x, *, y=1)", "public", "Says so.", False), ("function", "src.m{k}.outer{k}.inner", 3, "()", "public", None, False)]),
    ("@deco\nclass __P:\n    class Q:\n        @staticmethod\n        def s(*a, **k): ...\n", [("class", "src.m{k}.__P", 2, None, "private", None, False), ("class", "src.m{k}.__P.Q", 3, None, "public", None, False), ("method", "src.m{k}.__P.Q.s", 5, "(*a, **k)", "public", None, False)]),
    ("def broken(:\n", []),
    ("x = {k}\n\nif x:\n    def hidden():\n        pass\n\ndef shown(a) -> 'B': return a\n", [("function", "src.m{k}.shown", 7, "(a) -> 'B'", "public", None, False)]),
]


@query(_rows("kind, qualified_name, start_line, signature, visibility, docstring, is_async", PY, ".py"))
def py_definitions(spark, d):
    return extract(_files(spark, d, ".py", PY), python_source.definitions, python_source.DEFINITIONS).select("source_file", "kind", "qualified_name", "start_line", "signature", "visibility", "docstring", "is_async")


CALL: Shapes = [
    ("class C:\n    pass\n\ndef f(x: D):\n    c = C()\n    c.run()\n    x.p()\n", [("src.m{k}.f", "C", None, 5, False), ("src.m{k}.f", "run", "C", 6, True), ("src.m{k}.f", "p", "D", 7, True)]),
    ("class A:\n    def a(self):\n        self.b{k}()\n    def c(self, o: 'Optional[B]'):\n        o.d()\n", [("src.m{k}.A.a", "b{k}", "A", 3, True), ("src.m{k}.A.c", "d", "B", 5, True)]),
    ("import os\ndef g():\n    os.walk('.')\n    h(i(1))\n", [("src.m{k}.g", "walk", None, 3, True), ("src.m{k}.g", "h", None, 4, False), ("src.m{k}.g", "i", None, 4, False)]),
    ("def o():\n    def n():\n        q()\n    n()\n", [("src.m{k}.o", "n", None, 4, False), ("src.m{k}.o.n", "q", None, 3, False)]),
    ("print(1)\nx = [\n", []),
]


@query(_rows("caller, callee, receiver_class, line, is_attribute", CALL, ".py"))
def py_calls(spark, d):
    return extract(_files(spark, d, ".py", CALL), python_source.calls, python_source.CALLS).select("source_file", "caller", "callee", "receiver_class", "line", "is_attribute")


IMPORT: Shapes = [
    ("import os\nfrom .a import b\nfrom c.d import y as z\n", [("os", "os", None), ("b", "src.a", "b"), ("z", "c.d", "y")]),
    ("import a.b.c{k} as q\n", [("q", "a.b.c{k}", None)]),
    ("from . import x, y\n", [("x", "src", "x"), ("y", "src", "y")]),
    ("from e import (\n    f,\n    g as h,\n)\n", [("f", "e", "f"), ("h", "e", "g")]),
    ("x = 1\n", []),
]


@query(_rows("alias, module, name", IMPORT, ".py"))
def py_imports(spark, d):
    return extract(_files(spark, d, ".py", IMPORT), python_source.imports, python_source.IMPORTS).select("source_file", "alias", "module", "name")


DDL: Shapes = [
    ("-- made\nCREATE TABLE t{k} (id integer PRIMARY KEY, name varchar(9) NOT NULL, ref bigint REFERENCES other (id), UNIQUE (name, ref));\nINSERT INTO x VALUES (1);", [("table::src/m{k}.sql::t{k}", "t{k}", "id INTEGER pk|name VARCHAR(9)|ref BIGINT -> other", 1)]),
    ('CREATE TABLE IF NOT EXISTS "a" (x TEXT);\nCREATE TABLE b (y DATE, z INT, PRIMARY KEY (y, z));', [("table::src/m{k}.sql::a", "a", "x TEXT", 0), ("table::src/m{k}.sql::b", "b", "y DATE|z INT", 1)]),
    ("/* CREATE TABLE no (a int); */ select 'CREATE TABLE n2 (a int)';", []),
    ("CREATE TABLE c (d INT, FOREIGN KEY (d) REFERENCES e (f));", [("table::src/m{k}.sql::c", "c", "d INT", 1)]),
    ("create table g (h boolean default true, i int unique);", [("table::src/m{k}.sql::g", "g", "h BOOLEAN|i INT", 0)]),
]


@query(_rows("id, name, columns, constraints", DDL, ".sql", None).replace(" AS constraints", "::BIGINT AS constraints"))
def ddl_tables(spark, d):
    rows = extract(_files(spark, d, ".sql", DDL), ddl.tables, ddl.TABLES).where("kind = 'table'")
    shown = F.transform("columns", lambda c: F.concat(c["name"], F.lit(" "), c["data_type"], F.when(c["primary_key"], " pk").otherwise(""), F.coalesce(F.concat(F.lit(" -> "), c["references_table"]), F.lit(""))))
    return rows.select("id", "name", joined(shown).alias("columns"), F.size("constraints").cast("long").alias("constraints"))


API: Shapes = [
    ('{"swagger": "2.0", "basePath": "/v1/", "paths": {"/p{k}/{id}": {"parameters": [{"name": "id"}], "get": {"operationId": "one", "parameters": [{"name": "q"}]}, "post": {}}}}', [("GET", "/v1/p{k}/{id}", "one", "id|q", None), ("POST", "/v1/p{k}/{id}", None, "id", None)]),
    ('{"openapi": "3.0", "paths": {"/a": {"POST": {"requestBody": {"content": {"application/json": {"schema": {"type": "array", "items": {"$ref": "#/components/schemas/Item{k}"}}}}}}, "get": {"parameters": [{"$ref": "#/components/parameters/Page"}]}}}}', [("POST", "/a", None, "", "Item{k}[]"), ("GET", "/a", None, "Page", None)]),
    ('{"openapi": "3.1", "paths": {"/b": {"put": {"requestBody": {"content": {"x/y": {"schema": {"type": "array", "items": {"type": "string"}}}}}}, "summary": "no verb", "Delete": {"requestBody": {"$ref": "#/components/requestBodies/Body"}}}}}', [("PUT", "/b", None, "", "array"), ("DELETE", "/b", None, "", "Body")]),
    ('{"paths": {"/c": {"get": {}}}}', []),
    ('{"swagger": "2.0", "paths": {"/d": {"patch": {"parameters": [{"in": "body", "name": "body", "schema": {"$ref": "#/definitions/D"}}]}}}}', [("PATCH", "/d", None, "body", "D")]),
]


@query(_rows("method, path, operation_id, parameters, request_schema", API, ".json", "spec_file"))
def openapi_operations(spark, d):
    return extract(_files(spark, d, ".json", API), openapi.operations, openapi.OPERATIONS).select("spec_file", "method", "path", "operation_id", joined(F.col("parameters")).alias("parameters"), "request_schema")


HEAD = "from alembic import op\nimport sqlalchemy as sa\n"
MIGRATION: Shapes = [
    (HEAD + 'def upgrade():\n    op.create_table("t{k}", sa.Column("id", sa.Integer, primary_key=True))\n    op.drop_column("t{k}", "c")\ndef downgrade():\n    op.drop_table("x")\n', [("migration", "migration::src/m{k}.py", "m{k}.py", "create_table t{k}|drop_column t{k}", None), ("table", "table::src/m{k}.py::t{k}", "t{k}", None, "id Integer pk")]),
    (HEAD + "def upgrade():\n    op.add_column('a', sa.Column('b', sa.String(9)))\n", [("migration", "migration::src/m{k}.py", "m{k}.py", "add_column a", None)]),
    (HEAD + "op.rename_table('a', 'b')\n", [("migration", "migration::src/m{k}.py", "m{k}.py", "rename_table a", None)]),
    (HEAD + "def upgrade():\n    op.create_table('u', sa.Column('x', sa.String(length=4), nullable=False), sa.Column('y', sa.ForeignKey('t.id')), sa.PrimaryKeyConstraint('x'))\n", [("migration", "migration::src/m{k}.py", "m{k}.py", "create_table u", None), ("table", "table::src/m{k}.py::u", "u", None, "x String pk not null|y ForeignKey -> t.id")]),
    ("def upgrade():\n    pass\n", []),
]


@query(_rows("kind, id, name, operations, columns", MIGRATION, ".py", None))
def alembic_operations(spark, d):
    rows = extract(_files(spark, d, ".py", MIGRATION), alembic.migrations, alembic.MIGRATIONS)
    shown = F.transform("columns", lambda c: F.concat(c["name"], F.lit(" "), c["data_type"], F.when(c["primary_key"], " pk").otherwise(""), F.when(~c["nullable"], " not null").otherwise(""), F.coalesce(F.concat(F.lit(" -> "), c["references_table"], F.lit("."), c["references_column"]), F.lit(""))))
    return rows.select("kind", "id", "name", joined(F.col("operations")).alias("operations"), joined(shown).alias("columns"))


MOUNT: Shapes = [
    ('r = APIRouter(prefix="/x")\napp.include_router(r, prefix="/v1")\n', [("router", "r", None, "/x"), ("mount", "app", "r", "/v1")]),
    ("api{k} = APIRouter()\n", [("router", "api{k}", None, "")]),
    ("from a import b\nmain.include_router(b.router)\n", [("mount", "main", "b.router", "")]),
    ("x = 1\n", []),
    ("s = APIRouter(prefix='/s', tags=['t'])\ns.include_router(t)\n", [("router", "s", None, "/s"), ("mount", "s", "t", "")]),
]


@query(_rows("kind, router, child, prefix", MOUNT, ".py"))
def router_mounts(spark, d):
    return extract(_files(spark, d, ".py", MOUNT), mounts.mounts, mounts.MOUNTS).select("source_file", "kind", "router", "child", "prefix")


# Languages other than Python.

BLOCK = "kind, qualified_name, start_line, end_line, signature, docstring, decorators, is_static, visibility"


def _blocks(spark, d, ending: str, shapes: Shapes) -> DataFrame:
    rows = extract(_files(spark, d, ending, shapes), block_source.definitions, block_source.DEFINITIONS)
    return rows.select("source_file", "kind", "qualified_name", "start_line", "end_line", "signature", "docstring", joined(F.col("decorators")).alias("decorators"), "is_static", "visibility")


JAVA: Shapes = [
    ("package a.b{k};\n\n/** Keeps {k}. */\n@Service\npublic class S {\n  /** Finds. */\n  @Override\n  public static D find(String id, int depth) {\n    return null;\n  }\n  private void h() {}\n}\n", [("class", "a.b{k}.S", 5, 12, None, "Keeps {k}.", "Service", False, "public"), ("method", "a.b{k}.S.find", 8, 10, "(String id, int depth) -> D", "Finds.", "Override", True, "public"), ("method", "a.b{k}.S.h", 11, 11, "() -> void", None, "", False, "private")]),
    ("interface I extends J {\n  List<String> all(int n);\n  // no doc\n  default int one() { return 1; }\n}\n", [("interface", "src.m{k}.I", 1, 5, None, None, "", False, "public"), ("method", "src.m{k}.I.all", 2, 2, "(int n) -> List<String>", None, "", False, "public"), ("method", "src.m{k}.I.one", 4, 4, "() -> int", None, "", False, "public")]),
    ("package p;\nenum E {\n  A(1), B(2);\n  E(int x) { this.x = x; }\n}\n", [("enum", "p.E", 2, 5, None, None, "", False, "public"), ("method", "p.E.E", 4, 4, "(int x)", None, "", False, "public")]),
    ("package p;\nrecord P{k}(int x, int y) {\n  int sum() { if (x > 0) { return x + y; } return \"}\".length(); }\n}\n", [("class", "p.P{k}", 2, 4, "(int x, int y)", None, "", False, "public"), ("method", "p.P{k}.sum", 3, 3, "() -> int", None, "", False, "public")]),
    ("public class {{{ broken", []),
]


@query(_rows(BLOCK, JAVA, ".java"))
def java_definitions(spark, d):
    return _blocks(spark, d, ".java", JAVA)


GO: Shapes = [
    ("package main\n\n// Upload{k} sends.\nfunc Upload{k}(b []byte) error {\n\treturn nil\n}\n", [("function", "src.m{k}.Upload{k}", 4, 6, "(b []byte)", "Upload{k} sends.", "", False, "public")]),
    ("package m\n\ntype T struct {\n\ta int\n}\n\nfunc (t *T) Get(a, b int) (int, error) {\n\tif x := f(func() { return }); x {\n\t}\n\treturn 1, nil\n}\n", [("type", "src.m{k}.T", 3, 5, None, None, "", False, "public"), ("method", "src.m{k}.Get", 7, 11, "(a, b int)", None, "", False, "public")]),
    ("package m\n\nvar x = `func no() {`\n", []),
    ("package m\n\n/* block */\nfunc A() {}\n\nfunc _b() {}\n", [("function", "src.m{k}.A", 4, 4, "()", None, "", False, "public"), ("function", "src.m{k}._b", 6, 6, "()", None, "", False, "private")]),
    ("package m\n\n// Map maps.\nfunc Map[K comparable](m map[K]int) map[K]int {\n\treturn m\n}\n", [("function", "src.m{k}.Map", 4, 6, "(m map[K]int)", "Map maps.", "", False, "public")]),
]


@query(_rows(BLOCK, GO, ".go"))
def go_definitions(spark, d):
    return _blocks(spark, d, ".go", GO)


TS: Shapes = [
    ("/** Renders {k}. */\nexport class View {\n  /** Loads it. */\n  async load(id: string): Promise<void> {}\n  static of(a: {b: number}) { if (a) { go(); } }\n}\n", [("class", "src.m{k}.View", 2, 6, None, "Renders {k}.", "", False, "public"), ("method", "src.m{k}.View.load", 4, 4, "(id: string) -> Promise<void>", "Loads it.", "", False, "public"), ("method", "src.m{k}.View.of", 5, 5, "(a: {b: number})", None, "", True, "public")]),
    ("export default function top(a) {\n  function inner(b) {}\n}\n", [("function", "src.m{k}.top", 1, 3, "(a)", None, "", False, "public"), ("function", "src.m{k}.inner", 2, 2, "(b)", None, "", False, "public")]),
    ("export interface I extends J {\n  a(): void\n}\n", [("interface", "src.m{k}.I", 1, 3, None, None, "", False, "public")]),
    ("const f = (x) => { return `${x} {`; };\n", []),
    ("class A<T> extends B {\n  private x = 1\n  constructor(y: T) { super(y); }\n  private get z(): number { return 1 }\n}\n", [("class", "src.m{k}.A", 1, 5, None, None, "", False, "public"), ("method", "src.m{k}.A.constructor", 3, 3, "(y: T)", None, "", False, "public"), ("method", "src.m{k}.A.z", 4, 4, "() -> number", None, "", False, "private")]),
]


@query(_rows(BLOCK, TS, ".ts"))
def ts_definitions(spark, d):
    return _blocks(spark, d, ".ts", TS)


OTHERS: dict[str, Shapes] = {
    ".rs": [("/// Adds.\npub fn add(a: i32) -> i32 { a }\nimpl P {\n  fn new() -> Self { P { x: 1 } }\n}\n", [("function", "src.m{k}.add", 2, 2, "(a: i32) -> i32", "Adds.", "", False, "public"), ("impl", "src.m{k}.P", 3, 5, None, None, "", False, "public"), ("function", "src.m{k}.new", 4, 4, "() -> Self", None, "", False, "public")])],
    ".cs": [("namespace A.B {\n /// <summary>X</summary>\n public class C : D {\n  private static int Run(int a) { return 1; }\n  public int X { get; set; }\n }\n}\n", [("class", "A.B.C", 3, 6, None, "<summary>X</summary>", "", False, "public"), ("method", "A.B.C.Run", 4, 4, "(int a) -> int", None, "", True, "private")])],
    ".php": [("<?php\n/** Doc. */\nfinal class A extends B {\n  public static function f(int $a = 1): ?string { return 'x{'; }\n}\nfunction h($x) { }\n", [("class", "src.m{k}.A", 3, 5, None, "Doc.", "", False, "public"), ("method", "src.m{k}.A.f", 4, 4, "(int $a = 1) -> ?string", None, "", True, "public"), ("function", "src.m{k}.h", 6, 6, "($x)", None, "", False, "public")])],
    ".kt": [("package a.b\n\n/** K */\ndata class K(val a: Int)\n\nclass L {\n  private fun f(x: Int): String {\n    return \"\"\n  }\n  fun g() = 1\n}\n", [("class", "a.b.K", 4, 4, None, "K", "", False, "public"), ("class", "a.b.L", 6, 11, None, None, "", False, "public"), ("method", "a.b.L.f", 7, 9, "(x: Int) -> String", None, "", False, "private"), ("method", "a.b.L.g", 10, 10, "()", None, "", False, "public")])],
    ".rb": [("# Doc {k}\nclass A < B\n  def go(a, b = 1)\n    list.each do |x|\n      y if x\n    end\n  end\nend\nmodule M\nend\n", [("class", "src.m{k}.A", 2, 8, None, "Doc {k}", "", False, "public"), ("method", "src.m{k}.A.go", 3, 7, "(a, b = 1)", None, "", False, "public"), ("module", "src.m{k}.M", 9, 10, None, None, "", False, "public")])],
    ".jsx": [("class W {\n  render() { return 1; }\n}\nfunction App(p) { return <W/>; }\n", [("class", "src.m{k}.W", 1, 3, None, None, "", False, "public"), ("method", "src.m{k}.W.render", 2, 2, "()", None, "", False, "public"), ("function", "src.m{k}.App", 4, 4, "(p)", None, "", False, "public")])],
}


@query(" UNION ALL ".join(_rows(BLOCK, shapes, ending) for ending, shapes in OTHERS.items()))
def other_definitions(spark, d):
    out = None
    for ending, shapes in OTHERS.items():
        rows = _blocks(spark, d, ending, shapes)
        out = rows if out is None else out.unionByName(rows)
    return out
