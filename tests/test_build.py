"""A small repository, built, stored, asked."""

import json

import pytest

from cairn import catalog as store
from cairn.kb import KnowledgeBase
from cairn.plans.build import build
from cairn.plans.config import Config

FILES = {
    "app/services/billing_service.py": '''"""Billing."""
from app.models.invoice import Invoice


class Base:
    def save(self):
        return 1


class BillingService(Base):
    """Charges invoices."""

    def __init__(self, store: Base):
        self.store = store

    async def charge(self, invoice: Invoice) -> Invoice:
        """Charge one invoice.

        More."""
        self.store.save()
        self.save()
        invoice.total()
        return helper(invoice)


def helper(x):
    unknown.save()
    return x
''',
    "app/models/invoice.py": '''class Invoice:
    @staticmethod
    def _parse(x): return x
    def total(self): return 0
''',
    "app/api/invoices.py": '''from fastapi import APIRouter
router = APIRouter(prefix="/invoices")

@router.get("/{invoice_id}")
def read_invoice(invoice_id): ...

@router.post("/")
def create_invoice(): ...
''',
    "app/main.py": '''from fastapi import FastAPI
from app.api import invoices
app = FastAPI()
app.include_router(invoices.router, prefix="/v1")
''',
    "broken.py": "def (",
    "src/Ledger.java": "package shop;\n/** Keeps sums. */\npublic class Ledger {\n  public long sum(long[] xs) { return 0; }\n}\n",
    "cmd/tool.py": "import json\n\n\ndef dumps(x):\n    return x\n\n\ndef run(store):\n    store.dumps(1)\n    json.dumps(2)\n",
    "node_modules/x.py": "def ignored(): pass",
    "openapi.json": json.dumps({"openapi": "3.0.0", "paths": {"/v1/invoices/{id}": {"get": {"operationId": "get_one", "parameters": [{"name": "id"}], "responses": {"200": {}}}}, "/v1/invoices": {"post": {"requestBody": {"content": {"application/json": {"schema": {"type": "array", "items": {"$ref": "#/c/Invoice"}}}}}}}}}),
    "db/migration/V1__init.sql": 'CREATE TABLE IF NOT EXISTS shop.customer (id SERIAL PRIMARY KEY, name VARCHAR(20) NOT NULL DEFAULT \'x\', CONSTRAINT u UNIQUE (name));\n-- x\nCREATE TABLE "order" (id INT, customer_id INT REFERENCES customer(id), FOREIGN KEY (customer_id) REFERENCES customer (id), CHECK (id > 0));\nCREATE UNIQUE INDEX ix ON customer (name);\nDROP TABLE x;',
    "alembic/versions/a1.py": '''from alembic import op
import sqlalchemy as sa
def upgrade():
    op.create_table("item", sa.Column("id", sa.Integer(), primary_key=True), sa.Column("c", sa.Integer, sa.ForeignKey("customer.id"), nullable=False), sa.UniqueConstraint("c"))
    op.add_column("item", sa.Column("n", sa.String(3)))
def downgrade():
    op.drop_table("item")
''',
    "requirements.txt": "psycopg2\nalembic\n",
}


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    repo = tmp_path_factory.mktemp("repo")
    for name, text in FILES.items():
        p = repo / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    out = str(tmp_path_factory.mktemp("kb") / "kb")
    catalog, said = build(spark, Config(str(repo), output=out))
    return str(repo), out, catalog, said


def rows(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


def test_symbols_take_their_definitions(built):
    s = {r["qualified_name"]: r for r in built[2]["symbols"].where("qualified_name IS NOT NULL").collect()}
    charge = s["app.services.billing_service.BillingService.charge"]
    assert charge["kind"] == "method" and charge["is_async"] and charge["signature"].endswith("-> Invoice") and charge["docstring"].startswith("Charge one invoice.")
    parse = s["app.models.invoice.Invoice._parse"]
    assert parse["is_static"] and parse["visibility"] == "protected" and parse["decorators"] == ["staticmethod"]
    assert not [q for q in s if "ignored" in q]


def test_calls_are_resolved_by_class_ancestors_and_file(built):
    e = rows(built[2]["relationships"].where("relation = 'calls'"), "source_id", "target_id")
    f = "app/services/billing_service.py::app.services.billing_service"
    assert e == {(f"{f}.BillingService.charge", f"{f}.Base.save"), (f"{f}.BillingService.charge", "app/models/invoice.py::app.models.invoice.Invoice.total"), (f"{f}.BillingService.charge", f"{f}.helper"), ("cmd/tool.py::cmd.tool.run", "cmd/tool.py::cmd.tool.dumps")}
    assert built[3].stats["calls"] == {"added": 4, "callers": 2} and sum(built[3].stats["modules"].values()) == built[2]["modules"].count()


def test_other_languages_give_symbols(built):
    s = {r["qualified_name"]: r for r in built[2]["symbols"].where("language = 'java'").collect()}
    assert s["shop.Ledger"]["docstring"] == "Keeps sums." and s["shop.Ledger.sum"]["signature"] == "(long[] xs) -> long"


def test_contracts_are_bound_through_mounts(built):
    a = {(r["method"], r["path"]): r for r in built[2]["apis"].where("origin = 'openapi'").collect()}
    assert a[("GET", "/v1/invoices/{id}")]["handler_symbol_id"].endswith("read_invoice")
    assert a[("POST", "/v1/invoices")]["request_schema"] == "Invoice[]"


def test_database_layer(built):
    t = {r["name"]: r for r in built[2]["db_tables"].collect()}
    c = {x["name"]: x for x in t["customer"]["columns"]}
    assert t["customer"]["schema_name"] == "shop" and c["id"]["primary_key"] and c["id"]["data_type"] == "SERIAL" and c["name"]["nullable"] is False and c["name"]["default"] == "'x'"
    assert [i["name"] for i in t["customer"]["indexes"]] == ["ix"] and t["customer"]["technology"] == "flyway"
    assert {k["kind"] for k in t["order"]["constraints"]} == {"foreign_key", "check"}
    item = {x["name"]: x for x in t["item"]["columns"]}
    assert item["c"]["unique"] and item["c"]["references_table"] == "customer" and item["id"]["nullable"] is None and item["id"]["data_type"] == "Integer"
    m = {r["name"]: r["operations"] for r in built[2]["db_migrations"].collect()}
    assert m["a1.py"] == ["create_table item", "add_column item"] and m["V1__init.sql"] == ["create_table customer", "create_table order"]
    found = {r["id"]: r["confidence"] for r in built[2]["db_technologies"].collect()}
    assert found["alembic"] == found["postgres"] == found["flyway"] == "EXTRACTED"


def test_components_modules_and_validation(built, spark):
    c = built[2]
    assert ("BillingService",) in rows(c["services"], "name")
    names = [r[0] for r in c["modules"].select("name").collect()]
    assert len(names) == len(set(names)) and names
    assert not [x for x in built[3].rows if x[0] == "error"], built[3].rows
    assert store.counts(c).where("relation = 'symbols'").first()["n"] == c["symbols"].count()


def test_questions(built, spark):
    kb = KnowledgeBase(spark, built[1])
    top = kb.query("charging invoices billing").first()
    assert "Billing" in top["name"] or "charge" in top["name"]
    assert kb.query("").count() == 0 and kb.table("CUSTOMER")["name"] == "customer"
    got = kb.hybrid("how does billing charge an invoice", built[0])
    assert "## Exact code" in got["text"] and got["tokens"] > 0 and "async def charge" in got["text"]
    assert kb.stats()["counts"]["db_tables"] == 3
    assert store.export_sqlite(kb.catalog, built[1] + ".db").endswith(".db")


def test_a_failing_database_layer_is_a_warning(built, spark):
    from cairn.plans.build import PASSES

    def fail(c, spark, config):
        raise RuntimeError("no such luck")

    passes = [(n, fail if n == "database" else f) for n, f in PASSES]
    catalog, said = build(spark, Config(built[0]), passes=passes)
    assert ("warning", "database", "left out: no such luck") in said.rows and catalog["db_tables"].count() == 0 and catalog["symbols"].count() > 0


def test_graphs_come_from_a_command_once(spark, tmp_path):
    from cairn.sources import graph_build
    from cairn.sources.graph_json import LoadError

    repo, workspace, source = tmp_path / "repo", tmp_path / "work", tmp_path / "made"
    repo.mkdir()
    (repo / "a.py").write_text("def f(): pass\n")
    graph = json.dumps({"nodes": [{"id": "a", "label": "f()", "source_file": "a.py", "source_location": "L1", "file_type": "code"}], "links": []})
    (repo / "make.sh").write_text(f"mkdir -p {source}; echo '{graph}' > {source}/graph.json; echo '{{\"gods\": [\"a\"], \"surprises\": [\"odd\"]}}' > {source}/.x_analysis.json; echo x >> {tmp_path}/runs")
    with pytest.raises(LoadError):
        graph_build.ensure_graph(str(repo), str(workspace), str(source))
    command = ["sh", "{repo}/make.sh"]
    done = graph_build.ensure_graph(str(repo), str(workspace), str(source), command)
    assert done["ran_command"] and done["imported"] == [".x_analysis.json", "graph.json"] and not source.exists()
    assert graph_build.ensure_graph(str(repo), str(workspace), str(source), command)["cached"]
    assert graph_build.ensure_graph(str(repo), str(workspace), str(source), command, rebuild=True)["ran_command"]
    assert (tmp_path / "runs").read_text() == "x\nx\n"
    out = str(tmp_path / "kb")
    catalog, said = build(spark, Config(str(repo), output=out, workspace=str(workspace), agents_doc=True))
    assert said.stats["graph"]["cached"] and [r["god_nodes"] for r in catalog["summaries"].collect()] == [["f()"]]
    assert {tuple(r) for r in KnowledgeBase(spark, out).insights().collect()} == {("god", "a"), ("surprise", "odd")}
    assert "cairn.cli" in (repo / "AGENTS.md").read_text()


def test_managed_blocks_are_replaced_in_place(tmp_path):
    from cairn.sinks import agents_doc

    path = tmp_path / "AGENTS.md"
    assert agents_doc.upsert(path, agents_doc.block("kb")) == "created"
    path.write_text("before\n" + path.read_text() + "after\n")
    assert agents_doc.upsert(path, agents_doc.block("other")) == "updated"
    text = path.read_text()
    assert text.startswith("before\n") and text.endswith("after\n") and text.count(agents_doc.BEGIN) == 1 and "`other`" in text and "`kb`" not in text
    path.write_text("plain")
    assert agents_doc.upsert(path, "x") == "updated" and path.read_text() == "plain\n\nx\n"


def test_command_line_shows_few_symbols_in_full(built, spark, capsys):
    from cairn import cli

    assert cli.main(["symbols", "-k", built[1], "charge"]) == 0
    assert "signature: " in capsys.readouterr().out
    assert cli.main(["stats", "-k", built[1]]) == 0
    assert json.loads(capsys.readouterr().out)["dialect"] == "postgres"
