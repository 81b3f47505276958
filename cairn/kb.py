"""The knowledge base: a stored catalog and the questions that it answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn import catalog as store
from cairn.functions.paths import ascii_lower
from cairn.operators import aggs, checks
from cairn.plans import registry
from cairn.schemas import SCHEMA_VERSION
from cairn.search import hybrid, index, render
from cairn.operators.graph import adjacency
from cairn.search.tokens import count_tokens, tokenizer_name
from cairn.session import cut_lineage
from cairn.sources.files import repo_files

COVERED = ["start_line", "end_line", "signature", "docstring", "qualified_name", "visibility"]


class KnowledgeBase:
    """Opens a folder that the build wrote. Lookups return a Row or None, listings DataFrames."""

    def __init__(self, spark: SparkSession, folder: str | None = None, catalog: store.Catalog | None = None):
        self.spark, self.folder = spark, folder
        self.catalog = catalog if catalog is not None else store.read(spark, folder)
        self._index: DataFrame | None = None
        self._graph: tuple[DataFrame, DataFrame] | None = None

    def __enter__(self) -> "KnowledgeBase":
        return self

    def __exit__(self, *_: object) -> None:
        for kept in (self._index, *(self._graph or ())):
            if kept is not None:
                kept.unpersist()

    @property
    def index(self) -> DataFrame:
        if self._index is None:
            self._index = index.build_index(self.catalog).persist()
        return self._index

    @property
    def graph(self) -> tuple[DataFrame, DataFrame]:
        """(tokens of nodes, neighbours), made once for all questions."""
        if self._graph is None:
            c = self.catalog
            self._graph = hybrid.node_tokens(c["graph_nodes"], c["symbols"]).persist(), adjacency(c["relationships"]).persist()
        return self._graph

    def _by(self, relation: str, column: str, value: str):
        """A point lookup that folds ASCII letters, then one on trimmed lower-case text; the least id of several."""
        rows = self.catalog[relation]
        same = rows.where((ascii_lower(F.col(column)) == ascii_lower(F.lit(value))) | (F.lower(F.trim(column)) == F.lower(F.trim(F.lit(value)))))
        return same.orderBy("id").limit(1).first()

    def module(self, name: str):
        return self._by("modules", "name", name)

    def service(self, name: str):
        return self._by("services", "name", name)

    def workflow(self, name: str):
        return self._by("workflows", "name", name)

    def concept(self, name: str):
        return self._by("concepts", "label", name)

    def table(self, name: str):
        return self._by("db_tables", "name", name)

    def summary(self, module_id: str):
        return self.catalog["summaries"].where(F.col("module_id") == module_id).limit(1).first()

    def technologies(self) -> DataFrame:
        return self.catalog["db_technologies"].orderBy("category", "id")

    def tables(self) -> DataFrame:
        return self.catalog["db_tables"].orderBy("name", "id")

    def migrations(self) -> DataFrame:
        return self.catalog["db_migrations"].orderBy("id")

    def dialect(self) -> str | None:
        """The SQL dialect of the repository, if a technology tells it."""
        row = registry.dialect(self.catalog["db_technologies"]).first()
        return row["dialect"] if row else None

    def insights(self) -> DataFrame:
        """(kind, text): surprises, questions and central nodes that came with the graph."""
        if self.folder is None:
            return self.spark.createDataFrame([], "kind string, text string")
        return self.spark.read.schema("kind string, text string").parquet(f"{self.folder}/insights")

    def apis(self, with_controllers: bool = False) -> DataFrame:
        rows = self.catalog["apis"]
        if with_controllers:
            names = self.catalog["controllers"].select(F.col("id").alias("controller_id"), F.col("name").alias("controller"))
            rows = rows.join(names, "controller_id", "left")
        return rows.orderBy(F.coalesce(F.nullif("path", F.lit("")), "name", F.lit("")), F.coalesce("method", F.lit("")), "id")

    def symbols(self, name: str | None = None, kind: str | None = None, limit: int = 25) -> DataFrame:
        rows = self.catalog["symbols"]
        if name:
            rows = rows.where(F.contains(F.lower("name"), F.lit(name.lower())))
        if kind:
            rows = rows.where(F.col("kind") == kind)
        return rows.orderBy(F.coalesce("source_file", F.lit("")), F.coalesce("start_line", F.lit(0)), "id").limit(limit)

    def coverage(self) -> DataFrame:
        return aggs.coverage(self.catalog["symbols"], "language", COVERED).orderBy(F.desc("total"), "language")

    def inspect(self) -> DataFrame:
        s = self.catalog["summaries"].select(F.col("module_id").alias("id"), "concepts")
        return self.catalog["modules"].join(s, "id", "left").select("name", "origin", F.size("symbol_ids").alias("symbols"), "concepts").orderBy("name")

    def metadata(self) -> dict:
        row = self.catalog["metadata"].first()
        return row.asDict() if row else {}

    def file_hashes(self) -> DataFrame:
        return self.catalog["file_hashes"]

    def stats(self) -> dict:
        return self.metadata() | {"dialect": self.dialect(), "counts": {r["relation"]: r["n"] for r in store.counts(self.catalog).collect()}}

    def validate(self) -> DataFrame:
        return checks.validate(self.catalog, SCHEMA_VERSION).orderBy("level", "code", "message")

    def query(self, question: str, limit: int = 10, kinds: Sequence[str] | None = None) -> DataFrame:
        return index.ranked(self.index, question, limit, kinds).select("kind", "id", "name", F.round("score", 6).alias("score"), "is_test")

    def context(self, question: str, limit: int = 8, kinds: Sequence[str] | None = None) -> dict:
        hits = self.query(question, limit, kinds)
        late = F.when(F.col("kind") == "db_migration", 2).otherwise(1)
        # At most limit rows, written once as each kind looks its own up: the window over them is one small partition.
        hits = cut_lineage(hits)
        ranked = hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "is_test", late, "kind", "name", "id")))
        row = render.context_text(question, render.blocks(ranked, self.catalog)).withColumn("tokens", count_tokens(F.col("text"))).first()
        return {"text": row["text"] or f"# Question: {question}", "tokens": row["tokens"] or 0, "tokenizer": tokenizer_name()}

    def hybrid(self, question: str, repo: str, limit: int = 8, hops: int = 1, max_symbols: int = 40, max_lines: int = 60, code_budget: int = 2000) -> dict:
        """The context and slices of code of the symbols that the graph leads to, within a token budget."""
        c = self.catalog
        found = hybrid.retrieve(*self.graph, c["symbols"], question, hops, max_symbols)
        code = hybrid.slices(found, c["symbols"], repo_files(self.spark, repo), max_lines)
        kept = hybrid.within_budget(code, count_tokens, code_budget)
        rows = kept.select("id", "source_file", "start", "end", "cost").collect()
        base = self.context(question, limit)
        text = base["text"]
        if rows:
            text += "\n\n## Exact code\n\n" + render.code_text(kept).first()["code"]
        spent = sum(r["cost"] for r in rows)
        return base | {"text": text, "code_tokens": spent, "context_tokens": base["tokens"], "tokens": base["tokens"] + spent, "slices": [(r["id"], r["source_file"], r["start"], r["end"]) for r in rows]}
