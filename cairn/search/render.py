"""Context text: a block per hit, slices of code, all ordered and joined with built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _line(label: str, value: Column) -> Column:
    return F.when(value.isNotNull() & (value != ""), F.concat(F.lit(f"- {label}: "), value))


def _list(label: str, values: Column) -> Column:
    return _line(label, F.array_join(values, ", "))


def _flags(c: Column) -> Column:
    target = F.concat(F.lit("-> "), c["references_table"], F.coalesce(F.concat(F.lit("."), c["references_column"]), F.lit("")))
    flags = F.array(F.when(c["primary_key"], "pk"), F.when(c["unique"], "unique"), F.when(~c["nullable"], "not null"), target)
    shown = F.array_join(F.filter(flags, lambda x: x.isNotNull()), ", ")
    return F.concat(F.lit("  - "), c["name"], F.lit(" "), F.coalesce(c["data_type"], F.lit("")), F.when(shown != "", F.concat(F.lit(" ("), shown, F.lit(")"))).otherwise(""))


def blocks(hits: DataFrame, catalog: dict[str, DataFrame]) -> DataFrame:
    """hits (kind, id, name, ...) with block, the text of each; entities are looked up by id."""
    c = catalog
    title = lambda: F.concat(F.lit("### "), F.initcap(F.replace("kind", F.lit("_"), F.lit(" "))), F.lit(": "), "name")
    base = hits.select("kind", "id", "name")
    s = c["summaries"].drop("id").withColumnRenamed("module_id", "_m")
    module = base.where("kind = 'module'").join(s, F.col("id") == F.col("_m"), "left").select("kind", "id", F.concat_ws("\n", title(), _line("Purpose", F.col("purpose")), *[_list(n, F.col(k)) for n, k in (("Responsibilities", "responsibilities"), ("Business rules", "business_rules"), ("Depends on", "dependencies"), ("APIs", "public_apis"), ("Workflows", "workflows"), ("Constraints", "constraints"), ("Concepts", "concepts"), ("Key symbols", "god_nodes"))]).alias("block"))
    k = c["concepts"].select(F.col("id").alias("_c"), "rationale", "source_file")
    concept = base.where("kind = 'concept'").join(k, F.col("id") == F.col("_c"), "left").select("kind", "id", F.concat_ws("\n", title(), _line("Rationale", F.col("rationale")), _line("Source", F.col("source_file"))).alias("block"))
    y = c["symbols"].select(F.col("id").alias("_s"), "signature", "source_file", "source_location", "docstring")
    symbol = base.where("kind = 'symbol'").join(y, F.col("id") == F.col("_s"), "left").select("kind", "id", F.concat_ws("\n", title(), _line("Signature", F.col("signature")), _line("Location", F.concat_ws(":", "source_file", "source_location")), _line("Doc", F.element_at(F.split("docstring", "\n"), 1))).alias("block"))
    t = c["db_tables"].select(F.col("id").alias("_t"), "technology", "columns", "constraints", "indexes", "source_file")
    constraint = lambda x: F.concat(F.lit("  - "), F.concat_ws(" ", x["kind"], x["name"], F.concat(F.lit("("), F.array_join(x["columns"], ", "), F.lit(")")), F.concat(F.lit("-> "), x["references_table"])))
    index = lambda x: F.concat(F.lit("  - "), F.when(x["unique"], F.lit("unique ")).otherwise(""), F.coalesce(x["name"], F.lit("index")), F.lit(" ("), F.array_join(x["columns"], ", "), F.lit(")"))
    part = lambda label, values: F.when(F.size(values) > 0, F.concat(F.lit(f"- {label}:\n"), F.array_join(values, "\n")))
    tables = base.where("kind = 'db_table'").join(t, F.col("id") == F.col("_t"), "left").select("kind", "id", F.concat_ws("\n", title(), _line("Technology", F.col("technology")), _line("Source", F.col("source_file")), part("Columns", F.transform("columns", _flags)), part("Constraints", F.transform("constraints", constraint)), part("Indexes", F.transform("indexes", index))).alias("block"))
    m = c["db_migrations"].select(F.col("id").alias("_g"), "technology", "operations", "source_file")
    migrations = base.where("kind = 'db_migration'").join(m, F.col("id") == F.col("_g"), "left").select("kind", "id", F.concat_ws("\n", title(), _line("Technology", F.col("technology")), _line("Source", F.col("source_file")), _list("Operations", F.col("operations"))).alias("block"))
    g = c["db_technologies"].select(F.col("id").alias("_y"), "category", "confidence", "evidence")
    technologies = base.where("kind = 'db_technology'").join(g, F.col("id") == F.col("_y"), "left").select("kind", "id", F.concat_ws("\n", title(), _line("Category", F.col("category")), _line("Confidence", F.col("confidence")), _list("Evidence", F.col("evidence"))).alias("block"))
    rest = base.where("kind NOT IN ('module', 'concept', 'symbol', 'db_table', 'db_migration', 'db_technology')").select("kind", "id", title().alias("block"))
    out = module
    for x in (concept, symbol, tables, migrations, technologies, rest):
        out = out.unionByName(x)
    return hits.join(out, ["kind", "id"])


def context_text(question: str, ranked_blocks: DataFrame, order: str = "rank") -> DataFrame:
    """One row: the question, its heading and the blocks in order."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "block"))), lambda x: x["block"]), "\n\n")
    head = F.lit(f"# Question: {question}\n\n## Relevant repository knowledge\n\n")
    return ranked_blocks.agg(F.rtrim(F.concat(head, body)).alias("text"))


def code_text(slices: DataFrame) -> DataFrame:
    """One row: the kept slices as fenced blocks in order of score."""
    block = F.concat(F.lit("### "), "source_file", F.lit(":"), "start", F.lit("-"), "end", F.lit("\n```\n"), "code", F.lit("\n```"))
    rows = slices.select(F.struct(-F.col("score"), "id", block.alias("block")).alias("s"))
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["block"]), "\n\n").alias("code"))
