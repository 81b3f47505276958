"""Graph-guided retrieval: seeds, expansion, slices of source under a token budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.paths import NON_COMPONENT_KINDS, line_range
from cairn.functions.text import asks_for_tests, is_test, question_stems, token_set
from cairn.operators.graph import expand
from cairn.operators.windows import budget_cut

from .index import TEST_PENALTY


def node_tokens(nodes: DataFrame, symbols: DataFrame) -> DataFrame:
    """(id, tokens, is_test) of all graph nodes: label, file and what the symbol of the node says."""
    s = symbols.select(F.col("id").alias("_s"), F.concat_ws(" ", "name", "qualified_name", "docstring", "signature").alias("_text"))
    both = nodes.join(s, F.col("id") == F.col("_s"), "left")
    return both.select("id", token_set(F.concat_ws(" ", "label", "source_file", "_text")).alias("tokens"), is_test(F.concat_ws(" ", "source_file", "label")).alias("is_test"))


def seeds(tokens: DataFrame, question: str) -> DataFrame:
    stems = question_stems(tokens.sparkSession, question)
    hits = F.size(F.array_intersect("tokens", F.array(*map(F.lit, stems)))) if stems else F.lit(0)
    weight = F.lit(1.0) if asks_for_tests(stems) else F.when(F.col("is_test"), TEST_PENALTY).otherwise(1.0)
    return tokens.select("id", (hits * weight).alias("score")).where("score > 0")


def retrieve(tokens: DataFrame, near: DataFrame, symbols: DataFrame, question: str, hops: int = 1, limit: int = 40) -> DataFrame:
    """The best symbols with a place in source, by expanded score, then id; tokens of nodes, and neighbours (a, b)."""
    found = expand(seeds(tokens, question), near, hops)
    placed = symbols.where((F.coalesce("source_location", F.lit("")) != "") & (F.coalesce("source_file", F.lit("")) != "") & ~F.coalesce("kind", F.lit("")).isin(*NON_COMPONENT_KINDS))
    return placed.join(found, "id").orderBy(F.desc("score"), "id").limit(limit)


def file_lines(files: DataFrame) -> DataFrame:
    """(path, line, text): lines count from 1; every line end of Unicode's line breaking ends one."""
    text = F.regexp_replace("text", r"(\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029])\z", "")
    return files.where("text <> ''").select("path", F.posexplode(F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]")).alias("_i", "text")).select("path", (F.col("_i") + 1).alias("line"), "text")


def slices(targets: DataFrame, symbols: DataFrame, files: DataFrame, max_lines: int = 60) -> DataFrame:
    """(id, source_file, start, end, code): from a symbol's start to its own end, or to before the next symbol of the file."""
    lo, hi = line_range(F.col("source_location"))
    starts = symbols.where("coalesce(kind, '') <> 'file'").select(F.col("source_file").alias("f"), F.coalesce("start_line", lo).alias("st")).where("st IS NOT NULL").distinct()
    w = Window.partitionBy("f").orderBy("st").rangeBetween(1, Window.unboundedFollowing)
    bounds = starts.withColumn("nx", F.min("st").over(w))
    t = targets.withColumns({"st": F.coalesce("start_line", lo), "en": F.coalesce("end_line", hi)}).where("st IS NOT NULL")
    t = t.join(bounds, (F.col("source_file") == F.col("f")) & (t["st"] == bounds["st"]), "left").select("id", "source_file", t["st"].alias("start"), "en", "nx", *[c for c in ("score",) if c in targets.columns])
    lines = file_lines(files)
    n = lines.groupBy("path").agg(F.max("line").alias("n_lines"))
    most = F.col("start") + max_lines - 1
    t = t.join(n, F.col("source_file") == F.col("path")).where((F.col("start") >= 1) & (F.col("start") <= F.col("n_lines")))
    t = t.withColumn("end", F.least(F.coalesce("en", F.col("nx") - 1, most), most, "n_lines")).drop("path")
    got = t.join(lines, (F.col("source_file") == F.col("path")) & F.col("line").between(F.col("start"), F.col("end")))
    keys = [c for c in t.columns if c not in ("en", "nx", "n_lines")]
    code = got.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("code"))
    return code.where(F.trim(F.regexp_replace("code", r"\s+", " ")) != "")


def within_budget(code: DataFrame, token_cost, budget: int = 2000) -> DataFrame:
    """Slices in order of score whose running token cost stays in the budget; the first always stays."""
    return budget_cut(code.withColumn("cost", token_cost(F.col("code"))), "cost", [F.desc("score"), F.col("id")], budget)
