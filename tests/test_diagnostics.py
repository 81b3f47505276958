"""What a build reports of many issues."""

import pytest
from pyspark.sql import functions as F

from cairn import catalog as store
from cairn.plans.build import SHOWN, build
from cairn.plans.config import Config, ValidationError
from cairn.schemas import RELATIONS

N = 1200


def load(c, spark, config):
    """N symbols that are no graph nodes and have no start line, and N lost files."""
    ids = spark.range(N).select(F.format_string("s%05d", "id").alias("id"))
    symbols = store.conform(ids.withColumns({"name": F.col("id"), "kind": F.lit("function")}), "symbols")
    return {k: store.empty(spark, k) for k in RELATIONS} | {"symbols": symbols, "_lost_files": ids.select(F.concat("id", F.lit(".py")).alias("source_file"))}


@pytest.mark.parametrize("stored", [True, False])
def test_all_issues_and_lost_files_are_reported(spark, tmp_path, stored):
    out = str(tmp_path / "kb") if stored else None
    said = build(spark, Config(str(tmp_path), output=out), passes=[("load", load)])[1]
    want = {("error", "NO_MODULES"): 1, ("error", "SYMBOL_NOT_NODE"): N, ("warning", "LOST_SOURCE_FILE"): N, ("warning", "SYMBOL_NO_MODULE"): N, ("warning", "SYMBOL_NO_START_LINE"): N}
    issues = spark.read.parquet(f"{out}/issues") if stored else said.issues
    assert said.counts == want and {(r[0], r[1]): r[2] for r in issues.groupBy("level", "code").count().collect()} == want
    assert issues.where("code = 'LOST_SOURCE_FILE'").select("message").distinct().count() == N
    assert ("warning", "load", f"LOST_SOURCE_FILE: {N - SHOWN} more of {N}, see the table of issues") in said.rows
    assert ("warning", "load", "s00000.py is named by the graph, but isn't there") in said.rows
    if stored:
        with pytest.raises(ValidationError):
            build(spark, Config(str(tmp_path), output=out, strict=True), passes=[("load", load)])
