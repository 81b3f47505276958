"""Operators that depend on row order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def budget_cut(rows: DataFrame, cost: str, order: Sequence[str], budget: int, group: Sequence[str] = ()) -> DataFrame:
    """The rows, in order, whose running cost stays within budget; the first of a group always stays."""
    w = Window.partitionBy(*group).orderBy(*order)
    run = rows.withColumns({"_rank": F.row_number().over(w), "_upto": F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    return run.where((F.col("_rank") == 1) | (F.col("_upto") <= budget)).drop("_rank").withColumnRenamed("_upto", "running")


def first_claim(claims: DataFrame, key: str, owner: str, order: Sequence[str]) -> DataFrame:
    """(key, owner): the owner that claims a key first."""
    return claims.groupBy(key).agg(F.min_by(owner, F.struct(*order)).alias(owner))


def collisions(rows: DataFrame, name: str) -> DataFrame:
    """rows whose name another row has too, with n, the number of them."""
    return rows.withColumn("n", F.count("*").over(Window.partitionBy(name))).where("n > 1")


def widen_names(modules: DataFrame) -> DataFrame:
    """modules (id, name, source_paths, candidates) with colliding names made distinct.

    Names are given one after the other against all names taken so far, which no set operation expresses.
    Only modules that share a name come to the driver, and of the other names those that they could meet:
    their candidates, and numbered forms of their own names.
    """
    clash = collisions(modules.select("id", "name", "source_paths", "candidates"), "name").orderBy("name", "id").collect()
    if not clash:
        return modules.drop("candidates")
    spark = modules.sparkSession
    fixed = {x for r in clash for x in _wider(r["name"], r["source_paths"] or [], r["candidates"] or [], False)} | {r["name"] for r in clash}
    names = modules.select("name").distinct().withColumn("_base", F.regexp_extract("name", r"^(.*) \d+$", 1))
    could = spark.createDataFrame([(x,) for x in sorted(fixed)], "_name string")
    bases = spark.createDataFrame([(x,) for x in sorted({r["name"] for r in clash})], "_name string")
    met = names.join(could, F.col("name") == F.col("_name"), "left_semi").select("name").unionByName(names.join(bases, F.col("_base") == F.col("_name"), "left_semi").select("name"))
    taken = {r["name"] for r in met.distinct().collect()}
    given: list[tuple[str, str]] = []
    for row in clash:
        new = next(n for n in _wider(row["name"], row["source_paths"] or [], row["candidates"] or []) if n not in taken)
        taken.add(new)
        given.append((row["id"], new))
    names = spark.createDataFrame(given, "id string, _new string")
    return modules.join(names, "id", "left").withColumn("name", F.coalesce("_new", "name")).drop("_new", "candidates")


def _wider(base: str, source_paths: Sequence[str], symbols: Sequence[str], numbered: bool = True):
    """Candidates: two to four trailing directories of the first path, symbol names, then numbers without end."""
    parts = [p for p in (source_paths[0].split("/")[:-1] if source_paths else []) if p not in ("", ".")]
    for n in range(2, 5) if len(parts) > 1 else range(1, 2):
        words: list[str] = []
        for p in parts[-n:]:
            word = "".join(w[:1].upper() + w[1:] for w in p.replace("-", "_").replace(".", "_").split("_") if w)
            if word and word not in words[-1:]:
                words.append(word)
        if words:
            yield " ".join(words)
    for s in symbols:
        if not s.startswith("_"):
            yield f"{base} {s}"
    n = 2
    while numbered:
        yield f"{base} {n}"
        n += 1
