"""Graph operators: adjacency, expansion, ancestors and prefix relaxation, by loops of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.session import cut_lineage

DECAY = 0.5
LEAST = 0.15
SEEDS = 40
#: Rounds after which what was found is written too, so that plans of deep graphs stay short.
CUT_EVERY = 16


def both_ways(edges: DataFrame) -> DataFrame:
    """(a, b) for each edge in both directions, parallel edges as often as they stand."""
    e = edges.select(F.col("source_id").alias("a"), F.col("target_id").alias("b"))
    return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))


def adjacency(edges: DataFrame) -> DataFrame:
    """Distinct neighbours (a, b) in both directions; a loop is its own neighbour."""
    return both_ways(edges).distinct()


def frontier(seeds: DataFrame, width: int = SEEDS) -> DataFrame:
    """The best seeds (id, score), the least id of equals first."""
    return seeds.orderBy(F.desc("score"), "id").limit(width).select("id", "score")


def expand(seeds: DataFrame, near: DataFrame, hops: int = 1, width: int = SEEDS) -> DataFrame:
    """(id, score): seeds (id, score) and what their neighbours add.

    near is (a, b), with or without repeats: neighbours are made distinct behind the join with the frontier,
    which is small. The best seeds make the frontier. A hop adds score * 0.5^(hop + 1) to each neighbour,
    unless that is under 0.15; the neighbours, with the largest score that reached them undecayed, are the
    next frontier.
    """
    total = seeds.select("id", "score")
    # The first frontier has width rows at most; later ones are joined as their sizes allow.
    front = F.broadcast(frontier(seeds, width))
    for h in range(hops):
        reached = near.join(front.withColumn("c", F.col("score") * DECAY ** (h + 1)).where(F.col("c") >= LEAST), F.col("id") == F.col("a")).select("a", "b", "c", "score").distinct()
        step = reached.groupBy(F.col("b").alias("id")).agg(F.sum("c").alias("c"), F.max("score").alias("score"))
        total = total.unionByName(step.select("id", F.col("c").alias("score")))
        front = step.select("id", "score")
    return total.groupBy("id").agg(F.sum("score").alias("score"))


def ancestors(parents: DataFrame) -> DataFrame:
    """(id, ancestor, depth, ord): breadth-first over (id, parent, ord) to the last level, each ancestor once at its least depth; cycles end.

    ord orders an id's ancestors of one depth: it is their rank by the path of parents' ord.
    """
    up = parents.select(F.col("id").alias("ancestor"), F.col("parent").alias("_p"), F.col("ord").cast("long").alias("_o"))
    first = parents.select("id", F.col("parent").alias("ancestor"), F.lit(1).alias("depth"), F.col("ord").cast("long").alias("ord")).where("id <> ancestor")
    found = step = first.groupBy("id", "ancestor").agg(F.min("depth").alias("depth"), F.min("ord").alias("ord"))
    d = 1
    while True:
        d += 1
        step = step.join(up, "ancestor").where("id <> _p").groupBy("id", F.col("_p").alias("ancestor")).agg(F.min(F.struct("ord", "_o")).alias("_place")).join(found.select("id", "ancestor"), ["id", "ancestor"], "left_anti")
        # Ranks start anew on each level, so that they stay small however deep it is.
        step = step.select("id", "ancestor", F.lit(d).alias("depth"), F.dense_rank().over(Window.partitionBy("id").orderBy("_place")).cast("long").alias("ord"))
        step = cut_lineage(step)
        if step.isEmpty():
            return found
        found = found.unionByName(step)
        if d % CUT_EVERY == 0:
            found = cut_lineage(found)


def mount_prefixes(routers: DataFrame, mounts: DataFrame, sweeps: int | None = None) -> DataFrame:
    """(id, prefix): the full prefix of each router.

    routers: id, own (its own prefix); mounts: parent, child, prefix, ord. Roots are routers that nothing
    mounts. A child's prefix is its parent's, the mount's and its own; of several mounts the last counts.
    Routers on a cycle keep their own prefix, since no root reaches them.
    """
    last = mounts.groupBy("child").agg(F.max_by(F.struct("parent", "prefix"), "ord").alias("m")).select("child", "m.parent", F.col("m.prefix").alias("at"))
    known = routers.join(mounts.select(F.col("child").alias("id")).distinct(), "id", "left_anti").select("id", F.col("own").alias("prefix"))
    step = known
    most = sweeps if sweeps is not None else mounts.count() + 1
    for _ in range(most):
        step = last.join(step.withColumnsRenamed({"id": "parent", "prefix": "above"}), "parent").join(routers.select(F.col("id").alias("child"), "own"), "child").select(F.col("child").alias("id"), F.concat("above", "at", "own").alias("prefix"))
        step = cut_lineage(step.join(known.select("id"), "id", "left_anti"))
        if step.isEmpty():
            break
        known = known.unionByName(step)
    rest = routers.join(known.select("id"), "id", "left_anti").select("id", F.col("own").alias("prefix"))
    return known.unionByName(rest)
