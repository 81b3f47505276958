"""Mixing sources to target weights with hash-threshold histograms.

Every document has a fixed hash of 60 bits. A source takes whole copies of all its documents, and one more
copy of those whose hash is at most the source's threshold. The threshold that meets the budget is found
without sorting: tokens are summed by source and by the 10 highest bits of the hash; a running sum names
the boundary bucket; only that bucket is summed again by the next 10 bits, and so on until the bucket
holds one hash value. Thresholds are nested: a larger budget takes a superset. Whole rows then pass a filter
on source and hash where they were read: the thresholds, one row a source, come to them.

Defined cases: a null text has size 0, a null source is a source of its own that comes last, an empty
table gives no rows. Repeated rows share a hash and are taken or left together. Rows with a null doc_id
hash as one value. Sources of size 0 get a target of 0. Texts are counted whole. Columns that a caller adds
pass through take_mix, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, free_prefix, words

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_REPEATS = 2
DIGIT_BITS = 10
DIGITS = 6


def doc_hash(doc_id: Column, seed: str = "mix") -> Column:
    """60 bits of an MD5, so that any SQL engine can compute the same value."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """A row per source with source_size and target; sizes has source and size.

    Sources fill like vessels: the level at which capped and open sources together hold the whole budget
    is read off running sums over sources in the order of cap per weight. The windows run over one row per
    source, after the aggregation.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("w", w).withColumn("cap", F.col("source_size").cast("double") * max_repeats)
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    per = per.withColumns({
        "budget": F.sum("source_size").over(everything).cast("double") * share,
        "capped": F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "open_w": F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)),
    }).withColumn("level", (F.col("budget") - F.col("capped")) / F.col("open_w"))
    # Levels fall once enough sources are capped: the first open source has the highest of the open levels.
    per = per.withColumn("is_open", F.col("level") * F.col("w") <= F.col("cap"))
    level = F.max(F.when(F.col("is_open"), F.col("level"))).over(everything)
    return per.withColumn("at", level).select(
        "source", "source_size", F.when(F.col("at").isNull() | (F.col("at") * F.col("w") >= F.col("cap")), F.col("cap")).otherwise(F.col("at") * F.col("w")).alias("target")
    )


def _digit(k: int) -> Column:
    return F.shiftright(F.col("h"), DIGIT_BITS * (DIGITS - 1 - k)).bitwiseAND((1 << DIGIT_BITS) - 1)


def thresholds(sizes: DataFrame, budgets: DataFrame) -> DataFrame:
    """A row per source with the largest hash that it takes (-1: none); budgets has key and budget.

    The last document is taken if the sum then lies nearer to the budget. All that a round keeps is a
    histogram of at most 2^10 rows a source; no rows are sorted or collected.
    """
    state = budgets.select("key", F.col("budget").alias("left"), F.lit(0).cast("long").alias("prefix"), F.lit(-1).cast("long").alias("thr"), F.lit(False).alias("done"))
    for k in range(DIGITS):
        shift = DIGIT_BITS * (DIGITS - 1 - k)
        open_ = state.where(~F.col("done")).select("key", "prefix", "left")
        rows = sizes.where(F.col("size") > 0)
        if k:
            rows = rows.join(F.broadcast(open_.select("key", "prefix")) if _few(open_) else open_.select("key", "prefix"), "key").where(F.shiftright("h", shift + DIGIT_BITS) == F.col("prefix")).drop("prefix")
        hist = rows.groupBy("key", _digit(k).alias("digit")).agg(F.sum("size").alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi"))
        w = Window.partitionBy("key").orderBy("digit")
        hist = hist.withColumn("upto", F.sum("n").over(w)).join(open_, "key")
        spent, over = F.col("upto") - F.col("n"), F.col("upto") > F.col("left")
        found = hist.groupBy("key").agg(
            F.max(F.when(~over, F.col("hi"))).alias("last"),
            F.min(F.when(over, F.struct("digit", (F.col("left") - spent).alias("left"), "n", "lo", "hi"))).alias("edge"),
        )
        if k == 0:
            found = open_.select("key").join(found, "key", "left")
        got = state.join(found, "key", "left")
        lone = F.col("edge.lo") == F.col("edge.hi")
        take = lone & (F.col("edge.left") * 2 > F.col("edge.n"))
        state = got.select(
            "key",
            F.coalesce(F.col("edge.left"), F.col("left")).alias("left"),
            F.when(F.col("edge").isNotNull(), F.shiftleft(F.col("prefix"), DIGIT_BITS) + F.col("edge.digit")).otherwise(F.col("prefix")).alias("prefix"),
            F.when(F.col("done"), F.col("thr")).when(take, F.col("edge.hi")).otherwise(F.greatest("thr", F.coalesce("last", F.lit(-1).cast("long")))).alias("thr"),
            (F.col("done") | F.col("edge").isNull() | lone).alias("done"),
        )
        state = cut(state, f"mix-threshold-{k}")
        if state.where(~F.col("done")).isEmpty():
            break
    return state.select("key", "thr")


#: Rows up to which a table of one row per source is broadcast; beyond it the join shuffles.
BROADCAST_SOURCES = 100_000


def _few(df: DataFrame) -> bool:
    return df.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null"))


def source_plan(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """A row per source: key, source_size, target, whole (copies of all its documents) and thr (one more up to this hash)."""
    per = source_targets(sizes, weights, share, max_repeats)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    per = cut(per.withColumns({"key": _key(F.col("source")), "whole": whole}).withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size")), "mix-targets")
    per = cut(per.join(thresholds(sizes, per.select("key", "budget")), "key").select("key", "source_size", "target", "whole", "thr"), "mix-plan")
    return F.broadcast(per) if _few(per) else per


def doc_sizes(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, source, key, size and h; written once, as the rounds read it again and again."""
    return cut(docs.select("doc_id", "source", _key(F.col("source")).alias("key"), F.size(words(F.col("text"))).cast("long").alias("size"), doc_hash(F.col("doc_id")).alias("h")), "mix-sizes")


def plan_mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """A row per document: doc_id, source, h, size, source_size, target, copies."""
    sizes = doc_sizes(docs)
    joined = sizes.join(source_plan(sizes, weights, share, max_repeats), "key")
    copies = F.col("whole") + (F.col("h") <= F.col("thr")).cast("long")
    return joined.select("doc_id", "source", "h", "size", "source_size", "target", copies.alias("copies"))


def take_mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """The mixed rows themselves, each as often as the mix takes it, with the columns of docs.

    No text is shuffled or sorted: hash and source of a row say how many copies of it are taken.
    """
    per = source_plan(doc_sizes(docs), weights, share, max_repeats)
    prefix = free_prefix(docs)
    per = per.select(*[F.col(c).alias(prefix + c) for c in ("key", "whole", "thr")])
    own = lambda name: F.col(prefix + name)
    joined = docs.withColumn(f"{prefix}own", _key(F.col("source"))).join(per, own("own") == own("key"))
    copies = own("whole") + (doc_hash(F.col("doc_id")) <= own("thr")).cast("long")
    taken = joined.withColumn(f"{prefix}copies", copies).where(own("copies") > 0)
    return taken.withColumn(f"{prefix}copy", F.explode(F.sequence(F.lit(1).cast("long"), own("copies")))).select(*[f"`{c}`" for c in docs.columns])


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
p AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap,
         [3.0::DOUBLE, 1.0, 2.0][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1] AS w
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source)),
q AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM p),
r AS (SELECT *, max(CASE WHEN level * w <= cap THEN level END) OVER () AS open_level FROM q),
t AS (SELECT source, source_size, CASE WHEN open_level IS NULL OR open_level * w >= cap THEN cap ELSE open_level * w END AS target FROM r),
b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
s AS (
  SELECT source, h, sum(size) AS n FROM d WHERE size > 0 GROUP BY source, h),
c AS (
  SELECT s.*, b.target - b.whole * b.source_size AS budget,
         sum(n) OVER (PARTITION BY s.source ORDER BY h) AS upto
  FROM s JOIN b ON s.source IS NOT DISTINCT FROM b.source),
e AS (
  SELECT source, max(h) AS thr FROM c
  WHERE upto <= budget OR (upto - n <= budget AND 2 * (budget - (upto - n)) > n) GROUP BY source)
SELECT d.doc_id, d.size, b.source_size, b.target,
       (d.size * (b.whole + CASE WHEN d.h <= coalesce(e.thr, -1) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
LEFT JOIN e ON d.source IS NOT DISTINCT FROM e.source
"""
