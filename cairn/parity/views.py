"""Graph-shaped views over the star-schema tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers are code, parts concepts or code, nations documents; parts over size 45 are left out."""
    c, s, p, n = (table(spark, sf_dir, t) for t in ("customer", "supplier", "part", "nation"))
    text = lambda x: F.lit(x).cast("string")
    return (
        c.select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_name").alias("label"), F.lit("code").alias("file_type"), text("class").alias("kind"), F.concat(F.lit("app/"), F.lower("c_mktsegment"), F.lit("/service.py")).alias("source_file"), F.col("c_nationkey").cast("string").alias("community_id"))
        .unionByName(s.select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.col("s_name").alias("label"), F.lit("code").alias("file_type"), text("function").alias("kind"), F.lit("app/supplier/routes.py").alias("source_file"), F.col("s_nationkey").cast("string").alias("community_id")))
        .unionByName(p.where("p_size <= 45").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.col("p_name").alias("label"), F.when(F.col("p_size") > 25, "concept").otherwise("code").alias("file_type"), text(None).alias("kind"), F.concat(F.lit("lib/"), F.replace("p_brand", F.lit("#"), F.lit("")), F.lit("/part.py")).alias("source_file"), text(None).alias("community_id")))
        .unionByName(n.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.col("n_name").alias("label"), F.lit("document").alias("file_type"), text(None).alias("kind"), text(None).alias("source_file"), text(None).alias("community_id")))
    )


NODES = """v_nodes AS (
  SELECT 'c' || c_custkey AS id, c_name AS label, 'code' AS file_type, 'class' AS kind, 'app/' || lower(c_mktsegment) || '/service.py' AS source_file, c_nationkey::VARCHAR AS community_id FROM customer
  UNION ALL SELECT 's' || s_suppkey, s_name, 'code', 'function', 'app/supplier/routes.py', s_nationkey::VARCHAR FROM supplier
  UNION ALL SELECT 'p' || p_partkey, p_name, CASE WHEN p_size > 25 THEN 'concept' ELSE 'code' END, NULL, 'lib/' || replace(p_brand, '#', '') || '/part.py', NULL FROM part WHERE p_size <= 45
  UNION ALL SELECT 'n' || n_nationkey, n_name, 'document', NULL, NULL, NULL FROM nation)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s, o, l = (table(spark, sf_dir, t) for t in ("customer", "supplier", "orders", "lineitem"))  # noqa: E741
    calls = o.join(l, o["o_orderkey"] == l["l_orderkey"]).select("o_custkey", "l_partkey").distinct().select(F.concat(F.lit("c"), "o_custkey").alias("source_id"), F.concat(F.lit("p"), "l_partkey").alias("target_id"), F.lit("calls").alias("relation"))
    imports = l.select("l_partkey", "l_suppkey").distinct().select(F.concat(F.lit("p"), "l_partkey").alias("source_id"), F.concat(F.lit("s"), "l_suppkey").alias("target_id"), F.lit("imports").alias("relation"))
    refs = c.select(F.concat(F.lit("c"), "c_custkey").alias("source_id"), F.concat(F.lit("n"), "c_nationkey").alias("target_id"), F.lit("references").alias("relation"))
    uses = s.select(F.concat(F.lit("s"), "s_suppkey").alias("source_id"), F.concat(F.lit("n"), "s_nationkey").alias("target_id"), F.lit("uses").alias("relation"))
    every = calls.unionByName(imports).unionByName(refs).unionByName(uses)
    return every.select(F.concat("source_id", F.lit("--"), "relation", F.lit("-->"), "target_id").alias("id"), "source_id", "target_id", "relation")


EDGES = """v_edges AS (
  SELECT source_id || '--' || relation || '-->' || target_id AS id, * FROM (
    SELECT DISTINCT 'c' || o_custkey AS source_id, 'p' || l_partkey AS target_id, 'calls' AS relation FROM orders JOIN lineitem ON o_orderkey = l_orderkey
    UNION ALL SELECT DISTINCT 'p' || l_partkey, 's' || l_suppkey, 'imports' FROM lineitem
    UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'references' FROM customer
    UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'uses' FROM supplier))"""


def hyper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as workflows; their parts, by line number, as participants."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    rows = l.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("m"))
    return rows.select(F.concat(F.lit("w"), "l_orderkey").alias("id"), F.transform("m", lambda x: F.concat(F.lit("p"), x["l_partkey"])).alias("participant_ids"))


HYPER = """v_hyper AS (
  SELECT 'w' || l_orderkey AS id, 'p' || l_partkey AS member, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS pos FROM lineitem)"""


def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(spark, sf_dir).where("community_id IS NOT NULL").select("id", F.concat(F.lit("module::community::"), "community_id").alias("module"))


MEMBERSHIP = "v_member AS (SELECT id, 'module::community::' || community_id AS module FROM v_nodes WHERE community_id IS NOT NULL)"
