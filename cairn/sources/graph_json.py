"""A node-link code graph in JSON, with its sidecars, as node, edge, hyperedge and community rows."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.functions import coerce
from cairn.session import scratch_folder

NODE = "struct<id:string,label:string,file_type:string,source_file:string,source_location:string,source_url:string,captured_at:string,author:string,contributor:string,rationale:string,community:string,community_id:string>"
EDGE = "struct<source:string,target:string,relation:string,confidence:string,confidence_score:string,weight:string,source_file:string>"
HYPER = "struct<id:string,label:string,relation:string,nodes:array<string>,members:array<string>,confidence:string,confidence_score:string,source_file:string>"
#: Items stay JSON text while the document is read, so an item of another kind spoils no other.
GRAPH = "directed boolean, multigraph boolean, nodes array<string>, links array<string>, edges array<string>, hyperedges array<string>, graph struct<hyperedges:array<string>>"
ANALYSIS = "communities map<string,array<string>>, cohesion map<string,double>, gods array<string>, god_nodes array<string>, surprises array<string>, questions array<string>"

# What the names of the sidecars end in.
ANALYSIS_FILE, LABELS_FILE = "_analysis.json", "_labels.json"


class LoadError(Exception):
    """A graph file is missing or isn't what it should be."""


def read_graph(spark: SparkSession, folder: str, name: str = "graph.json") -> DataFrame:
    """The graph as one row of items; a file that is no JSON object is an error."""
    return spark.read.schema(GRAPH).option("multiLine", True).option("mode", "FAILFAST").json(f"{folder}/{name}")


def _items(graph: DataFrame, column: Column, kind: str) -> DataFrame:
    """ord and the fields of each item of an array of JSON texts, parsed in parallel; items that are no objects have no fields."""
    rows = graph.select(F.posexplode(F.coalesce(column, F.array().cast("array<string>"))).alias("ord", "raw"))
    return rows.repartition("ord").select("ord", F.from_json("raw", kind).alias("x")).select("ord", "x.*")


def _sidecar(spark: SparkSession, folder: str, ending: str, ddl: str) -> DataFrame:
    """The one row of the folder's file whose name ends so, or a row of nulls where there is none.

    Spark's readers pass over names that begin with a dot, as sidecars do: such a file is copied first.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(folder)
    fs = where.getFileSystem(conf)
    found = sorted(f.getPath().toString() for f in fs.listStatus(where) if f.getPath().getName().endswith(ending)) if fs.exists(where) else []
    if not found:
        return spark.createDataFrame([tuple([None] * len(ddl_names(ddl)))], ddl)
    copy = f"{scratch_folder(spark)}/cairn/sidecar-{uuid.uuid4().hex}.json"
    target = jvm.org.apache.hadoop.fs.Path(copy)
    jvm.org.apache.hadoop.fs.FileUtil.copy(fs, jvm.org.apache.hadoop.fs.Path(found[0]), target.getFileSystem(conf), target, False, conf)
    return spark.read.schema(ddl).option("multiLine", True).json(copy)


def ddl_names(ddl: str) -> list[str]:
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl).names


def nodes(graph: DataFrame, community_of: DataFrame | None = None) -> DataFrame:
    """graph_nodes rows: the label defaults to the id, empty text is null, the community is the node's own or the sidecar's."""
    n = _items(graph, F.col("nodes"), NODE).where("coalesce(id, '') <> ''")
    keep = ["source_file", "source_location", "source_url", "captured_at", "author", "contributor", "rationale"]
    out = n.select("ord", "id", F.coalesce(coerce.opt(F.col("label")), "id").alias("label"), coerce.file_type(F.col("file_type")).alias("file_type"), *[coerce.opt(F.col(c)).alias(c) for c in keep], coerce.first_text(F.col("community"), F.col("community_id")).alias("community_id"))
    if community_of is not None:
        side = community_of.select("id", F.col("community_id").alias("_c"))
        out = out.join(side, "id", "left").withColumn("community_id", F.coalesce("community_id", "_c")).drop("_c")
    return out


def edges(graph: DataFrame) -> DataFrame:
    """relationships rows: links, else edges; rows without source, target or relation are left out; the first of an id stays."""
    e = _items(graph, F.coalesce("links", "edges"), EDGE)
    e = e.where("coalesce(source, '') <> '' AND coalesce(target, '') <> '' AND coalesce(relation, '') <> ''")
    rows = e.select(
        coerce.edge_id(F.col("source"), F.col("relation"), F.col("target")).alias("id"), F.col("source").alias("source_id"), F.col("target").alias("target_id"), "relation", coerce.confidence(F.col("confidence")).alias("confidence"),
        coerce.number_or(F.col("confidence_score"), 1.0).alias("confidence_score"), coerce.number_or(F.col("weight"), 1.0).alias("weight"), coerce.opt(F.col("source_file")).alias("source_file"), "ord",
    )
    w = Window.partitionBy("id").orderBy("ord")
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def hyperedges(graph: DataFrame) -> DataFrame:
    """workflow rows: hyperedges with members; an id that is missing is hyperedge_ and the number among those kept."""
    read = F.transform(F.coalesce("graph.hyperedges", "hyperedges", F.array().cast("array<string>")), lambda h: F.from_json(h, HYPER))
    some = F.filter(read, lambda h: F.size(F.coalesce(h["nodes"], h["members"])) > 0)
    kept = graph.select(F.posexplode(some).alias("_n", "h")).select("_n", "h.*").withColumn("participant_ids", F.coalesce("nodes", "members"))
    ident = F.coalesce(coerce.opt(F.col("id")), F.concat(F.lit("hyperedge_"), "_n"))
    return kept.select(ident.alias("id"), F.coalesce(coerce.opt(F.col("label")), ident).alias("name"), "participant_ids", coerce.hyperedge_relation(F.col("relation")).alias("relation"), coerce.confidence(F.col("confidence")).alias("confidence"), coerce.number_or(F.col("confidence_score"), None).alias("confidence_score"), coerce.opt(F.col("source_file")).alias("source_file"))


def communities(spark: SparkSession, folder: str, node_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(communities: ord, community_id, label, cohesion; members: community_id, id) of the sidecar, else of the nodes."""
    analysis = _sidecar(spark, folder, ANALYSIS_FILE, ANALYSIS)
    labels = _sidecar(spark, folder, LABELS_FILE, "labels map<string,string>")
    named = labels.select(F.explode_outer("labels").alias("community_id", "_label")).where("community_id IS NOT NULL")
    listed = analysis.select(F.posexplode(F.map_entries("communities")).alias("ord", "c"), "cohesion").select("ord", F.col("c.key").alias("community_id"), F.col("c.value").alias("ids"), F.try_element_at("cohesion", F.col("c.key")).alias("cohesion"))
    if listed.isEmpty():
        own = node_rows.where("community_id IS NOT NULL")
        listed = own.groupBy("community_id").agg(F.min("ord").alias("ord"), F.array_sort(F.collect_list(F.struct("ord", "id"))).alias("m"), F.lit(None).cast("double").alias("cohesion")).select("ord", "community_id", F.transform("m", lambda x: x["id"]).alias("ids"), "cohesion")
    rows = listed.join(named, "community_id", "left").select("ord", "community_id", F.coalesce("_label", F.concat(F.lit("Community "), "community_id")).alias("label"), "cohesion")
    members = listed.select("ord", "community_id", F.posexplode("ids").alias("pos", "id"))
    return rows, members


def insights(spark: SparkSession, folder: str) -> DataFrame:
    """(kind, text) of surprises and questions, and (god, id) of the central nodes."""
    a = _sidecar(spark, folder, ANALYSIS_FILE, ANALYSIS)
    text = lambda x: F.coalesce(F.get_json_object(x, "$.text"), F.get_json_object(x, "$.summary"), F.get_json_object(x, "$.label"), x)
    ident = lambda x: F.coalesce(F.get_json_object(x, "$.id"), F.get_json_object(x, "$.node"), F.get_json_object(x, "$.node_id"), F.get_json_object(x, "$.label"), x)
    part = lambda kind, c, f: a.select(F.lit(kind).alias("kind"), F.explode(F.transform(c, f)).alias("text"))
    return part("surprise", F.col("surprises"), text).unionByName(part("question", F.col("questions"), text)).unionByName(part("god", F.coalesce("gods", "god_nodes"), ident))
