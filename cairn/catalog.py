"""A catalog of entity relations: shaped, written as Parquet, read again, counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.coerce import as_json
from cairn.operators.aggs import counts as count_rows
from cairn.schemas import ENTITIES, RELATIONS, schema

Catalog = dict[str, DataFrame]


def conform(rows: DataFrame, relation: str) -> DataFrame:
    """rows with the columns of a relation in their order and types; what is missing is null, missing arrays empty."""
    have = {c.lower() for c in rows.columns}
    out = []
    for f in schema(relation):
        kind = f.dataType.simpleString()
        c = F.col(f.name).cast(f.dataType) if f.name.lower() in have else F.lit(None).cast(f.dataType)
        out.append((F.coalesce(c, F.array().cast(f.dataType)) if kind.startswith("array") else c).alias(f.name))
    return rows.select(*out)


def empty(spark: SparkSession, relation: str) -> DataFrame:
    return spark.createDataFrame([], schema(relation))


def write(catalog: Catalog, folder: str) -> str:
    """Each relation below folder, sorted by its key within files so that scans by key skip row groups."""
    for name in RELATIONS:
        rows = conform(catalog[name], name)
        rows.sortWithinPartitions(rows.columns[0]).write.mode("overwrite").parquet(f"{folder}/{name}")
    return folder


def read(spark: SparkSession, folder: str) -> Catalog:
    return {name: spark.read.schema(schema(name)).parquet(f"{folder}/{name}") for name in RELATIONS}


def with_data(rows: DataFrame) -> DataFrame:
    """rows with data, the whole row as JSON, nulls included."""
    return rows.withColumn("data", as_json(*rows.columns))


def content_key(rows: DataFrame, ids: tuple[str, ...] = ("id", "module_id")) -> Column:
    """A hash of what a row says without its ids: rows of equal content have equal keys."""
    return F.xxhash64(*[F.to_json(F.struct(c)) for c in rows.columns if c not in ids])


def scan(catalog: Catalog, relation: str) -> DataFrame:
    return catalog[relation].orderBy("id")


def counts(catalog: Catalog) -> DataFrame:
    return count_rows({k: catalog[k] for k in ENTITIES})


def export_sqlite(catalog: Catalog, path: str) -> str:
    """One portable SQLite file: per relation its key, scalar columns and the JSON data. For catalogs that fit the driver."""
    import sqlite3

    with sqlite3.connect(path) as db:
        for name in ENTITIES:
            rows = with_data(catalog[name])
            scalars = [c for c, t in rows.dtypes if not t.startswith(("array", "struct"))]
            db.execute(f"DROP TABLE IF EXISTS {name}")
            db.execute(f"CREATE TABLE {name} ({', '.join(f'{c} PRIMARY KEY' if c == 'id' else c for c in scalars)})")
            marks = ", ".join("?" * len(scalars))
            db.executemany(f"INSERT INTO {name} VALUES ({marks})", (tuple(r) for r in rows.select(*scalars).toLocalIterator()))
    return path
