"""The Spark session that the command line and tests use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with UTC times and adaptive execution; a running one is used as it is."""
    builder = SparkSession.builder.appName("cairn")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def reach_workers(spark: SparkSession) -> None:
    """Lets Python workers on this machine import the package wherever the driver was started.

    On a cluster the package is installed or shipped (--py-files); the entry does no harm there.
    """
    import os
    from pathlib import Path

    root = str(Path(__file__).resolve().parent.parent)
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)


_own_folder: str | None = None


def scratch_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one on a local master where that is unset."""
    global _own_folder
    import re
    import tempfile

    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if _own_folder is None:
        _own_folder = tempfile.mkdtemp(prefix="cairn-")
    return _own_folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """df, written as Parquet to the folder that the cluster names in spark.checkpoint.dir (a temporary one on a local master where it is unset).

    A checkpoint would compute df twice; a written table does it once, and recovers from lost executors alike.
    """
    import uuid

    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/cairn/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
