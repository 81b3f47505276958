"""Files of a checked-out repository as rows, and their hashes."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Folders that hold no source, and limits.
IGNORED = [
    ".git", ".hg", ".svn", ".venv", "venv", "env", "node_modules", "__pycache__", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".idea", ".vscode", "dist", "build", "target", ".knowledge",
    "graphify-out", ".tox", ".gradle",
]
MAX_BYTES = 2_000_000
MAX_FILES = 50_000


def hashed(rows: DataFrame, content: str = "content") -> DataFrame:
    """rows with hash, the SHA-256 of content (null: of nothing)."""
    return rows.withColumn("hash", F.sha2(F.coalesce(F.col(content).cast("binary"), F.lit("").cast("binary")), 256))


def repo_files(spark: SparkSession, root: str, max_files: int | None = MAX_FILES, max_bytes: int | None = MAX_BYTES) -> DataFrame:
    """(path, text, content, hash) of files; text is null for files over max_bytes.

    Bytes that are no UTF-8 are left out of text. Of more than max_files files the first ones by path are
    read, as the walk of a runaway repository would be: paths alone are sorted, contents are then joined.
    None lifts a limit.
    """
    base = root.rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    rel = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), f"^/*{re.escape(base.removeprefix('file:').strip('/'))}/", "")
    parts = F.split(rel, "/")
    kept = raw.select(rel.alias("path"), "content", "length").where(~F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*map(F.lit, IGNORED))))
    if max_files is not None:
        kept = kept.join(kept.select("path").orderBy("path").limit(max_files), "path", "left_semi")
    text = F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("\ufffd"), F.lit(""))
    return hashed(kept.select("path", (text if max_bytes is None else F.when(F.col("length") <= max_bytes, text)).alias("text"), "content"))


def source_hashes(nodes: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(source_file and hash of files that nodes name, source_file of those that don't exist)."""
    named = nodes.where("source_file IS NOT NULL").select("source_file").distinct()
    have = files.select(F.col("path").alias("source_file"), "hash")
    return named.join(have, "source_file"), named.join(have.select("source_file"), "source_file", "left_anti")


def changed_files(files: DataFrame, hashes: DataFrame) -> DataFrame:
    """Files that are new or differ from stored hashes (source_file, hash): what an incremental build reads again."""
    old = hashes.select(F.col("source_file").alias("path"), "hash")
    return files.join(old, ["path", "hash"], "left_anti")
