"""What the training-data operators share: the word rule, table cuts, files in the shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.session import reach_workers

# The six white-space bytes that part words.
BLANKS = " \t\n\x0b\f\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"

_own_folder: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one on a local master where that is unset (tests)."""
    global _own_folder
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if _own_folder is None:
        _own_folder = "file://" + tempfile.mkdtemp(prefix="cairn-")
    return _own_folder


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/cairn/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it again: later stages recover from these files."""
    return _written(df, fresh_path(df.sparkSession, name))


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables that a computation writes on its way; those that aren't kept are deleted when the block ends."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.drop(*[df for df, _ in self.paths.values()])

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        path = fresh_path(self.spark, name)
        out = _written(df, path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *used_up: DataFrame) -> None:
        """Deletes tables that no later step reads."""
        for df in used_up:
            _, path = self.paths.pop(id(df))
            remove_tree(self.spark, path)


def remove_tree(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reach_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(bare.isNull() | (bare == ""), F.array().cast("array<string>")).otherwise(F.split(bare, BLANK_RUN))


#: Bits of the map that thins a table before a join: 16 MB at most are broadcast, whatever the tables' sizes.
MAP_BITS = 1 << 27


def thinned(df: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """The rows of df whose column may be in wanted, for a join to decide; most others go before they are shuffled.

    A map of MAP_BITS bits marks the hashes of wanted; where it fills up, fewer rows are spared, none is lost.
    """
    place = F.pmod(F.xxhash64(column), F.lit(MAP_BITS)) + 1
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    prefix = free_prefix(df)
    bucket, bit, bits = f"{prefix}bucket", f"{prefix}bit", f"{prefix}bits"
    marks = wanted.select(F.bitmap_bucket_number(place).alias(bucket), F.bitmap_bit_position(place).alias(bit))
    marks = marks.repartition(n, bucket).groupBy(bucket).agg(F.bitmap_construct_agg(bit).alias(bits))
    rows = df.withColumns({bucket: F.bitmap_bucket_number(place), bit: F.bitmap_bit_position(place)}).join(F.broadcast(marks), bucket)
    byte = F.conv(F.hex(F.substring(bits, (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return rows.where(F.getbit(byte, (F.col(bit) % 8).cast("int")) == 1).select(*[f"`{c}`" for c in df.columns])


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def free_prefix(df: DataFrame, wanted: str = "_x_") -> str:
    """A prefix that no column of df has."""
    while any(c.lower().startswith(wanted) for c in df.columns):
        wanted = f"_{wanted}"
    return wanted


def open_files(path: str):
    """A pyarrow file system and the path within it, for a URI of any store that pyarrow knows."""
    from pyarrow import fs

    if path.startswith("file:/"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
