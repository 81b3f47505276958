"""A content-addressed store for token ids.

Layout under the store's folder, all Parquet, written by Spark so that a lost task is simply run again:
  chunks/    hash, ids: each unique chunk once; ids are unsigned 16 bits little-endian (32 with a larger vocabulary)
  recipes/   part, place, doc_id, n_tokens, root, chunks: in ascending order of doc_id; chunks are the hashes
             that make the document up, root their Merkle root
  manifest/  part, n_docs, n_tokens, root: the Merkle root of a part's document roots
A rolling hash over 16 ids cuts where its low bits are zero, so equal passages give equal chunks wherever
they stand. Reading joins recipes with chunks, hashes every chunk again and rebuilds all roots; a
difference raises an error.

Defined cases: a null or empty text is its end id alone. Null doc_ids come first; equal doc_ids stand
together, ordered by their root. An empty table gives an empty store. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, fresh_path, remove_tree
from .encoding import encoder, small_batches, with_end

END_ID = 2
MIN_CHUNK = 128
MAX_CHUNK = 4096
#: A cut where so many low bits of the rolling hash are zero: chunks of about 2^9 ids.
CUT_BITS = 9
ROLL = 16
#: Hashes of stored chunks that a task remembers; beyond them copies go when the tasks' chunks are merged.
REMEMBERED = 500_000

#: Copies of chunks between tasks up to which their list (12 bytes each) is broadcast; beyond, chunks are shuffled.
BROADCAST_EXTRA = 1_000_000


def _gear(ids: np.ndarray) -> np.ndarray:
    """A fixed 64-bit value for each id."""
    x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


def rolling_hash(ids: np.ndarray) -> np.ndarray:
    """The hash of the last ROLL ids at each position, by doubling: windows of 1, 2, 4, ... ids."""
    h, width = _gear(ids), 1
    while width < ROLL:
        h[width:] += h[:-width] * np.uint64(pow(0xD6E8FEB86659FD93, width, 1 << 64))
        width *= 2
    return h


def chunk_ends(ids: np.ndarray, ends: np.ndarray) -> list[list[int]]:
    """For each document the ends of its chunks."""
    mask = np.uint64((1 << CUT_BITS) - 1)
    marks = np.flatnonzero((rolling_hash(ids) >> np.uint64(20)) & mask == 0) + 1 if len(ids) else np.zeros(0, np.int64)
    first = np.searchsorted(marks, ends[:-1], "right")
    last = np.searchsorted(marks, ends[1:], "left")
    out = []
    for a, b, i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), first.tolist(), last.tolist()):
        cuts, at = [], a
        for m in marks[i:j].tolist():
            while m - at > MAX_CHUNK:
                at += MAX_CHUNK
                cuts.append(at)
            if m - at >= MIN_CHUNK and b - m >= MIN_CHUNK:
                cuts.append(m)
                at = m
        while b - at > MAX_CHUNK:
            at += MAX_CHUNK
            cuts.append(at)
        cuts.append(b)
        out.append(cuts)
    return out


def chunk_hash(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """Pairs are hashed level by level; a lone last node moves up."""
    level = leaves or [b""]
    while len(level) > 1:
        up = [chunk_hash(level[i] + level[i + 1]) for i in range(0, len(level) - 1, 2)]
        level = up + level[len(up) * 2 :]
    return level[0]


def _encode(path: str, width: str):
    def run(batches):
        from pyspark import TaskContext

        enc = encoder(path, True)
        task = TaskContext.get().partitionId()
        seen: set[bytes] = set()
        stored_chunks = 0
        for batch in small_batches(batches, "text", 32_000_000):
            ids, ends = with_end(*enc.encode(batch.column("text")), END_ID)
            stored = ids.astype(width)
            docs, roots, sizes, hashes, new, news = [], [], [], [], [], []
            for i, (doc, cuts) in enumerate(zip(batch.column("doc_id").to_pylist(), chunk_ends(ids, ends))):
                at, own = int(ends[i]), []
                for end in cuts:
                    raw = stored[at:end].tobytes()
                    h = chunk_hash(raw)
                    own.append(h)
                    if h not in seen:
                        if len(seen) < REMEMBERED:
                            seen.add(h)
                        new.append(h)
                        news.append(raw)
                    at = end
                docs.append(doc)
                sizes.append(int(ends[i + 1] - ends[i]))
                roots.append(merkle_root(own))
                hashes.append(own)
            names = ["kind", "task", "doc_id", "n_tokens", "root", "chunks", "hash", "ids"]
            for k in range(0, len(docs), 2000):
                d = docs[k : k + 2000]
                none = pa.nulls(len(d), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(["r"] * len(d)), pa.array([task] * len(d), pa.int32()), pa.array(d, pa.int64()), pa.array(sizes[k : k + 2000], pa.int64()), pa.array(roots[k : k + 2000], pa.binary()), pa.array(hashes[k : k + 2000], pa.list_(pa.binary())), none, none], names=names)
            for k in range(0, len(new), 2000):
                c = new[k : k + 2000]
                numbers = list(range(stored_chunks, stored_chunks + len(c)))
                stored_chunks += len(c)
                yield pa.RecordBatch.from_arrays([pa.array(["c"] * len(c)), pa.array([task] * len(c), pa.int32()), pa.nulls(len(c), pa.int64()), pa.array(numbers, pa.int64()), pa.nulls(len(c), pa.binary()), pa.nulls(len(c), pa.list_(pa.binary())), pa.array(c, pa.binary()), pa.array(news[k : k + 2000], pa.binary())], names=names)

    return run


def _manifest_rows(batches):
    roots: list[bytes] = []
    tokens, part = 0, None
    for batch in batches:
        roots += batch.column("root").to_pylist()
        tokens += sum(batch.column("n_tokens").to_pylist())
        part = batch.column("part")[0].as_py() if batch.num_rows else part
    if roots:
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([len(roots)], pa.int64()), pa.array([tokens], pa.int64()), pa.array([merkle_root(roots)], pa.binary())], names=["part", "n_docs", "n_tokens", "root"])


def write_store(docs: DataFrame, tokenizer_path: str, folder: str, wide: bool = False, partitions: int | None = None) -> str:
    """Encodes docs into a new store in folder.

    A task stores a chunk once; among tasks the lowest keeps it. Which rows go is found from hashes alone, so
    the chunks themselves aren't shuffled.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    raw_path = f"{folder}/encoded"
    schema = "kind string, task int, doc_id long, n_tokens long, root binary, chunks array<binary>, hash binary, ids binary"
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts.mapInArrow(_encode(tokenizer_path, "<u4" if wide else "<u2"), schema).write.option("compression", "zstd").partitionBy("kind").parquet(raw_path)
    raw = spark.read.schema(schema).option("basePath", raw_path).parquet(raw_path)

    found = raw.where("kind = 'c'")
    place = F.struct("task", F.col("n_tokens").alias("number"))  # of a chunk row, n_tokens is its number in the task
    owner = found.groupBy("hash").agg(F.min(place).alias("owner"), F.count("*").alias("n"))
    extra = found.select("hash", "task", "n_tokens").join(owner.where("n > 1"), "hash").where(place != F.col("owner")).select("task", "n_tokens")
    extra = cut(extra, "store-extra")
    few = extra.limit(BROADCAST_EXTRA + 1).count() <= BROADCAST_EXTRA
    kept = found.join(F.broadcast(extra) if few else extra, ["task", "n_tokens"], "left_anti").select("hash", "ids")
    kept.write.option("compression", "zstd").parquet(f"{folder}/chunks")

    recipes = raw.where("kind = 'r'").select("doc_id", "n_tokens", "root", "chunks")
    recipes = recipes.repartitionByRange(n, "doc_id", "root").sortWithinPartitions("doc_id", "root")
    recipes = recipes.select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("place"), "*")
    recipes.write.option("compression", "zstd").parquet(f"{folder}/recipes")
    remove_tree(spark, raw_path)
    stored = spark.read.schema(recipes.schema).parquet(f"{folder}/recipes")
    ordered = stored.select("part", "place", "n_tokens", "root").repartition(n, "part").sortWithinPartitions("part", "place")
    _by_part(ordered).write.parquet(f"{folder}/manifest")
    return folder


MANIFEST = "part int, n_docs long, n_tokens long, root binary"


def _by_part(ordered: DataFrame) -> DataFrame:
    def run(batches):
        table = None
        for batch in batches:
            parts = np.asarray(batch.column("part"))
            cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]
            for a, b in zip(cuts, cuts[1:]):
                piece = batch.slice(a, b - a)
                if table and table[-1].column("part")[0].as_py() != piece.column("part")[0].as_py():
                    yield from _manifest_rows(table)
                    table = None
                table = [*(table or []), piece] if piece.num_rows else table
        if table:
            yield from _manifest_rows(table)

    return ordered.mapInArrow(run, MANIFEST)


def _rebuild(width: str, with_ids: bool):
    def run(batches):
        held: dict = {"key": None}

        def close():
            if held["key"] is None:
                return None
            ids = np.frombuffer(b"".join(held["raw"]), width)
            if merkle_root(held["hashes"]) != held["root"] or len(ids) != held["n_tokens"]:
                raise ValueError(f"document {held['doc_id']} of the store can't be rebuilt: its root differs")
            return (*held["key"], held["doc_id"], len(ids), ids.astype("<u4").tobytes())

        for batch in batches:
            cols = [batch.column(x).to_pylist() for x in ("part", "place", "doc_id", "n_tokens", "root", "hash", "ids")]
            rows = []
            for part, place, doc, n, root, h, raw in zip(*cols):
                if raw is None or chunk_hash(raw) != h:
                    raise ValueError("a chunk of the store is missing or differs from its hash")
                if held["key"] != (part, place):
                    if (row := close()) is not None:
                        rows.append(row)
                    held.update(key=(part, place), doc_id=doc, n_tokens=n, root=root, hashes=[], raw=[])
                held["hashes"].append(h)
                held["raw"].append(raw)
            if rows:
                yield _rows(rows, with_ids)
        if (row := close()) is not None:
            yield _rows([row], with_ids)

    return run


def _rows(rows, with_ids):
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    crc = [(*r[:4], zlib.crc32(r[4])) for r in rows]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*zip(*crc), [r[4] if with_ids else None for r in rows]], [*kinds, pa.binary()])], names=["part", "place", "doc_id", "n_tokens", "ids_crc32", "ids"])


def read_store(spark: SparkSession, folder: str, wide: bool = False, with_ids: bool = True) -> DataFrame:
    """A row per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and ids."""
    recipes = spark.read.schema("part int, place long, doc_id long, n_tokens long, root binary, chunks array<binary>").parquet(f"{folder}/recipes")
    chunks = spark.read.schema("hash binary, ids binary").parquet(f"{folder}/chunks")
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    # One row per range partition of the store: a bound that doesn't grow with the rows.
    base = manifest.select("part", (F.sum("n_tokens").over(Window.orderBy("part")) - F.col("n_tokens")).alias("base"))
    own = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("place")) - F.col("n_tokens")
    starts = recipes.select("part", "place", "doc_id", "n_tokens").withColumn("own", own).join(F.broadcast(base), "part")
    starts = starts.select("part", "place", (F.col("base") + F.col("own")).alias("start"))
    rows = recipes.select("part", "place", "doc_id", "n_tokens", "root", F.posexplode("chunks").alias("seq", "hash")).join(chunks, "hash", "left")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "part", "place").sortWithinPartitions("part", "place", "seq").select("part", "place", "doc_id", "n_tokens", "root", "hash", "ids")
    built = rows.mapInArrow(_rebuild("<u4" if wide else "<u2", with_ids), "part int, place long, doc_id long, n_tokens long, ids_crc32 long, ids binary")
    kept = ["part", "place", "doc_id", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]
    return built.select(*kept).join(starts, ["part", "place"]).select("doc_id", "start", "n_tokens", *kept[4:])


def store_digest(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    folder = write_store(docs, tokenizer_path, fresh_path(docs.sparkSession, "token-store"))
    return read_store(docs.sparkSession, folder, with_ids=False)
