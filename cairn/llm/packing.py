"""Order-preserving packing of token streams into windows of at most 4096 ids.

Documents stand in the order of doc_id. A window may end behind a document (free), behind a sentence (a
small penalty) or, where a stretch has no such end, at a coarse grid (a larger one). The cuts that minimise
padding plus penalties come from dynamic programming over the possible ends. Padding depends on a window's
start and end only through their difference, so the best start for each end is the smallest value of
cost + position among the starts within reach, which a monotone queue gives in constant time.

Each range partition is packed for itself, in blocks of about BLOCK_IDS ids, so memory is bounded; the open
rest of a block starts the next one. So cuts are the best ones within a block, and cuts and sequence numbers
depend on the number of partitions and on the size of blocks; that every id lies in one piece doesn't. A
partition's last rest is cut into powers of two, which need no padding, where that is cheaper.

Defined cases: a null or empty text is its end id alone. Equal doc_ids and null doc_ids stand together,
ordered by text; each row is a document of its own. Texts of any length are encoded whole. An empty table
gives no rows; columns that a caller adds are ignored.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .encoding import encoder, small_batches, with_end

WINDOW = 4096
END_ID = 2
SENTENCE_PENALTY = 16
GRID_PENALTY = 128
GRID = 256
#: Ids that are packed at once; what a block leaves open is carried over.
BLOCK_IDS = 1_000_000

SCHEMA = "doc_id long, start long, length long, doc_tokens long, part int, local_sequence long, offset long, ids binary"


def sentence_ends(path: str) -> np.ndarray:
    """A flag for each id: its token ends a sentence."""
    from tokenizers import Tokenizer

    vocab = Tokenizer.from_file(path).get_vocab()
    flags = np.zeros(max([*vocab.values(), END_ID]) + 1, bool)
    for token, i in vocab.items():
        flags[i] = token.removesuffix("</w>")[-1:] in (".", "!", "?")
    return flags


def possible_cuts(ids: np.ndarray, doc_ends: np.ndarray, is_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions behind which a window may end, penalty of each), ascending; doc_ends are such positions."""
    n = len(ids)
    penalty = np.full(n + 1, -1, np.int64)
    penalty[GRID::GRID] = GRID_PENALTY
    penalty[1:][is_end[ids]] = SENTENCE_PENALTY
    penalty[doc_ends] = 0
    penalty[0] = 0
    penalty[n] = 0
    at = np.flatnonzero(penalty >= 0)
    return at, penalty[at]


def best_cuts(at: np.ndarray, penalty: np.ndarray, window: int = WINDOW) -> list[int]:
    """The positions of at, from the first to the last, that cut at the least cost.

    cost[i] = penalty[i] + min over j within reach of cost[j] + window - (at[i] - at[j]). Gaps between
    neighbours are at most GRID, so there always is a j.
    """
    pos, pen = at.tolist(), penalty.tolist()
    value = [0] * len(pos)  # cost[j] + at[j]
    parent = [0] * len(pos)
    value[0] = pos[0]
    queue = deque([0])
    for i in range(1, len(pos)):
        p = pos[i]
        low = p - window
        while pos[queue[0]] < low:
            queue.popleft()
        j = queue[0]
        v = value[j] + window + pen[i]
        value[i], parent[i] = v, j
        while queue and value[queue[-1]] >= v:
            queue.pop()
        queue.append(i)
    cuts, i = [pos[-1]], len(pos) - 1
    while i:
        i = parent[i]
        cuts.append(pos[i])
    return cuts[::-1]


def tail_cuts(start: int, end: int, window: int = WINDOW) -> list[int]:
    """Ends of the windows of a rest: one padded window, or powers of two if their cuts cost less."""
    n = end - start
    bits = [b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]
    if n == 0 or n > window or (len(bits) - 1) * GRID_PENALTY >= window - n:
        return [end] if n else []
    return [start + sum(1 << b for b in bits[: k + 1]) for k in range(len(bits))]


def _pack_partition(path: str, window: int, block_ids: int):
    def run(batches):
        from pyspark import TaskContext

        enc, is_end = encoder(path, False), sentence_ends(path)
        part = TaskContext.get().partitionId()
        held: list[tuple[int | None, int, int, np.ndarray]] = []  # (doc_id, ids before, ids in the document, ids)
        count = sequence = 0

        def flush(last: bool):
            nonlocal held, count, sequence
            if not held:
                return
            ids = np.concatenate([x[3] for x in held])
            begins = np.cumsum([0, *(len(x[3]) for x in held)])
            cuts = best_cuts(*possible_cuts(ids, begins[1:], is_end), window)
            if last:
                ends = cuts[1:-1] + tail_cuts(cuts[-2], cuts[-1], window)
            else:
                ends = cuts[1:-1]
            rows, k, a = [], 0, 0
            for end in ends:
                offset = 0
                while a < end:
                    while begins[k + 1] <= a:
                        k += 1
                    doc, before, total, _ = held[k]
                    b = min(end, int(begins[k + 1]))
                    rows.append((doc, before + a - int(begins[k]), b - a, total, part, sequence, offset, ids[a:b].astype("<u4").tobytes()))
                    offset += b - a
                    a = b
                sequence += 1
            rest = []
            for j in range(k, len(held)):
                doc, before, total, x = held[j]
                skip = max(0, a - int(begins[j]))
                if skip < len(x):
                    rest.append((doc, before + skip, total, x[skip:]))
            held, count = rest, len(ids) - a
            for i in range(0, len(rows), 4000):
                cols = list(zip(*rows[i : i + 4000]))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["doc_id", "start", "length", "doc_tokens", "part", "local_sequence", "offset", "ids"])

        for batch in small_batches(batches, "text", 32_000_000):
            ids, ends = with_end(*enc.encode(batch.column("text")), END_ID)
            for i, doc in enumerate(batch.column("doc_id").to_pylist()):
                x = ids[ends[i] : ends[i + 1]]
                held.append((doc, 0, len(x), x))
                count += len(x)
                if count >= block_ids:
                    yield from flush(False)
        yield from flush(True)

    return run


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, block_ids: int = BLOCK_IDS, partitions: int | None = None) -> DataFrame:
    """A row per piece: doc_id, start, length, doc_tokens, sequence_id, offset and its ids (unsigned 32 bits, little-endian).

    The order of doc_id comes from range partitions. Pieces are written once, with sequence numbers of
    their partition; a count per partition then makes the numbers of all sequences gapless.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = ordered.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    pieces = cut(ordered.mapInArrow(_pack_partition(tokenizer_path, window, block_ids), SCHEMA), "packed")
    per_part = pieces.groupBy("part").agg((F.max("local_sequence") + 1).alias("n"))
    base = per_part.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    # One row per range partition: a bound that doesn't grow with the rows.
    out = pieces.join(F.broadcast(base), "part")
    return out.select("doc_id", "start", "length", "doc_tokens", (F.col("base") + F.col("local_sequence")).alias("sequence_id"), "offset", "ids")


def digest(pieces: DataFrame) -> DataFrame:
    """The packed pieces with a checksum in place of their ids."""
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
