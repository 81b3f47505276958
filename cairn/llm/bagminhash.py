"""Near-duplicates by weighted Jaccard similarity: BagMinHash signatures, bands, exact verification.

A document is the multiset of its runs of five words (a shorter one is a single run). BagMinHash: each
shingle owns Poisson processes in time, one for each dyadic interval [0,1), [1,2), [2,4), ... of weight.
A process of [2^k, 2^(k+1)) stands for the tree of its halves: a point belongs to the half, quarter, ...
that the bits of its weight name, from the highest on (all bits come from one hash), and counts if that
weight lies below the shingle's. Each point has a slot of the signature; a slot keeps its earliest point.
Two documents agree in a slot with probability equal to their weighted Jaccard similarity. Points are made
in the order of time and only up to a time by which all slots are filled, so large documents cost little
more than small ones. One byte of a slot's point is kept.

Groups: copies of a text are one row from the start. Bands of slots, drawn by a fixed rule, give keys.
Members of a key are compared with the key's least member; links of 0.8 and more join groups. In keys that
still hold more than one group, members of different groups are compared in blocks of bounded size: the
largest group of a key is dealt out once, the others meet each of its blocks. A first pass compares
signatures alone and gives back the members that have a partner; only their texts are fetched, and a second
pass compares shingles, where each link found joins groups and so spares comparisons. Every link is exact.
Groups are connected components, found with distributed joins. Intermediate tables are deleted when used up.

Defined cases: null and empty texts are copies of each other and of no other text. Rows that repeat are
copies. A null doc_id stays a row; a group's class_id is its least doc_id that isn't null. An empty table
gives no rows. Columns that a caller adds are ignored, or pass through in keep_one; of rows equal in doc_id
and text it keeps the one whose JSON form comes first.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .common import BLANK_RUN, BLANKS, Scratch, cut, free_name, thinned
from .encoding import ragged_take, small_batches

SHINGLE = 5
SIMILARITY = 0.8
SLOTS = 256
BANDS = 64
ROWS = 8
#: Pairs that agree in fewer slots than this share aren't verified: five standard deviations below 0.8. With 0 all are.
LEAST_AGREEMENT = 0.675
#: Rows of a key that are compared in one task; larger keys are cut into blocks of this size.
BLOCK = 512
#: Shingles that a block keeps in memory for its comparisons (16 bytes each).
HELD_SHINGLES = 3_000_000

_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def unit(x: np.ndarray) -> np.ndarray:
    """(0, 1] from the 53 high bits."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle hash, weight), ascending by document, for all shingles of texts."""
    bare = pc.utf8_trim(pc.fill_null(texts.cast(pa.large_string()), ""), BLANKS)
    split = pc.split_pattern_regex(bare, BLANK_RUN)
    offsets = np.asarray(split.offsets)
    coded = split.flatten().dictionary_encode()
    offsets = offsets - offsets[0]
    names = coded.dictionary.to_pylist()
    by_word = np.array([int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little") for w in names], dtype=np.uint64) if names else np.zeros(0, np.uint64)
    word = by_word[np.asarray(coded.indices)] if names else by_word
    count = np.diff(offsets)
    empty = np.asarray(pc.equal(bare, ""))
    runs = np.where(empty, 0, np.maximum(count - SHINGLE + 1, 1))
    doc = np.repeat(np.arange(len(runs)), runs)
    first = ragged_take(np.arange(len(word)), offsets[:-1], runs)
    last = np.repeat(offsets[1:], runs)
    h = np.full(len(doc), 0x5EED, np.uint64)
    for k in range(SHINGLE):
        at = first + k
        inside = at < last
        h = mix(h * _M3 + np.where(inside, word[np.minimum(at, max(len(word) - 1, 0))] if len(word) else 0, np.uint64(k + 1)).astype(np.uint64))
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    starts = np.flatnonzero(new)
    return doc[starts], h[starts], np.diff(np.append(starts, len(doc)))


def signatures(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, n: int, slots: int = SLOTS) -> np.ndarray:
    """An n by slots array of the earliest points' hashes; rows without shingles are zero."""
    best_t = np.full(n * slots, np.inf)
    best_p = np.zeros(n * slots, np.uint64)
    # One process for each dyadic interval of weight that begins below the shingle's weight.
    levels = np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64) + 1
    p_doc, p_level = np.repeat(doc, levels), ragged_take(np.arange(64), np.zeros(len(levels), np.int64), levels)
    p_weight = np.repeat(weight, levels)
    p_key = mix(np.repeat(h, levels) + _M3 * (p_level + 1).astype(np.uint64))
    low = np.where(p_level == 0, 0, np.left_shift(1, np.maximum(p_level - 1, 0)))
    width = np.maximum(low, 1)
    rate = np.bincount(p_doc, weights=np.minimum(p_weight, low + width) - low, minlength=n)
    # By this time all slots of a document are filled, but for one in some thousands; those go on.
    limit = np.where(rate > 0, slots * (np.log(slots) + 8.0) / np.maximum(rate, 1e-9), 0.0)
    time = np.zeros(len(p_doc))
    live = np.arange(len(p_doc))
    k = 0
    while len(live):
        k += 1
        seed = mix(p_key[live] + np.uint64(k * int(_M3) % 2**64))
        t = time[live] - np.log(unit(mix(seed ^ _M1))) / width[live]
        time[live] = t
        on = t <= limit[p_doc[live]]
        live, seed, t = live[on], seed[on], t[on]
        # The weight of a point: its bits choose halves of the interval from the top.
        y = low[live] + (unit(mix(seed ^ _M2)) * width[live] * (1 - 2.0**-53)).astype(np.int64)
        hit = y < p_weight[live]
        slot = p_doc[live][hit] * slots + (mix(seed[hit] ^ _M3) >> np.uint64(40)).astype(np.int64) % slots
        t, point = t[hit], seed[hit]
        early = t < best_t[slot]
        slot, t, point = slot[early], t[early], point[early]
        order = np.argsort(t)[::-1]  # the earliest of a slot is written last
        best_t[slot[order]] = t[order]
        best_p[slot[order]] = point[order]
        if not len(live):
            open_ = np.isinf(best_t.reshape(n, slots)).any(1) & (rate > 0)
            if open_.any():
                limit[open_] *= 2
                live = np.flatnonzero(open_[p_doc])
                best_t.reshape(n, slots)[open_] = np.inf
                time[live] = 0.0
                k = 0
    return best_p.reshape(n, slots)


def band_slots(slots: int = SLOTS, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """The slots of each band: a fixed rule spreads them so that bands share few slots."""
    order = np.argsort(mix(np.arange(bands * rows, dtype=np.uint64) + np.uint64(77)), kind="stable") % slots
    return np.array([np.sort(b) for b in order.reshape(bands, rows)])


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A key for each row of sig and band, as uint64."""
    chosen = band_slots()
    x = np.tile(np.arange(1, len(chosen) + 1, dtype=np.uint64), (len(sig), 1))
    for r in range(chosen.shape[1]):
        x = mix(x * _M3 + sig[:, chosen[:, r]])
    return x


def sig_matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _sign(batches):
    """doc_id, mark, sig; texts that repeat in a batch are signed once, those without words not at all."""
    for batch in small_batches(batches, "text", 3_000_000):
        codes = np.asarray(batch.column("mark").dictionary_encode().indices)
        _, where = np.unique(codes, return_index=True)
        doc, h, weight = shingles(batch.column("text").take(pa.array(where)))
        small = (signatures(doc, h, weight, len(where)) & np.uint64(255)).astype(np.uint8)
        signed = np.zeros(len(where), bool)
        signed[doc] = True
        sig = pa.array([r.tobytes() if ok else None for r, ok in zip(small, signed)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), sig.take(pa.array(codes))], names=["doc_id", "mark", "sig"])


def _bands(batches):
    for batch in batches:
        if batch.num_rows:
            keys = band_keys(sig_matrix(batch.column("sig")))
            uid = np.repeat(batch.column("uid").to_numpy(), keys.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(uid), pa.array(keys.view(np.int64).ravel())], names=["uid", "key"])


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=-1)


@F.pandas_udf(DoubleType())
def _agree(a: pd.Series, b: pd.Series) -> pd.Series:
    if not len(a):
        return pd.Series([], dtype="float64")
    x = np.frombuffer(b"".join(a), np.uint8).reshape(len(a), -1)
    y = np.frombuffer(b"".join(b), np.uint8).reshape(len(b), -1)
    return pd.Series(agreement(x, y))


def exact_similarity(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Weighted Jaccard similarity of texts pair by pair."""
    n = len(left)
    d1, h1, w1 = shingles(left)
    d2, h2, w2 = shingles(right)
    doc, h = np.concatenate([d1, d2]), np.concatenate([h1, h2])
    w = np.concatenate([w1, w2])
    order = np.lexsort((h, doc))
    doc, h, w = doc[order], h[order], w[order]
    twin = np.flatnonzero((doc[1:] == doc[:-1]) & (h[1:] == h[:-1]))
    both = np.bincount(doc[twin], weights=np.minimum(w[twin], w[twin + 1]), minlength=n)
    total = np.bincount(doc, weights=w, minlength=n)
    return both / np.maximum(total - both, 1)


def _verify(batches):
    for wide in small_batches(batches, "text_a", 2_000_000):
        for batch in small_batches([wide], "text_b", 2_000_000):
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                s = exact_similarity(part.column("text_a"), part.column("text_b"))
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(s)], names=["a", "b", "similarity"])


def place_of(doc_id: Column, mark: Column) -> Column:
    """What names a row: its doc_id and the MD5 of its text."""
    return F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), mark)


def texts_of(uids: DataFrame, once: DataFrame, rows: DataFrame, tables: Scratch) -> DataFrame:
    """(uid, text) of uids: of rows, those of the least doc_id of a text."""
    wanted = once.join(uids.select("uid").distinct(), "uid", "left_semi").select("uid", place_of(F.col("least"), F.col("mark")).alias("place"))
    wanted = tables.cut(wanted, "wanted")
    found = thinned(rows.select(place_of(F.col("doc_id"), F.col("mark")).alias("place"), "text"), wanted, "place").join(wanted, "place")
    return found.dropDuplicates(["place"]).select("uid", "text")


def verify_pairs(pairs: DataFrame, once: DataFrame, rows: DataFrame, threshold: float, least_agreement: float, tables: Scratch) -> DataFrame:
    """The pairs (a, b) that are similar enough, with their similarity."""
    sig = once.select("uid", "sig")
    near = pairs.join(sig.withColumnsRenamed({"uid": "a", "sig": "sig_a"}), "a").join(sig.withColumnsRenamed({"uid": "b", "sig": "sig_b"}), "b")
    near = near.where(_agree("sig_a", "sig_b") >= least_agreement).select("a", "b")
    near = tables.cut(near, "near-pairs")
    t = texts_of(near.select(F.col("a").alias("uid")).unionByName(near.select(F.col("b").alias("uid"))), once, rows, tables)
    both = near.join(t.withColumnsRenamed({"uid": "a", "text": "text_a"}), "a").join(t.withColumnsRenamed({"uid": "b", "text": "text_b"}), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(_verify, "a long, b long, similarity double").where(F.col("similarity") >= threshold)


def connected(edges: DataFrame, tables: Scratch | None = None) -> DataFrame:
    """(uid, root) for each end of an edge (a, b): the least uid of its component.

    Alternating large-star and small-star steps until every end hangs on a root. Each step's minima are
    written before they are joined, so that adaptive execution can split the rows of a hub.
    """
    tables = tables or Scratch(edges.sparkSession)
    edges = tables.cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR (up = 1 AND down = 1)").isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = tables.cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = tables.cut(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "large-star")
        tables.drop(edges, least)
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(down.select("a", F.col("m").alias("b")))
        edges = tables.cut(small.where("a <> b").distinct(), "small-star")
        tables.drop(large)
    return tables.cut(edges.select(F.col("a").alias("uid"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("uid"), F.col("b").alias("root")).distinct()), "groups")


def _own_shingles(text: str) -> tuple[np.ndarray, np.ndarray]:
    _, h, w = shingles(pa.array([text]))
    return h, w


def _overlap(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> float:
    _, i, j = np.intersect1d(one[0], two[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(one[1][i], two[1][j]).sum())
    return both / max(int(one[1].sum() + two[1].sum()) - both, 1)


def block_pairs(uid, root, own, sig, keys, band: int, one: int, two: int, least_agreement: float):
    """(i, partners) for members of a block: those of other groups that agree enough, the nearest first.

    A pair is compared in the first band alone that its members share.
    """
    right = np.flatnonzero(own == two)
    for i in np.flatnonzero(own == one).tolist():
        other = right[uid[right] > uid[i]] if one == two else right
        other = other[root[other] != root[i]]
        other = other[(keys[other] == keys[i]).argmax(axis=1) == band] if len(other) else other
        if len(other):
            near = agreement(sig[other], sig[i])
            found = other[np.argsort(-near, kind="stable")][: int((near >= least_agreement).sum())]
            if len(found):
                yield i, found


def block_links(uid, root, own, sig, keys, texts, band: int, one: int, two: int, threshold: float, least_agreement: float = LEAST_AGREEMENT):
    """Links between different groups of a block; a link joins its groups, so pairs within one need no comparison."""
    group = {r: r for r in root.tolist()}

    def find(r: int) -> int:
        while group[r] != r:
            group[r] = group[group[r]]
            r = group[r]
        return r

    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    size = 0

    def get(i: int) -> tuple[np.ndarray, np.ndarray]:
        nonlocal size
        if i not in held:
            if size > HELD_SHINGLES:
                held.clear()
                size = 0
            held[i] = _own_shingles(texts[i])
            size += len(held[i][0])
        return held[i]

    for i, partners in block_pairs(uid, root, own, sig, keys, band, one, two, least_agreement):
        for j in partners.tolist():
            x, y = find(int(root[i])), find(int(root[j]))
            if x != y and _overlap(get(i), get(j)) >= threshold:
                group[max(x, y)] = min(x, y)
                yield int(max(uid[i], uid[j])), int(min(uid[i], uid[j]))


def _blocks(batches):
    """The rows of each block, from rows sorted by key and block."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, one, two = (batch.column(c).to_numpy() for c in ("key", "one", "two"))
        new = np.flatnonzero((key[1:] != key[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])) + 1
        cuts = [0, *new.tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            this = (key[a], one[a], two[a])
            if this != last and held:
                yield pa.Table.from_batches(held)
                held = []
            last = this
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _block_arrays(rows: pa.Table) -> tuple:
    """uid, root, own, sig, keys, the band of the key, and the two sides of a block."""
    uid, root, own = (rows.column(c).to_numpy() for c in ("uid", "root", "own"))
    key, one, two = (rows.column(c)[0].as_py() for c in ("key", "one", "two"))
    sig = sig_matrix(rows.column("sig"))
    keys = band_keys(sig)
    return uid, root, own, sig, keys, int((keys[0].view(np.int64) == key).argmax()), one, two


MEMBER = "key long, one int, two int, own int, uid long, root long, sig binary"


def _near_members(least_agreement: float):
    """The members of blocks that have a partner by signature."""

    def run(batches):
        for rows in _blocks(batches):
            stays = np.zeros(len(rows), bool)
            for i, partners in block_pairs(*_block_arrays(rows), least_agreement):
                stays[i] = stays[partners] = True
            if stays.any():
                yield from rows.filter(pa.array(stays)).to_batches()

    return run


def _open_links(threshold: float, least_agreement: float):
    """Links of different groups, from members with their texts."""

    def run(batches):
        for rows in _blocks(batches):
            uid, root, own, sig, keys, band, one, two = _block_arrays(rows)
            found = list(block_links(uid, root, own, sig, keys, rows.column("text").to_pylist(), band, one, two, threshold, least_agreement))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])

    return run


def open_members(crowded: DataFrame, groups: DataFrame, tables: Scratch) -> DataFrame:
    """Members (key, one, two, own, uid, root) of keys with more than one group, a row for each block they are in.

    A key of up to BLOCK members is one block. Of a larger one, the largest group and the rest are cut into
    blocks of about that size; blocks of the rest meet those of the largest group and, if they hold several
    groups, each other. So members of a large group that is nearly the whole key aren't copied.
    """
    member = tables.cut(crowded.select("key", "uid").join(groups, "uid", "left").withColumn("root", F.coalesce("root", "uid")), "members")
    per = member.groupBy("key", "root").agg(F.count("*").alias("n"))
    mixed = per.groupBy("key").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("n"), F.count("*").alias("groups")).where("groups > 1")
    mixed = tables.cut(mixed.select("key", F.col("top.root").alias("largest"), F.col("top.n").alias("n_largest"), "n", "groups"), "mixed-keys")
    of = lambda n: F.when(F.col("n") <= BLOCK, F.lit(0)).otherwise(F.ceil(n / BLOCK)).cast("int")
    member = member.join(mixed, "key").withColumns({"first": of(F.col("n_largest")), "rest": of(F.col("n") - F.col("n_largest"))})
    dealt = lambda n: F.pmod(F.xxhash64("uid", "key"), F.greatest(n, F.lit(1))).cast("int")
    in_first = F.col("root") == F.col("largest")
    member = member.withColumn("own", F.when(F.col("first") == 0, F.lit(0)).when(in_first, dealt(F.col("first"))).otherwise(F.col("first") + dealt(F.col("rest"))))
    run = lambda a, b: F.sequence(a, b - 1)
    others = run(F.col("first"), F.col("first") + F.col("rest"))
    meets = F.when(F.col("first") == 0, F.array(F.lit(0))).when(in_first, others).when(F.col("groups") > 2, run(F.lit(0), F.col("first") + F.col("rest"))).otherwise(run(F.lit(0), F.col("first")))
    member = member.withColumn("other", F.explode(meets))
    return member.select("key", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), "own", "uid", "root")


def _in_blocks(member: DataFrame) -> DataFrame:
    n = int(member.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return member.repartition(n, "key", "one", "two").sortWithinPartitions("key", "one", "two")


def similar_groups(once: DataFrame, rows: DataFrame, tables: Scratch, threshold: float = SIMILARITY, least_agreement: float = LEAST_AGREEMENT) -> DataFrame:
    """(uid, root) of every text of once (uid, mark, least, sig) that is linked to another; rows hold the texts."""
    bands = once.where("sig IS NOT NULL").select("uid", "sig").mapInArrow(_bands, "uid long, key long")
    keys = bands.groupBy("key").agg(F.min("uid").alias("leader"), F.count("*").alias("n")).where("n > 1")
    crowded = tables.cut(bands.join(tables.cut(keys.select("key", "leader"), "keys"), "key"), "bands")
    stars = crowded.where("uid <> leader").select(F.col("uid").alias("a"), F.col("leader").alias("b")).distinct()
    links = tables.cut(verify_pairs(stars, once, rows, threshold, least_agreement, tables).select("a", "b"), "links")
    groups = connected(links, tables)

    # Keys whose members aren't all of one group yet: members of different groups, first by their signatures.
    member = open_members(crowded, groups, tables).join(once.select("uid", "sig"), "uid").select("key", "one", "two", "own", "uid", "root", "sig")
    member = tables.cut(_in_blocks(member).mapInArrow(_near_members(least_agreement), MEMBER), "near-members")
    if member.isEmpty():
        return groups
    texts = texts_of(member, once, rows, tables)
    more = _in_blocks(member.join(texts, "uid").select("key", "one", "two", "own", "uid", "root", "sig", "text")).mapInArrow(_open_links(threshold, least_agreement), "a long, b long").distinct()
    # Groups are stars already: their edges and the new links give the final groups.
    return connected(groups.select(F.col("uid").alias("a"), F.col("root").alias("b")).unionByName(more), tables)


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = SIMILARITY, least_agreement: float = LEAST_AGREEMENT) -> DataFrame:
    """A row per text of docs: mark (its MD5), least (its least doc_id), root (its group), class_id (the group's least doc_id)."""
    rows = _marked(docs, doc_id, text)
    with Scratch(docs.sparkSession) as tables:
        signed = tables.cut(rows.mapInArrow(_sign, "doc_id long, mark string, sig binary"), "signatures")
        once = signed.groupBy("mark").agg(F.min("doc_id").alias("least"), F.max("sig").alias("sig"))
        # The numbers of texts are fixed when the table is written.
        once = tables.cut(once.select(F.monotonically_increasing_id().alias("uid"), "mark", "least", "sig"), "texts")
        tables.drop(signed)
        groups = similar_groups(once, rows, tables, threshold, least_agreement)
        named = once.select("uid", "mark", "least")
        per = tables.cut(groups.join(named, "uid").groupBy("root").agg(F.min("least").alias("class_id")), "class-ids")
        named = named.join(groups, "uid", "left").withColumn("root", F.coalesce("root", "uid")).join(per, "root", "left")
        return cut(named.select("mark", "least", "root", F.coalesce("class_id", "least").alias("class_id")), "classes")


def _marked(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return rows.select("doc_id", F.md5("text").alias("mark"), "text")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = SIMILARITY, least_agreement: float = LEAST_AGREEMENT) -> DataFrame:
    """A row per row of docs: doc_id, mark (its text's MD5), root (its group) and class_id, the least doc_id of the group."""
    named = classes(docs, doc_id, text, threshold, least_agreement).select("mark", "root", "class_id")
    return _marked(docs, doc_id, text).select("doc_id", "mark").join(named, "mark")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = SIMILARITY, least_agreement: float = LEAST_AGREEMENT) -> DataFrame:
    """docs with one row of each group: that of the least doc_id that isn't null."""
    found = classes(docs, doc_id, text, threshold, least_agreement)
    first = F.min(F.struct(F.col("least").isNull().alias("none"), "least", "mark")).alias("first")
    name = free_name(docs, "_kept")
    kept = cut(found.groupBy("root").agg(first).select(place_of(F.col("first.least"), F.col("first.mark")).alias(name)), "kept")
    placed = docs.withColumn(name, place_of(F.col(doc_id).cast("long"), F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")))))
    # Rows equal in doc_id and text are rare: they are settled apart, the rest needs no aggregation of texts.
    twice = placed.groupBy(name).agg(F.count("*").alias("n")).where("n > 1").select(name)
    twice = cut(twice.join(kept, name, "left_semi"), "kept-twice")
    if twice.isEmpty():
        return placed.join(kept, name, "left_semi").select(*docs.columns)
    single = placed.join(kept.join(twice, name, "left_anti"), name, "left_semi").select(*docs.columns)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    chosen = placed.join(twice, name, "left_semi").groupBy(name).agg(F.min_by(whole, F.to_json(whole)).alias("row"))
    return single.unionByName(chosen.select("row.*"))
