"""Whole corpora against the tokenizers library and plain loops that share no code with the operators."""

import hashlib
import os
import re
import struct
import zlib
from collections import Counter

import pytest

from cairn.llm import ogg
from cairn.llm.queries import QUERIES, tokenizer_file

FOLDER = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def documents():
    import pyarrow.parquet as pq

    t = pq.read_table(f"{FOLDER}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    return dict(zip(t["doc_id"], t["text"]))


def encoded(documents, name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file(name))
    ids = sorted(documents)
    return {i: [*x.ids, 2] for i, x in zip(ids, t.encode_batch([documents[i] or "" for i in ids], add_special_tokens=False))}


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def test_store_holds_the_librarys_ids(spark, documents):
    want = encoded(documents, "byte_bpe_50k.json")
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in QUERIES["op7_token_store"](spark, FOLDER).collect()}
    at = 0
    for i in sorted(want):
        assert got.pop(i) == (at, len(want[i]), crc(want[i]))
        at += len(want[i])
    assert not got


def test_packing_holds_the_librarys_ids(spark, documents):
    want = encoded(documents, "word_bpe_49k.json")
    rows = QUERIES["op8_packing"](spark, FOLDER).collect()
    pieces, sequences = {}, {}
    for r in rows:
        assert r["ids_crc32"] == crc(want[r["doc_id"]][r["start"] : r["start"] + r["length"]]) and r["doc_tokens"] == len(want[r["doc_id"]])
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, ids in want.items():
        at = 0
        for start, length in sorted(pieces[i]):
            assert start == at and length > 0
            at += length
        assert at == len(ids)
    padding = total = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
        total += at
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    assert sorted(sequences) == list(range(len(sequences))) and padding < 0.02 * total


def crc_table():
    out = []
    for b in range(256):
        r = b << 24
        for _ in range(8):
            r = (r << 1 ^ 0x04C11DB7 if r & 0x80000000 else r << 1) & 0xFFFFFFFF
        out.append(r)
    return out


def read_ogg(media):
    """(packets of each serial number, granules of each) by the format's text, with its own checksum."""
    table, at, packets, granules = crc_table(), 0, {}, {}
    while at < len(media):
        assert media[at : at + 5] == b"OggS\0"
        granule, serial, number, stated = struct.unpack("<qIII", media[at + 6 : at + 26])
        n = media[at + 26]
        lacing = media[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        r = 0
        for b in media[at : at + 22] + bytes(4) + media[at + 26 : end]:
            r = (r << 8 & 0xFFFFFFFF) ^ table[r >> 24 ^ b]
        assert r == stated
        found = packets.setdefault(serial, [b""])
        p = at + 27 + n
        for x in lacing:
            found[-1] += media[p : p + x]
            p += x
            if x < 255:
                found.append(b"")
        granules.setdefault(serial, []).append(granule)
        at = end
    return {s: p[:-1] for s, p in packets.items()}, granules


def test_media_by_an_own_reader(spark, documents):
    got = {r["doc_id"]: r for r in QUERIES["op5_ogg"](spark, FOLDER).collect()}
    assert set(got) == set(documents)
    for k, (i, text) in enumerate(sorted(documents.items())):
        raw = (text or "").encode()
        payload = raw + b" " * (-len(raw) % 192 or 192 * (not raw))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        media = ogg.encode(text)
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
        crossings = sum((a >= 100) != (b >= 100) for a, b in zip(payload, payload[1:]))
        samples = -(-len(payload) // 4096)
        assert r["feature"] == f"packets={samples};ms={round(len(payload) / 8)};sum={sum(payload)};squares={sum(b * b for b in payload)};peak={max(payload)};crossings={crossings}"
        if k % 10 == 0:
            packets, granules = read_ogg(media)
            data = next(s for s, p in packets.items() if p[0].startswith(b"\x80pcm8"))
            assert b"".join(packets[data][1:]) == payload and granules[data][-1] == len(payload) and len(packets) == 2


def test_groups_by_brute_force(spark, documents):
    """Weighted Jaccard of all pairs that share a run of words, by an inverted list."""
    word = re.compile(r"[^\x20\x09-\x0D]+")
    ids = sorted(documents)
    bags = {i: Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if (w := word.findall(documents[i] or "")) else Counter() for i in ids}
    where, both = {}, {}
    for i in ids:
        for s, n in bags[i].items():
            for j, m in where.get(s, ()):
                both[j, i] = both.get((j, i), 0) + min(n, m)
            where.setdefault(s, []).append((i, n))
    size = {i: sum(b.values()) for i, b in bags.items()}
    group = {i: i for i in ids}

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    first = {}
    links = [(i, j) for (i, j), n in both.items() if n >= 0.8 * (size[i] + size[j] - n)]
    links += [(first.setdefault(documents[i] or "", i), i) for i in ids]
    for i, j in links:
        a, b = sorted((find(i), find(j)))
        group[b] = a
    got = {r["doc_id"]: r["class_id"] for r in QUERIES["op9_bagminhash"](spark, FOLDER).collect()}
    assert got == {i: find(i) for i in ids}
