"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for each operator."""

import hashlib
import os
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from cairn.llm import bagminhash, encoding, extraction, line_dedup, mixing, ogg, packing, quality, token_store, url_filters, warc
from cairn.llm.common import fresh_path, shared_folder, thinned
from cairn.llm.encoding import Encoder, encoder
from cairn.llm.queries import tokenizer_file

DOCS = "doc_id long, text string, source string"
LONG = "word " * 3000 + "end."
PROSE = [" ".join(f"w{(i * 7 + k * 13) % 97}x{k}".translate({48 + d: 97 + d for d in range(10)}) for i in range(80)) for k in range(12)]
ROWS = [(1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, LONG, "b"), (5, PROSE[0], "b"), (5, PROSE[0], "b"), (None, PROSE[1], "a"), (7, PROSE[1], None), (8, PROSE[2] + " more", "é"), (9, PROSE[2], "c")]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_quality_counts_match_a_plain_loop(spark, docs, none):
    for r in quality.judge(docs).collect():
        words = WORD.findall(r["text"] or "")
        tri = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        n = Counter(tri)
        hit = {i + k for i, t in enumerate(tri) if n[t] > 1 for k in range(3)}
        lines = [x for x in (r["text"] or "").split("\n") if WORD.search(x)]
        assert (r["n_words"], r["n_repeat_words"], r["n_dup_lines"], r["word_chars"]) == (len(words), len(hit), len(lines) - len(set(lines)), sum(map(len, words)))
        assert r["base_failed"] == (len(words) < 50 or 100 * len(hit) > 50 * len(words))
        assert not (r["base_failed"] and r["kept"])
    assert quality.judge(none, order=quality.RULES).count() == 0 and quality.keep_good(none).count() == 0


def test_quality_with_clashing_columns(docs):
    clash = docs.withColumn("n_words", F.lit(-1)).withColumn("kept", F.lit("mine"))
    got = quality.keep_good(clash)
    assert got.columns == clash.columns and {r["kept"] for r in got.collect()} == {"mine"}


def test_quality_with_names_of_its_own_columns(docs):
    clash = docs
    for c in ("_w", "_h", "_lines", "_p", "_s", "_twice", "_x_words", "_x_alive0", "n_words"):
        clash = clash.withColumn(c, F.lit("mine"))
    good = sorted(r["doc_id"] or 0 for r in quality.keep_good(docs).collect())
    got = quality.keep_good(clash, order=(*quality.RULES[::-1], *quality.BASE)).collect()
    assert sorted(r["doc_id"] or 0 for r in got) == good and all(set(r[3:]) == {"mine"} for r in got)
    judged = quality.judge(clash, order=quality.RULES)
    assert set(clash.columns) <= set(judged.columns) and all(r["_x_words"] == "mine" and r["n_words"] != "mine" for r in judged.collect())


def test_rule_sample_needs_no_exchange(docs):
    plan = docs.sample(0.2, seed=7).coalesce(1).limit(5).groupBy().count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 0


def test_rule_order_does_not_change_verdicts(docs):
    a = quality.judge(docs, order=quality.RULES).select("doc_id", "kept").collect()
    b = quality.judge(docs, order=quality.RULES[::-1]).select("doc_id", "kept").collect()
    assert sorted(map(str, a)) == sorted(map(str, b))
    order = [x[2] / x[1] for x in quality.order_rules(docs)]
    assert order == sorted(order, reverse=True)


def test_lines_on_many_sites_go_but_for_the_first(spark, none):
    rows = [(i, f"own line {i}\n shared line \n\nlast {i}", f"s{i % 12}") for i in range(24)] + [(None, None, None), (99, "", "s1"), (50, "twice\ntwice", "s1")]
    df = spark.createDataFrame(rows, DOCS).withColumn("n_lines", F.lit("x"))
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(df.drop("n_lines")).collect()}
    assert got[0]["text"] == rows[0][1] and got[1]["text"] == "own line 1\n\nlast 1" and got[1]["n_removed"] == 1
    assert got[None]["text"] is None and got[99]["text"] == "" and got[50]["text"] == "twice\ntwice"
    kept = line_dedup.cleaned(df)
    assert kept.columns == df.columns and kept.where("n_lines = 'x'").count() == len(rows)
    assert line_dedup.dedup_lines(none).count() == 0


def test_long_passages_go_from_three_sites_on(spark):
    passage = " ".join(f"p{i}" for i in range(50))
    rows = [(i, f"own {i}\n{passage}", f"s{i % 3}") for i in range(6)] + [(10 + i, f"{passage} two", f"s{i % 2}") for i in range(6)] + [(20, LONG, "a"), (20, LONG, "a")]
    df = spark.createDataFrame(rows, DOCS)
    for c in ("_lines", "_gone", "_doc", "_mark", "_n_lines", "_n_removed"):
        df = df.withColumn(c, F.lit("mine"))
    got = [(r["doc_id"], r["text"], r["_lines"]) for r in line_dedup.dedup_lines(df).collect()]
    want = [(i, t if i in (0, 20) or i >= 10 else f"own {i}", "mine") for i, t, _ in rows]
    assert sorted(got) == sorted(want)
    plain = line_dedup.cleaned(df)
    assert plain.columns == df.columns and sorted((r["doc_id"], r["text"]) for r in plain.collect()) == sorted(r[:2] for r in rows)


def test_spread_near_the_threshold_is_exact(spark):
    rows = [(100 * n + i, f"line {n}", f"s{i}") for n in range(7, 14) for i in range(n)]
    lines = line_dedup.line_rows(spark.createDataFrame(rows, DOCS), "doc_id", "text", "source")
    assert line_dedup.spread_lines(lines).count() == 4


def test_thinned_rows_hold_all_wanted_ones(spark):
    df = spark.range(20000).select(F.concat(F.lit("k"), "id").alias("k"), F.lit(1).alias("_x_bucket"))
    wanted = df.where("_x_bucket = 1 and k like '%77%'").select("k")
    got = {r["k"] for r in thinned(df, wanted, "k").collect()}
    want = {f"k{i}" for i in range(20000) if "77" in str(i)}
    assert want <= got and len(got) < len(want) + 20
    assert thinned(df, wanted.limit(0), "k").count() == 0


@pytest.mark.parametrize("block", [512, 4])
def test_near_duplicates_by_brute_force(spark, none, monkeypatch, block):
    monkeypatch.setattr(bagminhash, "BLOCK", block)
    base = [f"t{i}" for i in range(120)]
    texts = [" ".join(base), " ".join(base[:-4] + ["q"] * 4), " ".join(base[::-1]), " ".join(base), None, "", "a b", "a b", "a b c"] + PROSE
    for k in range(30):
        x = list(base)
        x[k] = f"z{k}"
        texts.append(" ".join(x))
    rows = [(None if i == 3 else i, t, "s") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS).withColumn("root", F.lit(1)).withColumn("_kept", F.lit(2))
    got = [(r["doc_id"], r["class_id"]) for r in bagminhash.near_duplicates(df).collect()]
    bags = [Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := WORD.findall(t or "")) else Counter() for t in texts]
    group = list(range(len(texts)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both, either = sum((bags[i] & bags[j]).values()), sum((bags[i] | bags[j]).values())
            if (texts[i] or "") == (texts[j] or "") or either and both / either >= 0.8:
                group[find(i)] = find(j)
    least = {}
    for i, (doc, _, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), 10**9), 10**9 if doc is None else doc)
    want = [(doc, least[find(i)]) for i, (doc, _, _) in enumerate(rows)]
    assert sorted(got, key=str) == sorted(want, key=str)
    if block == 4:
        return
    assert not [x for x in os.listdir(shared_folder(spark).removeprefix("file://") + "/cairn") if x.split("-")[0] in ("signatures", "texts", "bands", "edges", "members")]
    again = df.withColumn("root", F.lit(0)).unionByName(df)
    kept = bagminhash.keep_one(again)
    rows = kept.collect()
    assert kept.columns == again.columns and {r["root"] for r in rows} == {0} and len(rows) == len(least)
    assert sorted(((r["doc_id"], r["class_id"]) for r in bagminhash.near_duplicates(df, least_agreement=0.0).collect()), key=str) == sorted(want, key=str)
    assert bagminhash.near_duplicates(none).count() == 0 and bagminhash.keep_one(none).count() == 0


def test_block_links_find_what_leaders_missed():
    texts = [" ".join(f"a{i}" for i in range(100)), " ".join([f"a{i}" for i in range(96)] + ["x"] * 4), " ".join(f"b{i}" for i in range(100))]
    doc, h, w = bagminhash.shingles(pa.array(texts))
    sig = bagminhash.signatures(doc, h, w, 3)
    small = (sig & np.uint64(255)).astype(np.uint8)
    keys = np.tile(np.arange(4), (3, 1))
    found = list(bagminhash.block_links(np.array([5, 3, 9]), np.array([5, 3, 9]), np.zeros(3, int), small, keys, texts, 0, 0, 0, 0.8))
    assert found == [(5, 3)]
    assert not list(bagminhash.block_links(np.array([5, 3, 9]), np.array([5, 3, 9]), np.zeros(3, int), small, keys, texts, 1, 0, 0, 0.8))


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(3)
    for _ in range(3):
        a, b = rng.integers(1, 40, 60), rng.integers(1, 40, 60)
        h = np.tile(np.arange(60, dtype=np.uint64) * np.uint64(977) + np.uint64(5), 2)
        s = bagminhash.signatures(np.repeat([0, 1], 60), h, np.concatenate([a, b]), 2, 8192)
        assert abs((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.03


def test_connected_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (100, 102), (7, 7)]
    got = {r["uid"]: r["root"] for r in bagminhash.connected(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


def test_mix_targets_and_thresholds(spark, docs, none):
    rows = [(i, "w " * (1 + i % 9), f"s{i % 5}" if i % 11 else None) for i in range(900)] + [(2000 + i, "w " * 400, "tiny") for i in range(2)]
    plan = mixing.plan_mix(spark.createDataFrame(rows, DOCS)).collect()
    size, taken, target = Counter(), Counter(), {}
    for r in plan:
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["size"] * r["copies"]
        target[r["source"]] = r["target"]
        assert r["copies"] <= 2
    names = sorted(x for x in size if x is not None) + [None]
    weight = {n: (3, 1, 2)[i % 3] for i, n in enumerate(names)}
    want, fixed = {n: 1.5 * sum(size.values()) * weight[n] / sum(weight.values()) for n in names}, set()
    while over := [n for n in names if n not in fixed and want[n] > 2 * size[n]]:
        fixed |= set(over)
        want.update({n: 2.0 * size[n] for n in over})
        rest = 1.5 * sum(size.values()) - sum(want[n] for n in fixed)
        want.update({n: rest * weight[n] / sum(weight[m] for m in names if m not in fixed) for n in names if n not in fixed})
    for n in names:
        assert abs(target[n] - want[n]) < 1e-6
        assert abs(taken[n] - want[n]) <= 9 or n == "tiny"
    mixed = mixing.take_mix(docs.withColumn("copies", F.lit(7)))
    assert mixed.columns == [*docs.columns, "copies"]
    clash = docs
    for c in ("_id", "_src", "_copies", "_copy", "_x_key", "_x_copies"):
        clash = clash.withColumn(c, F.lit("mine"))
    wanted = sorted((str(r["doc_id"]), str(r["source"])) for r in mixing.plan_mix(docs).collect() for _ in range(r["copies"]))
    taken = mixing.take_mix(clash).collect()
    assert sorted((str(r["doc_id"]), str(r["source"])) for r in taken) == wanted and all(set(r[3:]) == {"mine"} for r in taken)
    assert mixing.plan_mix(docs).count() == len(ROWS) and mixing.plan_mix(none).count() == 0 and mixing.take_mix(none).count() == 0


def test_packing_covers_every_id_once(spark, docs, none):
    path = tokenizer_file("word_bpe_49k.json")
    rows = packing.pack(docs.withColumn("part", F.lit(1)), path, block_ids=2000).collect()
    enc = encoder(path, False)
    ids, ends = enc.encode(pa.array([r[1] for r in ROWS]))
    want = Counter(tuple(ids[ends[i] : ends[i + 1]].tolist() + [2]) for i in range(len(ROWS)))
    seen, by_row = Counter(), {}
    for r in rows:
        assert len(r["ids"]) == 4 * r["length"]
        by_row.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    assert sum(r["length"] for r in rows) == sum(len(k) * n for k, n in want.items())
    for (doc, n), pieces in by_row.items():
        if doc not in (5, None):
            pieces.sort(key=lambda r: r["start"])
            whole = b"".join(p["ids"] for p in pieces)
            assert tuple(np.frombuffer(whole, "<u4").tolist()) in want and len(whole) == 4 * n
    seen = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert seen.get(r["sequence_id"], 0) == r["offset"]
        seen[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(seen.values()) <= 4096 and set(seen) == set(range(len(seen)))
    assert packing.pack(none, path).count() == 0


def test_best_cuts_are_optimal():
    rng = np.random.default_rng(1)
    for _ in range(20):
        at = np.concatenate([[0], np.cumsum(rng.integers(1, 6, 14))])
        pen = rng.integers(0, 5, 15)
        cuts = packing.best_cuts(at, pen, 10)
        best = {0: 0}
        for i in range(1, 15):
            best[i] = min(best[j] + 10 - int(at[i] - at[j]) + int(pen[i]) for j in range(i) if at[i] - at[j] <= 10)
        where = {int(p): i for i, p in enumerate(at)}
        cost = sum(10 - (b - a) + int(pen[where[b]]) for a, b in zip(cuts, cuts[1:]))
        assert cost == best[14]


def test_store_rebuilds_documents(spark, docs, none):
    path = tokenizer_file("byte_bpe_50k.json")
    got = token_store.store_digest(docs, path).collect()
    enc = encoder(path, True)
    ids, ends = enc.encode(pa.array([r[1] for r in ROWS]))
    crc = Counter(zlib.crc32(np.append(ids[ends[i] : ends[i + 1]], 2).astype("<u4").tobytes()) for i in range(len(ROWS)))
    assert Counter(r["ids_crc32"] for r in got) == crc
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    known = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert known == sorted(known, key=lambda x: (x is not None, x))
    assert token_store.store_digest(none, path).count() == 0


def test_store_keeps_chunks_once_and_notices_damage(spark):
    path = tokenizer_file("byte_bpe_50k.json")
    folder = fresh_path(spark, "store-test")
    token_store.write_store(spark.createDataFrame([(i, LONG + str(i % 2), "s") for i in range(6)], DOCS).repartition(3), path, folder)
    chunks = spark.read.parquet(f"{folder}/chunks")
    assert chunks.count() == chunks.select("hash").distinct().count()
    bad = fresh_path(spark, "store-bad")
    for part in ("recipes", "manifest"):
        spark.read.parquet(f"{folder}/{part}").write.parquet(f"{bad}/{part}")
    chunks.withColumn("ids", F.expr("concat(ids, X'0000')")).write.parquet(f"{bad}/chunks")
    with pytest.raises(Exception, match="differs from its hash"):
        token_store.read_store(spark, bad).count()


@pytest.mark.parametrize("text", ["", " a", "a  b", "don't <|endoftext|> I'd", "é ß x  y", "a\n\nb c\t d ", "12 345", "x" * 200 + " y.", "A!? b... c", "中文 字"])
def test_encoder_equals_the_tokenizer(text):
    for name, keeps in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        e = encoder(tokenizer_file(name), keeps)
        ids, ends = e.encode(pa.array([text, None, text]))
        assert ids[ends[2] : ends[3]].tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids and ends[1] == ends[2]


@pytest.mark.parametrize("name, keeps", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_plain_pieces_are_cut_together(name, keeps, monkeypatch):
    e = Encoder(tokenizer_file(name), keeps)
    monkeypatch.setattr(e, "_split", lambda piece, lead: pytest.fail(f"{piece!r} was cut alone"))
    text = "Straße Été. ÜBER,*** word$$$ AB12cd +1 (604) 555-8469 a.\nDer x_y!? 12\n34 ÀÞ"
    ids, ends = e.encode(pa.array([text, text]))
    want = e.tokenizer.encode(text, add_special_tokens=False).ids
    assert ids.tolist() == want * 2 and ends.tolist() == [0, len(want), 2 * len(want)]


@pytest.mark.parametrize("name, keeps", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_encoder_equals_the_tokenizer_on_odd_characters(name, keeps, monkeypatch):
    monkeypatch.setattr(encoding, "CACHE_PIECES", 500)
    marks = [*"aBzéÉÀßŸİıſǅȺȿ×÷ªµ1²½'<|>.,!?-_\n\t\r\x1c\x85\u0301\u00a0中ب🙂#$\x00\x7f  ", "'t", "<|endoftext|>", " Word", "Über ", "12"]
    texts = ["".join(marks[(i * i * 31 + i * k * k * 17 + k) % len(marks)] for k in range(i % 13)) for i in range(4000)]
    e = Encoder(tokenizer_file(name), keeps)
    for some in (texts[:2000], texts[2000:]):
        ids, ends = e.encode(pa.array(some))
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [x.ids for x in e.tokenizer.encode_batch(some, add_special_tokens=False)]


def test_tokenizer_that_keeps_marks_with_words(tmp_path):
    letters = sorted(pre_tokenizers.ByteLevel.alphabet())
    t = Tokenizer(models.BPE(vocab={x: i for i, x in enumerate([*letters, "d,"])}, merges=[("d", ",")]))
    t.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    t.save(str(tmp_path / "t.json"))
    ids, _ = Encoder(str(tmp_path / "t.json"), False).encode(pa.array(["a word, and"]))
    assert ids.tolist() == t.encode("a word, and", add_special_tokens=False).ids and 256 in ids


def test_ogg_round_trip_and_damage(docs, none):
    for text in (None, "", "a" * 192, "é" * 70000, "b" * 65025):
        raw = (text or "").encode()
        d = ogg.decode(ogg.encode(text))
        assert d["payload"] == (raw + b" " * (-len(raw) % 192) or b" " * 192) and d["n_bytes"] == len(raw)
    media = bytearray(ogg.encode("hello"))
    media[-1] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        ogg.decode(bytes(media))
    with pytest.raises(ValueError):
        ogg.decode(ogg.encode("x" * 200000)[:-100])
    got = ogg.measure(ogg.store_media(docs.withColumn("media", F.lit(1)))).collect()
    assert Counter(r["payload_sha256"] for r in got) == Counter(hashlib.sha256(ogg.decode(ogg.encode(r[1]))["payload"]).hexdigest() for r in ROWS)
    assert ogg.measure(ogg.store_media(none)).count() == 0


def test_page_checksum_is_the_formats():
    def plain(data):
        r = 0
        for b in data:
            r ^= b << 24
            for _ in range(8):
                r = (r << 1 ^ 0x04C11DB7 if r & 0x80000000 else r << 1) & 0xFFFFFFFF
        return r

    assert ogg.page_crc(b"OggS and more") == plain(b"OggS and more")


PAGE = """<!doctype html><html><head><title>T</title><script>var a = "<p>no</p>";</script></head><body><header><h2>Site name, welcome.</h2></header><nav><a href=/>Home</a></nav>
<div class="cookie-notice"><p>We use cookies, dear reader, as you know.</p></div><div id=wrap><article><h1>A &amp; B</h1><p>First   <b>bold</b>,
text&nbsp;here.<p>Second &lt;one&gt;.<ul><li>item one<li>item two</ul></article><div class="comments"><p>Nice article, thanks.</p></div></div>
<aside>Related: more, and more.</aside><form>Search here, please.</form><footer>&copy; Us, all rights.</footer></body></html>"""


def test_extraction_takes_the_article(spark):
    assert extraction.main_text(PAGE) == "A & B\nFirst bold, text here.\nSecond <one>.\nitem one\nitem two"
    plain = PAGE.replace("<article>", "<div>").replace("</article>", "</div>")
    assert "First bold, text here." in extraction.main_text(plain) and "cookies" not in extraction.main_text(plain) and "Nice article" not in extraction.main_text(plain)
    for odd in (None, "", "<", "<p", "</div></p>", "<!-- open", "<script>x", "just text, no tags.", "<p a='x>y</p>", "<div>" * 2000 + "deep, deep."):
        assert isinstance(extraction.main_text(odd), str)
    rows = spark.createDataFrame([(1, None, PAGE), (None, "u", None), (1, None, PAGE)], "page_id long, url string, html string").withColumn("text", F.lit(0))
    assert [r["n_chars"] for r in extraction.extract(rows).collect()].count(0) == 1
    assert extraction.extract(rows.limit(0)).count() == 0


def test_warc_round_trip(spark):
    big = "<p>" + "x" * 2000
    rows = [(1, "http://a/ b", big), (2, None, big), (3, "http://c/", None), (None, "u", big), (5, "http://é/\n", "small"), (6, "x", "small"), (2, None, big)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("mine"))
    got = warc.round_trip(spark, df, with_payload=True).collect()
    assert len(got) == len(rows)
    for r in got:
        revisit = r["payload_bytes"] == 2003 and r["page_id"] != 2
        assert r["record_type"] == ("revisit" if revisit else "response") and r["refers_to"] == (2 if revisit else None)
        assert (r["payload"] is None) == revisit
        assert revisit or hashlib.sha1(r["payload"]).hexdigest() == r["payload_digest"]
    assert {r["url"] for r in got} == {r[1] for r in rows}
    assert warc.round_trip(spark, df.limit(0)).count() == 0


def test_warc_index_names_each_record(spark):
    rows = [(i, f"http://h/{i}", LONG * 20 if i == 3 else "x" * (1500 if i % 2 else i)) for i in range(11)] + [(4, "http://h/4", "xxxx")]
    folder = fresh_path(spark, "warc-test")
    written = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), f"{folder}/whole")
    runs = warc.normalise_archives(written, f"{folder}/records", step=5)
    found = sorted(runs.collect(), key=lambda r: r["index_from"])
    assert [r["records"] for r in found] == [5, 5, 2] and found[0]["index_from"] == 0
    path = found[0]["archive"].removeprefix("file://")
    data, index = open(path, "rb").read(), open(path + ".idx").read()
    assert len(index) == found[-1]["index_to"]
    at = 0
    for line in index.splitlines():
        offset, size, kind, urn = line.split(" ")
        record = zlib.decompress(data[int(offset) : int(offset) + int(size)], 31)
        assert int(offset) == at and f"WARC-Type: {kind}\r\n".encode() in record and f"WARC-Record-ID: {urn}\r\n".encode() in record
        at += int(size)
    assert at == len(data)
    got = Counter((r["page_id"], r["payload"]) for r in warc.read_archives(runs).collect() if r["record_type"] == "response")
    assert got[(3, (LONG * 20).encode())] == 1 and got[(4, b"xxxx")] == 2 and sum(got.values()) == 9


def test_warc_records_split_at_any_piece():
    whole = b"".join(warc.build_record(i, None, b"p\r\n\r\nq" * i, hashlib.sha1(b"p\r\n\r\nq" * i).hexdigest(), None, False) for i in range(5))
    for n in (1, 7, 64, 10_000):
        assert [warc.parse_record(r)["page_id"] for r in warc.split_records(whole[i : i + n] for i in range(0, len(whole), n))] == list(range(5))
    with pytest.raises(ValueError):
        list(warc.split_records([whole[:-9]]))


def test_url_lists_hold_at_fetch_time(spark):
    entries = [("domain:bad.org", "spam", "2024-01-10", True), ("domain:bad.org", "spam", "2024-01-20", False), ("domain:bad.org", "spam", "2024-02-01", True), ("host:x.org", "ads", "2024-01-01", True), ("host:x.org", "ads", "2024-01-01", False), ("prefix:y.org/a/", "t", "2024-01-01", True), (None, "t", "2024-01-01", True)]
    e = spark.createDataFrame(entries, "subject string, category string, day string, added boolean").withColumn("day", F.to_date("day"))
    urls = [("http://www.BAD.org:80/x", "2024-01-09"), ("http://www.bad.org/", "2024-01-10"), ("https://u@bad.org./", "2024-01-19"), ("http://bad.org", "2024-01-20"), ("http://bad.org", "2024-03-01"), ("http://notbad.org", "2024-03-01"), ("http://x.org/", "2024-01-01"), ("http://y.org/a/b?q", "2024-01-02"), ("http://y.org/ab", "2024-01-02"), (None, "2024-01-02"), ("http://bad.org", None), ("nonsense", "2024-01-15")]
    c = spark.createDataFrame([(i, u, d) for i, (u, d) in enumerate(urls)], "i int, url string, fetched string").withColumn("day", F.lit(1))
    got = {r["i"]: (r["kept"], r["hits"]) for r in url_filters.judge_captures(c, e).collect()}
    assert [i for i, (kept, _) in got.items() if not kept] and {i for i, (kept, _) in got.items() if not kept} == {1, 2, 4, 7}
    assert got[1][1] == ["spam=domain:bad.org"] and len(got) == len(urls)
    clash = url_filters.judge_captures(c.select("*", *[F.lit("mine").alias(x) for x in ("_d", "_s", "_h", "_day", "_subjects", "_found_hits", "hits")]), e).collect()
    assert {r["i"]: (r["kept"], r["hits"]) for r in clash} == got and all(r["_d"] == r["_found_hits"] == r["_subjects"] == "mine" for r in clash)
    assert url_filters.judge_captures(c.limit(0), e).count() == 0 and url_filters.judge_captures(c, e.limit(0)).where("kept").count() == len(urls)
