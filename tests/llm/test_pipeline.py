"""The pipeline, stage by stage, against SQL and brute force on the smallest documents table."""

import os
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from cairn.llm import line_dedup, mixing, quality
from cairn.llm.common import cut
from cairn.llm.encoding import encoder
from cairn.llm.queries import ORACLES, QUERIES, tokenizer_file

duckdb = pytest.importorskip("duckdb")
SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sql(documents, text):
    c = duckdb.connect()
    c.register("documents", documents)
    return c.execute(text).fetchall()


@pytest.fixture(scope="module")
def steps(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = [df.toPandas()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        df = cut(stage(spark, df, SMALL), f"test-{k}")
        out.append(df.toPandas())
    return out


def test_stages_keep_the_columns(steps):
    assert all(list(s.columns) == list(steps[0].columns) for s in steps[1:-1]) and len(steps) == 6


def test_quality_stage(steps):
    want = {r[0] for r in sql(steps[0], f"SELECT doc_id FROM ({quality.ORACLE}) WHERE kept")}
    assert set(steps[1].doc_id) == want and len(steps[1]) == len(want)


def test_line_stage(steps):
    want = dict(sql(steps[1], f"SELECT doc_id, text FROM ({line_dedup.oracle(long_sites=None)})"))
    assert dict(zip(steps[2].doc_id, steps[2].text)) == want
    assert (steps[2].text.str.len() == steps[2].n_chars).all()


def test_near_dedup_stage(steps):
    texts, ids = list(steps[2].text), list(steps[2].doc_id)
    bags = [Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := WORD.findall(t)) else Counter() for t in texts]
    group = list(range(len(texts)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = sum((bags[i] & bags[j]).values())
            if texts[i] == texts[j] or both and both / sum((bags[i] | bags[j]).values()) >= 0.8:
                group[find(i)] = find(j)
    least = {}
    for i, doc in enumerate(ids):
        least[find(i)] = min(least.get(find(i), doc), doc)
    assert sorted(steps[3].doc_id) == sorted(least.values())


def test_mixing_stage(steps):
    want = {r[0]: r[1] // r[2] if r[2] else 0 for r in sql(steps[3], f"SELECT doc_id, taken, size FROM ({mixing.ORACLE})")}
    got = Counter(steps[4].doc_id)
    sized = {i for i, t in zip(steps[3].doc_id, steps[3].text) if WORD.search(t)}
    assert {i: got.get(i, 0) for i in sized} == {i: want[i] for i in sized}


def test_packing_stage(steps):
    ids, ends = encoder(tokenizer_file("word_bpe_49k.json"), False).encode(pa.array(list(steps[4].text)))
    assert int(steps[5].length.sum()) == len(ids) + len(steps[4])
    per = steps[5].groupby("sequence_id").length.sum()
    assert per.max() <= 4096 and sorted(per.index) == list(range(len(per)))
    starts = steps[5].sort_values(["sequence_id", "offset"]).groupby("sequence_id").apply(lambda g: (g.offset.to_numpy() == np.cumsum(g.length.to_numpy()) - g.length.to_numpy()).all(), include_groups=False)
    assert starts.all()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_their_sql(spark, name):
    c = duckdb.connect()
    for f in os.listdir(SMALL):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SMALL}/{f}'")
    got = c.execute(ORACLES[name])
    names = [x[0] for x in got.description]
    plain = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    want = sorted(tuple(map(plain, r)) for r in got.fetchall())
    df = QUERIES[name](spark, SMALL)
    assert sorted(df.columns) == sorted(names)
    assert sorted(tuple(plain(r[n]) for n in names) for r in df.collect()) == want


ODD = "doc_id long, text string, source string, n_chars long, _x_words string, n_words string, _kept string, copies string, part string, root string"


def odd_rows():
    prose = [" ".join(f"{chr(97 + i // 26)}{chr(97 + i % 26)}{chr(97 + k)}" for i in range(90)) + "." for k in range(8)]
    texts = [None, "", " \n ", "short", *prose, prose[0], prose[0] + " more", prose[1], "\n".join(prose * 40), "a " * 9000]
    rows = [(i if i % 5 else None, t, None if i % 4 == 0 else f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    return [(*r, *["mine"] * 6) for r in [*rows, rows[6], rows[6]]]


def test_stages_on_odd_rows_and_clashing_columns(spark):
    docs = spark.createDataFrame(odd_rows(), ODD)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, cut(stage(spark, docs, SMALL), f"odd-{k}")
        if k < 4:
            assert docs.columns == before.columns
            assert {tuple(r[4:]) for r in docs.collect()} <= {("mine",) * 6} and docs.count() > 0
        if k == 2:
            texts = [r["text"] for r in docs.collect()]
            assert len(texts) == len(set(texts))
    assert docs.count() > 0 and {"doc_id", "start", "length", "sequence_id", "offset"} <= set(docs.columns)


def test_stages_on_an_empty_table(spark):
    docs = spark.createDataFrame([], ODD)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = cut(stage(spark, docs, SMALL), f"none-{k}")
        assert docs.count() == 0
