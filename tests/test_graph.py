"""Ancestors of deep graphs."""

from cairn.operators import graph
from cairn.parity import queries


def test_ancestors_go_to_the_last_level(spark):
    chain = [(i, i + 1, 1) for i in range(18)] + [(0, 100, 0), (100, 101, 0)]
    got = {(r["id"], r["ancestor"]): (r["depth"], r["ord"]) for r in graph.ancestors(spark.createDataFrame(chain, "id int, parent int, ord int")).collect()}
    assert {k: d for k, (d, _) in got.items() if k[0] == 0} == {(0, i): i for i in range(1, 19)} | {(0, 100): 1, (0, 101): 2}
    assert got[(0, 101)][1] < got[(0, 2)][1] and len(got) == 18 * 19 // 2 + 3


def test_bfs_ancestors_of_large_keys(spark, tmp_path):
    spark.createDataFrame([(2**k,) for k in range(22)], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    got = [tuple(r) for r in queries.QUERIES["bfs_ancestors"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted((2**k, 2**k >> d, d) for k in range(22) for d in range(1, k + 2))
