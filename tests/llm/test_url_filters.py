"""URL filters on hosts that are no valid DNS names."""

from pyspark.sql import functions as F

from cairn.llm import url_filters


def test_hosts_of_many_labels_have_all_their_parents(spark):
    e = spark.createDataFrame([("domain:evil.com", "spam", "2024-01-01", True)], "subject string, category string, day string, added boolean").withColumn("day", F.to_date("day"))
    urls = ["http://" + "a." * n + "evil.com/" for n in (0, 1, 125, 126, 127, 200)] + ["http://" + "a." * 200 + "good.com/"]
    c = spark.createDataFrame([(i, u, "2024-01-02") for i, u in enumerate(urls)], "i int, url string, fetched string")
    got = {r["i"]: r["hits"] for r in url_filters.judge_captures(c, e).collect()}
    assert got == {i: ["spam=domain:evil.com"] for i in range(6)} | {6: []}
