from pyspark.sql import functions as F

from cairn.streaming.incremental import new_files, stream_definitions, windowed_counts


def test_new_files_are_extracted_once(spark, tmp_path):
    src, out, mark = tmp_path / "src", str(tmp_path / "out"), str(tmp_path / "mark")
    src.mkdir()
    for k in range(2):
        (src / f"m{k}.py").write_text(f"def f{k}(): pass\n")
        stream_definitions(new_files(spark, str(src)), out, mark).awaitTermination()
        assert spark.read.parquet(out).count() == k + 1


def test_windowed_counts(spark):
    rows = spark.createDataFrame([("2024-01-01 00:01:00", "a"), ("2024-01-01 00:09:00", "a"), ("2024-01-01 00:11:00", "a")], "t string, k string").withColumn("t", F.to_timestamp("t"))
    assert sorted(r["n"] for r in windowed_counts(rows, "t", "k").collect()) == [1, 2]
