from pyspark.sql import functions as F

from quire.streaming import documents as D


def test_lines_of_arriving_documents(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, "a\nb"), (2, None)], "doc_id long, text string").write.parquet(src)
    q = D.lines(D.arriving(spark, src)).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(out)
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == [(1, 0, "a"), (1, 1, "b"), (2, 0, "")]


def test_windows_and_late_rows(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [("2024-01-01 00:10:00", "text", 1), ("2024-01-01 00:20:00", "text", 2), ("2024-01-01 05:00:00", "path", 3)]
    e = spark.createDataFrame(rows, "ts string, op string, id long").withColumn("ts", F.to_timestamp("ts"))
    e.write.parquet(src)
    stream = spark.readStream.schema(e.schema).parquet(src)
    q = D.running_tally(stream).writeStream.format("memory").queryName("tally").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r["op"], r["n"]) for r in spark.table("tally").collect()) == [("path", 1), ("text", 2)]
