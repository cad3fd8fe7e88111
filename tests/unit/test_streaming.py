from retort.streaming import dedup_stream, run_stream


def test_unique_across_batches(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "k string, n bigint"
    for part in ([("a", 1), ("b", 2), ("a", 3)], [("b", 4), ("c", 5)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    run_stream(stream, lambda df: df.where("n > 0"), out, str(tmp_path / "ck"), "k", "n").awaitTermination(60)
    got = sorted(r.k for r in spark.read.parquet(out + "/batch=*").collect())
    assert got == ["a", "b", "c"]
    q = dedup_stream(stream, ["k"]).writeStream.format("memory").queryName("dd").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("dd").count() == 3
