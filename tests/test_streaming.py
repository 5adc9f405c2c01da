from palimpsest.streaming.ingest import ingest, unseen


def test_each_file_is_scanned_once(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "ck"))
    spark.createDataFrame([(1, " a "), (2, "b")], "doc_id long, text string").write.parquet(source)
    ingest(spark, source, out, checkpoint).awaitTermination()
    spark.createDataFrame([(3, "a"), (4, "c")], "doc_id long, text string").write.mode("append").parquet(source)
    ingest(spark, source, out, checkpoint).awaitTermination()
    rows = spark.read.parquet(out)
    assert sorted(r["doc_id"] for r in rows.collect()) == [1, 2, 3, 4]
    old, new = rows.where("batch = 0"), rows.where("batch = 1")
    assert [r["doc_id"] for r in unseen(new, old).collect()] == [4]
