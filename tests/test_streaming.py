from quire.streaming.ingest import ingest, repaired

DOCS = "/root/testdata/sf0.001/documents.parquet"


def test_stream_equals_batch_and_takes_each_file_once(spark, tmp_path):
    docs = spark.read.parquet(DOCS).selectExpr("doc_id", "replace(text, '. ', '.') as text", "lang", "source", "n_chars")
    source, target, state = (f"file://{tmp_path}/{x}" for x in ("in", "out", "state"))
    docs.where("doc_id % 2 = 0").write.parquet(source)
    for _ in range(2):
        ingest(spark, source, target, state).awaitTermination()
    docs.where("doc_id % 2 = 1").write.mode("append").parquet(source)
    ingest(spark, source, target, state).awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(target).select("doc_id", "para", "text", "mended").collect()))
    assert got == sorted(map(tuple, repaired(docs).collect())) and any(r[3] for r in got)
