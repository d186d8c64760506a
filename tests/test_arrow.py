from quire.operators import arrow


def test_long_documents_and_paragraphs_are_whole(spark, tmp_path):
    texts = [f"para number {p} of the document, with some words in it" for p in range(8)] + ["a sentence, and on. " * 300, "short", "e " * 20]
    spark.createDataFrame([(1, "s", "en", "\n".join(texts))], "doc_id long, source string, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def paras(name):
        return sorted({r["para"] for r in arrow.QUERIES[name][0](spark, str(tmp_path)).collect()})

    assert paras("slugs") == paras("wrapped_packets") == list(range(11))
    assert paras("engine_agreement") == [*range(9), 10]
