import corpus_pipeline
from quire.llm import bpe, langid, mixing, pii, simhash
from quire.llm.common import table
from quire.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_stages_follow_their_contract(spark):
    docs = table(spark, SF, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_duplicates", "pii", "mixing", "bpe"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


def test_run_equals_its_stages_by_brute_force(spark):
    docs = table(spark, SF, "documents")
    rows = {r["doc_id"]: r for r in docs.collect()}
    got = corpus_pipeline.run(spark, SF).collect()
    found = {r["doc_id"]: r for r in langid.language_id(docs).collect()}
    kept = docs.where(docs.doc_id.isin([d for d, r in found.items() if r["keep"]]))
    stay = [r["doc_id"] for r in simhash.near_duplicates(kept).collect() if r["keep"]]
    texts = {}
    for d in stay:
        text = rows[d]["text"]
        for _, a, b, _, kind in sorted(((s[0], s[1], s[2], s[3], s[0]) for s in pii.spans(text)), key=lambda s: -s[1]):
            text = text[:a] + f"[{kind.upper()}]" + text[b:]
        texts[d] = text
    final = spark.createDataFrame([(d, t, found[d]["lang"], rows[d]["source"]) for d, t in texts.items()], "doc_id long, text string, lang string, source string")
    copies = sorted(r["doc_id"] for r in mixing.mix(final).collect())
    assert sorted(r["doc_id"] for r in got) == copies and copies
    for r in got:
        back, _ = bpe.load().decode(__import__("numpy").array(r["token_ids"], int))
        assert r["round_trip"] and back.tobytes().decode() == texts[r["doc_id"]]


def test_empty_documents(spark):
    docs = table(spark, SF, "documents").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_a_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11)) and set(ORACLES) <= set(QUERIES)


def test_nulls_long_texts_repeats_and_extra_columns(spark, tmp_path):
    from pyspark.sql import functions as F

    docs = table(spark, SF, "documents").withColumn("row", F.lit("r")).withColumn("red", F.lit(1)).withColumn("epoch", F.lit(True))
    some = docs.limit(20)
    odd = some.limit(1).withColumn("text", F.lit(None).cast("string")).unionAll(some.limit(1).withColumn("text", F.lit(""))).unionAll(some.limit(1).withColumn("text", F.repeat("text", F.lit(400)))).withColumn("source", F.lit(None).cast("string"))
    docs.unionAll(some).unionAll(some).unionAll(odd).withColumn("doc_id", F.when(F.col("doc_id") % 50 > 0, F.col("doc_id"))).write.parquet(f"{tmp_path}/documents.parquet")
    before = set(_folders(spark))
    out = corpus_pipeline.run(spark, str(tmp_path))
    rows = out.collect()
    assert rows and all(r["round_trip"] for r in rows)
    left = {f.split("-")[0] + "-" + f.split("-")[1] for f in set(_folders(spark)) - before}
    assert left == {"pipeline-mixing"}  # what the result still reads


def _folders(spark):
    import os

    from quire.llm.common import shared_dir

    return os.listdir(shared_dir(spark).removeprefix("file://"))


def test_a_cluster_needs_a_shared_folder(monkeypatch, spark):
    import pytest

    from quire.llm import common

    class Context:
        master = "spark://x:7077"
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: type("O", (), {"isDefined": lambda self: False})()})()})()

    class Session:
        conf = type("C", (), {"get": lambda self, *a: None})()
        sparkContext = Context()

    with pytest.raises(RuntimeError):
        common.shared_dir(Session())
