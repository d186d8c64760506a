import hashlib
import json

import pytest
from pyspark.sql import functions as F

from quire.sources import corpus


def test_configs_but_no_drafts(spark, tmp_path):
    for name in ("b/book.yaml", "a/book-two.yaml", "a/book.draft.yaml", "a/other.yaml", "c/deep/book.yaml"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x: 1")
    got = [(r["workspace"], r["stem"]) for r in corpus.discover_configs(spark, str(tmp_path)).collect()]
    assert got == [("a", "book-two"), ("b", "book")]
    assert [r["stem"] for r in corpus.discover_configs(spark, str(tmp_path), ["b", "a/none"]).collect()] == ["book"]
    assert [r["stem"] for r in corpus.discover_configs(spark, str(tmp_path), ["a/book-two"]).collect()] == ["book-two"]


def test_baseline(spark, tmp_path):
    at = tmp_path / "baseline.json"
    at.write_text(json.dumps({"baseline_version": 1, "entries": {"a/book": {"counters": {"pages": 3, "notes": 2}}}}))
    assert {tuple(r) for r in corpus.load_baseline(spark, str(at)).collect()} == {("a/book", "pages", 3.0), ("a/book", "notes", 2.0)}
    assert corpus.load_baseline(spark, str(at), version=2).count() == 0 and corpus.load_baseline(spark, str(tmp_path / "none.json")).count() == 0


def test_hashes_and_verification(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"abc")
    (tmp_path / "y.bin").write_bytes(b"d")
    found = corpus.hashes(spark, str(tmp_path))
    assert {tuple(r) for r in found.collect()} == {("x.bin", 3, hashlib.sha256(b"abc").hexdigest()), ("y.bin", 1, hashlib.sha256(b"d").hexdigest())}
    recorded = spark.createDataFrame([("x.bin", hashlib.sha256(b"abc").hexdigest()), ("y.bin", "0"), ("z.bin", "1")], "name string, sha256 string")
    assert {tuple(r) for r in corpus.verify(recorded, found).collect()} == {("y.bin", "changed"), ("z.bin", "missing or empty")}


def test_imprints(spark):
    @corpus.imprint("loud")
    def loud(blocks):
        return blocks.withColumn("text", F.upper("text"))

    df = spark.createDataFrame([("a",)], "text string")
    assert corpus.apply_imprint(df, "loud").first()["text"] == "A" and corpus.apply_imprint(df, None).first()["text"] == "a"
    with pytest.raises(ValueError):
        corpus.apply_imprint(df, "none")
