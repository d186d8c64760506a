import duckdb
import pytest
from hypothesis import given
from hypothesis import strategies as st

from quire.llm import mixing


@given(st.integers(0, 1000), st.dictionaries(st.sampled_from("abcdefg"), st.tuples(st.integers(1, 9), st.integers(0, 300)), min_size=1))
def test_fill_gives_all_it_can(budget, children):
    got = mixing.fill(budget, children)
    room = sum(c for _, c in children.values())
    assert all(0 <= got[k] <= c for k, (_, c) in children.items())
    assert min(budget, room) - len(children) <= sum(got.values()) <= budget
    short = [k for k, (_, c) in children.items() if got[k] < c]
    for a in short:  # those that aren't full share by their weights
        for b in short:
            assert abs(got[a] / children[a][0] - got[b] / children[b][0]) <= 1


def test_shortage_goes_to_siblings_first():
    tokens = {("w", "en", "a"): 10, ("w", "en", "b"): 1000, ("v", "en", "c"): 1000}
    got = mixing.budgets(tokens, (1, 2), 1, {"domain": {}, "lang": {}, "source": {}})
    assert got == {("w", "en", "a"): 10, ("w", "en", "b"): 492, ("v", "en", "c"): 502}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_equals_sql(spark, sf):
    at = f"/root/testdata/{sf}/documents.parquet"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{at}'")
    want = sorted(con.sql(f"SELECT doc_id, domain, lang, source, n_tokens, epoch FROM ({mixing.SQL})").fetchall())
    assert sorted(tuple(r) for r in mixing.mix(spark.read.parquet(at)).collect()) == want
    assert sorted(r["doc_id"] for r in mixing.mix_documents(spark.read.parquet(at)).collect()) == [w[0] for w in want]


def test_rows(spark):
    data = [(i, "a b c", None if i % 3 else "en", None if i % 2 else "src0", "d", 1, "x") for i in range(50)] + [(None, None, "en", "src0", "d", 1, "x"), (3, "a b c", None, None, "d", 1, "x"), (9, "", "en", "src9", "d", 1, "x"), (10, "w " * 100000, "en", "src1", "d", 1, "x")]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, domain string, full int, h string")
    out = mixing.mix_documents(docs, max_epochs=3)
    assert out.columns == docs.columns
    con = duckdb.connect()
    documents = docs.toArrow()  # noqa: F841
    want = con.sql(mixing.SQL).fetchall()
    assert sorted(map(str, (tuple(r) for r in mixing.mix(docs).collect()))) == sorted(str(r) for r in want)
    assert mixing.mix(docs.where("false")).count() == 0 and mixing.mix_documents(docs.where("false")).count() == 0
