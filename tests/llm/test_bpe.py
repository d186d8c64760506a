import base64

import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import bpe

RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.VOCABULARY, "rb"))}
REFERENCE = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=RANKS, special_tokens={})
TEXTS = ["", "hello world", "  two  spaces\n\n x", "a" * 3000, "!?" * 500, "漢字 🙂 ñandú's we'll", "<|endoftext|>", "the thing 1234 56", "the thing 1234 56"]


def split(ids, counts):
    at = 0
    for n in counts:
        yield ids[at : at + n].tolist()
        at += n


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=60), min_size=1, max_size=5))
def test_equals_the_reference_and_decodes(texts):
    ids, counts = bpe.load().encode(texts)
    assert list(split(ids, counts)) == [REFERENCE.encode_ordinary(t) for t in texts]
    assert bpe.load().decode(ids)[0].tobytes().decode() == "".join(texts)


def test_long_words_by_heap_equal_rounds():
    import random
    import time

    rng = random.Random(1)
    words = ["a" * 5000, "".join(rng.choices("acgt", k=3000)), "".join(rng.choices("etaoinshrdlu", k=2500)), "the" * 900, "short"]
    ids, n = bpe.load().merge([w.encode() for w in words])
    want, m = bpe.load().rounds([w.encode() for w in words])
    assert n.tolist() == m.tolist() and ids.tolist() == want.tolist()
    at = time.time()
    bpe.load().merge(["".join(rng.choices("etaoinshrdlu", k=100_000)).encode()])
    assert time.time() - at < 15


def test_forgetting_words_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "MOST_WORDS", 1)
    for _ in range(2):
        ids, counts = bpe.load().encode(TEXTS)
        assert list(split(ids, counts)) == [REFERENCE.encode_ordinary(t) for t in TEXTS]


def test_rows(spark):
    data = list(enumerate([*TEXTS, None, "word " * 60000]))
    docs = spark.createDataFrame([(i, t, 7, "x") for i, t in data], "doc_id long, text string, n_tokens int, x string")
    out = bpe.encode_documents(docs)
    got = {r["doc_id"]: r for r in out.collect()}
    for i, t in data:
        if t is None:
            assert got[i]["token_ids"] is None and got[i]["n_tokens"] is None and got[i]["round_trip"] is None
        else:
            assert got[i]["token_ids"] == REFERENCE.encode_ordinary(t) and got[i]["round_trip"] and got[i]["n_tokens"] == len(got[i]["token_ids"])
    assert {r["doc_id"]: r["text"] for r in bpe.decode_documents(out).collect()} == dict(data)
    assert bpe.encode_documents(docs.where("false")).count() == 0


def test_bytes_that_are_no_text():
    ids, n = bpe.load().merge([b"hello", b"\xff\xfe", b"zzzzz"])
    assert bpe.load().decode(ids)[0].tobytes() == b"hello\xff\xfezzzzz" and n.sum() == len(ids)
    assert ids[: n[0]].tolist() == REFERENCE.encode_ordinary("hello")
