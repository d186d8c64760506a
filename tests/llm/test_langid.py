import random

from quire.llm import langid

WORDS = {"aa": ["tal", "mer", "ondo", "sili"], "bb": ["krunk", "zwerg", "ptolz", "brix"]}


def rows(n=160):
    rng = random.Random(3)
    return [(i, " ".join(rng.choices(WORDS["aa" if i % 2 else "bb"], k=rng.randint(5, 40))), "aa" if i % 2 else "bb") for i in range(n)]


def test_held_out_accuracy_and_rejection(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, lang string")
    model = langid.fit(docs, rows_per_lang=60)
    new = [(1000 + i, t, lang) for i, t, lang in rows(60)] + [(1, None, None), (2, "", None), (3, "123 $$$ !!", "aa")]
    got = {r["doc_id"]: r for r in langid.language_id(spark.createDataFrame(new, "doc_id long, text string, lang string"), model).collect()}
    assert all(got[i]["lang"] == lang and got[i]["keep"] for i, _, lang in new[:60])
    for i in (1, 2, 3):
        assert got[i]["lang"] is None and got[i]["keep"] is False and got[i]["confidence"] == 0


def test_scores_equal_a_slow_mean_and_softmax(spark):
    import math

    import numpy as np
    import pyarrow as pa

    docs = spark.createDataFrame(rows(), "doc_id long, text string, lang string")
    model = langid.fit(docs, rows_per_lang=60)
    size = len(model.scores) // 2
    texts = [t for _, t, _ in rows(12)] + ["Tal, MER! 9 ondo", "a", ""]
    best, sure, known = langid.predict(model, pa.array(texts))
    for i, text in enumerate(texts):
        t = "".join(c.lower() if c.isalpha() else " " for c in text).encode()
        found = []
        for order, at in ((3, 0), (4, size)):
            for p in range(len(t) - order + 1):
                gram = t[p : p + order]
                if b" " in gram[1:-1]:
                    continue
                h = 0
                for c in gram:
                    h = (h * 0x01000193 + c) % 2**32
                h = h * 0x9E3779B1 % 2**32
                found.append(at + (h ^ (h >> 15)) % size)
        if not found:
            assert best[i] == -1 and sure[i] == 0
            continue
        logits = [(np.mean([model.scores[r][k] for r in found]) + model.bias[k]) / model.temperature for k in range(2)]
        p = [math.exp(x - max(logits)) for x in logits]
        assert best[i] == int(np.argmax(p)) and abs(sure[i] - max(p) / sum(p)) < 1e-4 and abs(known[i] - np.mean([model.known[r] for r in found])) < 1e-9


def test_ties_go_to_the_first_language():
    import numpy as np
    import pyarrow as pa

    model = langid.Model(("aa", "bb"), np.zeros((2 * 64, 2), np.float32), np.zeros(2, np.float32), 1.0, 0.0, np.ones(128, bool), 0.0)
    assert langid.predict(model, pa.array(["some text"]))[0].tolist() == [0]


def test_pieces_make_no_difference(monkeypatch, spark):
    import pyarrow as pa

    docs = spark.createDataFrame(rows(), "doc_id long, text string, lang string")
    model = langid.fit(docs, rows_per_lang=60)
    texts = pa.array([t for _, t, _ in rows(30)] + ["tal mer " * 5000, None, ""])
    whole = langid.predict(model, texts)
    monkeypatch.setattr(langid, "PIECE", 97)
    parts = langid.predict(model, texts)
    assert (whole[0] == parts[0]).all() and abs(whole[1] - parts[1]).max() < 1e-6


def test_keeps_columns_repeated_rows_and_sets_lang(spark):
    data = [(i, t, lang, "s", "c", "k") for i, t, lang in rows()] * 2 + [(None, None, None, None, None, None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, row string, confidence string, keep string")
    out = langid.keep_identified(docs, rows_per_lang=60)
    assert out.columns == docs.columns and out.count() == 320
    assert out.where("lang not in ('aa', 'bb') or keep <> 'k'").count() == 0


def test_empty_and_unlabelled(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert langid.language_id(empty).count() == 0 and langid.keep_identified(empty).count() == 0
    none = spark.createDataFrame([(1, "tal mer", None)], "doc_id long, text string, lang string")
    assert [r["keep"] for r in langid.language_id(none).collect()] == [False]


def test_untrained_languages_and_noise_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    new = [
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.",
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.",
        "Minden emberi lény szabadon születik és egyenlő méltósága és joga van. Az emberek ésszel és lelkiismerettel bírván.",
        "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler.",
        "Все люди рождаются свободными и равными в своем достоинстве и правах.",
        "人人生而自由,在尊严和权利上一律平等。",
        "q83Jk+wMIIEvQIBADANBgkqhkiG9w0BAQEFAASCBKcwggSjAgEAAoIBAQC7AKIAQYWJKYKBCSQTTZ",
    ]
    model = langid.fit(docs)
    texts = spark.createDataFrame(list(enumerate(new)), "doc_id int, text string")
    assert [r["doc_id"] for r in langid.language_id(texts, model).collect() if r["keep"]] == []
    trained = langid.language_id(docs, model)
    assert trained.where("keep").count() >= 0.99 * docs.count() and 0.01 < model.temperature < 100
