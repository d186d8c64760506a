from quire.operators import folds


def line(n, text="x", page=1, x0=72.0, x1=200.0, y0=None, size=11.0):
    return {"line": n, "page": page, "x0": x0, "x1": x1, "y0": 100 + 13.5 * n if y0 is None else y0, "size": size, "text": text}


def values(rows):
    return {r["line"]: r["v"] for r in rows}


def test_baselines_compare_with_the_groups_first_line():
    rows = [line(0, y0=100), line(1, y0=101.5), line(2, y0=103), line(3, y0=103.5), line(4, page=2, y0=103.6)]
    assert values(folds.baselines(rows)) == {0: 0, 1: 0, 2: 1, 3: 1, 4: 2}


def test_right_runs_need_a_shared_margin():
    rows = [line(0, x1=300), line(1, x1=299), line(2, x1=250), line(3, x0=90, x1=310), line(4, x0=72, x1=280)]
    assert values(folds.right_runs(rows)) == {0: 300, 1: 300, 2: 300, 3: -1, 4: -1}


def test_notes_must_count_up_within_a_page():
    rows = [line(0, "4 a"), line(1, "6 b"), line(2, "5 c"), line(3, "1914 d"), line(4, "2 e", page=2)]
    assert values(folds.note_sequence(rows)) == {0: 4, 2: 5, 4: 2}


def test_note_wraps_join_the_last_note():
    rows = [line(0, "1 a", size=9), line(1, "b", size=9), line(2, "c", page=2, size=9), line(3, "2 d", page=2, size=9)]
    assert values(folds.wrap_merge(rows)) == {0: 1, 1: 1, 2: 1, 3: 2}


def test_markers_take_the_head_of_the_queue():
    rows = [line(0, "a*"), line(1, "b"), line(2, "n1", size=9), line(3, "c*", page=3), line(4, "n2", page=4, size=9), line(5, "n3", page=9, size=9)]
    assert folds.note_queue(rows) == [{"line": 0, "v": 2}, {"line": 3, "v": 4}, {"line": 3, "v": 5}]


def test_headings_are_claimed_once():
    rows = [line(0, "The same title", size=14), line(1, "The same title", page=5, size=14)]
    got = folds.claim_headings(rows)
    assert sorted(r["line"] for r in got) == [0, 1] and sorted(r["v"] for r in got) == [0, 1]


def test_stanzas_cross_pages_but_not_gaps():
    rows = [line(0), line(1, x1=500), line(2), line(3, page=2), line(4, page=4)]
    assert values(folds.verse_groups(rows)) == {0: 1, 2: 2, 3: 2, 4: 3}


def test_items_are_carried():
    assert values(folds.list_pass([line(0), line(1, x0=90), line(2), line(3, page=2), line(4, x0=90)])) == {1: 1, 2: 1, 3: 1, 4: 2}


def test_coverage_and_fidelity_see_what_is_missing():
    rows = [line(n, " ".join(f"word{n}x{k}" for k in range(10)), page=1 + n // 40) for n in range(80)]
    cover, recall = values(folds.paged_coverage(rows)), values(folds.page_fidelity(rows))
    assert all(0.8 * 3500 < v < 4000 for v in cover.values()) and all(80 < v < 100 for v in recall.values())


def test_every_page_of_a_long_document_is_matched(spark, tmp_path):
    text = "\n".join(" ".join(f"word{p}x{k}" for k in range(100)) for p in range(64))
    spark.createDataFrame([(1, "s", "en", text)], "doc_id long, source string, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("paged_coverage", "page_fidelity"):
        assert sorted(r["line"] for r in folds.QUERIES[name][0](spark, str(tmp_path)).collect()) == list(range(1, 17))


def test_packages_are_stable_and_read_back(spark):
    from quire.sources.epub import package, parse, read_packages, write_packages

    made = package("urn:x", "T & t", "en", [("One <1>", ["a & b", "c"]), ("Two", [])])
    assert made == package("urn:x", "T & t", "en", [("One <1>", ["a & b", "c"]), ("Two", [])])
    assert [(h, p, n) for h, p, _, n in parse(made)] == [("c0001.xhtml", 0, False), ("c0002.xhtml", 1, False), ("nav.xhtml", -1, True)]
    paras = spark.createDataFrame([(1, None, k, f"para <{k}>") for k in range(12)], "doc_id long, lang string, para long, text string")
    rows = {r["href"]: r for r in read_packages(write_packages(paras)).collect()}
    assert rows["c0001.xhtml"]["n_blocks"] == 10 and rows["c0002.xhtml"]["text"] == "para <10>\npara <11>" and rows["c0002.xhtml"]["title"] == "Part 2"


def test_html_events():
    from quire.sources.html import events

    got = events("<p>a<br>b<b>c</p>d")
    assert [(e[0], e[1], e[4]) for e in got] == [("start", "p", None), ("text", "p", "a"), ("start", "br", None), ("text", "p", "b"), ("start", "b", None), ("text", "b", "c"), ("end", "p", None), ("text", "", "d")]
    assert events(None) == [] and events("") == []
