"""Inputs on which a query once differed from its SQL: rows that the small tables lack, compared with DuckDB."""

import difflib
import random
import re
import time

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from quire import catalog
from quire.functions import seams
from quire.operators.layout_queries import Book
from quire.operators.prose import TIGHT
from quire.operators.text import SPACE_RULES
from quire.plans import book
from quire.plans.views import dialect, prefix
from quire.sources.epub import blocks, page
from quire.sources.html import events

GERMAN = "ßheit enkeit nicht und das ach der au ein tzst schach der und lichen diedes chtetz berpf er\nΐch ŉein ﬁnden und das ach der au ein tzst schach der und lichen"
DOCUMENTS = {
    "capitals": [(i, f"{first}{GERMAN}") for i, first in enumerate(["", "ŉ", "ﬁ", "ᾳ", "ǰ", "a", "é", "ƛ", "ẞ"])],
    "twice": [(i, f"Title\n\n{GERMAN}\n" + "one two three " * 300) for i in (3, 3, 4, 5)],
    "blank": [(1, "  \n"), (5, ""), (10, None), (6, "            x y\n" + "z " * 401)],
    "periods": [(1, "a\nb\n" + "To " * 33 + "ereres ereres " * 9), (2, "a\nb\n" + "to-to " * 40), (3, "a\nb\n" + " ab" * 60 + " " + "abc " * 30)],
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    made = {}
    for name, rows in DOCUMENTS.items():
        made[name] = tmp_path_factory.mktemp(name)
        table = pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows], "lang": ["de"] * len(rows), "source": ["src0"] * len(rows), "n_chars": [len(r[1] or "") for r in rows]})
        pq.write_table(table, made[name] / "documents.parquet")
    return made


def same(spark, at, name: str) -> int:
    query, sql = catalog.QUERIES[name]
    df = query(spark, str(at))
    with duckdb.connect() as duck:
        duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{at}/documents.parquet'")
        rel = duck.sql(sql)
        want = sorted(map(repr, rel.select(", ".join(f'"{c}"' for c in df.columns)).fetchall()))
    got = sorted(repr(tuple(r)) for r in df.collect())
    assert got == want
    return len(got)


@pytest.mark.parametrize("name", ["paragraph_geometry", "reader_text", "style_clusters"])
def test_one_capital_for_one_letter(spark, folder, name):
    assert same(spark, folder["capitals"], name)


def test_fuzzy_find_in_text_that_repeats(spark, folder):
    assert same(spark, folder["periods"], "fuzzy_find")


@pytest.mark.parametrize("name", ["line_style_key", "page_shift", "folio_agreement", "render_queue"])
@pytest.mark.parametrize("documents", ["twice", "blank"])
def test_repeated_and_blank_documents(spark, folder, documents, name):
    assert same(spark, folder[documents], name) or name == "page_shift"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_and_book_are_laid_out_without_a_shuffle(spark):
    at = "/root/testdata/sf0.001"
    d = dialect(spark, at)
    spark.read.parquet(f"{at}/documents.parquet").createOrReplaceTempView("documents")
    assert "Exchange" not in _plan(spark.sql(f"{prefix(d, ['lines']).rstrip(',')} SELECT * FROM lines"))
    assert "Exchange" not in _plan(spark.sql(f"{book.sql(d, ['book']).rstrip(',')} SELECT * FROM book"))


def test_styled_lines_are_shuffled_once_and_never_written(spark):
    b = Book(spark, "/root/testdata/sf0.001")
    plan = _plan(b.styled)
    assert plan.count("Exchange hashpartitioning") <= 3  # lines, geometry, shifts by document
    assert "styled-" not in plan


def test_matching_blocks_are_those_of_difflib():
    draw = random.Random(3)
    for _ in range(3000):
        letters = "abcdef"[: draw.randint(1, 6)]
        a, b = ("".join(draw.choices(letters, k=draw.randint(0, 50))) for _ in "ab")
        b = draw.choice((b, a[:9] + b + a[15:40]))
        assert seams.matching_blocks(a, b) == [tuple(x) for x in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()]


def test_matching_blocks_of_text_that_repeats_take_no_square_of_it():
    a, b = "to " * 3000, "to " * 2990
    at = time.process_time()
    assert seams.matching_blocks(a, b)[0] == (0, 0, len(b))
    assert time.process_time() - at < 5  # difflib: over a minute


def test_rules_of_spaces_need_a_tight_mark():
    for text, n in [("end.Next", 1), ("a&B", 1), ("x;y ”.Z", 2), ("one. Two, three", 0), ("[1].“A 2,1999 *b", 3)]:
        found = sum(len(re.findall(f"({left})({right}" + (f"(?={ahead})" if ahead else "") + ")", text)) for _, left, right, ahead in SPACE_RULES)
        assert bool(found) == bool(n) and (not found or re.search(TIGHT, text))
    for _, left, right, _ in SPACE_RULES:
        assert not re.match(right, " ")


def test_joining_stats_shuffle_no_text(spark):
    plan = _plan(catalog.QUERIES["joining_stats"][0](spark, "/root/testdata/sf0.001"))
    assert plan.count("FileScan") <= 3  # lines once, geometry, shifts


@pytest.mark.parametrize("name", ["paged_coverage", "page_fidelity", "epub_spine"])
def test_folds_of_a_documents_own_lines_shuffle_nothing(spark, name):
    assert "Exchange" not in _plan(catalog.QUERIES[name][0](spark, "/root/testdata/sf0.001"))


def test_lcs_of_likes_is_that_of_the_table():
    draw = random.Random(4)
    for _ in range(200):
        a, b = ("".join(draw.choices("abc", k=draw.randint(0, 90))) for _ in "ab")
        b = draw.choice((b, a[:40] + b[:9] + a[50:]))
        row = [0] * (len(b) + 1)
        for x in a:
            now = [0]
            for j, y in enumerate(b):
                now.append(row[j] + 1 if x == y else max(row[j + 1], now[-1]))
            row = now
        assert seams.lcs(a, b) == seams.lcs(list(a), list(b)) == row[-1]
        n = seams._alike(a, b)
        assert a[:n] == b[:n] and (n == min(len(a), len(b)) or a[n] != b[n])


@pytest.mark.parametrize("body", ["<h1>A</h1><p>one</p><p> two\n </p>", "<h1>A <i>b</i></h1><p>x<b>y</b>z</p>", "<h1>A</h1><p>one<br>two</p>", "<p>a&nbsp;b &#65; &lt;</p>", "<p>a\rb</p>", "<p>\u0001</p>", "", "<P>x</P><p/>"])
def test_parts_read_alike_by_either_parser(body):
    text = page("de", "T", body)
    e = events(text)
    assert blocks(text) == (next((x[4] for x in e if x[:2] == ("text", "h1")), None), sum(x[:2] == ("start", "p") for x in e), "\n".join(x[4] for x in e if x[:2] == ("text", "p")))
