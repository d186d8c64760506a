"""Views derived from the tables, on which the operators run: paragraphs, physical lines with a layout, damaged text.

Lines hold ten words; the layout is that of a book page of 40 lines with an indent at a paragraph's first line. ``damaged``
carries the kinds of damage that the repairs mend, one kind by the paragraph's number, so that repairs have work to do.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from quire.plans.dialect import Keyed, Spark

SOFT, LOST, PRIVATE, CONTROL, LIGATURE, CLOSE = "­", "�", "", "\u0001", "ﬁ", "”"


def paras(d: Spark) -> str:
    return f"""SELECT doc_id, source, lang, CAST(i AS BIGINT) AS para, x AS text
FROM (SELECT doc_id, source, lang, {d.rows(d.paragraphs())} FROM documents) WHERE trim(x) <> ''"""


_dialects: dict[tuple, Spark] = {}


def dialect(spark: SparkSession, sf_dir: str) -> Spark:
    """Spark's spellings for a folder, asked once a session: where no doc_id is there twice, lines need no window over documents."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _dialects:
        twice = spark.read.parquet(f"{sf_dir}/documents.parquet").groupBy("doc_id").count().where("count > 1")
        _dialects[key] = Keyed() if twice.isEmpty() else Spark()
    return _dialects[key]


def row_lines(d: Spark, more: str = "") -> str:
    """The lines of a document's row as an array in order: line, para, j, text, mark, n_lines. A paragraph's words are there once, not with each of its lines.

    ``more`` are arrays of such structs made of the lines ``a``. The one-element array around the lines is there for its lambda: it names them,
    so that they are made once.
    """
    each = f"""flatten(transform(filter(transform({d.paragraphs()}, (x, i) -> struct(i AS para, x, {d.words("x")} AS w)), p -> trim(p.x) <> ''),
  p -> transform({d.upto(d.div(d.size("p.w") + " + 9", "10"))}, k -> struct(CAST(p.para AS BIGINT) AS para, CAST(k AS BIGINT) AS j, {d.part("p.w", "k * 10 + 1", 10)} AS text))))"""
    rows = f"transform(a, (r, i) -> {row_line('i', 'r.para', 'r.j', 'r.text', 'line')})"
    return f"""transform(array({each}), a -> {f"concat({rows}, {more})" if more else rows})[0]"""


def row_line(line: str, para: str, j: str, text: str, mark: str) -> str:
    return f"struct(CAST({line} AS BIGINT) AS line, CAST({para} AS BIGINT) AS para, CAST({j} AS BIGINT) AS j, {text} AS text, '{mark}' AS mark, size(a) AS n_lines)"


def lines(d: Spark, more: str = "") -> str:
    numbered = f"""SELECT doc_id, source, lang, para, CAST(i AS BIGINT) AS j, {d.part("w", "x * 10 + 1", 10)} AS text, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY para, i) - 1 AS BIGINT) AS line
  FROM (SELECT doc_id, source, lang, para, w, {d.rows(d.upto(d.div(d.size("w") + " + 9", "10")))} FROM (SELECT *, {d.words("text")} AS w FROM paras))"""
    if d.keyed:
        numbered = f"SELECT doc_id, source, lang, inline({row_lines(d, more)}) FROM documents"
    return f"""SELECT doc_id, source, lang, para, j, line, text, {d.div("line", "40")} + 1 AS page, line % 40 AS idx,
  CAST(CASE WHEN j = 0 THEN 90 ELSE 72 END AS DOUBLE) AS x0, CAST(CASE WHEN j = 0 THEN 90 ELSE 72 END + 5 * length(text) AS DOUBLE) AS x1, CAST(100 + 13.5 * (line % 40) AS DOUBLE) AS y0,
  CAST(CASE WHEN para % 17 = 0 THEN 9 WHEN j = 0 AND length(text) < 30 THEN 14 ELSE 11 END AS DOUBLE) AS size, para % 5 = 0 AS italic{", mark, n_lines" if d.keyed else ""}
FROM ({numbered})"""


def damaged(d: Spark) -> str:
    return f"""SELECT doc_id, para, lang, text AS original, CASE (doc_id + para) % 9
  WHEN 0 THEN replace(text, '. ', '.') WHEN 1 THEN replace(text, 'th', '{LIGATURE}') WHEN 2 THEN replace(text, 'e ', 'e{SOFT} ') WHEN 3 THEN replace(text, 'on', '{LOST}')
  WHEN 4 THEN replace(text, 'an ', '{PRIVATE} ') WHEN 5 THEN replace(text, ' the ', ' the{CONTROL} ') WHEN 6 THEN replace(text, '. ', '. {CLOSE}') WHEN 7 THEN replace(replace(text, ', ', ','), 'e ', 'e` ')
  ELSE replace(text, 'ti', 't- i') END AS text FROM paras"""


VIEWS = {"paras": paras, "lines": lines, "damaged": damaged}
NEEDS = {"paras": [], "lines": ["paras"], "damaged": ["paras"]}


def prefix(d: Spark, names: list[str]) -> str:
    """WITH clause of the views and those they need."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS[name]:
            add(n)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n](d)})" for n in order) + ("," if order else "")
