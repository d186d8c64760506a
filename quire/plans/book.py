"""The fixture that layout operators are tried on: books set from the text tables, the only place where evidence is made up.

``book`` has the physical lines of pages (doc_id, page, idx, text, box, size, family, italic, bold, vertical), ``book_pages`` the
pages (label, images, trim). Pages of every book have a running head with a fused folio, a folio line, centred headings, drop caps, verse at two
levels, quotations inset on both sides, notes in small type, a first-line indent, and in some books even pages slid sideways; some
end in a plate. The SQL is the same for both engines, as tables are; operators and oracles read only its columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.plans.dialect import Spark
from quire.plans.views import dialect, lines, prefix, row_line
from quire.session import workspace

FULL = "length(text) - length(replace(text, ' ', '')) >= 9"


def _body(extra: str = "", lines: str = "lines") -> str:
    """The lines as they are set; ``extra`` columns go along."""
    return f"""SELECT doc_id, source, lang, page, para, kind, CASE WHEN kind = 'note' AND idx = 37 THEN '1. ' || text ELSE text END AS text,
  CASE kind WHEN 'head' THEN 252 - 2.5 * length(text) WHEN 'verse' THEN CASE WHEN j % 2 = 0 THEN 90 ELSE 108 END WHEN 'quote' THEN 96 WHEN 'note' THEN 72 ELSE CASE WHEN page % 4 = 1 AND idx < 2 THEN 91 WHEN j = 0 THEN 90 ELSE 72 END END AS x0,
  CASE kind WHEN 'head' THEN 252 + 2.5 * length(text) WHEN 'verse' THEN 230 + line * 17 % 90 WHEN 'quote' THEN CASE WHEN {FULL} THEN 408 ELSE least(400, 96 + 5 * length(text)) END
    ELSE CASE WHEN {FULL} THEN 432 ELSE least(425, 72 + 5 * length(text)) END END AS x1,
  100 + 13.5 * idx AS y0, CASE kind WHEN 'head' THEN 14 WHEN 'note' THEN 9 ELSE 11 END AS size, CASE WHEN kind = 'head' THEN 'Trajan' WHEN italic THEN 'Garamond-Italic' ELSE 'Garamond' END AS family, italic, kind = 'head' AS bold{extra}
  FROM (SELECT *, CASE WHEN size = 14 THEN 'head' WHEN idx >= 37 AND page % 2 = 1 THEN 'note' WHEN para % 7 = 3 THEN 'verse' WHEN para % 7 = 5 THEN 'quote' ELSE 'body' END AS kind FROM {lines})"""


def book(d: Spark) -> str:
    if d.keyed:
        return _row_book(d)
    body = _body()
    sheets = "(SELECT doc_id, source, lang, page FROM lines UNION SELECT doc_id, source, lang, max(page) + 1 FROM lines WHERE doc_id % 5 = 0 GROUP BY doc_id, source, lang)"
    heads = "SELECT doc_id, source, lang, page, -1, 'running', CASE WHEN page % 2 = 0 THEN CAST(page AS VARCHAR(9)) || 'the book of ' || source ELSE 'Part of ' || source END, 200, 300, 40, 9, 'Garamond', false, false FROM lines GROUP BY doc_id, source, lang, page"
    caps = f"SELECT doc_id, source, lang, page, para, 'cap', {d.capital('substr(text, 1, 1)')}, 72, 91, 100, 30, 'Trajan', false, false FROM lines WHERE idx = 0 AND page % 4 = 1"
    folios = f"SELECT doc_id, source, lang, page, -1, 'folio', CAST(page AS VARCHAR(9)), 245, 259, 690, 9, 'Garamond', false, false FROM {sheets}"
    return f"""SELECT doc_id, source, lang, page, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY y0, x0, kind) - 1 AS BIGINT) AS idx, para, kind, text, CAST(x0 + slide AS DOUBLE) AS x0, CAST(x1 + slide AS DOUBLE) AS x1,
  CAST(y0 AS DOUBLE) AS y0, CAST(y0 + size AS DOUBLE) AS y1, CAST(size AS DOUBLE) AS size, family, italic, bold, false AS vertical
FROM (SELECT *, CASE WHEN page % 2 = 0 AND doc_id % 3 = 0 THEN 12 ELSE 0 END AS slide FROM ({body} UNION ALL {heads} UNION ALL {caps} UNION ALL {folios}))"""


def _row_book(d: Spark) -> str:
    """The same rows without a shuffle: a document's row brings the lines of its pages along with its own, and its plate.

    Their places follow from where they stand: the running head (y0 40) before all lines (100 to 626.5), the folio (690) behind them, the drop cap (x0 72)
    before the first line, which never stands further left than 90.
    """
    head = row_line("p * 40", "-1", "0", "CASE WHEN p % 2 = 1 THEN CAST(p + 1 AS VARCHAR(9)) || 'the book of ' || source ELSE 'Part of ' || source END", "running")
    cap = row_line("p * 40", "r.para", "0", d.capital("substr(r.text, 1, 1)"), "cap")
    foot = row_line("p * 40", "-1", "0", "CAST(p + 1 AS VARCHAR(9))", "folio")
    plate = row_line("size(a) + 39 - (size(a) + 39) % 40", "-1", "0", "CAST((size(a) + 39) DIV 40 + 1 AS VARCHAR(9))", "plate")
    more = f"flatten(transform(filter(a, (r, i) -> i % 40 = 0), (r, p) -> CASE WHEN p % 4 = 0 THEN array({head}, {cap}, {foot}) ELSE array({head}, {foot}) END)), filter(array({plate}), r -> r.n_lines > 0 AND doc_id % 5 = 0)"
    put = lambda own, running, cap, folio: f"CASE mark WHEN 'line' THEN {own} WHEN 'running' THEN {running} WHEN 'cap' THEN {cap} ELSE {folio} END"
    return f"""SELECT doc_id, source, lang, page, CAST(CASE mark WHEN 'line' THEN place + lead WHEN 'cap' THEN 1 WHEN 'folio' THEN least(40, n_lines - (page - 1) * 40) + lead ELSE 0 END AS BIGINT) AS idx, para,
  CASE mark WHEN 'line' THEN kind WHEN 'plate' THEN 'folio' ELSE mark END AS kind, text, CAST({put("x0", 200, 72, 245)} + slide AS DOUBLE) AS x0, CAST({put("x1", 300, 91, 259)} + slide AS DOUBLE) AS x1,
  CAST({put("y0", 40, 100, 690)} AS DOUBLE) AS y0, CAST({put("y0 + size", 49, 130, 699)} AS DOUBLE) AS y1, CAST({put("size", 9, 30, 9)} AS DOUBLE) AS size,
  {put("family", "'Garamond'", "'Trajan'", "'Garamond'")} AS family, mark = 'line' AND italic AS italic, mark = 'line' AND bold AS bold, false AS vertical
FROM (SELECT *, CASE WHEN page % 4 = 1 THEN 2 ELSE 1 END AS lead, CASE WHEN page % 2 = 0 AND doc_id % 3 = 0 THEN 12 ELSE 0 END AS slide FROM ({_body(", idx AS place, mark, n_lines", f"({lines(d, more)})")}))"""


def book_pages(d: Spark) -> str:
    return """SELECT doc_id, page, CASE WHEN doc_id % 4 = 3 THEN NULL WHEN page % 30 = 29 THEN CAST(page + 1 AS VARCHAR(9)) ELSE CAST(page AS VARCHAR(9)) END AS label,
  CASE WHEN page % 5 = 0 OR count(*) = 1 THEN 1 ELSE 0 END AS n_images, CAST(0 AS DOUBLE) AS trim_x0, CAST(0 AS DOUBLE) AS trim_y0, CAST(504 AS DOUBLE) AS trim_x1, CAST(720 AS DOUBLE) AS trim_y1 FROM book GROUP BY doc_id, page"""


def hyphened(d: Spark) -> str:
    """Lines of a paragraph whose last words are cut by a hyphen where they are long and in small letters."""
    last, before = d.at("w", "least(n, x * 10 + 10)"), d.at("w", "x * 10")
    cut = lambda w: f"length({w}) >= 7 AND {d.has(w, '^[a-z]+$')} AND substr({w}, 5) NOT IN ('and', 'und', 'oder', 'nor') AND substr({w}, 1, 4) NOT IN ('self', 'half', 'well', 'just')"
    return f"""SELECT doc_id, para, CAST(x AS BIGINT) AS j, text AS whole, CASE WHEN x > 0 AND {cut(before)} THEN substr({before}, 5) || CASE WHEN n > x * 10 THEN ' ' ELSE '' END ELSE '' END
  || CASE WHEN n >= x * 10 + 10 AND n > x * 10 + 10 AND {cut(last)} THEN {d.part("w", "x * 10 + 1", 9)} || ' ' || substr({last}, 1, 4) || '-' ELSE {d.part("w", "x * 10 + 1", 10)} END AS text
FROM (SELECT doc_id, para, text, w, n, x FROM (SELECT doc_id, para, text, w, {d.size("w")} AS n, {d.rows(d.upto(d.div(d.size("w") + " + 9", "10")))} FROM (SELECT doc_id, para, text, {d.words("text")} AS w FROM paras)))"""


def names(d: Spark) -> str:
    kinds = ".xhtml .css .ncx .otf .ttf .jpg .JPEG .png .gif .svg .bin .txt".split()
    case = " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(kinds))
    return f"SELECT DISTINCT idx, source || ' Body_' || CAST(idx AS VARCHAR(9)) || CASE idx % 12 {case} END AS name FROM book"


def markers(d: Spark) -> str:
    """Paragraphs, some with a marker of a list before them."""
    lead = ["1. ", "19-22. ", "3.· ", "7.Art ", "1987 ", "12) ", "• ", "‣ ", "- ", "* ", "", "4.x "]
    case = " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(lead))
    return f"SELECT doc_id, para, CASE (doc_id + para) % 12 {case} END || text AS text FROM paras"


def links(d: Spark) -> str:
    return "SELECT doc_id, page * 1000 + idx AS link, CASE idx % 5 WHEN 0 THEN 'goto' WHEN 1 THEN 'uri' WHEN 2 THEN 'named' WHEN 3 THEN 'launch' ELSE 'goto' END AS kind, CASE WHEN idx % 7 = 2 THEN 'chapter' ELSE CAST(page AS VARCHAR(20)) END AS target FROM book"


def outline(d: Spark) -> str:
    nul = "chr(0)"
    return f"SELECT doc_id, page * 1000 + idx AS pos, idx % 3 AS depth, text || CASE WHEN idx % 2 = 0 THEN {nul} || {nul} ELSE '' END AS title, CASE WHEN page % 7 = 6 THEN NULL WHEN page % 5 = 4 THEN -1 ELSE page END AS target FROM book WHERE kind = 'head'"


def warnings(d: Spark) -> str:
    codes = ["image-only-page", "engine-agreement-low", "embedded-image-uncovered", "top-band-kept", "nav-numeric-bloat", "pua-unmapped"]
    case = " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(codes))
    return f"SELECT doc_id, page * 10 + idx AS warning, CASE (page + idx) % 6 {case} END AS code, CASE WHEN (page + idx) % 6 = 4 OR idx = 5 THEN NULL ELSE page END AS page, idx AS line FROM book WHERE idx < 6"


def toc(d: Spark) -> str:
    """Lines of a contents page: with leaders, with two spaces, with a run of its own for the folio, and without one."""
    t, p = "substr(text, 1, 30)", "CAST(page AS VARCHAR(9))"
    return f"""SELECT doc_id, line, CASE k WHEN 0 THEN {t} || ' . . . . ' || {p} WHEN 1 THEN {t} || '   xiv' WHEN 2 THEN {t} || ' ' || {p} WHEN 3 THEN {t} || ' ' || {p} ELSE text END AS text,
  CASE k WHEN 2 THEN {p} WHEN 3 THEN {p} END AS last, CAST(CASE k WHEN 2 THEN 8 WHEN 3 THEN 3 END AS DOUBLE) AS gap FROM (SELECT doc_id, page * 1000 + idx AS line, page, trim({d.sub('text', '[ .]+', ' ')}) AS text, idx % 5 AS k FROM book WHERE kind = 'body')"""


def figures(d: Spark) -> str:
    return "SELECT doc_id, page * 1000 + idx AS figure, 'f' || CAST(idx AS VARCHAR(9)) || '.png' AS file, CASE WHEN idx % 4 = 0 THEN NULL ELSE '<' || substr(text, 1, 9) || '> & more' END AS alt, CASE idx % 5 WHEN 0 THEN 'chinese-page' WHEN 1 THEN 'decoration' ELSE 'figure' END AS role, x1 - x0 + CASE WHEN idx % 7 = 3 THEN 200 ELSE 0 END AS width FROM book"


def blocks(d: Spark) -> str:
    return "SELECT doc_id, page * 1000 + idx AS pos, CASE kind WHEN 'folio' THEN 'break' WHEN 'head' THEN 'head' WHEN 'running' THEN 'break' WHEN 'verse' THEN 'text' ELSE 'entry' END AS kind, text FROM book WHERE kind <> 'cap'"


def events(d: Spark) -> str:
    return "SELECT doc_id, page AS block, idx AS pos, CASE WHEN idx % 4 = 3 THEN 'a' ELSE 'p' END AS tag, CASE idx % 8 WHEN 3 THEN 'noteref x' WHEN 7 THEN 'backlink' ELSE '' END AS cls, CASE WHEN idx % 4 = 3 THEN ' ' || CAST(idx AS VARCHAR(9)) || ' ' ELSE text END AS text FROM book"


def ranges(d: Spark) -> str:
    return "SELECT doc_id, page AS para, idx * 10 AS start, idx * 10 + 25 AS stop FROM book WHERE idx < 12"


def needles(d: Spark) -> str:
    """Pieces of paragraphs to be found again: as they are, with words in the middle changed, without spaces, and not there at all."""
    piece = "substr(text, 6, 90)"
    return f"SELECT doc_id, para, text, CASE para % 4 WHEN 0 THEN {piece} WHEN 1 THEN substr({piece}, 1, 52) || '###' || substr({piece}, 56) WHEN 2 THEN replace({piece}, ' ', '- ') ELSE '@@@@ @@@@ @@@@ @@@@' END AS needle FROM paras WHERE length(text) >= 120"


MADE = {"book": (["lines"], book), "book_pages": (["lines", "book"], book_pages), "hyphened": (["paras"], hyphened), "markers": (["paras"], markers), "needles": (["paras"], needles)} | {f.__name__: (["lines", "book"], f) for f in (names, links, outline, warnings, toc, figures, blocks, events, ranges)}


def sql(d: Spark, names: list[str]) -> str:
    """WITH clause that defines the named tables of the fixture, and what they are made of."""
    base, order = [], []
    for n in names:
        if n not in MADE:
            base.append(n)
            continue
        for need in MADE[n][0]:
            (order if need in MADE else base).append(need)
        order.append(n)
    order = list(dict.fromkeys(order))
    head = prefix(d, list(dict.fromkeys(base)))
    return head if not order else head + "\n" + ",\n".join(f"{n} AS ({MADE[n][1](d)})" for n in order) + ","


WRITTEN = {"book", "book_pages"}
_ready: dict[tuple, DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the fixture. The book and its pages are written once a session to the shared folder, so that no query lays out the corpus anew;
    the others are a projection of the book or the documents."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    d = dialect(spark, sf_dir)
    if key not in _ready:
        spark.read.parquet(f"{sf_dir}/documents.parquet").createOrReplaceTempView("documents")
        if "book" in MADE.get(name, ([],))[0]:
            table(spark, sf_dir, "book").createOrReplaceTempView("book")
            df = spark.sql(MADE[name][1](d))
        else:
            df = spark.sql(f"{sql(d, [name]).rstrip(',')} SELECT * FROM {name}")
        if name not in WRITTEN:
            return df
        at = f"{workspace(spark)}/{name}-{len(_ready)}"
        df.write.mode("overwrite").parquet(at)
        _ready[key] = spark.read.schema(df.schema).parquet(at)
    return _ready[key]


def kept(spark: SparkSession, sf_dir: str, name: str, make) -> DataFrame:
    """What ``make()`` gives, written once a session to the shared folder: derived tables that many queries read."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _ready:
        df, at = make(), f"{workspace(spark)}/{name}-{len(_ready)}"
        df.write.mode("overwrite").parquet(at)
        _ready[key] = spark.read.schema(df.schema).parquet(at)
    return _ready[key]
