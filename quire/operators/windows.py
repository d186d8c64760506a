"""Window and sequence operators: runs and islands over lines, propagation of labels, orders, gutters, paragraph assembly."""

from __future__ import annotations

from quire.plans.dialect import Spark

HYPHEN = "text LIKE '%-'"


def seams(d: Spark) -> str:
    """Lines of which a word of eight letters or more at the end is cut after its fourth, put together again."""
    cut = f"{d.has('last_word', '^[a-zà-ÿ]{8,}$')}"
    return f"""w AS (SELECT doc_id, para, j, text, {d.first("text", "([^ ]+)$")} AS last_word, max(j) OVER (PARTITION BY doc_id, para) AS last_j FROM lines),
h AS (SELECT doc_id, para, j, CASE WHEN {cut} AND j < last_j THEN substr(text, 1, CAST(length(text) - length(last_word) + 4 AS INT)) || '-' ELSE text END AS text, CASE WHEN {cut} AND j < last_j THEN substr(last_word, 5) ELSE '' END AS rest FROM w),
b AS (SELECT doc_id, para, j, CASE WHEN lag(rest) OVER (PARTITION BY doc_id, para ORDER BY j) <> '' THEN lag(rest) OVER (PARTITION BY doc_id, para ORDER BY j) || ' ' || text ELSE text END AS text FROM h),
n AS (SELECT doc_id, para, j, text, lead(text) OVER (PARTITION BY doc_id, para ORDER BY j) AS nxt FROM b),
s AS (SELECT doc_id, para, j, CASE WHEN nxt IS NULL THEN text WHEN {d.has("text", "[A-Za-zÀ-ſ]-$")} AND {d.has("nxt", "^[a-zà-ÿ]")} THEN substr(text, 1, CAST(length(text) - 1 AS INT)) WHEN {d.has("text", "([A-Za-zÀ-ſ]-|www[.]|/)$")} THEN text ELSE text || ' ' END AS piece, CASE WHEN {d.has("text", "[A-Za-zÀ-ſ]-$")} AND {d.has("coalesce(nxt, '')", "^[a-zà-ÿ]")} THEN 1 ELSE 0 END AS mended FROM n)"""


OPERATORS = {
    "paragraph_assembly": (["lines"], lambda d: f"{seams(d)} SELECT doc_id, para, {d.joined('piece', '', 'j')} AS text, CAST(sum(mended) AS BIGINT) AS n_mended FROM s GROUP BY doc_id, para"),
    "line_seams": (["lines"], lambda d: f"{seams(d)} SELECT doc_id, para, j, piece, mended FROM (SELECT doc_id, para, j, piece, CAST(mended AS BIGINT) AS mended FROM s) WHERE mended = 1"),
    "paragraph_breaks": (["lines"], lambda d: """p AS (SELECT doc_id, page, line, x0, x1, y0, size, para, lag(x0) OVER u AS px0, lag(x1) OVER u AS px1, lag(size) OVER u AS psize, lag(page) OVER u AS ppage, lag(y0) OVER u AS py0 FROM lines WINDOW u AS (PARTITION BY doc_id ORDER BY line)),
e AS (SELECT doc_id, max(x1) AS edge FROM lines GROUP BY doc_id),
b AS (SELECT p.doc_id, line, CASE WHEN px0 IS NULL THEN 'first' WHEN size <> psize THEN 'style' WHEN page <> ppage THEN CASE WHEN px1 < edge - 40 THEN 'page-short' WHEN x0 > 80 THEN 'page-indent' ELSE 'join' END WHEN x0 > 80 AND px0 < 80 THEN 'indent' WHEN px1 < edge - 40 AND x0 <= px0 THEN 'short' WHEN y0 - py0 > 21.6 THEN 'gap' ELSE 'join' END AS rule FROM p JOIN e ON p.doc_id = e.doc_id)
SELECT doc_id, line, rule, CAST(sum(CASE WHEN rule = 'join' THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line) AS BIGINT) AS paragraph FROM b"""),
    "page_label_fill": (["lines"], lambda d: """p AS (SELECT doc_id, page, CASE WHEN (doc_id + page) % 4 = 1 THEN page + 10 END AS printed FROM lines WHERE idx = 0),
f AS (SELECT doc_id, page, printed, max(CASE WHEN printed IS NOT NULL THEN page END) OVER (PARTITION BY doc_id ORDER BY page) AS from_page, min(CASE WHEN printed IS NOT NULL THEN page END) OVER (PARTITION BY doc_id ORDER BY page DESC) AS to_page FROM p)
SELECT f.doc_id, f.page, CASE WHEN from_page IS NOT NULL THEN from_page + 10 + f.page - from_page WHEN to_page IS NOT NULL THEN to_page + 10 - (to_page - f.page) ELSE 0 END AS label, CASE WHEN printed IS NOT NULL THEN 'printed' WHEN from_page IS NOT NULL THEN 'continued' WHEN to_page IS NOT NULL THEN 'backfilled' ELSE 'none' END AS how FROM f"""),
    "heading_running_page": (["lines"], lambda d: "e AS (SELECT doc_id, line, page, CASE WHEN size > 12 THEN text END AS heading FROM lines), g AS (SELECT doc_id, line, page, heading, count(heading) OVER (PARTITION BY doc_id ORDER BY line) AS section FROM e), h AS (SELECT doc_id, section, max(heading) AS heading, min(page) AS first_page, max(page) AS last_page, count(*) AS n_lines FROM g GROUP BY doc_id, section) SELECT * FROM h WHERE section > 0"),
    "order_inversions": (["lines"], lambda d: "p AS (SELECT doc_id, page, CAST(sum(length(text)) AS BIGINT) AS n FROM lines GROUP BY doc_id, page), s AS (SELECT doc_id, page, n, CASE WHEN page % 5 = 0 THEN 0 ELSE CAST(sum(n) OVER (PARTITION BY doc_id ORDER BY page) AS BIGINT) - n END AS start FROM p), m AS (SELECT doc_id, page, start, max(start) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s WHERE n >= 60) SELECT doc_id, page, start, before FROM m WHERE start < before - 400"),
    "page_window_text": (["lines"], lambda d: f"p AS (SELECT doc_id, page, {d.joined('text', ' ', 'line')} AS t FROM lines GROUP BY doc_id, page), w AS (SELECT doc_id, page, length(t) AS n, lag(t) OVER (PARTITION BY doc_id ORDER BY page) AS a, lead(t) OVER (PARTITION BY doc_id ORDER BY page) AS b FROM p) SELECT doc_id, page, CAST(n + coalesce(length(a), 0) + coalesce(length(b), 0) AS BIGINT) AS window_chars FROM w"),
    "page_slices": (["lines"], lambda d: f"e AS (SELECT doc_id, line, text, CASE WHEN idx = 0 THEN 1 ELSE 0 END AS brk FROM lines), o AS (SELECT doc_id, line, text, sum(brk) OVER (PARTITION BY doc_id ORDER BY line) AS k FROM e) SELECT doc_id, CAST(k AS BIGINT) AS page, count(*) AS n_lines, {d.joined('text', ' ', 'line')} AS text FROM o GROUP BY doc_id, k"),
    "signature_rle": (["lines"], lambda d: "s AS (SELECT doc_id, line, CAST(CAST(size AS BIGINT) AS VARCHAR(9)) || CASE WHEN italic THEN 'i' ELSE '' END AS sig FROM lines), c AS (SELECT doc_id, line, sig, CASE WHEN sig = lag(sig) OVER (PARTITION BY doc_id ORDER BY line) THEN 0 ELSE 1 END AS fresh FROM s), r AS (SELECT doc_id, line, sig, sum(fresh) OVER (PARTITION BY doc_id ORDER BY line) AS run FROM c) SELECT doc_id, CAST(run AS BIGINT) AS run, min(sig) AS sig, count(*) AS n, min(line) AS first_line FROM r GROUP BY doc_id, run"),
    "page_ranges": (["lines"], lambda d: "p AS (SELECT DISTINCT doc_id, page FROM lines WHERE italic), g AS (SELECT doc_id, page, page - row_number() OVER (PARTITION BY doc_id ORDER BY page) AS island FROM p) SELECT doc_id, min(page) AS first_page, max(page) AS last_page, CASE WHEN min(page) = max(page) THEN CAST(min(page) AS VARCHAR(20)) ELSE CAST(min(page) AS VARCHAR(20)) || '-' || CAST(max(page) AS VARCHAR(20)) END AS label FROM g GROUP BY doc_id, island"),
    "column_gutters": (["lines"], lambda d: f"""l AS (SELECT doc_id, page, CAST(x0 + CASE WHEN line % 2 = 0 THEN 0 ELSE 260 END AS BIGINT) AS a, CAST(least(x1, 300) + CASE WHEN line % 2 = 0 THEN 0 ELSE 260 END AS BIGINT) AS b FROM lines WHERE page = 1),
q AS (SELECT doc_id, x * 6 + 60 AS pos FROM (SELECT DISTINCT doc_id, {d.rows(d.upto("100"))} FROM (SELECT DISTINCT doc_id FROM l))),
c AS (SELECT q.doc_id, q.pos, count(CASE WHEN l.a <= q.pos AND l.b >= q.pos THEN 1 END) AS cover, min(l.a) AS lo, max(l.b) AS hi FROM q JOIN l ON q.doc_id = l.doc_id GROUP BY q.doc_id, q.pos),
i AS (SELECT doc_id, pos, {d.div("pos", "6")} - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM c WHERE cover = 0 AND pos > lo AND pos < hi)
SELECT doc_id, CAST(min(pos) AS BIGINT) AS gutter_from, CAST(max(pos) AS BIGINT) AS gutter_to FROM i GROUP BY doc_id, island"""),
    "reading_order": (["lines"], lambda d: "l AS (SELECT doc_id, page, line, idx, CASE WHEN idx % 10 = 9 THEN 1 ELSE 0 END AS span, CASE WHEN idx % 10 = 9 THEN 0 ELSE idx % 2 END AS col FROM lines), b AS (SELECT doc_id, page, line, idx, span, col, sum(span) OVER (PARTITION BY doc_id, page ORDER BY idx) * 2 - span AS band FROM l) SELECT doc_id, page, line, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY band, col, idx) AS BIGINT) AS position FROM b"),
    "right_margins": (["lines"], lambda d: f"r AS (SELECT doc_id, page, line, {d.rint('x0')} AS a, {d.rint('x1')} AS b, CASE WHEN {d.rint('x0')} = lag({d.rint('x0')}) OVER (PARTITION BY doc_id, page ORDER BY line) THEN 0 ELSE 1 END AS fresh FROM lines), g AS (SELECT doc_id, page, a, b, sum(fresh) OVER (PARTITION BY doc_id, page ORDER BY line) AS run FROM r) SELECT doc_id, page, CAST(run AS BIGINT) AS run, min(a) AS x0, max(b) AS right_edge, count(*) AS n FROM g GROUP BY doc_id, page, run HAVING count(*) >= 2"),
    "noteref_seams": (["paras"], lambda d: f"w AS (SELECT doc_id, para, CAST(i AS BIGINT) AS i, x AS word FROM (SELECT doc_id, para, {d.rows(d.words('text'))} FROM paras)), n AS (SELECT doc_id, para, i, word, i % 13 = 5 AS is_ref, lead(word) OVER (PARTITION BY doc_id, para ORDER BY i) AS nxt FROM w) SELECT doc_id, para, i, nxt FROM n WHERE is_ref AND {d.has('nxt', '^[A-Za-z0-9]')} AND (i + para) % 3 = 0"),
}
