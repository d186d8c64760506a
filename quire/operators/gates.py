"""Quality gates, samples and configured pages: every gate is a row with ok true, false, or null where it only informs."""

from __future__ import annotations

from quire.operators.text import folio
from quire.plans.dialect import Spark


def gates(d: Spark) -> str:
    return f"""c AS (SELECT doc_id, CAST(sum({d.count("text", "[-]")}) AS BIGINT) AS pua, CAST(sum({d.count("text", "�")}) AS BIGINT) AS lost, CAST(sum({d.count("text", "[a-z]- [a-z]")}) AS BIGINT) AS hyphens, CAST(sum({d.count("text", "[a-z][.!?,;:][A-Z]")}) AS BIGINT) AS spaces FROM damaged GROUP BY doc_id),
g AS (SELECT doc_id, 'pua residue' AS gate, pua = 0 AS ok, pua AS n FROM c UNION ALL SELECT doc_id, 'garble', lost = 0, lost FROM c UNION ALL SELECT doc_id, 'hyphen residue', hyphens = 0, hyphens FROM c UNION ALL SELECT doc_id, 'lost space', spaces = 0, spaces FROM c UNION ALL SELECT doc_id, 'reference scorecard', CAST(NULL AS BOOLEAN), pua + lost FROM c)"""


OPERATORS = {
    "gate_rows": (["damaged"], lambda d: f"{gates(d)} SELECT doc_id, gate, CASE WHEN ok IS NULL THEN 'info' WHEN ok THEN 'pass' ELSE 'fail' END AS verdict, n FROM g"),
    "gate_summary": (["damaged"], lambda d: f"{gates(d)} SELECT doc_id, count(*) AS n_gates, count(CASE WHEN NOT ok THEN 1 END) AS failed, count(CASE WHEN ok IS NULL THEN 1 END) AS advisory, bool_and(ok) AS passed FROM g GROUP BY doc_id"),
    "in_flow_pages": (["lines"], lambda d: "x AS (SELECT 1 AS page UNION ALL SELECT 4) SELECT DISTINCT l.doc_id, l.page FROM lines l LEFT JOIN x ON l.page = x.page WHERE x.page IS NULL"),
    "trim_clip": (["lines"], lambda d: "c AS (SELECT doc_id, line, (x0 + x1) / 2 AS xc, y0 + 6 AS yc FROM lines) SELECT doc_id, line, xc BETWEEN 24 AND 250 AND yc BETWEEN 24 AND 560 AS inside FROM c"),
    "crop_box_vote": (["lines"], lambda d: "b AS (SELECT doc_id, page, CASE WHEN page % 5 = 0 THEN '0 0 431 648' ELSE '24 24 455 672' END AS box FROM lines WHERE idx = 0), v AS (SELECT doc_id, box, count(*) AS n, min(page) AS seen FROM b GROUP BY doc_id, box), k AS (SELECT doc_id, box, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, seen) AS k FROM v) SELECT doc_id, box, n FROM k WHERE k = 1"),
    "trim_in_text_space": (["lines"], lambda d: f"p AS (SELECT doc_id, page, page % 7 AS dx, page % 5 AS dy FROM lines WHERE idx = 0) SELECT doc_id, page, 24 - dx AS x0, 672 - 24 - dy AS y1, {d.rint('(431.25 - dx) * 100')} AS width_100 FROM p"),
    "page_lists": (["lines"], lambda d: f"s AS (SELECT DISTINCT doc_id, page AS a, page + page % 4 AS b FROM lines), e AS (SELECT doc_id, a, a + x AS page FROM (SELECT doc_id, a, {d.rows(d.upto('b - a + 1'))} FROM s)) SELECT doc_id, CAST(page AS BIGINT) AS page, count(*) AS n FROM e GROUP BY doc_id, page"),
    "page_range_check": (["lines"], lambda d: "r AS (SELECT doc_id, page AS a, page + page % 3 AS b FROM lines WHERE idx = 0), o AS (SELECT doc_id, a, b, lag(b) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM r) SELECT doc_id, a, b, before FROM o WHERE before >= a"),
    "form_feed_pages": (["lines"], lambda d: f"t AS (SELECT doc_id, {d.joined('text', '|', 'line')} AS t FROM lines GROUP BY doc_id), s AS (SELECT doc_id, CAST(i AS BIGINT) + 1 AS page, x AS text FROM (SELECT doc_id, {d.rows("split(t, '[|]')" if d.name == 'spark' else "string_split(t, '|')")} FROM t)) SELECT doc_id, page, text FROM s WHERE trim(text) <> ''"),
    "nav_numeric_bloat": (["lines"], lambda d: f"n AS (SELECT doc_id, CASE WHEN line % 3 = 0 THEN CAST(line AS VARCHAR(20)) || '.' ELSE text END AS title FROM lines) SELECT doc_id, count(CASE WHEN {d.has('title', '^[0-9]+[.]?[*]*$')} THEN 1 END) AS numeric_titles, count(*) AS n FROM n GROUP BY doc_id HAVING count(CASE WHEN {d.has('title', '^[0-9]+[.]?[*]*$')} THEN 1 END) >= 10"),
    "page_list_order": (["lines"], lambda d: f"p AS (SELECT doc_id, page, CASE WHEN page <= 2 THEN 'roman' ELSE 'arabic' END AS kind, CASE WHEN page % 6 = 0 THEN page - 2 ELSE page END AS val FROM lines WHERE idx = 0), l AS (SELECT doc_id, page, kind, val, lag(kind) OVER (PARTITION BY doc_id ORDER BY page) AS pk, lag(val) OVER (PARTITION BY doc_id ORDER BY page) AS pv FROM p) SELECT doc_id, page, CASE WHEN pk = 'arabic' AND kind = 'roman' THEN 'roman after arabic' WHEN pk = kind AND val <= pv THEN 'not increasing' ELSE 'ok' END AS finding FROM l"),
    "citation_index": (["paras"], lambda d: f"s AS (SELECT 1 AS sura, 7 AS verses UNION ALL SELECT 2, 286 UNION ALL SELECT 3, 200 UNION ALL SELECT 4, 176), t AS (SELECT doc_id, para, CAST(para % 5 + 1 AS VARCHAR(9)) || ':' || CAST(para * 3 % 300 AS VARCHAR(9)) AS cite FROM paras), c AS (SELECT doc_id, para, CAST({d.first('cite', '^([0-9]+):')} AS BIGINT) AS sura, CAST({d.first('cite', ':([0-9]+)$')} AS BIGINT) AS verse FROM t), o AS (SELECT doc_id, para, sura, verse, lag(sura * 1000 + verse) OVER (PARTITION BY doc_id ORDER BY para) AS before FROM c) SELECT o.doc_id, o.para, o.sura, o.verse, CASE WHEN s.sura IS NULL THEN 'no such sura' WHEN o.verse < 1 OR o.verse > s.verses THEN 'no such verse' WHEN o.before > o.sura * 1000 + o.verse THEN 'out of order' ELSE 'ok' END AS finding FROM o LEFT JOIN s ON o.sura = s.sura"),
    "heading_census": (["lines"], lambda d: f"h AS (SELECT doc_id, line, text FROM lines WHERE size > 12) SELECT doc_id, line, CASE WHEN {d.has('text', '[.!?]$')} THEN 'sentence-like' WHEN {d.has('text', '^(Part|Chapter)[A-Z0-9]')} THEN 'fused label' ELSE 'ok' END AS finding FROM h"),
    "size_fidelity": (["lines"], lambda d: "s AS (SELECT doc_id, size, count(*) AS n FROM lines GROUP BY doc_id, size), e AS (SELECT doc_id, size, n, CAST(size * 1000 / 11 AS BIGINT) AS em, CAST(size * 1000 / 11 AS BIGINT) + CASE WHEN doc_id % 5 = 0 THEN 100 ELSE 0 END AS shipped FROM s) SELECT doc_id, size, em, shipped, abs(em - shipped) <= 60 AS ok FROM e" if d.name == "duckdb" else "s AS (SELECT doc_id, size, count(*) AS n FROM lines GROUP BY doc_id, size), e AS (SELECT doc_id, size, n, CAST(rint(size * 1000 / 11) AS BIGINT) AS em, CAST(rint(size * 1000 / 11) AS BIGINT) + CASE WHEN doc_id % 5 = 0 THEN 100 ELSE 0 END AS shipped FROM s) SELECT doc_id, size, em, shipped, abs(em - shipped) <= 60 AS ok FROM e"),
    "stratified_sample": (["lines"], lambda d: f"p AS (SELECT DISTINCT doc_id, page FROM lines), r AS (SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id ORDER BY {d.hash("'7:' || CAST(page AS VARCHAR(20))")}) AS k FROM p), f AS (SELECT doc_id, CASE WHEN size > 12 THEN 'heading' WHEN size < 10 THEN 'note' ELSE 'body' END AS why, min(page) AS page FROM lines GROUP BY doc_id, CASE WHEN size > 12 THEN 'heading' WHEN size < 10 THEN 'note' ELSE 'body' END) SELECT doc_id, page, 'random' AS why FROM r WHERE k <= 3 UNION SELECT doc_id, page, why FROM f"),
    "reading_boxes": (["lines"], lambda d: f"b AS (SELECT doc_id, page, line, {d.rint('y0 / 10')} AS band, x0 FROM lines) SELECT doc_id, page, line, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY band, x0, line) AS BIGINT) AS position FROM b"),
    "epub_scorecard": (["paras"], lambda d: "a AS (SELECT source, count(*) AS blocks, CAST(sum(length(text)) AS BIGINT) AS chars FROM paras GROUP BY source), b AS (SELECT source, count(*) AS blocks, CAST(sum(length(text)) AS BIGINT) AS chars FROM paras WHERE para % 10 < 9 GROUP BY source) SELECT a.source, a.blocks, b.blocks AS candidate_blocks, a.chars, b.chars AS candidate_chars, CASE WHEN 100 * b.chars >= 99 * a.chars THEN 'same' WHEN 100 * b.chars >= 90 * a.chars THEN 'close' ELSE 'less' END AS verdict FROM a JOIN b ON a.source = b.source"),
    "folio_first_last": (["lines"], lambda d: f"h AS (SELECT doc_id, page, idx, CASE WHEN idx = 0 AND page % 2 = 0 THEN CAST(page AS VARCHAR(20)) ELSE text END AS text FROM lines) SELECT doc_id, page, text AS folio FROM h WHERE idx = 0 AND {folio(d, 'text')}"),
}
