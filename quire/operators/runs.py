"""Operators on the runs of a line and on what readers see of a page: contents lines, folios, seams, queues, packets, metrics."""

from __future__ import annotations

OPERATORS = {
    "merged_runs": (["paras"], lambda d: f"w AS (SELECT doc_id, para, CAST(i AS BIGINT) AS i, x AS word, i % 7 IN (3, 4) AS italic FROM (SELECT doc_id, para, {d.rows(d.words('text'))} FROM paras)), f AS (SELECT doc_id, para, i, word, italic, CASE WHEN italic = lag(italic) OVER (PARTITION BY doc_id, para ORDER BY i) THEN 0 ELSE 1 END AS fresh FROM w), g AS (SELECT doc_id, para, i, word, italic, sum(fresh) OVER (PARTITION BY doc_id, para ORDER BY i) AS run FROM f) SELECT doc_id, para, CAST(run AS BIGINT) AS run, bool_and(italic) AS italic, {d.joined('word', ' ', 'i')} AS text FROM g GROUP BY doc_id, para, run"),
    "cross_run_spaces": (["lines"], lambda d: f"r AS (SELECT doc_id, para, j, text || ' ' AS a, lead(' ' || text) OVER (PARTITION BY doc_id, para ORDER BY j) AS b FROM lines) SELECT doc_id, para, j, {d.sub('a', '[ ]+$', ' ')} AS head, {d.sub('b', '^[ ]+')} AS tail FROM r WHERE a LIKE '% ' AND b LIKE ' %'"),
    "style_roots": (["lines"], lambda d: f"s AS (SELECT DISTINCT source || CASE WHEN italic THEN '-Italic' ELSE '-Roman' END || ' ' || CAST(CAST(size AS BIGINT) AS VARCHAR(9)) AS style FROM lines) SELECT style, trim({d.sub(d.sub('style', '(?i)[- ]?(italic|roman|regular)'), '[ ]+', ' ')}) AS root FROM s"),
    "complexity_sample": (["lines"], lambda d: "p AS (SELECT doc_id, page, count(DISTINCT size) AS sizes, count(*) AS n FROM lines GROUP BY doc_id, page), k AS (SELECT doc_id, page, sizes, row_number() OVER (PARTITION BY doc_id ORDER BY sizes DESC, page) AS most, row_number() OVER (PARTITION BY doc_id ORDER BY n, page) AS fewest FROM p) SELECT doc_id, page, CASE WHEN most = 1 THEN 'most styles' WHEN fewest = 1 THEN 'fewest lines' ELSE 'stride' END AS why FROM k WHERE most = 1 OR fewest = 1 OR page % 10 = 0"),
    "build_metrics": (["damaged"], lambda d: f"c AS (SELECT doc_id, CAST(sum({d.count('text', '[ﬀ-ﬆ]')}) AS BIGINT) AS a, CAST(sum({d.count('text', '�')}) AS BIGINT) AS b FROM damaged GROUP BY doc_id), u AS (SELECT doc_id, 'ligatures' AS k, a AS v FROM c UNION ALL SELECT doc_id, 'lost', b FROM c), s AS (SELECT doc_id, k, '\"' || k || '\":' || CAST(v AS VARCHAR(20)) AS kv FROM u) SELECT doc_id, '{{' || {d.joined('kv', ',', 'k')} || '}}' AS metrics FROM s GROUP BY doc_id"),
    "reading_packets": (["paras"], lambda d: f"b AS (SELECT doc_id, para, text, CAST(sum({d.size(d.words('text'))}) OVER (PARTITION BY doc_id ORDER BY para) AS BIGINT) AS upto FROM paras), p AS (SELECT doc_id, para, text, {d.div('upto - 1', '350')} AS packet FROM b) SELECT doc_id, packet, count(*) AS n, {d.joined('text', ' ', 'para')} AS text FROM p GROUP BY doc_id, packet"),
    "page_char_slices": (["paras"], lambda d: f"o AS (SELECT doc_id, para, text, CAST(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY para) AS BIGINT) - length(text) - 1 AS start FROM paras), s AS (SELECT doc_id, para, text, start, {d.div('start', '1500')} AS first_page, {d.div('start + length(text) - 1', '1500')} AS last_page FROM o), e AS (SELECT doc_id, para, text, start, first_page, first_page + x AS page FROM (SELECT doc_id, para, text, start, first_page, {d.rows(d.upto('last_page - first_page + 1'))} FROM s)) SELECT doc_id, para, CAST(page AS BIGINT) AS page, substr(text, CAST(greatest(0, page * 1500 - start) + 1 AS INT), CAST(least(page * 1500 + 1500 - greatest(start, page * 1500), length(text)) AS INT)) AS piece FROM e"),
    "qa_verdicts": (["damaged"], lambda d: f"c AS (SELECT doc_id, CAST(sum({d.count('text', '[-]')}) AS BIGINT) AS pua, CAST(sum({d.count('text', '�')}) AS BIGINT) AS lost FROM damaged GROUP BY doc_id), g AS (SELECT doc_id, 1 AS k, '10 pua: ' || CASE WHEN pua = 0 THEN 'pass' ELSE 'FAIL ' || CAST(pua AS VARCHAR(20)) END AS line FROM c UNION ALL SELECT doc_id, 2, '20 garble: ' || CASE WHEN lost = 0 THEN 'pass' ELSE 'FAIL ' || CAST(lost AS VARCHAR(20)) END FROM c) SELECT doc_id, {d.joined('line', '; ', 'k')} AS report FROM g GROUP BY doc_id"),
    "quote_suspects": (["lines"], lambda d: "r AS (SELECT doc_id, page, line, x0, x1, line - row_number() OVER (PARTITION BY doc_id, page, x0 ORDER BY line) AS run FROM lines WHERE x0 >= 78 OR para % 6 = 2) SELECT doc_id, page, x0, min(line) AS first_line, count(*) AS n FROM r GROUP BY doc_id, page, x0, run HAVING count(*) >= 3 AND (max(x1) - min(x1) > 6 OR count(*) >= 4)"),
    "layout_cross_check": (["lines"], lambda d: "b AS (SELECT DISTINCT doc_id, page FROM lines WHERE line % 17 = 3), a AS (SELECT DISTINCT doc_id, page FROM lines WHERE size > 12) SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.page, b.page) AS page, CASE WHEN b.page IS NULL THEN 'analyser only' ELSE 'boxes only' END AS finding FROM a FULL OUTER JOIN b ON a.doc_id = b.doc_id AND a.page = b.page WHERE a.page IS NULL OR b.page IS NULL"),
    "split_heads": (["lines"], lambda d: "h AS (SELECT doc_id, page, idx, CASE WHEN idx = 0 THEN 'Notes to' WHEN idx = 1 THEN source ELSE text END AS text, source FROM lines WHERE idx < 3), n AS (SELECT doc_id, page, idx, source, text || ' ' || lead(text) OVER (PARTITION BY doc_id, page ORDER BY idx) AS two FROM h) SELECT doc_id, page, idx FROM n WHERE two = 'Notes to ' || source"),
}
