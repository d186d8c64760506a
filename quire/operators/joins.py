"""Joins: lookups, rectangles, labels, ordinals, containment, baselines, style rules; and set operations on configured entries."""

from __future__ import annotations

OPERATORS = {
    "font_lookup": (["lines"], lambda d: "f AS (SELECT DISTINCT CAST(size AS BIGINT) * 2 + CASE WHEN italic THEN 1 ELSE 0 END AS font_id, size, italic FROM lines WHERE size < 14) SELECT l.doc_id, l.line, coalesce(f.font_id, -1) AS font_id, coalesce(f.size, 0.0) AS font_size FROM lines l LEFT JOIN f ON CAST(l.size AS BIGINT) * 2 + CASE WHEN l.italic THEN 1 ELSE 0 END = f.font_id"),
    "toc_link_rect": (["lines"], lambda d: "e AS (SELECT doc_id, page, line, y0 + 6 AS yc FROM lines WHERE size > 12), r AS (SELECT doc_id, page, line AS link, y0 - 1 AS top, y0 + 14 AS bottom FROM lines WHERE line % 2 = 0), m AS (SELECT e.doc_id, e.page, e.line, r.link, row_number() OVER (PARTITION BY e.doc_id, e.line ORDER BY r.link) AS k FROM e JOIN r ON e.doc_id = r.doc_id AND e.page = r.page AND e.yc BETWEEN r.top - 2 AND r.bottom + 2) SELECT doc_id, page, line, link FROM m WHERE k = 1"),
    "shifted_edges": (["lines"], lambda d: "s AS (SELECT DISTINCT doc_id, page, 12.0 AS shift FROM lines WHERE page % 2 = 0) SELECT l.doc_id, l.line, CAST(l.x0 - coalesce(s.shift, 0) AS DOUBLE) AS x0, CAST(l.x1 - coalesce(s.shift, 0) AS DOUBLE) AS x1 FROM lines l LEFT JOIN s ON l.doc_id = s.doc_id AND l.page = s.page"),
    "cross_references": (["lines"], lambda d: "t AS (SELECT doc_id, page AS label, min(line) AS target FROM lines GROUP BY doc_id, page), r AS (SELECT doc_id, line, page + line % 3 AS label FROM lines WHERE line % 10 = 4) SELECT r.doc_id, r.line, r.label, CASE WHEN t.target IS NULL THEN 'p. ' || CAST(r.label AS VARCHAR(20)) ELSE '#l' || CAST(t.target AS VARCHAR(20)) END AS href, t.target IS NOT NULL AS resolved FROM r LEFT JOIN t ON r.doc_id = t.doc_id AND r.label = t.label"),
    "region_lines": (["lines"], lambda d: "r AS (SELECT DISTINCT doc_id, page, 150.0 AS top, 250.0 AS bottom, 0.0 AS lft, 300.0 AS rgt FROM lines WHERE page % 3 = 1) SELECT l.doc_id, l.page, l.line FROM lines l JOIN r ON l.doc_id = r.doc_id AND l.page = r.page AND l.y0 + 6 BETWEEN r.top AND r.bottom AND (l.x0 + l.x1) / 2 BETWEEN r.lft AND r.rgt"),
    "paragraph_source_match": (["paras"], lambda d: f"s AS (SELECT doc_id, para, {d.sub('text', '[ ]+')} AS t FROM paras WHERE length(text) >= 40), w AS (SELECT doc_id, para + 1 AS para, t FROM s UNION ALL SELECT doc_id, para, t FROM s), c AS (SELECT doc_id, para, {d.sub('substr(text, 5, 30)', '[ ]+')} AS probe FROM paras WHERE length(text) >= 40) SELECT c.doc_id, c.para, count(*) AS n FROM c JOIN w ON c.doc_id = w.doc_id AND c.para = w.para WHERE strpos(w.t, c.probe) > 0 GROUP BY c.doc_id, c.para".replace("strpos(w.t, c.probe)", "instr(w.t, c.probe)")),
    "anchor_ordinals": (["lines"], lambda d: "a AS (SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM (SELECT DISTINCT doc_id, page FROM lines)), s AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM lines WHERE idx = 0 AND NOT (page = 3 AND doc_id % 2 = 0)) SELECT a.doc_id, a.page, s.line FROM a JOIN s ON a.doc_id = s.doc_id AND a.k = s.k WHERE a.n = s.n"),
    "assertions": (["lines"], lambda d: f"p AS (SELECT doc_id, page, {d.joined('text', ' ', 'line')} AS t FROM lines GROUP BY doc_id, page), a AS (SELECT doc_id, page, substr(t, 6, 12) AS needle, CASE page % 3 WHEN 0 THEN 'absent' ELSE 'present' END AS kind FROM p WHERE length(t) > 20), c AS (SELECT a.doc_id, a.page, kind, needle, instr(p.t, needle) > 0 AS found, count(*) OVER (PARTITION BY a.doc_id, a.page) AS labels FROM a JOIN p ON a.doc_id = p.doc_id AND a.page = p.page) SELECT doc_id, page, kind, needle, CASE WHEN labels > 1 THEN 'stale' WHEN (kind = 'present') = found THEN 'pass' ELSE 'fail' END AS verdict FROM c"),
    "metric_deltas": (["lines"], lambda d: "r AS (SELECT source AS config, CASE WHEN size > 12 THEN 'headings' WHEN italic THEN 'italics' ELSE 'body' END AS counter, count(*) AS v FROM lines GROUP BY source, CASE WHEN size > 12 THEN 'headings' WHEN italic THEN 'italics' ELSE 'body' END), b AS (SELECT config, CASE WHEN counter = 'italics' THEN 'slants' ELSE counter END AS counter, v - v % 7 AS v FROM r WHERE config <> 'src3') SELECT coalesce(r.config, b.config) AS config, coalesce(r.counter, b.counter) AS counter, coalesce(r.v, 0) AS value, coalesce(b.v, 0) AS baseline, coalesce(r.v, 0) - coalesce(b.v, 0) AS delta FROM r FULL OUTER JOIN b ON r.config = b.config AND r.counter = b.counter"),
    "baseline_merge": (["lines"], lambda d: "b AS (SELECT source AS config, count(*) AS v FROM lines GROUP BY source), n AS (SELECT config, v + 1 AS v FROM b WHERE config < 'src2') SELECT b.config, b.v FROM b LEFT JOIN n ON b.config = n.config WHERE n.config IS NULL UNION ALL SELECT config, v FROM n"),
    "index_locators": (["lines"], lambda d: f"i AS (SELECT doc_id, line, 'see ' || CAST(page AS VARCHAR(20)) || ', ' || CAST(page + 3 AS VARCHAR(20)) AS entry FROM lines WHERE line % 12 = 2), l AS (SELECT doc_id, line, x AS locator FROM (SELECT doc_id, line, {d.rows(d.every('entry', '[0-9]+'))} FROM i)), p AS (SELECT DISTINCT doc_id, CAST(page AS VARCHAR(20)) AS label FROM lines) SELECT l.doc_id, l.line, l.locator, p.label IS NOT NULL AS linked FROM l LEFT JOIN p ON l.doc_id = p.doc_id AND l.locator = p.label"),
    "editor_notes": (["paras"], lambda d: "n AS (SELECT doc_id, para, count(CASE WHEN para % 10 = 0 THEN 1 END) OVER (PARTITION BY doc_id ORDER BY para) AS chapter FROM paras), k AS (SELECT doc_id, chapter, para, row_number() OVER (PARTITION BY doc_id, chapter ORDER BY para) AS num FROM n WHERE para % 3 = 1), r AS (SELECT doc_id, chapter, para, row_number() OVER (PARTITION BY doc_id, chapter ORDER BY para) AS num FROM n WHERE para % 3 = 2) SELECT r.doc_id, CAST(r.chapter AS BIGINT) AS chapter, r.para AS reference, k.para AS note FROM r JOIN k ON r.doc_id = k.doc_id AND r.chapter = k.chapter AND r.num = k.num"),
    "style_rule_match": (["lines"], lambda d: "r AS (SELECT 1 AS o, 'p' AS tag, '' AS cls, 'indent' AS v UNION ALL SELECT 2, 'p', 'it', 'italic' UNION ALL SELECT 3, '', 'big', 'display' UNION ALL SELECT 4, 'h2', 'big', 'heading'), e AS (SELECT doc_id, line, CASE WHEN size > 12 THEN 'h2' ELSE 'p' END AS tag, CASE WHEN size > 12 THEN 'big' WHEN italic THEN 'it' ELSE 'plain' END AS cls FROM lines), m AS (SELECT e.doc_id, e.line, r.v, r.o, row_number() OVER (PARTITION BY e.doc_id, e.line ORDER BY CASE WHEN r.cls <> '' THEN 1 ELSE 0 END DESC, CASE WHEN r.tag <> '' THEN 1 ELSE 0 END DESC, r.o DESC) AS k FROM e JOIN r ON (r.tag = '' OR r.tag = e.tag) AND (r.cls = '' OR r.cls = e.cls)) SELECT doc_id, line, v FROM m WHERE k = 1"),
    "href_targets": (["lines"], lambda d: "h AS (SELECT doc_id, line, line + line % 5 - 1 AS target FROM lines WHERE line % 6 = 0) SELECT h.doc_id, h.line, h.target FROM h LEFT JOIN lines l ON h.doc_id = l.doc_id AND h.target = l.line WHERE l.line IS NULL"),
    "image_manifest": (["paras"], lambda d: "m AS (SELECT DISTINCT 'images/i' || CAST(para AS VARCHAR(20)) || '.png' AS item FROM paras WHERE para % 2 = 0), u AS (SELECT DISTINCT replace('text/../images/i' || CAST(para AS VARCHAR(20)) || '.png', 'text/../', '') AS src FROM paras WHERE para % 3 = 0) SELECT coalesce(m.item, u.src) AS item, CASE WHEN m.item IS NULL THEN 'missing' ELSE 'orphan' END AS finding FROM m FULL OUTER JOIN u ON m.item = u.src WHERE m.item IS NULL OR u.src IS NULL"),
    "noteref_backlinks": (["paras"], lambda d: "r AS (SELECT doc_id, para AS id, para + 1 AS note FROM paras WHERE para % 4 = 0), b AS (SELECT doc_id, para AS note, para - 1 - CASE WHEN para % 8 = 5 THEN 4 ELSE 0 END AS back FROM paras WHERE para % 4 = 1) SELECT r.doc_id, r.id, r.note, CASE WHEN b.note IS NULL THEN 'no note' WHEN b.back <> r.id THEN 'wrong backlink' ELSE 'ok' END AS state FROM r LEFT JOIN b ON r.doc_id = b.doc_id AND r.note = b.note"),
    "furniture_algebra": (["paras"], lambda d: "f AS (SELECT source, text FROM paras WHERE length(text) < 60 GROUP BY source, text HAVING count(*) >= 2), x AS (SELECT source, text FROM f UNION SELECT DISTINCT source, 'extra head' FROM paras) SELECT source, text FROM x EXCEPT SELECT source, text FROM f WHERE text LIKE '%the%'"),
    "stale_overrides": (["lines"], lambda d: "o AS (SELECT doc_id, page, idx + 20 AS idx, 'drop' AS kind FROM lines WHERE line % 15 = 3) SELECT o.doc_id, o.page, o.idx, o.kind FROM o LEFT JOIN lines l ON o.doc_id = l.doc_id AND o.page = l.page AND o.idx = l.idx WHERE l.line IS NULL"),
    "defended_pages": (["lines"], lambda d: "a AS (SELECT DISTINCT doc_id, page FROM lines WHERE size > 12), f AS (SELECT DISTINCT doc_id, page FROM lines WHERE page % 4 = 0), s AS (SELECT DISTINCT doc_id, page FROM lines WHERE italic) SELECT doc_id, page FROM s EXCEPT (SELECT doc_id, page FROM a UNION SELECT doc_id, page FROM f)"),
    "region_token_subset": (["paras"], lambda d: f"t AS (SELECT doc_id, para, x AS token FROM (SELECT doc_id, para, {d.rows(d.words('text'))} FROM paras)), r AS (SELECT DISTINCT doc_id, token FROM t WHERE para % 2 = 0) SELECT t.doc_id, t.para, count(*) AS n_tokens FROM t LEFT JOIN r ON t.doc_id = r.doc_id AND t.token = r.token GROUP BY t.doc_id, t.para HAVING count(r.token) = count(*)"),
    "column_suggestions": (["lines"], lambda d: "b AS (SELECT doc_id, page, line, x0 + CASE WHEN line % 2 = 0 THEN 0 ELSE 300 END AS x0, y0, y0 + 30 AS y1 FROM lines), p AS (SELECT DISTINCT a.doc_id, a.page, a.line AS lft, c.line AS rgt FROM b a JOIN b c ON a.doc_id = c.doc_id AND a.page = c.page AND a.x0 < 250 AND c.x0 >= 250 AND a.y0 < c.y1 AND c.y0 < a.y1) SELECT doc_id, page, count(DISTINCT lft) AS n_left, count(DISTINCT rgt) AS n_right FROM p GROUP BY doc_id, page HAVING count(DISTINCT lft) >= 2 AND count(DISTINCT rgt) >= 2"),
}
