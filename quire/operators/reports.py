"""Rows that reports, packages and manifests are made of: timelines, unmapped signs, groups as markup, warnings, verification."""

from __future__ import annotations


def run_of(kind: str) -> str:
    """Lines with the number of their run of equal ``kind``."""
    return f"k AS (SELECT doc_id, page, line, text, {kind} AS kind FROM lines), f AS (SELECT *, CASE WHEN kind = lag(kind) OVER (PARTITION BY doc_id ORDER BY line) THEN 0 ELSE 1 END AS fresh FROM k), g AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY line) AS run FROM f)"


PUA = "[-]"
OPERATORS = {
    "headings_timeline": (["lines"], lambda d: "h AS (SELECT doc_id, page, line, size, text FROM lines WHERE size > 12) SELECT doc_id, page, line, text, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line) AS BIGINT) AS k FROM h"),
    "unmapped_pua": (["damaged"], lambda d: f"m AS (SELECT '' AS ch UNION ALL SELECT ''), e AS (SELECT doc_id, x AS ch FROM (SELECT doc_id, {d.rows(d.every('text', PUA))} FROM damaged)) SELECT e.doc_id, e.ch, count(*) AS n FROM e LEFT JOIN m ON e.ch = m.ch WHERE m.ch IS NULL GROUP BY e.doc_id, e.ch"),
    "page_checks": (["lines"], lambda d: "c AS (SELECT doc_id, page, count(*) AS n_lines, count(CASE WHEN size > 12 THEN 1 END) AS headings, count(CASE WHEN size < 10 THEN 1 END) AS notes, count(CASE WHEN italic THEN 1 END) AS italics FROM lines GROUP BY doc_id, page) SELECT * FROM c WHERE headings + notes + italics > 0"),
    "verify_hashes": (["paras"], lambda d: f"a AS (SELECT doc_id, para, {d.hash('text')} AS sha FROM paras WHERE para % 10 <> 9), b AS (SELECT doc_id, para, CASE WHEN para % 8 = 3 THEN {d.hash("text || '!'")} ELSE {d.hash('text')} END AS sha FROM paras WHERE para % 7 <> 6) SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.para, b.para) AS para, CASE WHEN b.sha IS NULL THEN 'missing' WHEN a.sha IS NULL THEN 'unrecorded' ELSE 'changed' END AS finding FROM a FULL OUTER JOIN b ON a.doc_id = b.doc_id AND a.para = b.para WHERE a.sha IS NULL OR b.sha IS NULL OR a.sha <> b.sha"),
    "warnings_table": (["damaged"], lambda d: f"c AS (SELECT doc_id, para, {d.count('text', PUA)} AS pua, {d.count('text', '�')} AS lost, {d.count('text', '[֐-ࣿ]')} AS rtl, length(text) AS n FROM damaged), w AS (SELECT doc_id, para, 'pua-unmapped' AS code, 'content-risk' AS severity, pua AS n FROM c WHERE pua > 0 UNION ALL SELECT doc_id, para, 'fffd-unrepaired', 'content-risk', lost FROM c WHERE lost > 0 UNION ALL SELECT doc_id, para, 'list-marker-gap', 'advisory', CAST(n AS BIGINT) FROM c WHERE n < 20) SELECT * FROM w"),
    "warning_report": (["damaged"], lambda d: f"c AS (SELECT doc_id, para, {d.count('text', PUA)} AS pua, {d.count('text', '�')} AS lost FROM damaged), w AS (SELECT doc_id, CASE WHEN pua > 0 THEN 'pua-unmapped' ELSE 'fffd-unrepaired' END AS code, para FROM c WHERE pua + lost > 0), s AS (SELECT doc_id, code, count(*) AS n, min(para) AS first_para FROM w GROUP BY doc_id, code), t AS (SELECT doc_id, code, '- ' || code || ': ' || CAST(n AS VARCHAR(20)) || ' from ' || CAST(first_para AS VARCHAR(20)) AS row FROM s) SELECT doc_id, {d.joined('row', '; ', 'code')} AS report FROM t GROUP BY doc_id".replace(" AS row ", " AS line ").replace("(row,", "(line,")),
    "paragraph_html": (["lines"], lambda d: f"p AS (SELECT doc_id, para, max(CASE WHEN size > 12 THEN 'h2' WHEN size < 10 THEN 'aside' ELSE 'p' END) AS tag, {d.joined('text', ' ', 'line')} AS t FROM lines GROUP BY doc_id, para) SELECT doc_id, para, '<' || tag || '>' || replace(replace(t, '&', '&amp;'), '<', '&lt;') || '</' || tag || '>' AS html FROM p"),
    "verse_html": (["lines"], lambda d: f"{run_of('CASE WHEN x1 - x0 < 240 THEN 1 ELSE 0 END')}, v AS (SELECT doc_id, run, line, '<span>' || text || '</span>' AS span FROM g WHERE kind = 1) SELECT doc_id, CAST(run AS BIGINT) AS stanza, count(*) AS n, {d.joined('span', '<br/>', 'line')} AS html FROM v GROUP BY doc_id, run"),
    "quote_html": (["lines"], lambda d: f"{run_of('CASE WHEN para % 6 = 2 THEN 1 ELSE 0 END')} SELECT doc_id, CAST(run AS BIGINT) AS quote, count(*) AS n, {d.joined('text', ' ', 'line')} AS text FROM g WHERE kind = 1 GROUP BY doc_id, run"),
    "rescued_anchors": (["lines"], lambda d: "a AS (SELECT doc_id, page, line, para FROM lines WHERE idx = 0), x AS (SELECT DISTINCT doc_id, para FROM lines WHERE para % 4 = 2), n AS (SELECT a.doc_id, a.page, a.line, x.para IS NOT NULL AS dropped FROM a LEFT JOIN x ON a.doc_id = x.doc_id AND a.para = x.para) SELECT doc_id, page, line FROM n WHERE dropped"),
    "nav_entries": (["lines"], lambda d: f"h AS (SELECT doc_id, line, page, CASE WHEN line % 3 = 0 THEN CAST(page AS VARCHAR(20)) || '.' ELSE text END AS title FROM lines WHERE size > 12) SELECT doc_id, line, page, title FROM h WHERE NOT {d.has('trim(title)', '^[0-9]+[.]?[*]*$')}"),
    "absorbed_contents_heading": (["lines"], lambda d: "k AS (SELECT doc_id, line, text, CASE WHEN idx = 0 THEN 'anchor' WHEN line % 16 IN (4, 5, 6) THEN 'toc' WHEN size > 12 THEN 'heading' ELSE 'text' END AS kind FROM lines), b AS (SELECT doc_id, line, kind, lag(kind) OVER (PARTITION BY doc_id ORDER BY line) AS before, lag(line) OVER (PARTITION BY doc_id ORDER BY line) AS before_line FROM k WHERE kind <> 'anchor'), f AS (SELECT doc_id, line, before, before_line, count(CASE WHEN kind = 'toc' THEN 1 END) OVER (PARTITION BY doc_id ORDER BY line) AS nth, kind FROM b) SELECT doc_id, line AS first_entry, before_line, before = 'heading' AS absorbed FROM f WHERE kind = 'toc' AND nth = 1 AND before IS NOT NULL"),
    "link_marking": (["paras"], lambda d: "t AS (SELECT doc_id, para, text, instr(text, ' the ') AS at_ FROM paras) SELECT doc_id, para, substr(text, 1, CAST(at_ AS INT)) AS before, substr(text, CAST(at_ AS INT) + 1, 3) AS marked, substr(text, CAST(at_ AS INT) + 4) AS after FROM t WHERE at_ > 0".replace(" AS before", " AS head").replace(" AS after", " AS tail")),
    "style_catalogue": (["lines"], lambda d: "s AS (SELECT DISTINCT source, CAST(CAST(size AS BIGINT) AS VARCHAR(9)) || CASE WHEN italic THEN ' Italic' ELSE ' Regular' END AS style FROM lines) SELECT source, style, " + d.first("style", "^([0-9]+) ") + " AS size, " + d.has("style", "Italic$") + " AS italic, trim(" + d.sub("style", "(Italic|Regular)$") + ") AS root FROM s"),
    "corpus_runs": (["lines"], lambda d: f"r AS (SELECT source AS config, {d.hash('CAST(count(*) AS VARCHAR(20))')} AS sha, count(*) AS n FROM lines GROUP BY source), b AS (SELECT config, CASE WHEN n % 3 = 0 THEN {d.hash("config")} ELSE sha END AS sha FROM r WHERE config <> 'src4') SELECT r.config, CASE WHEN r.n < 1500 THEN 'n/a' WHEN b.sha IS NULL THEN 'NEW' WHEN b.sha = r.sha THEN 'identical' ELSE 'CHANGED' END AS bytes FROM r LEFT JOIN b ON r.config = b.config"),
    "raw_lines": (["lines"], lambda d: "p AS (SELECT doc_id, page, idx, text, lag(y0) OVER (PARTITION BY doc_id, page ORDER BY idx) AS py, y0, x0 FROM lines) SELECT doc_id, 'p' || CAST(page AS VARCHAR(20)) || ' #' || CAST(idx AS VARCHAR(20)) || ' x' || CAST(CAST(x0 AS BIGINT) AS VARCHAR(20)) || CASE WHEN py IS NULL THEN '' ELSE ' +' || CAST(CAST((y0 - py) * 10 AS BIGINT) AS VARCHAR(20)) END || ' ' || text AS row_text FROM p"),
    "source_entries": (["lines"], lambda d: "h AS (SELECT doc_id, page, line, text, CASE WHEN doc_id % 3 = 0 THEN 'outline' WHEN doc_id % 3 = 1 THEN 'printed' ELSE 'headings' END AS chosen FROM lines WHERE size > 12) SELECT doc_id, chosen, text AS title, page FROM h WHERE chosen = 'headings' OR (chosen = 'outline' AND line % 2 = 0) OR (chosen = 'printed' AND page <= 5)"),
    "report_counts": (["paras"], lambda d: "j AS (SELECT doc_id, '{\"impact\":\"' || CASE para % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'serious' WHEN 2 THEN 'minor' ELSE 'moderate' END || '\"}' AS body FROM paras), i AS (SELECT doc_id, " + ("get_json_object(body, '$.impact')" if d.name == "spark" else "json_extract_string(body, '$.impact')") + " AS impact FROM j) SELECT doc_id, impact, count(*) AS n, impact IN ('critical', 'serious') AS gates FROM i GROUP BY doc_id, impact"),
    "release_epoch": (["paras"], lambda d: "m AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '2024-01-0' || CAST(doc_id % 9 + 1 AS VARCHAR(9)) END AS stated, CASE WHEN doc_id % 2 = 0 THEN '2023-05-05' END AS built FROM paras WHERE para = 0) SELECT doc_id, coalesce(stated, built, '1980-01-01') AS epoch, stated IS NOT NULL AND CAST(stated AS DATE) IS NOT NULL AS valid FROM m"),
    "epub_identifier": (["paras"], lambda d: f"m AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'urn:own:' || CAST(doc_id AS VARCHAR(20)) END AS explicit, CASE WHEN doc_id % 2 = 0 THEN '978-0-' || CAST(100000 + doc_id AS VARCHAR(20)) END AS isbn FROM paras WHERE para = 0) SELECT doc_id, coalesce(explicit, 'urn:isbn:' || {d.sub('isbn', '[^0-9X]')}, 'urn:slug:document-' || CAST(doc_id AS VARCHAR(20))) AS identifier FROM m"),
    "effective_size": (["lines"], lambda d: "e AS (SELECT doc_id, page, line, CASE WHEN size > 12 THEN 150 WHEN size < 10 THEN 80 ELSE 100 END AS own, CASE WHEN italic THEN 90 ELSE 100 END AS outer_ FROM lines) SELECT doc_id, line, CAST(own * outer_ AS BIGINT) AS em_10000 FROM e"),
}
