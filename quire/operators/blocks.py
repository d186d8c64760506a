"""Block grammar, role mapping and emission: verse, quotes, lists, drop-caps, captions, roles, sections, files, notes."""

from __future__ import annotations


def islands(test: str, order: str = "line") -> str:
    """Rows of lines where ``test`` holds, with the number of their run."""
    return f"r AS (SELECT doc_id, page, line, text, x0, x1, size, {order} - row_number() OVER (PARTITION BY doc_id, page ORDER BY {order}) AS run FROM lines WHERE {test})"


OPERATORS = {
    "quote_runs": (["lines"], lambda d: f"{islands('x0 >= 78')} SELECT doc_id, page, min(line) AS first_line, max(line) AS last_line, count(*) AS n FROM r GROUP BY doc_id, page, run HAVING count(*) >= 3"),
    "list_items": (["paras"], lambda d: f"t AS (SELECT doc_id, para, CASE WHEN para % 5 < 3 THEN CAST(para % 5 + 1 AS VARCHAR(9)) || '. ' || text ELSE text END AS text FROM paras), m AS (SELECT doc_id, para, text, {d.has('text', r'^[0-9]{1,3}[.)] ')} AS entry FROM t), i AS (SELECT doc_id, para, text, entry, count(CASE WHEN entry THEN 1 END) OVER (PARTITION BY doc_id ORDER BY para) AS item FROM m) SELECT doc_id, CAST(item AS BIGINT) AS item, min(para) AS first_para, count(*) AS n_paras, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM i WHERE item > 0 GROUP BY doc_id, item"),
    "list_numbering": (["paras"], lambda d: f"t AS (SELECT doc_id, para, {d.first('text', '^(.)')} AS c, para % 7 + 1 AS num FROM paras), l AS (SELECT doc_id, para, num, lag(num) OVER (PARTITION BY doc_id ORDER BY para) AS before FROM t) SELECT doc_id, para, num, before FROM l WHERE num <= before"),
    "list_groups": (["paras"], lambda d: "k AS (SELECT doc_id, para, CASE WHEN para % 9 < 3 THEN 'ol' WHEN para % 9 < 5 THEN 'ul' ELSE 'p' END AS kind FROM paras), f AS (SELECT doc_id, para, kind, CASE WHEN kind = lag(kind) OVER (PARTITION BY doc_id ORDER BY para) THEN 0 ELSE 1 END AS fresh FROM k), g AS (SELECT doc_id, para, kind, sum(fresh) OVER (PARTITION BY doc_id ORDER BY para) AS grp FROM f) SELECT doc_id, CAST(grp AS BIGINT) AS grp, min(kind) AS kind, count(*) AS n, min(para) AS first_para FROM g WHERE kind <> 'p' GROUP BY doc_id, grp"),
    "dropcaps": (["lines"], lambda d: f"c AS (SELECT doc_id, line, CASE WHEN line % 9 = 0 THEN 'T' ELSE text END AS text, CASE WHEN line % 9 = 0 THEN 30.0 ELSE size END AS size FROM lines), n AS (SELECT doc_id, line, text, size, lead(text) OVER (PARTITION BY doc_id ORDER BY line) AS nxt FROM c) SELECT doc_id, line, text || coalesce(nxt, '') AS glued FROM n WHERE size >= 22 AND length(trim(text)) <= 2 AND {d.has('trim(text)', '^[A-Za-zÀ-ſ]+$')}"),
    "figure_captions": (["lines"], lambda d: "f AS (SELECT doc_id, page, min(y0) + 80 AS bottom FROM lines WHERE page % 2 = 1 GROUP BY doc_id, page), c AS (SELECT l.doc_id, l.page, l.line, l.text, row_number() OVER (PARTITION BY l.doc_id, l.page ORDER BY l.y0) AS k FROM lines l JOIN f ON l.doc_id = f.doc_id AND l.page = f.page AND l.y0 BETWEEN f.bottom AND f.bottom + 40.5) SELECT doc_id, page, line, text FROM c WHERE k <= 2"),
    "figure_width": (["lines"], lambda d: f"w AS (SELECT doc_id, page, max(x1) - min(x0) AS w FROM lines GROUP BY doc_id, page) SELECT doc_id, page, least(100, greatest(20, {d.rint('w * 100 / 360')})) AS pct FROM w"),
    "note_region": (["lines"], lambda d: "s AS (SELECT doc_id, page, line, text, CASE WHEN size < 10 THEN 1 ELSE 0 END AS small FROM lines), t AS (SELECT doc_id, page, line, text, min(small) OVER (PARTITION BY doc_id, page ORDER BY line DESC) AS still FROM s) SELECT doc_id, page, min(line) AS first_line, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM t WHERE still = 1 GROUP BY doc_id, page HAVING sum(length(text)) > 20"),
    "note_markers": (["paras"], lambda d: f"t AS (SELECT doc_id, para, CASE para % 3 WHEN 0 THEN CAST(para + 1 AS VARCHAR(20)) || ' ' || text WHEN 1 THEN '** ' || text ELSE text END AS text FROM paras) SELECT doc_id, para, CASE WHEN {d.first('text', '^([0-9]{1,3}) ')} <> '' THEN {d.first('text', '^([0-9]{1,3}) ')} ELSE {d.first('text', '^([*†‡]+)')} END AS marker FROM t WHERE {d.has('text', '^([0-9]{1,3} |[*†‡])')}"),
    "note_numbering": (["paras"], lambda d: "r AS (SELECT doc_id, para, para % 5 AS note_id FROM paras WHERE para % 2 = 0), f AS (SELECT doc_id, note_id, min(para) AS first_ref, count(*) AS n_refs FROM r GROUP BY doc_id, note_id) SELECT doc_id, note_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY first_ref) AS BIGINT) AS number, n_refs FROM f"),
    "style_role_map": (["lines"], lambda d: "m AS (SELECT 14 AS size, 'h2' AS role UNION ALL SELECT 9, 'note'), p AS (SELECT DISTINCT doc_id, page, 'plate' AS role FROM lines WHERE page % 6 = 0), o AS (SELECT doc_id, line, 'keep' AS role FROM lines WHERE line % 31 = 7) SELECT l.doc_id, l.line, coalesce(o.role, p.role, m.role, 'p') AS role, m.role IS NULL AS unmapped FROM lines l LEFT JOIN m ON CAST(l.size AS BIGINT) = m.size LEFT JOIN p ON l.doc_id = p.doc_id AND l.page = p.page LEFT JOIN o ON l.doc_id = o.doc_id AND l.line = o.line"),
    "section_bounds": (["lines"], lambda d: "h AS (SELECT doc_id, line, text, size > 12 AS h1 FROM lines), s AS (SELECT doc_id, line, text, h1, count(CASE WHEN h1 THEN 1 END) OVER (PARTITION BY doc_id ORDER BY line) AS sec FROM h) SELECT doc_id, CAST(sec AS BIGINT) AS section, min(line) AS first_line, max(line) AS last_line FROM s GROUP BY doc_id, sec"),
    "language_clusters": (["paras"], lambda d: f"t AS (SELECT doc_id, para, CASE para % 3 WHEN 0 THEN '漢字 ' || text WHEN 1 THEN '漢字かな ' || text ELSE text END AS text FROM paras), c AS (SELECT doc_id, para, x AS cluster FROM (SELECT doc_id, para, {d.rows(d.every('text', '[぀-ヿ一-鿿]+'))} FROM t)) SELECT doc_id, para, cluster, CASE WHEN {d.has('cluster', '[぀-ヿ]')} THEN 'ja' ELSE 'zh' END AS lang FROM c"),
    "file_split": (["lines"], lambda d: "s AS (SELECT doc_id, line, page, idx = 0 AS anchor, size > 12 AS split FROM lines), f AS (SELECT doc_id, line, anchor, count(CASE WHEN split THEN 1 END) OVER (PARTITION BY doc_id ORDER BY line) AS file_no FROM s), n AS (SELECT doc_id, line, anchor, file_no, lead(file_no) OVER (PARTITION BY doc_id ORDER BY line) AS nxt FROM f) SELECT doc_id, line, CAST(CASE WHEN anchor THEN coalesce(nxt, file_no) ELSE file_no END AS BIGINT) AS file_no FROM n"),
    "index_runs": (["lines"], lambda d: "k AS (SELECT doc_id, line, CASE WHEN idx = 0 OR size > 12 THEN 'bridge' WHEN line % 10 < 6 THEN 'entry' ELSE 'text' END AS kind FROM lines), c AS (SELECT doc_id, line, kind, count(CASE WHEN kind = 'text' THEN 1 END) OVER (PARTITION BY doc_id ORDER BY line) AS run FROM k) SELECT doc_id, min(CASE WHEN kind = 'entry' THEN line END) AS first_line, max(CASE WHEN kind = 'entry' THEN line END) AS last_line, count(CASE WHEN kind = 'entry' THEN 1 END) AS n FROM c WHERE kind <> 'text' GROUP BY doc_id, run HAVING count(CASE WHEN kind = 'entry' THEN 1 END) > 0"),
    "contents_section": (["lines"], lambda d: "k AS (SELECT doc_id, line, line % 8 IN (0, 1, 3) AS toc FROM lines), a AS (SELECT doc_id, line, toc, max(CASE WHEN toc THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS ahead FROM k) SELECT doc_id, line, toc FROM a WHERE toc OR ahead = 1"),
    "endnotes_html": (["paras"], lambda d: f"n AS (SELECT doc_id, para, row_number() OVER (PARTITION BY doc_id ORDER BY para) AS k, substr(text, 1, 40) AS t FROM paras WHERE para % 4 = 1) SELECT doc_id, count(*) AS n, {d.joined('\'<li>\' || CAST(k AS VARCHAR(9)) || \' \' || t || \'</li>\'', '', 'k')} AS html FROM n GROUP BY doc_id"),
    "opf_manifest": (["lines"], lambda d: f"f AS (SELECT DISTINCT doc_id, page FROM lines) SELECT doc_id, {d.joined('\'<item id=f\' || CAST(page AS VARCHAR(9)) || \'/>\'', '', 'page')} AS manifest FROM f GROUP BY doc_id"),
    "css_generation": (["lines"], lambda d: f"s AS (SELECT source, size, count(*) AS n FROM lines GROUP BY source, size) SELECT source, {d.joined('\'.s\' || CAST(CAST(size AS BIGINT) AS VARCHAR(9)) || \'{font-size:\' || CAST(' + d.rint('size * 1000 / 11') + ' AS VARCHAR(9)) || \'m}\'', ' ', 'size')} AS css FROM s WHERE abs(size - 11) > 0.2 GROUP BY source"),
    "packet_order": (["lines"], lambda d: "b AS (SELECT doc_id, line, CAST(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY line) AS BIGINT) AS upto FROM lines) SELECT doc_id, line, upto FROM b WHERE line % 20 = 0"),
}
