"""What the layout operators must give, in DuckDB's SQL over the fixture's tables."""

from __future__ import annotations

from quire.plans.book import sql
from quire.plans.dialect import Duck

NORMAL = "trim(regexp_replace(translate({}, '‘’“”–—­﻿', '''''\"\"--'), '[\\s\\x{{a0}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{3000}}]+', ' ', 'g'))"


def normal(x: str) -> str:
    return NORMAL.format(x)


def template(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace({normal(x)}, '[0-9]+', '#', 'g'), '^[ivxlcdmIVXLCDM]+|[ivxlcdmIVXLCDM]+$', '#', 'g'))"


def folio(x: str) -> str:
    return f"regexp_full_match(lower(trim({x})), '[0-9]{{1,4}}|[ivxlcdm]+')"


def good(x: str) -> str:
    return f"CASE WHEN regexp_full_match({x}, '[0-9]+') THEN TRY_CAST({x} AS INT) BETWEEN 1 AND 999 ELSE regexp_full_match(lower({x}), '[ivxlcdm]{{1,8}}') END"


GEO = """ranked AS (SELECT doc_id, page, idx, x0, x1, round_even(x0, 0) AS a, round_even(x1, 0) AS b, x1 - x0 AS w, max(x1 - x0) OVER (PARTITION BY doc_id) AS widest FROM book),
long AS (SELECT * FROM ranked WHERE w >= 0.55 * widest),
lefts AS (SELECT doc_id, a AS v, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min(page * 100000 + idx)) AS k FROM long GROUP BY doc_id, a),
rights AS (SELECT doc_id, b AS v, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min(page * 100000 + idx)) AS k FROM long GROUP BY doc_id, b),
sizes AS (SELECT doc_id, size AS v, row_number() OVER (PARTITION BY doc_id ORDER BY sum(length(text)) DESC, min(page * 100000 + idx)) AS k FROM book GROUP BY doc_id, size),
geo AS (SELECT l.doc_id, l.v AS col_left, r.v AS col_right, s.v AS body_size FROM lefts l, rights r, sizes s WHERE l.k = 1 AND r.k = 1 AND s.k = 1 AND l.doc_id = r.doc_id AND l.doc_id = s.doc_id)"""
SHIFT = f"""{GEO},
pe AS (SELECT doc_id, page, a AS edge, count(*) AS n, row_number() OVER (PARTITION BY doc_id, page ORDER BY count(*) DESC, min(idx)) AS k FROM long GROUP BY doc_id, page, a),
shifts AS (SELECT pe.doc_id, pe.page, col_left - edge AS shift FROM pe JOIN geo USING (doc_id) WHERE k = 1 AND n >= 3 AND abs(col_left - edge) >= 6
  AND EXISTS (SELECT 1 FROM long l WHERE l.doc_id = pe.doc_id AND l.page = pe.page AND l.a = edge AND l.w >= col_right - col_left - 10)
  AND (SELECT count(*) FROM long l WHERE l.doc_id = pe.doc_id AND l.page = pe.page AND abs(l.x0 - col_left) <= 2 AND l.x1 >= col_right - 10) < 3)"""
STYLED = f"""{SHIFT},
f1 AS (SELECT b.*, g.col_left, g.col_right, g.body_size, coalesce(s.shift, 0) AS shift, lag(b.x0) OVER w AS px0, lag(b.x1) OVER w AS px1, lag(b.y0) OVER w AS py0 FROM book b JOIN geo g USING (doc_id) LEFT JOIN shifts s USING (doc_id, page) WINDOW w AS (PARTITION BY b.doc_id, b.page ORDER BY b.idx)),
f2 AS (SELECT *, size <= body_size + 1 AS bodyish, coalesce(abs(px0 - x0) <= 2 AND px1 >= col_right - shift - 6 AND y0 > py0 AND y0 - py0 <= 2 * greatest(size, 8), false) AS cont, CASE WHEN size <= body_size + 1 THEN greatest(10, 0.12 * (col_right - col_left)) ELSE 10 END AS inset FROM f1),
f3 AS (SELECT *, NOT (bodyish AND cont) AND abs((x0 + x1) / 2 - ((col_left + col_right) / 2 - shift)) <= 10 AND x0 >= col_left - shift + inset AND x1 <= col_right - shift - inset AS centred FROM f2),
styled AS (SELECT *, family || '@' || replace(size::VARCHAR, '.0', '') || CASE WHEN centred THEN '/center' ELSE '' END AS style FROM f3)"""
CLUSTERS = f"""{STYLED},
cl AS (SELECT doc_id, style, any_value(size) AS size, any_value(centred) AS centred, count(*) AS n_lines, sum(length(text))::BIGINT AS n_chars, count(DISTINCT page) AS n_pages, min(page) AS first_page, min(page * 100000 + idx) AS seen FROM styled GROUP BY doc_id, style),
cm AS (SELECT *, first_value(style) OVER w AS main, size / first_value(size) OVER w AS ratio FROM cl WINDOW w AS (PARTITION BY doc_id ORDER BY n_chars DESC, seen))"""
FURNITURE = f"""cand AS (SELECT doc_id, page, idx, 'top' AS band, {template("text")} AS template FROM book WHERE idx < 2
  UNION ALL SELECT doc_id, page, idx, 'bottom', {template("text")} FROM book b WHERE idx = (SELECT max(idx) FROM book c WHERE c.doc_id = b.doc_id AND c.page = b.page) AND {folio(normal("text"))}),
fur AS (SELECT doc_id, template, count(*) AS n, arg_min(band, page * 100000 + idx * 10 + CASE band WHEN 'top' THEN 0 ELSE 1 END) AS band, array_to_string(list_sort(list(DISTINCT page))[1:8], ' ') AS pages FROM cand WHERE template NOT IN ('', '#') AND length(template) <= 60 GROUP BY doc_id, template HAVING count(*) >= 3)"""
FOLIOS = f"""ends AS (SELECT b.*, trim(text) AS t, regexp_extract(trim(text), '^([0-9]{{1,3}})[^0-9]', 1) AS f1, regexp_extract(trim(text), '[^0-9]([0-9]{{1,3}})$', 1) AS f2 FROM book b
  WHERE (idx = 0 OR idx = (SELECT max(idx) FROM book c WHERE c.doc_id = b.doc_id AND c.page = b.page)) AND (y0 <= 50 OR y1 >= 670)),
fol AS (SELECT doc_id, page, idx, CASE WHEN {folio("t")} AND {good("t")} THEN t WHEN f1 <> '' THEN CASE WHEN {good("f1")} THEN f1 END WHEN f2 <> '' AND {good("f2")} THEN f2 END AS folio FROM ends),
folios AS (SELECT doc_id, page, arg_min(folio, idx) AS folio FROM fol WHERE folio IS NOT NULL GROUP BY doc_id, page)"""
STROKES = "strokes AS (SELECT doc_id, page, x0, y1 AS y0, x1, y1 FROM book WHERE kind = 'quote')"
RULED = f"""{STROKES}, ruled AS (SELECT doc_id, page, count(DISTINCT round_even(y0, 0)) AS rows, 0::BIGINT AS columns FROM strokes WHERE x1 - x0 >= 30 GROUP BY doc_id, page HAVING count(DISTINCT round_even(y0, 0)) >= 3)"""
COLUMNS = """mid AS (SELECT doc_id, page, x0 + CASE WHEN idx % 2 = 0 AND page % 3 = 0 THEN 200 ELSE 0 END AS x0 FROM book WHERE y0 > 60 AND y0 < 660),
cols AS (SELECT doc_id, page, count(*) FILTER (x0 < 201.6) AS n_left, count(*) FILTER (x0 > 277.2) AS n_right FROM mid GROUP BY doc_id, page HAVING count(*) >= 12 AND count(*) FILTER (x0 < 201.6) >= 6 AND count(*) FILTER (x0 > 277.2) >= 6 AND min(x0) FILTER (x0 > 252) - coalesce(max(x0) FILTER (x0 <= 252), 0) > 30)"""
SUSPECTS = f"""{RULED}, {COLUMNS},
why AS (SELECT doc_id, page, 'columns' AS why FROM cols UNION ALL SELECT doc_id, page, 'image' FROM book_pages WHERE n_images > 0 UNION ALL SELECT doc_id, page, 'rules' FROM ruled
  UNION ALL SELECT doc_id, page, 'narrow lines' FROM book WHERE x1 - x0 < 0.4 * 504 GROUP BY doc_id, page HAVING count(*) >= 8),
sus AS (SELECT doc_id, page, string_agg(DISTINCT why, ', ' ORDER BY why) AS why FROM why GROUP BY doc_id, page)"""
VERSE = f"""{STYLED},
vf AS (SELECT *, NOT centred AND size <= body_size + 1 AND x0 >= col_left - shift - 2 AND x1 <= col_right - shift - greatest(18, 0.06 * greatest(1, col_right - col_left)) AS fit FROM styled),
vr AS (SELECT *, sum(CASE WHEN fit THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page ORDER BY idx) AS run, x0 - (col_left - shift) AS off FROM vf),
vo AS (SELECT doc_id, page, run, off, off > coalesce(lag(off) OVER (PARTITION BY doc_id, page, run ORDER BY off), -1e9) + 2 AS fresh FROM vr WHERE fit),
vl AS (SELECT doc_id, page, run, count(*) FILTER (fresh) AS levels, min(off) AS base, min(off) FILTER (fresh AND off > (SELECT min(off) FROM vo q WHERE q.doc_id = vo.doc_id AND q.page = vo.page AND q.run = vo.run)) AS second FROM vo GROUP BY doc_id, page, run),
vg AS (SELECT doc_id, page, run, min(idx) AS first, count(*) AS n, arg_min(off, idx) AS opens, max(x1) - min(x1) AS spread FROM vr WHERE fit GROUP BY doc_id, page, run),
verse AS (SELECT doc_id, page, first, n, round(base, 1) AS base, levels FROM vg JOIN vl USING (doc_id, page, run) WHERE n >= 3 AND spread >= 6 AND base >= 6 AND ((levels >= 2 AND second - base >= 6 AND opens <= base + 2) OR (levels = 1 AND n >= 4)))"""
NOTES = f"""tailed AS (SELECT b.*, g.body_size, (y1 >= 670 AND {folio(normal("text"))}) AS foot FROM book b JOIN geo g USING (doc_id)),
t2 AS (SELECT *, (SELECT coalesce(max(idx), -1) FROM tailed q WHERE q.doc_id = t.doc_id AND q.page = t.page AND NOT q.foot) AS last FROM tailed t),
t3 AS (SELECT *, (SELECT coalesce(max(idx), -1) FROM t2 q WHERE q.doc_id = t2.doc_id AND q.page = t2.page AND q.idx <= q.last AND q.size > q.body_size - 1.5) AS stop FROM t2),
notes AS (SELECT doc_id, page, trim(string_agg(text, ' ' ORDER BY idx)) AS t FROM t3 WHERE idx <= last AND idx > stop GROUP BY doc_id, page HAVING length(trim(string_agg(text, ' ' ORDER BY idx))) > 30)"""


def _q(rest: str, names: tuple[str, ...] = ("book",)) -> str:
    return f"{sql(Duck(), list(names))} {rest}"


BOTH = ("book", "book_pages")
ORACLES = {
    "column_geometry": _q(f"{GEO} SELECT * FROM geo"),
    "page_shift": _q(f"{SHIFT} SELECT doc_id, page, shift::DOUBLE AS shift FROM shifts"),
    "line_style_key": _q(f"{STYLED} SELECT doc_id, page, idx, style FROM styled"),
    "style_clusters": _q(f"{CLUSTERS} SELECT doc_id, style, n_lines, n_chars, n_pages, first_page, CASE WHEN style = main THEN 'p' WHEN ratio >= 1.8 THEN 'title-page' WHEN ratio >= 1.35 THEN 'h1' WHEN centred AND ratio >= 1.03 THEN 'h2' WHEN centred AND ratio >= 0.97 THEN 'h3' WHEN ratio <= 0.85 AND n_lines >= 10 THEN 'footnote' ELSE 'p' END AS role FROM cm"),
    "style_samples": _q(f"{STYLED} SELECT doc_id, style, row_number() OVER (PARTITION BY doc_id, style ORDER BY page, idx) AS k, trim(text) AS text FROM styled WHERE length(text) BETWEEN 16 AND 89 QUALIFY k <= 3"),
    "top_band": _q("""y AS (SELECT doc_id, page, list_sort(list(y0)) AS ys FROM book GROUP BY doc_id, page), a AS (SELECT doc_id, count(*) AS pages, list_sort(list(ys[1]) FILTER (len(ys) > 2 AND ys[2] - ys[1] >= 6)) AS h FROM y GROUP BY doc_id)
SELECT doc_id, CASE WHEN coalesce(len(h), 0) >= greatest(3, pages // 10) THEN round(h[floor(len(h) * 0.8)::INT + 1] + 4, 1) ELSE 0 END::DOUBLE AS top_band FROM a"""),
    "furniture_templates": _q(f"{FURNITURE} SELECT * FROM fur"),
    "printed_folio": _q(f"{FOLIOS} SELECT * FROM folios"),
    "folio_agreement": _q(f"""{FOLIOS}, j AS (SELECT p.doc_id, f.folio, p.label FROM book_pages p LEFT JOIN folios f USING (doc_id, page)),
s AS (SELECT doc_id, count(*) AS pages, count(folio) AS printed, count(label) AS labels, count(*) FILTER (folio IS NOT NULL AND label IS NOT NULL) AS total, count(*) FILTER (lower(folio) = lower(label)) AS agree FROM j GROUP BY doc_id)
SELECT doc_id, printed, total, CASE WHEN total > 0 THEN round(100 * agree / total, 1) END AS agreement, CASE WHEN total = 0 THEN CASE WHEN printed > 0 THEN 'printed-folios' WHEN labels > 0 THEN 'pdf-page-labels' ELSE 'synthetic' END WHEN round(100 * agree / total, 1) >= 97 THEN 'pdf-page-labels' WHEN printed >= pages // 3 THEN 'printed-folios' ELSE 'synthetic' END AS label_source FROM s""", BOTH),
    "footnote_census": _q(f"{GEO}, {NOTES} SELECT doc_id, page, length(t) AS n_chars, CASE WHEN regexp_matches(t, '^[0-9]{{1,3}}[.)]\\s') THEN 'digits' WHEN regexp_matches(t, '^[*†‡]') THEN 'asterisk' END AS marker FROM notes"),
    "joining_stats": _q(f"""{CLUSTERS}, o AS (SELECT s.*, lag(y0) OVER (PARTITION BY s.doc_id, page ORDER BY idx) AS above FROM styled s JOIN (SELECT DISTINCT doc_id, main FROM cm) m ON s.doc_id = m.doc_id AND s.style = m.main),
ld AS (SELECT doc_id, list_sort(list(y0 - above)) AS g FROM o WHERE y0 - above > 5 AND y0 - above < 40 GROUP BY doc_id),
bl AS (SELECT doc_id, round_even(x0, 0) AS base, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min(page * 100000 + idx)) AS k FROM o GROUP BY doc_id, round_even(x0, 0)),
st AS (SELECT o.doc_id, round_even(x0, 0) - base AS off, count(*) AS n FROM o JOIN bl ON o.doc_id = bl.doc_id AND k = 1 WHERE round_even(x0, 0) - base > 2 AND round_even(x0, 0) - base < 60 GROUP BY ALL),
ind AS (SELECT doc_id, round(min(off) * 0.75, 1) AS indent FROM st WHERE n >= 0.5 * (SELECT max(n) FROM st q WHERE q.doc_id = st.doc_id) GROUP BY doc_id),
ty AS (SELECT doc_id, count(*) FILTER (regexp_matches(rtrim(text), '[A-Za-z]-$')) AS eol_hyphens, sum(len(regexp_extract_all(rtrim(text), '[a-z][.!?,;:]["”’]?[A-Z“"]')))::BIGINT AS lost_spaces FROM o GROUP BY doc_id)
SELECT ty.doc_id, round(g[len(g) // 2 + 1], 1) AS leading, indent, eol_hyphens, lost_spaces FROM ty LEFT JOIN ld USING (doc_id) LEFT JOIN ind USING (doc_id)"""),
    "column_suspects": _q(f"{COLUMNS} SELECT * FROM cols"),
    "furniture_strip": _q(f"""{FURNITURE}, m AS (SELECT *, max(idx) OVER (PARTITION BY doc_id, page) AS n, {template("text")} AS tpl FROM book)
SELECT doc_id, page, idx, CASE WHEN NOT ((idx <= 1 OR idx >= n - 1) AND (y0 <= 50 OR y1 >= 670)) THEN 'kept' WHEN {folio(normal("text"))} THEN 'folio' WHEN EXISTS (SELECT 1 FROM fur WHERE fur.doc_id = m.doc_id AND fur.template = m.tpl) THEN 'head' WHEN abs(y0 - 40) <= 3 AND (starts_with(tpl, '#') OR ends_with(tpl, '#')) THEN 'baseline' ELSE 'kept' END AS reason FROM m"""),
    "furniture_leak": _q(f"""{FURNITURE}, tx AS (SELECT doc_id, page * 1000 + idx AS para, trim(text) AS t FROM book WHERE kind <> 'folio' UNION ALL SELECT DISTINCT doc_id, -page, 'proof.indd ' || page FROM book WHERE page % 7 = 3),
k AS (SELECT *, EXISTS (SELECT 1 FROM fur WHERE fur.doc_id = tx.doc_id AND fur.template = {template("t")}) AS is_head FROM tx WHERE t <> '' AND length(t) <= 120 AND lower(t) <> 'part of src3')
SELECT doc_id, para, substr(t, 1, 80) AS leak, is_head FROM k WHERE is_head OR regexp_matches(t, '\\.indd\\s') OR regexp_matches(t, '[0-9]+/[0-9]+/[0-9]+\\s+[0-9]+:[0-9]+\\s*[AP]M') OR regexp_matches(t, '(?i)^page [ivxlcdm0-9]+$')"""),
    "image_only_pages": _q("z AS (SELECT 1) SELECT p.doc_id, p.page, coalesce(sum(length(text)), 0)::BIGINT AS n_chars FROM book_pages p LEFT JOIN book b USING (doc_id, page) WHERE n_images >= 1 GROUP BY ALL HAVING coalesce(sum(length(text)), 0) < 20", BOTH),
    "continues_block": _q(f"{STYLED} SELECT doc_id, page, idx FROM styled WHERE cont"),
    "structure_suspects": _q(f"{SUSPECTS} SELECT * FROM sus", BOTH),
    "ruled_pages": _q(f"{RULED} SELECT * FROM ruled"),
    "uncovered_images": _q("z AS (SELECT 1) SELECT doc_id, page, n_images::BIGINT AS n_images FROM book_pages WHERE n_images > 0 AND page NOT IN (1, 5, 20)", BOTH),
    "left_stops": _q(f"{SHIFT}, a AS (SELECT b.doc_id, round_even(x0 + coalesce(shift, 0), 0) AS stop FROM book b JOIN geo USING (doc_id) LEFT JOIN shifts s USING (doc_id, page) WHERE x1 >= col_right - coalesce(shift, 0) - 6 AND x0 + coalesce(shift, 0) < col_left + greatest(18, 0.1 * (col_right - col_left)) - 2) SELECT doc_id, stop, count(*) AS n FROM a GROUP BY ALL HAVING count(*) >= 3"),
    "paragraph_geometry": _q("""l AS (SELECT doc_id, para, page, size, length(text) AS n, len(regexp_extract_all(text, '[A-Za-zª-ʯͰ-⹯]')) - len(regexp_extract_all(text, '[ªº«-¹»-¿×÷‐-⁯₠-⃀℀-⹯]')) AS k, italic OR regexp_matches(family, '(?i)italic|oblique') AS i, bold AS b FROM book WHERE para >= 0),
s AS (SELECT doc_id, para, size, sum(n) AS n FROM l GROUP BY ALL), w AS (SELECT doc_id, para, size, row_number() OVER (PARTITION BY doc_id, para ORDER BY n DESC, size) AS k FROM s)
SELECT l.doc_id, l.para, min(page) AS first_page, any_value(w.size) AS size, sum(l.k)::BIGINT AS letters, sum(CASE WHEN i THEN l.k ELSE 0 END)::BIGINT AS italic, sum(CASE WHEN b THEN l.k ELSE 0 END)::BIGINT AS bold FROM l JOIN w ON l.doc_id = w.doc_id AND l.para = w.para AND w.k = 1 GROUP BY l.doc_id, l.para"""),
    "page_anchors": _q(f"""{GEO}, b AS (SELECT book.* FROM book JOIN geo USING (doc_id) WHERE abs(size - body_size) <= 2),
pr AS (SELECT b.doc_id, b.page, b.idx, b.x0 FROM b JOIN b q ON q.doc_id = b.doc_id AND q.page = b.page AND abs(q.x0 - b.x0) <= 2 GROUP BY ALL HAVING count(*) >= 2),
lx AS (SELECT doc_id, page, min(x0) AS l FROM pr GROUP BY doc_id, page),
e AS (SELECT b.doc_id, b.page, b.idx, l, x1 FROM b JOIN lx USING (doc_id, page) WHERE abs(x0 - l) <= 3),
er AS (SELECT e.doc_id, e.page, e.l, e.x1, count(*) AS n FROM e JOIN e q ON q.doc_id = e.doc_id AND q.page = e.page AND abs(q.x1 - e.x1) <= 2 GROUP BY e.doc_id, e.page, e.idx, e.l, e.x1),
r AS (SELECT doc_id, page, l, coalesce(max(x1) FILTER (n >= 2), max(x1)) AS r FROM er GROUP BY ALL)
SELECT doc_id, page, l AS "left", r AS "right" FROM r WHERE r - l >= 100"""),
    "dropcap_wrap_veto": _q(f"{GEO}, c AS (SELECT book.* FROM book JOIN geo USING (doc_id) WHERE size >= 2 * body_size AND regexp_full_match(trim(text), '\\p{{L}}{{1,2}}')) SELECT DISTINCT b.doc_id, b.page, b.idx FROM book b JOIN c ON b.doc_id = c.doc_id AND b.page = c.page AND b.idx <> c.idx WHERE b.y0 < c.y1 AND c.y0 < b.y1 AND b.x0 BETWEEN c.x1 - 6 AND c.x1 + 6"),
    "verse_suspects": _q(f"{VERSE} SELECT * FROM verse"),
    "verse_witness": _q(f"{VERSE} SELECT * FROM verse WHERE NOT EXISTS (SELECT 1 FROM book b WHERE b.doc_id = verse.doc_id AND b.page = verse.page AND b.page % 2 = 0 AND b.kind = 'verse' AND b.idx >= verse.first AND b.idx < verse.first + verse.n)"),
    "orphan_headings": _q("f AS (SELECT doc_id, (page - 1) * 1000 + idx AS file, kind, text FROM book WHERE kind = 'head' UNION ALL SELECT doc_id, (page - 1) * 1000 + idx, CASE WHEN page % 3 = 0 THEN 'figure' ELSE 'body' END, substr(text, 1, 25 - 5 * (page % 4)) FROM book WHERE kind = 'head') SELECT doc_id, file, coalesce(sum(length(text)) FILTER (kind = 'body'), 0)::BIGINT AS chars FROM f GROUP BY doc_id, file HAVING count(*) FILTER (kind = 'figure') = 0 AND coalesce(sum(length(text)) FILTER (kind = 'body'), 0) < 20"),
    "line_order": _q("z AS (SELECT 1) SELECT doc_id, page, idx, row_number() OVER (PARTITION BY doc_id, page ORDER BY round(y0, 1), x0, idx) AS position FROM book"),
    "render_queue": _q(f"{SUSPECTS}, {GEO}, {NOTES}, q AS (SELECT doc_id, 1 AS page FROM book_pages WHERE page = 1 UNION SELECT doc_id, page FROM cols QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY page) <= 4 UNION SELECT doc_id, page FROM notes QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY page) <= 2 UNION SELECT doc_id, page FROM ruled) SELECT DISTINCT doc_id, page FROM q", BOTH),
    "page_spec": _q(f"{SUSPECTS}, h AS (SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id ORDER BY md5('7:' || doc_id || ':' || page)) AS k FROM book_pages), a AS (SELECT 'auto' AS spec, doc_id, page FROM sus UNION SELECT 'auto', doc_id, page FROM cols UNION SELECT '1,4-6+sample:2', doc_id, page FROM book_pages WHERE page IN (1, 4, 5, 6) UNION SELECT '1,4-6+sample:2', doc_id, page FROM h WHERE k <= 2 UNION SELECT 'flagged', doc_id, page FROM cols UNION SELECT 'all', doc_id, page FROM book_pages) SELECT * FROM a", BOTH),
}
