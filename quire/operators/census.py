"""Aggregations over a corpus: furniture, geometry, styles, leading, scripts, emphasis. Modes break ties by first sight."""

from __future__ import annotations

from quire.operators.text import template
from quire.plans.dialect import Spark


def mode(group: str, value: str, source: str, weight: str = "1", where: str = "true", first: str = "line") -> str:
    """SELECT of the group's most frequent value, the first seen among equals."""
    return f"""SELECT {group}, value, n FROM (SELECT {group}, value, n, row_number() OVER (PARTITION BY {group} ORDER BY n DESC, seen) AS k
  FROM (SELECT {group}, {value} AS value, CAST(sum({weight}) AS BIGINT) AS n, min({first}) AS seen FROM {source} WHERE {where} GROUP BY {group}, {value})) WHERE k = 1"""


def furniture(d: Spark) -> str:
    head = "CASE WHEN idx = 0 THEN source || ' chapter ' || CAST(page AS VARCHAR(20)) ELSE text END"
    return f"""c AS (SELECT doc_id, source, page, idx, {head} AS text FROM lines WHERE idx < 2),
t AS (SELECT doc_id, source, page, {template(d, "text")} AS template FROM c)
SELECT source, template, count(*) AS n, count(DISTINCT doc_id) AS n_docs, min(page) AS first_page FROM t WHERE template <> '' AND template <> '#' AND length(template) <= 60 GROUP BY source, template HAVING count(*) >= 3"""


OPERATORS = {
    "repeated_lines": (["paras"], lambda d: f"t AS (SELECT source, {template(d, 'text')} AS template FROM paras WHERE length(text) <= 60) SELECT source, template, count(*) AS n FROM t WHERE template NOT IN ('', '#') GROUP BY source, template HAVING count(*) >= 3"),
    "leading_stats": (["lines"], lambda d: f"""g AS (SELECT doc_id, y0 - lag(y0) OVER (PARTITION BY doc_id, page ORDER BY line) AS gap FROM lines),
r AS (SELECT doc_id, gap, row_number() OVER (PARTITION BY doc_id ORDER BY gap) AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM g WHERE gap > 5 AND gap < 40)
SELECT doc_id, gap AS leading, n FROM r WHERE k = {d.div("n", "2")} + 1"""),
    "indent_histogram": (["lines"], lambda d: f"h AS (SELECT doc_id, {d.rint('x0 - 72')} AS indent FROM lines) SELECT doc_id, indent, count(*) AS n FROM h GROUP BY doc_id, indent"),
    "pua_census": (["damaged"], lambda d: f"e AS (SELECT doc_id, para, x AS ch FROM (SELECT doc_id, para, {d.rows(d.every('text', '[-]'))} FROM damaged)) SELECT doc_id, ch, count(*) AS n, min(para) AS first_para FROM e GROUP BY doc_id, ch"),
    "script_census": (["damaged"], lambda d: f"t AS (SELECT doc_id, lang, CASE para % 6 WHEN 0 THEN text || ' 漢字' WHEN 1 THEN text || ' שלום' ELSE text END AS text FROM damaged), s AS (SELECT doc_id, lang, {d.count('text', '[　-鿿豈-﫿]')} AS cjk, {d.count('text', '[֐-ࣿ]')} AS rtl FROM t) SELECT doc_id, lang, CAST(sum(cjk) AS BIGINT) AS n_cjk, CAST(sum(rtl) AS BIGINT) AS n_rtl, CAST(sum(CASE WHEN rtl > 0 AND lang <> 'fr' THEN rtl ELSE 0 END) AS BIGINT) AS rtl_unexpected FROM s GROUP BY doc_id, lang"),
    "codepoint_buckets": (["paras"], lambda d: f"e AS (SELECT lang, para % 5 = 0 AS italic, x AS ch FROM (SELECT lang, para, {d.rows(d.every('text', '[^ -~]'))} FROM paras)) SELECT lang, italic, ch, count(*) AS n FROM e GROUP BY lang, italic, ch"),
    "dominant_font": (["lines"], lambda d: f"r AS (SELECT doc_id, page, line, 'f' || CAST(line % 4 AS VARCHAR(9)) AS font, length(text) AS n_chars FROM lines), m AS ({mode('doc_id, page', 'font', 'r', 'n_chars')}) SELECT doc_id, page, value AS font, n AS n_chars FROM m"),
    "letter_census": (["lines"], lambda d: f"c AS (SELECT doc_id, page, italic, size, {d.count('text', chr(92) + 'p{L}')} AS letters FROM lines) SELECT doc_id, page, CAST(sum(letters) AS BIGINT) AS letters, CAST(sum(CASE WHEN italic THEN letters ELSE 0 END) AS BIGINT) AS italic_letters, CAST(sum(CASE WHEN size > 12 THEN letters ELSE 0 END) AS BIGINT) AS bold_letters FROM c GROUP BY doc_id, page"),
    "emphasis_conservation": (["lines"], lambda d: f"""a AS (SELECT doc_id, page, CAST(sum(length(text)) AS BIGINT) AS letters, CAST(sum(CASE WHEN italic THEN length(text) ELSE 0 END) AS BIGINT) AS it FROM lines GROUP BY doc_id, page),
b AS (SELECT doc_id, page, CAST(sum(CASE WHEN italic AND line % 7 > 1 THEN length(text) ELSE 0 END) AS BIGINT) AS it FROM lines WHERE page % 11 > 0 GROUP BY doc_id, page)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.page, b.page) AS page, a.it AS expected, coalesce(b.it, 0) AS shipped FROM a FULL OUTER JOIN b ON a.doc_id = b.doc_id AND a.page = b.page WHERE a.letters > 40 AND abs(a.it - coalesce(b.it, 0)) > 40 AND 100 * abs(a.it - coalesce(b.it, 0)) > 15 * a.letters"""),
    "timing_percentiles": (["lines"], lambda d: f"t AS (SELECT source, page, (line * 37 % 1000) AS ms FROM lines WHERE idx = 3), r AS (SELECT source, ms, row_number() OVER (PARTITION BY source ORDER BY ms, page) AS k, count(*) OVER (PARTITION BY source) AS n FROM t) SELECT source, max(n) AS n, max(CASE WHEN k = {d.div('n', '2')} + 1 THEN ms END) AS median_ms, max(CASE WHEN k = least(n, {d.div('n * 95', '100')} + 1) THEN ms END) AS p95_ms, max(ms) AS max_ms FROM r GROUP BY source"),
    "first_evidence": (["lines"], lambda d: "e AS (SELECT doc_id, page, CASE WHEN size > 12 THEN 'heading' WHEN size < 10 THEN 'note' WHEN italic THEN 'italic' ELSE 'body' END AS phenomenon FROM lines) SELECT doc_id, phenomenon, min(page) AS first_page, count(DISTINCT page) AS n_pages FROM e GROUP BY doc_id, phenomenon"),
    "scaling_line": (["lines"], lambda d: "s AS (SELECT source, count(DISTINCT doc_id * 100000 + page) AS pages, count(CASE WHEN size > 12 THEN 1 END) AS overrides FROM lines GROUP BY source) SELECT source, pages, overrides, " + d.div("100 * overrides", "pages") + " AS per_100_pages FROM s"),
    "verse_integrity": (["paras"], lambda d: f"v AS (SELECT doc_id, para, replace(text, '. ', '.¶') AS t, {d.count('text', '[.] ')} AS seps FROM paras WHERE para % 7 = 0) SELECT doc_id, count(*) AS stanzas, CAST(sum(1 + seps) AS BIGINT) AS expected_lines, CAST(sum(1 + {d.count('t', '¶')}) AS BIGINT) AS shipped_spans FROM v GROUP BY doc_id"),
    "rule_counters": (["damaged"], lambda d: f"c AS (SELECT doc_id, {d.count('text', '[ﬀ-ﬆ]')} AS lig, {d.count('text', '­')} AS soft, {d.count('text', '�')} AS lost, {d.count('text', '[-]')} AS pua FROM damaged), u AS (SELECT doc_id, 'ligature' AS rule, lig AS n FROM c UNION ALL SELECT doc_id, 'soft-hyphen', soft FROM c UNION ALL SELECT doc_id, 'lost', lost FROM c UNION ALL SELECT doc_id, 'pua', pua FROM c) SELECT doc_id, rule, CAST(sum(n) AS BIGINT) AS n FROM u GROUP BY doc_id, rule HAVING sum(n) > 0"),
}
