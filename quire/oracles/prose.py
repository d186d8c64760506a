"""What the operators of ``prose`` must give, in DuckDB's SQL over the fixture's tables."""

from __future__ import annotations

from quire.plans.book import sql
from quire.plans.dialect import Duck
from quire.plans.views import PRIVATE

SUFFIXES = [(".xhtml", "application/xhtml+xml"), (".css", "text/css"), (".ncx", "application/x-dtbncx+xml"), (".otf", "application/vnd.ms-opentype"), (".ttf", "application/vnd.ms-opentype"), (".jpg", "image/jpeg"), (".jpeg", "image/jpeg"), (".png", "image/png"), (".gif", "image/gif"), (".svg", "image/svg+xml"), (".txt", "text/plain")]
LOST = "[a-z][.!?][A-Z]|,\"[A-Z]|,”[A-Z]"
HTML = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
BREAK = "'<div id=\"pg-' || {0} || '\" class=\"pagebreak\" epub:type=\"pagebreak\" role=\"doc-pagebreak\" aria-label=\"' || {0} || '\"></div>'"
POINTS = "array_to_string(list_sort(list_distinct(list_transform(string_split(array_to_string({}, ''), ''), lambda c: 'U+' || lpad(printf('%X', unicode(c)), 4, '0')))), '{}')"
RESOLVED = """res AS (SELECT *, CASE WHEN code = 'nav-numeric-bloat' THEN 'toc.drop_numeric_nav_entries set' WHEN code = 'image-only-page' AND page <= 2 THEN 'cover/excluded page' WHEN code = 'image-only-page' AND page <= 4 THEN 'ships as a figure page'
  WHEN code = 'engine-agreement-low' AND page IN (1, 2, 3, 4, 6, 7) THEN 'config handles the page (cover/exclude/figure/columns/printed-TOC)' WHEN code = 'embedded-image-uncovered' AND page IN (2, 5) THEN 'excluded page / figure_regions covers it'
  WHEN code = 'top-band-kept' AND ((page = 8 AND line = 1) OR (page = 9 AND line = 3)) THEN 'flow.overrides addresses this exact line' END AS resolved_by FROM warnings),
ent(entry, code, page, note) AS (VALUES (1, 'pua-unmapped', NULL, 'as printed'), (2, 'image-only-page', 8, 'a plate'), (3, 'top-band-kept', 99, 'a head'), (4, 'pua-unmapped', 2, 'seen'), (5, 'flow-uncoded', NULL, 'none'))"""
SPACES = [  # a space goes between the two groups; what must follow is a third one, put back
    (r'([a-z][.!?,;:])(["“’]?[A-Z“"])', ""), (r'([a-z][”"])([A-Z])', ""), (r'([\])0-9][.,])(["“”][A-Z“"])', ""), (r"([a-z],)([a-z])", ""), (r"([A-Za-z0-9\]][.!?,;:])([‘“])", ""), (r"(”)([A-Za-z])", ""), (r"([\])][.,;:])([A-Za-z])", ""),
    (r"([.!?”’])(\([0-9])", ""), (r"([.!?]\*)([A-Za-z])", ""), (r"([0-9A-Z]\.)([A-Z][a-z])", ""), (r"([0-9]\.)([A-Z])([\s’])", "3"), (r"(;)([A-Za-z])", ""), (r"([0-9],)([A-Z])", ""), (r"([0-9],)([0-9]{4})([^0-9]|$)", "3"), (r"(”\.)([A-Z])", ""),
    (r"(\*)([A-Za-z])", ""), (r"([a-z])(&)([A-Z])", "3"), (r"([a-z ]&)([A-Z])", ""),
]


def _chain() -> str:
    ctes = ["c0 AS (SELECT doc_id, para, para % 40 AS page, text AS t FROM damaged)"]
    cols: list[str] = []

    def step(expr: str, **counts: str) -> None:
        n = len(ctes)
        keep = "".join(f", {c}" for c in cols)
        new = "".join(f", ({v})::BIGINT AS {k}" for k, v in counts.items())
        ctes.append(f"c{n} AS (SELECT doc_id, para, page, {expr} AS t{keep}{new} FROM c{n - 1})")
        cols.extend(counts)

    def size(p: str) -> str:
        return f"len(regexp_extract_all(t, '{p}'))"

    c0 = "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]"
    step(f"regexp_replace(t, '{c0}', '', 'g')", controls=size(c0))
    step("regexp_replace(t, 'Ᾱ([a-z])', 'Ā\\1', 'g')", wrong_script=size("Ᾱ[a-z]"))
    step("regexp_replace(t, '`([^\\p{L}]|$)', '\\1', 'g')", graves=size("`(?:[^\\p{L}]|$)"))
    lost = "len(t) - len(replace(t, '�', ''))"
    step("CASE WHEN page IN (3, 12) THEN replace(t, '�', 'on') ELSE t END", replaced=f"CASE WHEN page IN (3, 12) THEN {lost} ELSE 0 END", unrepaired=f"CASE WHEN page IN (3, 12) THEN 0 ELSE {lost} END")
    step("regexp_replace(t, '­([^\\s]|$)', '\\1', 'g')", _s1=size("­[^\\s]"))
    step("regexp_replace(t, '­ +', '', 'g')", soft_hyphens="_s1 + " + size("­ +"))
    step("replace(replace(replace(replace(replace(replace(replace(t, 'ﬀ', 'ff'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬃ', 'ffi'), 'ﬄ', 'ffl'), 'ﬅ', 'st'), 'ﬆ', 'st')", ligatures=size("[ﬀ-ﬆ]"))
    step("regexp_replace(t, '- ((?i:and|or|nor|und|oder|et|ou))([^A-Za-zÀ-ſ’'']|$)', chr(1) || '\\1\\2', 'g')")
    step("regexp_replace(t, '([A-Za-zÀ-ſ])- ([a-zà-ÿ])', '\\1\\2', 'g')", hyphens=size("[A-Za-zÀ-ſ]- [a-zà-ÿ]"))
    step("replace(t, chr(1), '- ')")
    step("regexp_replace(t, '([.!?,;:]) ([”’])', '\\1\\2 ', 'g')", quotes_swapped=size("[.!?,;:] [”’]"))
    for i, (p, more) in enumerate(SPACES):
        step(f"regexp_replace(t, '{p}', '\\1 \\2{'\\3' if more else ''}', 'g')", **{f"_r{i}": size(p)})
    step("t", spaces=" + ".join(f"_r{i}" for i in range(len(SPACES))))
    step(f"regexp_replace(t, '[  ]*{PRIVATE}', ' (peace)', 'g')", private_read=size(PRIVATE), private_left="0")
    step("regexp_replace(t, '( \\(peace\\))[  ]+([.,;:!?])', '\\1\\2', 'g')")
    names = [c for c in cols if not c.startswith("_")]
    return ",\n".join(ctes) + f" SELECT doc_id, para, {', '.join(names)}, t AS text FROM c{len(ctes) - 1}"


def _q(rest: str, *names: str) -> str:
    return f"{sql(Duck(), list(names))} {rest}"


ORACLES = {
    "media_types": _q("z AS (SELECT 1) SELECT name, CASE " + " ".join(f"WHEN ends_with(lower(name), '{s}') THEN '{m}'" for s, m in SUFFIXES) + " ELSE 'application/octet-stream' END AS media_type FROM names", "names"),
    "css_class": _q("z AS (SELECT 1) SELECT name, trim(regexp_replace(name, '[^\\w-]+', '-', 'g'), '-') AS css_class FROM names", "names"),
    "chunk_suffix": _q("k AS (SELECT DISTINCT para FROM paras) SELECT para, CASE WHEN para = 0 THEN '' WHEN para < 26 THEN chr((97 + para)::INT) ELSE 'x' || para END AS suffix FROM k", "paras"),
    "list_marker_patterns": _q("k AS (SELECT doc_id, para, CASE WHEN regexp_matches(text, '^[0-9]{1,3}(-[0-9]{1,3})?[.)][\\s·‧∙A-Z“‘]') THEN 'decimal' WHEN regexp_matches(text, '^(•|·|‣|▪|●|-)\\s') THEN 'bullet' END AS kind FROM markers) SELECT * FROM k WHERE kind IS NOT NULL", "markers"),
    "lost_space_defects": _q(f"k AS (SELECT doc_id, para, regexp_extract_all(replace(replace(text, 'ti.T', ' '), 'en.A', ' '), '{LOST}') AS f FROM damaged) SELECT doc_id, para, len(f) AS n, array_to_string(f, ' ') AS found FROM k WHERE len(f) > 0", "damaged"),
    "stale_allowances": _q("a(snippet) AS (VALUES ('ti.T'), ('en.A'), ('never there')) SELECT snippet FROM a WHERE NOT EXISTS (SELECT 1 FROM damaged WHERE contains(text, snippet))", "damaged"),
    "garble_runs": _q(f"k AS (SELECT doc_id, para, regexp_extract_all(text, '[�\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f³´«]+') AS r FROM damaged) SELECT doc_id, para, len(r) AS n_runs, {POINTS.format('r', ',')} AS points FROM k WHERE len(r) > 0", "damaged"),
    "pua_residue": _q(f"k AS (SELECT doc_id, para, regexp_extract_all(text, '[\\x{{E000}}-\\x{{F8FF}}]') AS r FROM damaged) SELECT doc_id, para, {POINTS.format('r', ' ')} AS points FROM k WHERE len(r) > 0", "damaged"),
    "pua_decode": _q(f"z AS (SELECT 1) SELECT doc_id, para, regexp_replace(text, '[  ]*{PRIVATE}', ' (peace)', 'g') AS text FROM damaged WHERE contains(text, '{PRIVATE}')", "damaged"),
    "text_fix_chain": _q(_chain(), "damaged"),
    "page_break_html": _q(f"z AS (SELECT 1) SELECT doc_id, page, {BREAK.format('label')} AS html FROM book_pages WHERE label IS NOT NULL", "book_pages"),
    "figure_html": _q(f"""f AS (SELECT *, coalesce({HTML.format('alt')}, '') AS a, greatest(20, least(100, round_even(width / 3.6, 0)))::INT AS pct FROM figures)
SELECT doc_id, figure, CASE role WHEN 'chinese-page' THEN format('<div class="chinese-page"><img src="image/{{}}" alt="{{}}"/></div>', file, a) WHEN 'decoration' THEN format('<div class="figure decoration"><img src="image/{{}}" alt="" role="presentation"/></div>', file)
  ELSE format('<figure class="figure" style="width:{{}}%"><img src="image/{{}}" alt="{{}}"/></figure>', pct, file, a) END AS html FROM f""", "figures"),
    "index_section": _q(f"""b AS (SELECT *, sum((kind = 'text')::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM blocks), e AS (SELECT doc_id, run, min(pos) AS first, max(pos) AS last, count(*) AS n FROM b WHERE kind = 'entry' GROUP BY ALL)
SELECT e.doc_id, first, n, '<section epub:type="index" role="doc-index">' || string_agg(CASE kind WHEN 'entry' THEN '<p>' || {HTML.format('text')} || '</p>' WHEN 'head' THEN '<h2>' || {HTML.format('text')} || '</h2>' ELSE {BREAK.format('text')} END, '' ORDER BY pos) || '</section>' AS html
FROM e JOIN b ON e.doc_id = b.doc_id AND e.run = b.run AND b.pos BETWEEN first AND last AND kind <> 'text' GROUP BY e.doc_id, first, n""", "blocks"),
    "outline_targets": _q("z AS (SELECT 1) SELECT doc_id, pos, depth, rtrim(title, chr(0)) AS title, target, target IS NOT NULL AND target > 0 AS kept FROM outline", "outline"),
    "link_targets": _q("z AS (SELECT 1) SELECT doc_id, link, CASE WHEN kind = 'goto' THEN TRY_CAST(target AS BIGINT) + 1 WHEN kind = 'named' THEN TRY_CAST(target AS BIGINT) END AS page FROM links", "links"),
    "link_census": _q("z AS (SELECT 1) SELECT doc_id, kind, count(*) AS n, kind = 'launch' AS warns FROM links GROUP BY ALL", "links"),
    "warning_resolve": _q(f"{RESOLVED} SELECT doc_id, warning, resolved_by FROM res", "warnings"),
    "warning_adjudication": _q(f"{RESOLVED} SELECT doc_id, warning, code, (SELECT arg_max(note, entry) FROM ent WHERE ent.code = res.code AND (ent.page IS NULL OR ent.page = res.page)) AS note FROM res WHERE resolved_by IS NULL", "warnings"),
    "stale_adjudications": _q(f"{RESOLVED} SELECT d.doc_id, entry, code, page::BIGINT AS page FROM (SELECT DISTINCT doc_id FROM warnings) d, ent WHERE NOT EXISTS (SELECT 1 FROM res WHERE res.doc_id = d.doc_id AND res.code = ent.code AND resolved_by IS NULL AND (ent.page IS NULL OR ent.page = res.page))", "warnings"),
    "adjudication_snippet": _q("""z AS (SELECT 1) SELECT code, format('- {{warning: {}, pages: [{}], note: "<verified on render: why this is acceptable>"}}', code, string_agg(DISTINCT page::VARCHAR, ', ' ORDER BY page)) AS snippet FROM (SELECT DISTINCT code, page FROM warnings WHERE page IS NOT NULL) GROUP BY code""".replace("string_agg(DISTINCT page::VARCHAR, ', ' ORDER BY page)", "string_agg(page::VARCHAR, ', ' ORDER BY page)"), "warnings"),
    "reader_text": _q("z AS (SELECT 1) SELECT doc_id, block, string_agg(CASE cls WHEN 'noteref x' THEN '[' || trim(text) || ']' WHEN 'backlink' THEN '' ELSE text END, '' ORDER BY pos) AS text FROM events GROUP BY ALL", "events"),
    "bold_ranges": _q("""r AS (SELECT doc_id, page AS para, bold, coalesce(sum(length(text)) OVER (PARTITION BY doc_id, page ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a, length(text) AS n FROM book)
SELECT g.doc_id, g.para, g.start, g.stop, count(*) FILTER (a + n > g.start AND a < g.stop) > 0 AND count(*) FILTER (NOT bold AND a + n > g.start AND a < g.stop) = 0 AS bold FROM ranges g JOIN r USING (doc_id, para) GROUP BY ALL""", "book", "ranges"),
    "toc_lines": _q("""z AS (SELECT doc_id, line, text, page, idx, k, trim(substr(text, 1, 30)) AS head FROM (SELECT doc_id, page * 1000 + idx AS line, page, idx, trim(regexp_replace(text, '[ .]+', ' ', 'g')) AS text, idx % 5 AS k FROM book WHERE kind = 'body'))
SELECT doc_id, line, head AS title, CASE WHEN k = 1 THEN 'xiv' ELSE page::VARCHAR END AS folio FROM z WHERE (k < 3 OR (k = 3 AND substr(text, 30, 1) = ' ')) AND length(head) >= 2""", "book"),
    "fuzzy_find": _q("""n AS (SELECT *, substr(text, 6, 90) AS piece FROM needles), p AS (SELECT *, strpos(text, piece) AS pp, strpos(text, substr(piece, 11, 40)) AS mid FROM n)
SELECT doc_id, para, (CASE para % 4 WHEN 3 THEN -1 WHEN 1 THEN greatest(0, mid - 11) ELSE pp - 1 + CASE WHEN para % 4 = 2 THEN length(piece) - length(ltrim(piece)) ELSE 0 END END)::INT AS start,
  (CASE para % 4 WHEN 3 THEN -1 WHEN 1 THEN mid - 1 + strpos(substr(text, mid), substr(piece, 61, 30)) - 1 + 30 WHEN 0 THEN pp + 89 ELSE pp - 1 + length(rtrim(piece)) END)::INT AS stop FROM p""", "needles"),
    "note_excision": _q("z AS (SELECT 1) SELECT doc_id, para, CASE WHEN para % 4 = 3 THEN '3. ' || text ELSE replace_first END AS text, CASE WHEN para % 4 = 3 THEN 0 ELSE n END::INT AS n FROM (SELECT *, regexp_replace(substr('3. ' || text, 1, p0 - 1), '[.)]?\\s*$', '') || ' ' || substr('3. ' || text, p0 + length(needle)) AS replace_first, length(needle) + (length(substr('3. ' || text, 1, p0 - 1)) - length(regexp_replace(substr('3. ' || text, 1, p0 - 1), '[.)]?\\s*$', ''))) AS n FROM (SELECT *, strpos('3. ' || text, needle) AS p0 FROM needles WHERE para % 4 IN (0, 3)))", "needles"),
    "paragraph_fold": _q("z AS (SELECT 1) SELECT DISTINCT doc_id, para, whole AS text FROM hyphened", "hyphened"),
    "shifted_cmap_repair": _q("z AS (SELECT 1) SELECT doc_id, para, text FROM paras WHERE contains(text, ' ')", "paras"),
    "heading_fold": _q("z AS (SELECT 1) SELECT doc_id, page, idx, trim(regexp_replace(regexp_replace(lower(strip_accents(text)), '[^0-9a-z ]+', '', 'g'), '\\s+', ' ', 'g')) AS folded FROM book WHERE kind = 'head'", "book"),
    "benchmark_containment": "SELECT d.doc_id, b.item_id FROM documents d, benchmark b WHERE length(b.text) >= 20 AND strpos(d.text, b.text) > 0",
    "note_paragraphs": _q("z AS (SELECT 1) SELECT doc_id, page, string_agg(CASE WHEN starts_with(text, '1. ') THEN substr(text, 4) ELSE text END, ' ' ORDER BY idx) AS text FROM book WHERE kind = 'note' GROUP BY ALL", "book"),
}
