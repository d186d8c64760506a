"""Scalar text operators: repairs with counts, tests of shape, folds. Each entry: the views it reads and its SQL.

An operator's SQL is the rest of a WITH clause: common tables, then the final SELECT.
"""

from __future__ import annotations

from quire.plans.dialect import Spark
from quire.plans.views import LOST, SOFT

LOW, CAP, DIGIT, LETTER = "a-z", "A-Z", "0-9", "A-Za-z"
C0 = f'[{chr(92)}x00-{chr(92)}x08{chr(92)}x0b-{chr(92)}x0c{chr(92)}x0e-{chr(92)}x1f]'
STOP, PAUSE, END = ".!?", ",;:", ".!?,;:"
DQ, OPEN2, CLOSE2, OPEN1, CLOSE1 = '"', "“", "”", "‘", "’"
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}

#: Rules of lost spaces in their order: name, what stands left of the space, what right, what must follow.
SPACE_RULES = [
    ("after-punct", f"[{LOW}][{END}]", f"[{DQ}{OPEN2}{CLOSE1}]?[{CAP}{OPEN2}{DQ}]", ""),
    ("after-quote", f"[{LOW}][{CLOSE2}{DQ}]", f"[{CAP}]", ""),
    ("after-bracket", rf"[\]){DIGIT}][.,]", f"[{DQ}{OPEN2}{CLOSE2}][{CAP}{OPEN2}{DQ}]", ""),
    ("comma-lower", f"[{LOW}],", f"[{LOW}]", ""),
    ("punct-openq", rf"[{LETTER}{DIGIT}\]][{END}]", f"[{OPEN1}{OPEN2}]", ""),
    ("closeq", CLOSE2, f"[{LETTER}]", ""),
    ("after-cite", rf"[\])][.{PAUSE}]", f"[{LETTER}]", ""),
    ("before-paren", f"[{STOP}{CLOSE2}{CLOSE1}]", rf"\([{DIGIT}]", ""),
    ("after-star", rf"[{STOP}]\*", f"[{LETTER}]", ""),
    ("num-dot-cap", rf"[{DIGIT}{CAP}]\.", f"[{CAP}][{LOW}]", ""),
    ("num-dot-onecap", rf"[{DIGIT}]\.", f"[{CAP}]", rf"[\s{CLOSE1}]"),
    ("after-semi", ";", f"[{LETTER}]", ""),
    ("num-comma-cap", f"[{DIGIT}],", f"[{CAP}]", ""),
    ("num-comma-year", f"[{DIGIT}],", f"[{DIGIT}]{{4}}", f"(?:[^{DIGIT}]|$)"),
    ("closeq-dot", rf"{CLOSE2}\.", f"[{CAP}]", ""),
    ("star-letter", r"\*", f"[{LETTER}]", ""),
    ("amp-left", f"[{LOW}]", "&", f"[{CAP}]"),
    ("amp-right", f"[{LOW} ]&", f"[{CAP}]", ""),
]


def swap_quotes(d: Spark, x: str) -> str:
    return d.sub(x, f"([{END}]) ([{CLOSE2}{CLOSE1}])", "@1@2 ")


def restore_spaces(d: Spark, x: str) -> str:
    x = swap_quotes(d, x)
    for _, left, right, ahead in SPACE_RULES:
        if ahead and d.name == "spark":
            x = d.sub(x, f"({left})({right}(?={ahead}))", "@1 @2")
        elif ahead:
            x = d.sub(x, f"({left})({right})({ahead})", "@1 @2@3")
        else:
            x = d.sub(x, f"({left})({right})", "@1 @2")
    return x


def lacks_space(d: Spark, x: str) -> str:
    """Whether any rule, the swap included, applies: exactly then restore_spaces changes a text."""
    every = [f"[{END}] [{CLOSE2}{CLOSE1}]", *(f"{left}{right}{ahead}" for _, left, right, ahead in SPACE_RULES)]
    return d.has(x, "|".join(f"(?:{p})" for p in every))


def expand_ligatures(x: str) -> str:
    for a, b in LIGATURES.items():
        x = f"replace({x}, '{a}', '{b}')"
    return x


def folio(d: Spark, x: str) -> str:
    return d.has(f"lower(trim({x}))", f"^([{DIGIT}]{{1,4}}|[ivxlcdm]+)$")


def template(d: Spark, x: str) -> str:
    """Digits to #, then roman numerals at either edge; the text is in canonical form before."""
    x = d.sub(f"trim({d.sub(x, r'\s+', ' ')})", f"[{DIGIT}]+", "#")
    return f"trim({d.sub(x, '^[ivxlcdmIVXLCDM]+|[ivxlcdmIVXLCDM]+$', '#')})"


def _mend(expression, only: str):
    return lambda d: f"r AS (SELECT doc_id, para, text, {expression(d)} AS fixed FROM damaged) SELECT doc_id, para, fixed, CAST(length(text) - length(fixed) AS BIGINT) AS n_shorter FROM r WHERE {only}"


def _roman(d: Spark, n: str) -> str:
    for unit, (one, five, ten) in ((1000, ("M", "", "")), (100, ("C", "D", "M")), (10, ("X", "L", "C")), (1, ("I", "V", "X"))):
        digit = f"({d.div(n, str(unit))} % 10)"
        forms = ["", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten]
        yield f"CASE {digit} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(forms[:4] if unit == 1000 else forms)) + " ELSE '' END"


VALUES = dict(zip("ivxlcdm", (10**k * f for k in range(4) for f in (1, 5))))


def _value(x: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in VALUES.items()) + " ELSE 0 END"


OPERATORS = {
    "ligature_expand": (["damaged"], lambda d: f"r AS (SELECT doc_id, para, {expand_ligatures('text')} AS fixed, {d.count('text', '[ﬀ-ﬆ]')} AS n_ligatures FROM damaged) SELECT * FROM r WHERE n_ligatures > 0"),
    "ctrl_strip": (["damaged"], lambda d: f"r AS (SELECT doc_id, para, {d.sub('text', C0)} AS fixed, {d.count('text', C0)} AS n FROM damaged) SELECT * FROM r WHERE n > 0"),
    "quote_swap": (["damaged"], lambda d: f"r AS (SELECT doc_id, para, {swap_quotes(d, 'text')} AS fixed, {d.count('text', f'[{END}] [{CLOSE2}{CLOSE1}]')} AS n FROM damaged) SELECT * FROM r WHERE n > 0"),
    "restore_spaces": (["damaged"], lambda d: f"r AS (SELECT doc_id, para, text, {restore_spaces(d, 'text')} AS fixed FROM damaged WHERE {lacks_space(d, 'text') if d.name == 'spark' else 'true'}) SELECT doc_id, para, fixed, CAST(length(fixed) - length(text) AS BIGINT) AS n FROM r WHERE {'true' if d.name == 'spark' else 'fixed <> text'}"),
    "stray_grave": (["damaged"], lambda d: (f"r AS (SELECT doc_id, para, text, {d.sub('text', '`(?![\\p{L}])')} AS fixed FROM damaged) " if d.name == "spark" else f"r AS (SELECT doc_id, para, text, {d.sub('text', '`([^\\p{L}]|$)', '@1')} AS fixed FROM damaged) ") + "SELECT doc_id, para, fixed FROM r WHERE fixed <> text"),
    "wrong_script_alpha": (["damaged"], lambda d: "g AS (SELECT doc_id, para, replace(text, 'The', 'Ᾱe') AS text FROM damaged), r AS (SELECT doc_id, para, text, " + (d.sub("text", "Ᾱ(?=[a-z])", "Ā") if d.name == "spark" else d.sub("text", "Ᾱ([a-z])", "Ā@1")) + " AS fixed FROM g) SELECT doc_id, para, fixed FROM r WHERE fixed <> text"),
    "hyphen_residue": (["damaged"], lambda d: f"r AS (SELECT doc_id, para, {d.count('text', '[a-zà-ÿ]- [a-zà-ÿ]')} AS n FROM damaged) SELECT * FROM r WHERE n > 0"),
    "soft_hyphen_strip": (["damaged"], _mend(lambda d: f"replace(text, '{SOFT}', '')", "fixed <> text")),
    "inrun_dehyphenate": (["damaged"], _mend(lambda d: d.sub("text", f"([{LETTER}À-ſ])[-] ([{LOW}à-ÿ])", "@1@2"), "fixed <> text")),
    "space_rule_tally": (["damaged"], lambda d: "t AS (" + " UNION ALL ".join(f"SELECT '{name}' AS rule, {d.count('text', f'{left}{right}{ahead}')} AS n FROM damaged" for name, left, right, ahead in SPACE_RULES) + ") SELECT rule, CAST(sum(n) AS BIGINT) AS n FROM t GROUP BY rule"),
    "folio_lines": (["lines"], lambda d: f"h AS (SELECT doc_id, page, CASE page % 3 WHEN 0 THEN CAST(page AS VARCHAR(20)) WHEN 1 THEN 'xiv' ELSE source || ' ' || CAST(page AS VARCHAR(20)) END AS head FROM lines WHERE idx = 0), r AS (SELECT *, {folio(d, 'head')} AS is_folio FROM h) SELECT doc_id, page, head, is_folio, is_folio AND (length(trim(head)) <= 8) AS plausible FROM r"),
    "furniture_template_lines": (["lines"], lambda d: f"h AS (SELECT doc_id, page, source || ' chapter ' || CAST(page AS VARCHAR(20)) AS head FROM lines WHERE idx = 0) SELECT doc_id, page, {template(d, 'head')} AS template FROM h"),
    "int_to_roman": (["lines"], lambda d: "p AS (SELECT DISTINCT page FROM lines) SELECT page, " + " || ".join(_roman(d, "page")) + " AS roman FROM p WHERE page BETWEEN 1 AND 3999"),
    "roman_to_int": (["lines"], lambda d: "p AS (SELECT DISTINCT page FROM lines WHERE page BETWEEN 1 AND 3999), r AS (SELECT page, lower(" + " || ".join(_roman(d, "page")) + f") AS roman FROM p), c AS (SELECT page, roman, x + 1 AS k FROM (SELECT page, roman, {d.rows(d.upto('length(roman)'))} FROM r)), v AS (SELECT page, roman, k, {_value('substr(roman, k, 1)')} AS a, {_value('substr(roman, k + 1, 1)')} AS b FROM c) SELECT page, roman, CAST(sum(CASE WHEN a < b THEN -a ELSE a END) AS BIGINT) AS value FROM v GROUP BY page, roman"),
    "fold_punct": (["paras"], lambda d: f"r AS (SELECT doc_id, para, trim({d.sub('lower(text)', '[^a-z0-9]+', ' ')}) AS folded FROM paras) SELECT doc_id, para, folded FROM r"),
    "squeeze": (["paras"], lambda d: f"r AS (SELECT doc_id, para, {d.sub('text', r'[-\s]+')} AS squeezed FROM paras) SELECT doc_id, para, squeezed, CAST(length(squeezed) AS BIGINT) AS n FROM r"),
    "numeric_titles": (["paras"], lambda d: f"t AS (SELECT doc_id, para, CASE para % 3 WHEN 0 THEN CAST(para AS VARCHAR(20)) || '.' WHEN 1 THEN CAST(para AS VARCHAR(20)) || '*' ELSE substr(text, 1, 20) END AS title FROM paras) SELECT doc_id, para, title FROM t WHERE {d.has('trim(title)', '^[0-9]+[.]?[*]*$')}"),
    "size_bucket": (["lines"], lambda d: "b AS (SELECT doc_id, size, count(*) AS n FROM lines GROUP BY doc_id, size) SELECT doc_id, CASE WHEN size <= 9.5 THEN 'small' WHEN size >= 12.5 THEN 'display' ELSE 'body' END AS bucket, CAST(sum(n) AS BIGINT) AS n FROM b GROUP BY doc_id, CASE WHEN size <= 9.5 THEN 'small' WHEN size >= 12.5 THEN 'display' ELSE 'body' END"),
    "color_hex": (["lines"], lambda d: ("c AS (SELECT DISTINCT page * 65793 % 16777216 AS color FROM lines) SELECT color, '#' || lower(lpad(" + ("hex(color)" if d.name == "spark" else "printf('%x', color)") + ", 6, '0')) AS hex FROM c")),
    "rtl_cjk_test": (["paras"], lambda d: f"t AS (SELECT doc_id, para, CASE para % 4 WHEN 0 THEN 'שלום ' || substr(text, 1, 10) WHEN 1 THEN '漢字かな ' || substr(text, 1, 10) ELSE substr(text, 1, 10) END AS text FROM paras) SELECT doc_id, para, {d.has('text', '[֐-ࣿ]')} AS rtl, {d.count('text', '[　-鿿]')} AS n_cjk FROM t"),
    "run_html": (["lines"], lambda d: "r AS (SELECT doc_id, line, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS t, italic, size FROM lines) SELECT doc_id, line, CASE WHEN size > 12 THEN '<b>' ELSE '' END || CASE WHEN italic THEN '<i>' || t || '</i>' ELSE t END || CASE WHEN size > 12 THEN '</b>' ELSE '' END AS html FROM r"),
    "inline_markers": (["paras"], lambda d: f"t AS (SELECT doc_id, para, replace(text, 'the ', 'the* ') AS text FROM paras) SELECT doc_id, para, {d.count('text', f'[^ ][*†‡]([^{LETTER}{DIGIT}]|$)')} AS n FROM t WHERE {d.has('text', f'[^ ][*†‡]([^{LETTER}{DIGIT}]|$)')}"),
}
