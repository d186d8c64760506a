"""Operator 8, private data: regular expressions propose spans, validators confirm them, context words adjust the score.

Kinds: email, phone, ipv4, card (Luhn), iban (mod 97, and the length of its country where that is registered), ssn (areas that exist), secret (cloud access keys and values
assigned to a name such as token or password). Of a proposed span that its validator rejects, as numbers behind a card or
a word behind an IBAN run into it, the longest valid part from its start to the end of a group is taken, to a space if it can be; without one the
search goes on behind its first character. A valid span starts at the kind's score, gains ``near`` if one of the kind's words stands within ``window`` characters, and loses ``far`` for
a word that speaks against it. Spans of at least ``threshold`` count; of overlapping ones a private key (with its body up to
the END line, or as far as its base64 goes), else the higher score, then the longer, then the earlier one stays. Positions are in characters from 0, the end is exclusive.

Cases: null and empty texts have no span; whole texts are searched; repeated rows have the same spans; an empty table has
no rows. In redaction a text without a span is left as it is, and n_chars follows the new text.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import text_buffers

SPAN = "array<struct<kind: string, start: int, stop: int, value: string, score: double>>"


def luhn(s: str) -> bool:
    d = [int(c) for c in s if c.isdecimal()]
    return 13 <= len(d) <= 19 and len(set(d)) > 1 and sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(reversed(d))) % 10 == 0


IBAN_LENGTHS = dict(x.split(":") for x in "AD:24 AE:23 AT:20 BE:16 BG:22 CH:21 CY:28 CZ:24 DE:22 DK:18 EE:20 ES:24 FI:18 FR:27 GB:22 GR:27 HR:21 HU:28 IE:22 IS:26 IT:27 LI:21 LT:20 LU:20 LV:21 MC:27 MT:31 NL:18 NO:15 PL:28 PT:25 RO:24 SA:24 SE:24 SI:19 SK:24 SM:27 TR:26 AL:28 AZ:28 BA:20 BH:22 BI:27 BR:29 BY:28 CR:22 DJ:27 DO:28 EG:29 FK:18 FO:18 GE:22 GI:23 GL:18 GT:28 HN:28 IL:23 IQ:23 JO:30 KW:30 KZ:20 LB:28 LC:32 LY:25 MD:24 ME:22 MK:19 MN:20 MR:27 MU:30 NI:28 OM:23 PK:24 PS:29 QA:29 RS:22 RU:33 SC:31 SD:18 SO:23 ST:25 SV:28 TL:23 TN:24 UA:29 VA:22 VG:24 XK:20 YE:30".split())


def mod97(s: str) -> bool:
    s = re.sub(r"[ -]", "", s).upper()
    return 15 <= len(s) <= 34 and IBAN_LENGTHS.get(s[:2], str(len(s))) == str(len(s)) and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def octets(s: str) -> bool:
    p = s.split(".")
    return all(int(x) < 256 and (x == "0" or x[0] != "0") for x in p) and s not in ("0.0.0.0", "127.0.0.1", "255.255.255.255")


def area(s: str) -> bool:
    a, b, c = s.split("-")
    return a not in ("000", "666") and a[0] != "9" and b != "00" and c != "0000"


def number(s: str) -> bool:
    return 8 <= sum(c.isdecimal() for c in s) <= 15


def _yes(s: str) -> bool:
    return True


def _words(s: str) -> re.Pattern:
    return re.compile(rf"(?<!\w)(?:{s})(?!\w)", re.I)


BODY = r"|(?:\s*\n[A-Za-z][A-Za-z0-9-]*: [^\n]*)*(?:(?:\s|\\[nr])*[A-Za-z0-9+/=]{16,})+(?:\s+[A-Za-z0-9+/=]+(?=\s*(?:\n|\Z)))?"
"""What follows the first line of a private key that has no END line: headers, lines of base64, a short last one."""
RULES = [
    # kind, expression (its last group, if any, is the span), validator, score, words for it, words against it
    ("email", re.compile(r"(?<![\w.+%-])[\w.+%-]{1,64}@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,62})\.)+[A-Za-z]{2,24}(?![\w-])"), _yes, 0.8, _words("e-?mail|mail|contact|kontakt|correo|courriel"), None),
    ("phone", re.compile(r"(?<![\w+.])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?![\w-])"), number, 0.6, _words("tel|phone|call|fax|mobile|cell|telefon|téléphone|teléfono"), None),
    ("phone", re.compile(r"(?<![\w+.(-])(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\w-])"), number, 0.4, _words("tel|phone|call|fax|mobile|cell|telefon|téléphone|teléfono"), _words("order|invoice|isbn|part|model")),
    ("ipv4", re.compile(r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\w)"), octets, 0.5, _words("ip|address|host|server|client|login"), _words("version|release|section|chapter|v")),
    ("card", re.compile(r"(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-])"), luhn, 0.7, _words("card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta"), _words("isbn|order|tracking|serial")),
    ("iban", re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"), mod97, 0.9, _words("iban|bank|account|konto|compte|cuenta"), None),
    ("ssn", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"), area, 0.5, _words("ssn|social security"), _words("order|invoice|part|model")),
    ("secret", re.compile(r"(?<!\w)(?:AKIA|ASIA)[A-Z0-9]{12,16}(?!\w)"), _yes, 0.8, _words("key|secret|aws"), None),
    ("secret", re.compile(r"(?i)(?<![A-Za-z0-9])(?:api_?-?key|access_?-?key|secret|token|passwd|password|pwd|auth)\s{0,4}[=:]\s{0,4}[\"']?([\w+/.~-]{8,})"), lambda s: any(c.isdecimal() for c in s) or len(s) >= 16, 0.7, None, _words("example|placeholder")),
    ("secret", re.compile(r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----(?:[^-]*+(?:-(?!----)[^-]*+)*+-----END [A-Z ]{0,24}PRIVATE KEY-----" + BODY + ")?"), _yes, 0.9, None, None),
]
HINT = np.zeros(256, bool)
"""Bytes of which a rule needs one, but for keys (MARKS): digits, @, =, : and the first bytes of digits that aren't ASCII."""
HINT[[*b"0123456789@=:", *range(0xD9, 0x100)]] = True
MARKS = (b"AKIA", b"ASIA", b"PRIVATE KEY-----")


def _ends(kind: str, text: str, a: int, b: int) -> Iterator[int]:
    """Where a span that is proposed as text[a:b] may end, the longest first; spaces end a group sooner than other signs."""
    yield b
    if kind in ("phone", "card", "iban"):
        for signs in (" ", ".-"):
            yield from (z for z in range(b - 1, a, -1) if text[z] in signs and text[z - 1] not in " .-")


def _valid(kind: str, expression: re.Pattern, valid: Callable[[str], bool], text: str) -> Iterator[tuple[int, int]]:
    at = 0
    while m := expression.search(text, at):
        a, b = m.span(m.lastindex or 0)
        z = next((z for z in _ends(kind, text, a, b) if valid(text[a:z])), None)
        if z:
            yield a, z
        at = z or m.start() + 1


def spans(text: str, threshold: float = 0.5, window: int = 40, near: float = 0.2, far: float = 0.3) -> list[tuple[str, int, int, str, float]]:
    found = []
    for kind, expression, valid, score, good, bad in RULES:
        for a, b in _valid(kind, expression, valid, text):
            around = f"{text[max(0, a - window) : a]} {text[b : b + window]}"
            own = score + near * bool(good and good.search(around)) - far * bool(bad and bad.search(around))
            if own >= threshold:
                found.append((kind, a, b, text[a:b], round(min(1.0, own), 3)))
    kept: list = []  # by start; they don't overlap, so that only the neighbours of a new one can
    for s in sorted(found, key=lambda s: (not s[3].startswith("-----BEGIN"), -s[4], s[1] - s[2], s[1], s[0])):
        i = bisect(kept, s[1], key=lambda k: k[1])
        if (i == 0 or kept[i - 1][2] <= s[1]) and (i == len(kept) or s[2] <= kept[i][1]):
            kept.insert(i, s)
    return kept


def _hinted(column: pa.Array) -> np.ndarray:
    """Rows whose text has a byte of HINT or one of MARKS; every row in which a rule can match is among them."""
    flat, offs, _ = text_buffers(column)
    hit, whole = np.flatnonzero(HINT[flat]), flat.tobytes()
    marks = [m.start() for mark in MARKS for m in re.finditer(mark, whole)]
    return np.unique(np.searchsorted(offs, np.concatenate([hit, np.array(marks, np.int64)]), "right") - 1)


def finder(**params):
    """Column function: text to its spans."""

    @F.arrow_udf(SPAN)
    def pii_spans(text: pa.Array) -> pa.Array:
        out: list = [[]] * len(text)
        rows = _hinted(text)
        for i, t in zip(rows.tolist(), text.take(pa.array(rows)).to_pylist()):
            out[i] = [dict(zip(("kind", "start", "stop", "value", "score"), s)) for s in spans(t, **params)]
        return pa.array(out, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("value", pa.string()), ("score", pa.float64())])))

    return pii_spans.asNondeterministic()


def redactor(**params):
    """Column function: text to its redaction, null where nothing is to be redacted."""

    @F.arrow_udf("string")
    def pii_redact(text: pa.Array) -> pa.Array:
        out: list = [None] * len(text)
        rows = _hinted(text)
        for i, t in zip(rows.tolist(), text.take(pa.array(rows)).to_pylist()):
            if found := spans(t, **params):
                parts, at = [], 0
                for kind, a, b, _, _ in found:
                    parts += [t[at:a], f"[{kind.upper()}]"]
                    at = b
                out[i] = "".join([*parts, t[at:]])
        return pa.array(out, pa.string())

    return pii_redact


def find_pii(docs: DataFrame, **params) -> DataFrame:
    """doc_id, kind, start, stop, value and score of every span in docs."""
    return docs.select("doc_id", F.explode(finder(**params)("text")).alias("s")).select("doc_id", "s.kind", "s.start", "s.stop", "s.value", "s.score")


def redact_pii(docs: DataFrame, **params) -> DataFrame:
    """All rows of docs with its columns, each span replaced by its kind in brackets."""
    rows = docs.select(F.struct("*").alias("row"), redactor(**params)("text").alias("red"))
    new = {"text": F.coalesce("red", "row.text"), "n_chars": F.when(F.col("red").isNull(), F.col("row.n_chars") if "n_chars" in docs.columns else F.lit(None)).otherwise(F.length("red").cast("bigint"))}
    return rows.select(*[(new[c] if c in new else F.col("row").getField(c)).alias(c) for c in docs.columns])
