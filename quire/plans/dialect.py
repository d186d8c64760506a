"""The few spellings in which Spark's SQL and DuckDB's differ, so that one text of a fixture, or of a short operator, serves both."""

from __future__ import annotations

import re

# Java capitalises one letter by several where Unicode does (ß: SS), DuckDB always by one; the last ones have no capital in DuckDB's tables.
WHOLE = [c for c in map(chr, range(0x10000)) if len(c.upper()) > 1]
LATER = "ƛɤ\u1c8a\ua7cd\ua7db" + "".join(map(chr, range(0x10D70, 0x10D86)))
SINGLE = {c: c.title() if len(c.title()) == 1 else c for c in WHOLE} | {"ß": "ẞ"} | {c: c for c in LATER}


class Spark:
    name = "spark"
    keyed = False
    """Whether doc_id is known to be a key, so that a row's lines can be numbered within the row."""

    def lit(self, pattern: str) -> str:
        return "r'" + pattern + "'"

    def sub(self, x: str, pattern: str, to: str = "") -> str:
        return f"regexp_replace({x}, {self.lit(pattern)}, '{re.sub(r'@(\d)', r'$\1', to)}')"

    def count(self, x: str, pattern: str) -> str:
        return f"CAST(regexp_count({x}, {self.lit(pattern)}) AS BIGINT)"

    def has(self, x: str, pattern: str) -> str:
        return f"({x} RLIKE {self.lit(pattern)})"

    def first(self, x: str, pattern: str, group: int = 1) -> str:
        return f"regexp_extract({x}, {self.lit(pattern)}, {group})"

    def every(self, x: str, pattern: str) -> str:
        return f"regexp_extract_all({x}, {self.lit(pattern)}, 0)"

    def joined(self, x: str, sep: str, order: str) -> str:
        return f"listagg({x}, '{sep}') WITHIN GROUP (ORDER BY {order})"

    def rows(self, array: str) -> str:
        return f"posexplode({array}) AS (i, x)"

    def div(self, a: str, b: str) -> str:
        return f"(({a}) DIV ({b}))"

    def rint(self, x: str) -> str:
        return f"CAST(rint({x}) AS BIGINT)"

    def words(self, x: str) -> str:
        return f"split({x}, ' ')"

    def upto(self, n: str) -> str:
        """0 to n - 1, n at least 1."""
        return f"sequence(0, CAST({n} AS INT) - 1)"

    def size(self, array: str) -> str:
        return f"CAST(size({array}) AS BIGINT)"

    def part(self, array: str, start: str, n: int) -> str:
        return f"array_join(slice({array}, CAST({start} AS INT), {n}), ' ')"

    def at(self, array: str, k: str) -> str:
        """The k-th element from 1, null if there is none."""
        return f"try_element_at({array}, CAST({k} AS INT))" if k != "x * 10" else f"try_element_at({array}, greatest(1, CAST({k} AS INT)))"

    def paragraphs(self) -> str:
        return "split(text, '\\n')"

    def hash(self, x: str) -> str:
        return f"md5(CAST({x} AS BINARY))"

    def capital(self, x: str) -> str:
        """Of one letter."""
        these = "".join(SINGLE)
        return f"CASE WHEN instr('{these}', {x}) > 0 THEN translate({x}, '{these}', '{''.join(SINGLE.values())}') ELSE upper({x}) END"


class Keyed(Spark):
    keyed = True


class Duck(Spark):
    name = "duckdb"

    def lit(self, pattern: str) -> str:
        return "'" + pattern + "'"

    def sub(self, x: str, pattern: str, to: str = "") -> str:
        return f"regexp_replace({x}, {self.lit(pattern)}, '{re.sub(r'@(\d)', r'\\\1', to)}', 'g')"

    def count(self, x: str, pattern: str) -> str:
        return f"CAST(len(regexp_extract_all({x}, {self.lit(pattern)})) AS BIGINT)"

    def has(self, x: str, pattern: str) -> str:
        return f"regexp_matches({x}, {self.lit(pattern)})"

    def every(self, x: str, pattern: str) -> str:
        return f"regexp_extract_all({x}, {self.lit(pattern)})"

    def joined(self, x: str, sep: str, order: str) -> str:
        return f"string_agg({x}, '{sep}' ORDER BY {order})"

    def rows(self, array: str) -> str:
        return f"unnest(range(len({array}))) AS i, unnest({array}) AS x"

    def div(self, a: str, b: str) -> str:
        return f"(({a}) // ({b}))"

    def rint(self, x: str) -> str:
        return f"CAST(round_even({x}, 0) AS BIGINT)"

    def words(self, x: str) -> str:
        return f"string_split({x}, ' ')"

    def upto(self, n: str) -> str:
        return f"range(CAST({n} AS BIGINT))"

    def size(self, array: str) -> str:
        return f"CAST(len({array}) AS BIGINT)"

    def part(self, array: str, start: str, n: int) -> str:
        return f"array_to_string({array}[{start} : {start} + {n - 1}], ' ')"

    def at(self, array: str, k: str) -> str:
        return f"{array}[{k}]"

    def paragraphs(self) -> str:
        return "string_split(text, chr(10))"

    def hash(self, x: str) -> str:
        return f"md5({x})"

    def capital(self, x: str) -> str:
        return f"upper({x})"
