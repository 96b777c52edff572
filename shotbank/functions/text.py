"""Text Column expressions with Python ``str.split()`` / ``str.strip()`` semantics.

All of them are built-in Spark expressions (JVM side, no Python per row).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 29 code points Python treats as whitespace in split()/strip():
# U+0009-000D, U+001C-0020, U+0085, U+00A0, U+1680, U+2000-200A, U+2028, U+2029,
# U+202F, U+205F, U+3000.
WS_CHARS = "".join(chr(c) for c in [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
                                     *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
# The same set as a Java regex class (Spark). Java's isWhitespace covers all of
# them except the four no-break/next-line ones, which are added; one predicate
# per character is ~3x faster than the explicit list of ranges.
WS_CLASS = r"[\p{javaWhitespace}\x85\xa0\u2007\u202f]"
# The same set as an RE2 class (DuckDB oracle).
WS_CLASS_RE2 = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

_RUNS = f"{WS_CLASS}+"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """``str.strip()``: drop whitespace at both ends (cost grows with the edges only)."""
    return F.btrim(_col(c), F.lit(WS_CHARS))


def collapse(c) -> Column:
    """``' '.join(s.split())``: strip, then every whitespace run becomes one space."""
    return F.regexp_replace(strip(c), _RUNS, " ")


def tokens(c) -> Column:
    """``s.split()`` as an array (no empty tokens)."""
    return F.split(strip(c), _RUNS)


def preview(c, n: int) -> Column:
    """Text cut to ``n`` characters with ``...`` appended when longer."""
    c = _col(c)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def first_line(c) -> Column:
    """Text before the first newline (the whole text without one)."""
    return F.substring_index(_col(c), "\n", 1)


def last_line(c) -> Column:
    """Text after the last newline (the whole text without one)."""
    return F.substring_index(_col(c), "\n", -1)


def after_first_line(c) -> Column:
    c = _col(c)
    nl = F.instr(c, "\n")
    return F.when(nl > 0, c.substr(nl + 1, F.lit(2147483647))).otherwise(F.lit(""))
