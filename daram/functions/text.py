"""Column functions for text: blanks, spellings, predicates. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space that Java's \s leaves out, and characters that show nothing.
UNICODE_BLANKS = "\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
INVISIBLE = "\u00ad\u034f\u200b\u200c\u200d\u2060\ufeff"

ASCII_BLANKS = " \t\n\x0b\f\r"
FULL_WIDTH = "".join(chr(0xFF01 + i) for i in range(94))
ASCII_SIGNS = "".join(chr(0x21 + i) for i in range(94))


def is_blank(c: Column) -> Column:
    """Null, empty, only spaces of any kind, or a lone dash. Trims instead of matching a pattern: one pass over the ends."""
    return c.isNull() | F.btrim(c.cast("string"), F.lit(ASCII_BLANKS + UNICODE_BLANKS)).isin("", "-", "—")


def spelling(c: Column) -> Column:
    """One spelling: no white space or invisible characters, full-width signs as ASCII. What translate has no counterpart for is dropped."""
    return F.translate(c, FULL_WIDTH + ASCII_BLANKS + UNICODE_BLANKS + INVISIBLE, ASCII_SIGNS)


def is_valid(c: Column) -> Column:
    """A usable field: neither null, empty nor the dash that stands for missing."""
    return c.isNotNull() & ~c.isin("", "—")


def nullif_blank(c: Column) -> Column:
    return F.when(~is_blank(c), c)
