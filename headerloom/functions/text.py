"""Text helpers over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Unicode counts as white space.
SPACES = "\t\n\u000b\u000c\r \u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def one_line(c: Column) -> Column:
    """Runs of spaces, tabs and line ends as one space, without any at the ends."""
    # A single space stays as it is: most of a text needs no replacement.
    return F.btrim(F.regexp_replace(c, r"[\t\r\n][ \t\r\n]*+| [ \t\r\n]++", " "), F.lit(SPACES))


def found(c: Column, pattern: str, group: int = 1) -> Column:
    """A regular expression's first match, or null."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))
