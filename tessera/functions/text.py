"""Text helpers with the white space and word bounds of the web's scripting language."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: characters that trimming removes.
BLANK = r"[\t-\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"


#: The same characters for Python's strip.
BLANKS = "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def trimmed(c: Column) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.btrim(c, F.lit(BLANKS))


def said(c: Column) -> Column:
    """Whether there is anything but white space."""
    return c.rlike("[^" + BLANK[1:])


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is made once, however often ``f`` names it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def trimmed_end(c: Column) -> Column:
    return F.rtrim(c, F.lit(BLANKS))


def header(doc: Column) -> Column:
    """A document's first line, trimmed: its identity."""
    return trimmed(F.substring_index(doc, "\n", 1))


def titled(rel: Column, content: Column) -> Column:
    return F.concat(F.lit("## ["), rel, F.lit("]\n\n"), content)


def split_literal(c: Column, separator: str) -> Column:
    return F.split(c, "\\Q" + separator + "\\E", -1)


def first_by(items: Column, keys: Column) -> Column:
    """``items`` whose key is the first of its kind; both are arrays of one length."""
    return F.filter(items, lambda _, i: F.array_position(keys, F.get(keys, i)) == i + 1)


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast if it has no more than ``rows`` rows, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
