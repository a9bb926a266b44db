"""Name folding and number parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_fold(c: Column) -> Column:
    """Lower-case A-Z alone, as a comparison byte by byte does."""
    return F.translate(c, UPPER, LOWER)


def parse_float(c: Column) -> Column:
    """The longest numeric prefix, null if there is none: ``1,234.5`` is 1."""
    return F.regexp_extract(F.trim(c), r"^([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)", 1).try_cast("double")


def parse_int(c: Column) -> Column:
    return F.regexp_extract(F.trim(c), r"^([+-]?[0-9]+)", 1).try_cast("long")


def overlap(a: Column, b: Column) -> Column:
    """Length of the longest suffix of ``a`` that is a prefix of ``b``."""
    n = F.least(F.length(a), F.length(b))
    fits = F.filter(F.sequence(F.lit(0), n), lambda k: F.right(a, k) == F.left(b, k))
    return F.array_max(fits)


def uri_encode(c: Column) -> Column:
    """Percent-encoding of a part of an address: a space is ``%20``, letters, digits and -_.!~*'() stay."""
    out = F.url_encode(c)
    # what the form encoding does otherwise
    for theirs, ours in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(theirs), F.lit(ours))
    return out


def systems_query(names: Column) -> Column:
    """The query string that asks for several systems by name."""
    return F.array_join(F.transform(names, lambda n: F.concat(F.lit("systemName[]="), uri_encode(n))), "&")
