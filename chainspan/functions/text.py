"""Text canonicalisation as built-in column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from chainspan import model


def bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` at ``c``, with ``c`` computed once for each row however often ``f`` names it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def trimmed(c: Column) -> Column:
    """Strip Unicode white space at both ends. Most text has none, and looking costs less than trimming."""
    loose = F.left(c, F.lit(1)).isin(*model.WHITESPACE) | F.right(c, F.lit(1)).isin(*model.WHITESPACE)
    return F.when(loose, F.btrim(c, F.lit(model.WHITESPACE))).otherwise(c)


def blank(c: Column) -> Column:
    return c.isNull() | (trimmed(c) == "")


def slug(c: Column) -> Column:
    dashed = F.regexp_replace(F.lower(trimmed(c)), "[^a-z0-9]+", "-")
    return F.btrim(dashed, F.lit("-"))


def truncate_bytes(c: Column, n: int) -> Column:
    """At most ``n`` UTF-8 bytes of ``c``, never ending inside a character.

    Counting the characters that begin within the first ``n`` bytes gives the length, or one too many when the last
    of them does not end there.
    """
    begun = F.char_length(F.substring(c.cast("binary"), 1, n).cast("string"))
    longest = F.left(c, begun)
    cut = F.when(F.octet_length(longest) <= n, longest).otherwise(F.left(c, begun - 1))
    return F.when(F.octet_length(c) <= n, c).otherwise(cut)


# At most 16 hex digits, at most 19 decimal digits, or 20 that are compared with the largest 64-bit number.
_HEX = "^0x(?=[0-9a-f])0*[0-9a-f]{0,16}$"
_DEC = "^(?=[0-9])0*[0-9]{0,19}$"
_DEC_LONG = "^0*1[0-9]{19}$"


def _number(v: Column) -> Column:
    """Lower-cased text: an unsigned 64-bit number becomes ``0x`` + hex, zero becomes NULL, the rest stays."""
    in_range = v.rlike(_DEC) | (v.rlike(_DEC_LONG) & (F.ltrim(v, F.lit("0")) <= "18446744073709551615"))
    return (
        F.when(v.rlike(_HEX), F.nullif(F.regexp_replace(v, "^0x0*", "0x"), F.lit("0x")))
        .when(in_range, F.nullif(F.concat(F.lit("0x"), F.lower(F.conv(v, 10, 16))), F.lit("0x0")))
        .otherwise(v)
    )


def canon_identifier(c: Column) -> Column:
    """Decimal or 0x-hex unsigned 64-bit number -> ``0x`` + lower hex; zero -> NULL; other text kept whole."""
    v = F.lower(trimmed(c))
    return F.when(v != "", _number(v))


def image_basename(c: Column) -> Column:
    """Last path element, lower-cased; a path ending in a separator has none (NULL)."""
    return F.nullif(trimmed(F.substring_index(F.translate(F.lower(c), "\\", "/"), "/", -1)), F.lit(""))


def slot_value(c: Column, kind: str) -> Column:
    """One raw field value as a slot value of any length; NULL when it carries no information."""
    value = {"identifier": _number, "image": image_basename}.get(kind, lambda x: x)
    told = lambda v: F.when((v != "") & ~v.isin(*model.ABSENT_VALUES), value(v))
    return F.when(c.isNotNull(), bound(bound(c, lambda x: F.lower(trimmed(x))), told))


def normalize_tags(c: Column) -> Column:
    """Trim, lower, drop blanks and repeats, sort."""
    low = F.transform(c, lambda t: F.lower(trimmed(t)))
    return F.array_sort(F.array_distinct(F.filter(low, lambda t: t.isNotNull() & (t != ""))))
