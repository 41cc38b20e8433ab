"""The normalisation kernel: name keys, word forms, clean text and tokens, as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = "[a-z0-9]+"


def _text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def alnum_key(c: Column | str) -> Column:
    """Lower case, everything but a-z and 0-9 removed; null gives the empty key."""
    return F.regexp_replace(F.lower(_text(c)), "[^a-z0-9]", "")


def tokens(c: Column | str) -> Column:
    """All runs of a-z and 0-9 of the lower-cased text, in order."""
    return F.regexp_extract_all(F.lower(_text(c)), F.lit(WORD), F.lit(0))


def title_tokens(c: Column | str) -> Column:
    """Words made of ASCII letters and digits only; a word that mixes them with other letters or "_" is dropped."""
    words = F.regexp_extract_all(F.lower(_text(c)), F.lit(r"(?U)\w+"), F.lit(0))
    return F.filter(words, lambda w: F.regexp_like(w, F.lit("^[a-z0-9]+$")))


def name_forms(c: Column | str) -> Column:
    """The words of a name joined, forwards and with the order of words reversed."""
    w = tokens(c)
    return F.array_distinct(F.array(F.array_join(w, ""), F.array_join(F.reverse(w), "")))


def clean_text(c: Column | str) -> Column:
    """Lower case, outer white space off, inner white space (of any script) one blank; null gives ""."""
    return F.regexp_replace(F.regexp_replace(F.lower(_text(c)), r"(?U)\s+", " "), "^ | $", "")


def whole_year(c: Column | str) -> Column:
    """A year typed as text; blanks are trimmed, anything that is not a whole number is null."""
    return F.trim(_text(c)).try_cast("int")


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def harmonic(p: Column, r: Column) -> Column:
    return ratio(2 * p * r, p + r)
