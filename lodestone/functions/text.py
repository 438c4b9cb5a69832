"""Scalar text functions as column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as both sides of a comparison understand it.
SPACE = r"[ \t\n\r\f\x0B]"


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def is_blank(c: Column) -> Column:
    """Null, empty or nothing but white space."""
    return F.coalesce(F.length(strip(c)) == 0, F.lit(True))


def words(c: Column) -> Column:
    """The words between white space, without empty ones."""
    return F.filter(F.split(c, rf"{SPACE}+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    """How many words; 0 of null and blank texts."""
    return F.coalesce(F.size(words(c)), F.lit(0)).cast("bigint")


def contains_any(c: Column, terms: Sequence[str]) -> Column:
    """Whether one of ``terms`` is part of ``c``, also within a longer word; false of null."""
    return F.coalesce(reduce(lambda a, b: a | b, (c.contains(t) for t in terms)), F.lit(False))


def pdf_date(c: Column) -> Column:
    """DT-02: a date of the form D:YYYYMMDDHHMMSS and more; null where it can't be read."""
    return F.try_to_timestamp(F.substring(F.regexp_replace(c, "^D:", ""), 1, 14), F.lit("yyyyMMddHHmmss"))


def mail_date(c: Column) -> Column:
    """DT-02: the time that a mail's header gives, in any of the usual forms, without its zone; null where it can't be read."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(c, r"^[A-Za-z]{3,9}, ", ""), r"(?:\s+(?:[+-]\d{4}|GMT|UTC|\([A-Z]+\)))+\s*$", ""))
    forms = ("M/d/yyyy H:mm[:ss]", "M/d/yyyy h:mm[:ss] a", "MMMM d, yyyy H:mm[:ss]", "MMMM d, yyyy h:mm[:ss] a", "d MMM yyyy H:mm[:ss]", "yyyy-MM-dd H:mm[:ss]", "yyyy-MM-dd'T'HH:mm[:ss]")
    return F.coalesce(*(F.try_to_timestamp(bare, F.lit(f)) for f in forms))


def percent_share(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole is 0 or null."""
    return F.when(whole > 0, part / whole).otherwise(0.0)
