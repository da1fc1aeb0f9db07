"""Column helpers for the number, text and date rules of learning data."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value worked out once a row: what stands in a lambda or twice in branches is else worked out at each mention."""
    return F.get(F.transform(F.array(value), lambda x: then(x)), F.lit(0))


def half_up(x: Column) -> Column:
    """Rounds half toward plus infinity, to a long."""
    return F.floor(x + F.lit(0.5))


def places(x: Column, n: int) -> Column:
    """Rounds half up at n decimal places of the binary value."""
    return F.floor(x * F.lit(float(10**n)) + F.lit(0.5)) / F.lit(float(10**n))


def number(text: Column) -> Column:
    """A double from text: empty and null are 0, what is no number is NaN."""
    t = F.trim(F.coalesce(text.cast("string"), F.lit("")))
    return F.when(t == "", F.lit(0.0)).otherwise(F.coalesce(t.try_cast("double"), F.lit(float("nan"))))


def or_zero(x: Column) -> Column:
    """Null and NaN count as 0."""
    return F.coalesce(F.nanvl(x.cast("double"), F.lit(0.0)), F.lit(0.0))


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole, rounded; null where whole is 0."""
    return half_up(F.try_divide(F.lit(100.0) * part, whole))


def cents(money: Column) -> Column:
    """Money as whole hundredths, so that sums do not depend on their order."""
    return F.floor(money * 100 + F.lit(0.5))


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \t\n\f\r]+", " "))


def strip_tags(html: Column, gap: str = " ") -> Column:
    """Text without tags and non-breaking spaces; each run of white space is one space."""
    return squeeze(F.regexp_replace(F.regexp_replace(html, "<[^>]*>", gap), "&nbsp;", " "))


def sentences(text: Column) -> Column:
    """Parts at white space that follows a full stop, a question mark or an exclamation mark."""
    return F.split(text, r"(?<=[.?!])[ \t\n\f\r]+")


def plain_key(text: Column) -> Column:
    """Lower case, all but letters a-z and digits one space."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def _letters() -> tuple[str, str]:
    """Letters below U+2000 that decompose into a plain one and marks, and what is left of them: a table made by rule."""
    pairs = [(c, unicodedata.normalize("NFD", c)) for c in map(chr, range(0xC0, 0x2000))]
    pairs = [(c, d[0]) for c, d in pairs if len(d) > 1 and all(unicodedata.combining(x) for x in d[1:])]
    return "".join(c for c, _ in pairs), "".join(d for _, d in pairs)


_ACCENTED, _BARE = _letters()


def item_key(text: Column) -> Column:
    """plain_key() after accents and other marks are taken off, written as one letter or as marks of their own."""
    return plain_key(F.regexp_replace(F.translate(text, _ACCENTED, _BARE), r"\p{Mn}", ""))


def clock(seconds: Column) -> Column:
    """m:ss"""
    return F.concat(F.floor(seconds / 60).cast("string"), F.lit(":"), F.lpad((seconds % 60).cast("int").cast("string"), 2, "0"))


def marked_time(seconds: Column) -> Column:
    """m:ss, or h:mm:ss from an hour on; below 0 is 0:00, null is null."""
    s = F.greatest(seconds.cast("long"), F.lit(0))
    two = lambda x: F.lpad(x.cast("long").cast("string"), 2, "0")
    h, m = F.floor(s / 3600), F.floor(s % 3600 / 60)
    tail = F.concat(F.lit(":"), two(s % 60))
    return F.when(seconds.isNull(), F.lit(None)).when(h > 0, F.concat(h.cast("string"), F.lit(":"), two(m), tail)).otherwise(F.concat(m.cast("string"), tail))


def clock_long(seconds: Column) -> Column:
    """hh:mm:ss; null counts as 0."""
    s = F.coalesce(seconds.cast("long"), F.lit(0))
    two = lambda x: F.lpad(x.cast("long").cast("string"), 2, "0")
    return F.concat(F.when(s >= 360_000, F.floor(s / 3600).cast("string")).otherwise(two(F.floor(s / 3600))), F.lit(":"), two(F.floor(s % 3600 / 60)), F.lit(":"), two(s % 60))


def mark_seconds(mark: Column) -> Column:
    """Seconds of m:ss or h:mm:ss; null for what is neither."""
    p = F.split(mark, ":")
    n = lambda k: F.get(p, F.lit(k)).try_cast("int")
    return F.when(F.size(p) == 3, n(0) * 3600 + n(1) * 60 + n(2)).when(F.size(p) == 2, n(0) * 60 + n(1))


def money(amount: Column) -> Column:
    """Whole money with dots between thousands and its sign; null counts as 0."""
    return F.concat(F.translate(F.format_number(F.coalesce(amount.cast("long"), F.lit(0)), 0), ",", "."), F.lit("đ"))


def title_case(text: Column) -> Column:
    """The first letter of each word raised, the rest as it is."""
    return F.array_join(F.transform(F.split(text, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1_000_000))), " ")


def coin_amount(text: Column) -> Column:
    """The first number of a text, commas and spaces left out, floored, at least 0."""
    found = F.regexp_extract(F.regexp_replace(F.coalesce(text, F.lit("")), "[, \t\n]", ""), r"-?\d+(?:\.\d+)?", 0)
    return F.greatest(F.lit(0), F.floor(F.coalesce(found.try_cast("double"), F.lit(0.0)))).cast("long")


def local_time(text: Column, offset: str = "+07:00") -> Column:
    """ISO text to a timestamp; a text without Z or + gets the offset, one without seconds gets them; empty is null."""
    full = F.when(F.length(text) == 16, F.concat(text, F.lit(":00"))).otherwise(text)
    return F.when(F.rlike(full, F.lit("[Z+]")), full.try_cast("timestamp")).otherwise(F.concat(full, F.lit(offset)).try_cast("timestamp"))
