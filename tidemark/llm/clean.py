"""Shared cleaning of hand-typed values."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Words and shapes that stand for a missing value.
STAND_INS = (
    "-", "--", "?", "??", ".", "x", "xx", "xxx", "0", "n/a", "na", "n.a.", "none", "null", "nil", "tbc", "tba", "unknown", "not known",
    "not stated", "declined", "no email", "noemail", "no phone", "ex-directory", "unknown@unknown", "none@none.invalid", "x@x", "see file",
    "see notes", "address withheld", "withheld", "moved - no forwarding address", "no fixed abode", "refused", "not given",
)


def usable(value: Column) -> Column:
    """Neither null nor blank nor a stand-in for a missing value; false, not null, otherwise."""
    v = F.lower(F.trim(F.regexp_replace(value.cast("string"), r"\s+", " ")))
    same_digit = F.regexp_replace(v, r"[\s+()/.-]", "").rlike(r"^(0{6,}|9{6,})$")
    return F.coalesce((v != "") & ~v.isin(*STAND_INS) & ~same_digit, F.lit(False))


def date_of(value: Column) -> Column:
    """A date typed year-month-day or day/month/year with any of / . - between; null if no such day exists."""
    v = F.trim(value.cast("string"))
    dmy, ymd = r"^(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{4})$", r"^(\d{4})[/.\-](\d{1,2})[/.\-](\d{1,2})$"
    part = lambda p, i: F.regexp_extract(v, p, i)
    iso = F.when(v.rlike(dmy), F.concat_ws("-", part(dmy, 3), F.lpad(part(dmy, 2), 2, "0"), F.lpad(part(dmy, 1), 2, "0"))).when(
        v.rlike(ymd), F.concat_ws("-", part(ymd, 1), F.lpad(part(ymd, 2), 2, "0"), F.lpad(part(ymd, 3), 2, "0"))
    )
    return F.try_to_date(iso, "yyyy-MM-dd") if hasattr(F, "try_to_date") else F.to_date(F.try_to_timestamp(iso, F.lit("yyyy-MM-dd")))


def digits10(value: Column) -> Column:
    """The last ten digits of a phone number without its extension; null for unusable ones and short ones."""
    d = F.regexp_replace(F.regexp_replace(F.lower(value), r"\s*(ext|x|extension)\.?\s*\d*\s*$", ""), r"[^0-9]", "")
    return F.when(usable(value) & (F.length(d) >= 7), F.right(d, F.lit(10)))
